"""Connected components, as the library's other operators find them."""

from ..operators.graph import components

__all__ = ["components"]
