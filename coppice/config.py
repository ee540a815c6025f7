"""Parameters with their usual values, as a dataclass that command lines can override."""

import argparse
from dataclasses import dataclass, fields

from .functions.scalars import SWITCH


@dataclass
class Config:
    # fixed values: thresholds and constants of the workflow
    forced_pair: str = "000337,000338"
    plot_buffer: float = 40.0
    crop_buffer: float = 100.0
    clip_buffer: float = 50.0
    perimeter: float = 10.0
    year_window: int = 8
    exempt_project: str = "NEON2023"
    valid_share: float = 0.9
    trim_low: float = 0.05
    trim_high: float = 0.95
    rotation_tolerance: float = 1e-8
    window_a: float = 0.0
    window_b: float = 0.0325
    window_c: float = 0.25
    height_share: float = 0.5
    match_slope: float = 0.1
    match_intercept: float = 1.0
    least_height: float = 10.0
    least_rows: int = 10
    qualities: str = "3,4"
    chip_padding: float = 0.02
    chip_edge: int = 250
    part_share: float = 0.5
    background: int = 128
    val_share: float = 0.2
    split_seed: int = 35
    split_level: str = "l2"
    split_trials: int = 100_000
    warm: int = 100
    interval: int = 50
    sub_batch: int = 250
    resume: bool = True

    @classmethod
    def from_args(cls, args: list[str] | None = None) -> "Config":
        """One flag per field (dashes for underscores); unknown flags are ignored."""
        parser = argparse.ArgumentParser(allow_abbrev=False)
        for f in fields(cls):
            kind = switch if f.type in (bool, "bool") else {"int": int, "float": float}.get(getattr(f.type, "__name__", f.type), str)
            parser.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
        return cls(**vars(parser.parse_known_args(args)[0]))


def switch(word: str) -> bool:
    try:
        return SWITCH[word.strip().lower()]
    except KeyError:
        raise ValueError(f"expected one of {', '.join(SWITCH)}, not {word!r}") from None
