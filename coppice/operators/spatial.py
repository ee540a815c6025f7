"""Axis-aligned boxes and points: algebra, grid-bucketed joins, polygon measures.

A box is four columns; a join takes their names. Pairs are found by covering
boxes with grid cells and joining on the cell, so no pair of far boxes is ever
formed; a pair is kept in the one cell that holds its intersection's lower
corner. A crowded cell is an ordinary hot key of an equi-join, which adaptive
execution splits; where the counts of a join say that many pairs are tested, crowded cells are divided
beforehand (``relational.spread``), as adaptive execution sees bytes and not pairs. Where boxes repeat,
equal ones are tested as one (``repeated_box_join``), and their pairs are spelled out afterwards.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import spread

BOX = ("minx", "miny", "maxx", "maxy")


def buffered(box: tuple[Column, ...], d: Column | float) -> list[Column]:
    d = F.lit(d) if isinstance(d, (int, float)) else d
    return [(box[0] - d).alias(BOX[0]), (box[1] - d).alias(BOX[1]), (box[2] + d).alias(BOX[2]), (box[3] + d).alias(BOX[3])]


def intersection(*boxes: tuple[Column, ...]) -> list[Column]:
    """The common box (touching boxes give an edge or a point); NULLs where there is none."""
    low = [F.greatest(*[b[i] for b in boxes]) for i in (0, 1)]
    high = [F.least(*[b[i] for b in boxes]) for i in (2, 3)]
    some = (low[0] <= high[0]) & (low[1] <= high[1])
    return [F.when(some, c).alias(n) for c, n in zip([*low, *high], BOX, strict=True)]


def overlaps(a: list[Column], b: list[Column]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def contains(outer: list[Column], inner: list[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def ordered(a: Column, b: Column) -> Column:
    """The sequence from a to b."""
    return F.sequence(a, F.greatest(a, b))


def in_cells(df: DataFrame, box: tuple[str, ...], cell: float, names: tuple[str, str]) -> DataFrame:
    """``df`` with every grid cell that a box covers."""
    index = [F.floor(F.col(c) / cell).cast("long") for c in box]
    return df.withColumn(names[0], F.explode(ordered(index[0], index[2]))).withColumn(names[1], F.explode(ordered(index[1], index[3])))


def box_join(left: DataFrame, right: DataFrame, left_box: tuple[str, ...], right_box: tuple[str, ...], cell: float, on: list[tuple[str, str]] = (), condition: Column | None = None, weights: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of overlapping (or touching) boxes with equal ``on`` columns; column names must not collide. ``weights`` are those of ``spread``."""
    a, b = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    home = (F.col("_xl") == F.floor(F.greatest(a[0], b[0]) / cell)) & (F.col("_yl") == F.floor(F.greatest(a[1], b[1]) / cell))
    test = [overlaps(a, b), home] + ([condition] if condition is not None else [])
    lefts, rights, keys = spread(in_cells(left, left_box, cell, ("_xl", "_yl")), in_cells(right, right_box, cell, ("_xr", "_yr")), [*on, ("_xl", "_xr"), ("_yl", "_yr")], weights)
    same = [F.col(x) == F.col(y) for x, y in keys]
    return lefts.join(rights, reduce(lambda p, q: p & q, [*same, *test])).select(*left.columns, *right.columns)


#: Ids of equal boxes that one row holds, about.
TOGETHER = 256


def alike(df: DataFrame, key: str, box: tuple[str, ...], into: str) -> DataFrame:
    """(box, ``into``_ids, ``into``_n): the keys of equal boxes (or of rows equal in other columns), in several rows where there are many; boxes with a null have none."""
    counts = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in box]).agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    known = df.join(counts, [F.col(c) == F.col(f"_of_{c}") for c in box])
    return known.groupBy(*box, F.pmod(F.xxhash64(key), F.col("_parts")).alias("_part")).agg(F.collect_list(key).alias(f"{into}_ids"), F.count("*").alias(f"{into}_n")).drop("_part")


def repeated_box_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], left_box: tuple[str, ...], right_box: tuple[str, ...], cell: float, made: list[Column]) -> DataFrame:
    """(keys, made) of all pairs of overlapping (or touching) boxes, ``made`` being columns of the two boxes (not of keys; a null key pairs with nothing).

    Equal boxes meet others once and ``made`` is computed once for them, so a pair of rows costs no more than being listed.
    """
    near = box_join(alike(left, keys[0], left_box, "_l"), alike(right, keys[1], right_box, "_r"), left_box, right_box, cell, weights=("_l_n", "_r_n"))
    once = near.select("_l_ids", "_r_ids", *made)
    names = once.columns[2:]
    return once.select(F.explode("_l_ids").alias(keys[0]), "_r_ids", *names).select(keys[0], F.explode("_r_ids").alias(keys[1]), *names)


def shifted(x: Column, y: Column, dx: Column, dy: Column) -> list[Column]:
    return [x + dx, y + dy]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def padded_box(box: tuple[Column, ...], share: float, width: Column, height: Column) -> list[Column]:
    """Whole-pixel bounds with padding on every side, clamped to the image."""
    px, py = (box[2] - box[0]) * share, (box[3] - box[1]) * share
    low = lambda c: F.greatest(F.floor(c), F.lit(0)).cast("long")
    high = lambda c, most: F.least(F.ceil(c), most).cast("long")
    return [low(box[0] - px).alias("px0"), low(box[1] - py).alias("py0"), high(box[2] + px, width).alias("px1"), high(box[3] + py, height).alias("py1")]


def ring_area(ring: Column) -> Column:
    """Area of a closed or open ring of (x, y) structs, by the shoelace formula."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n) + 1)
    step = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.abs(F.aggregate(step, F.lit(0.0), lambda a, b: a + b)) / 2


def signed_area(ring: Column) -> Column:
    """Area of a closed ring of (x, y) structs, negative if it turns counter-clockwise (y downwards)."""
    at = lambda i: F.element_at(ring, i)
    step = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: (at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]).cast("double"))
    return F.aggregate(step, F.lit(0.0), lambda a, b: a + b) / 2


def perimeter(ring: Column) -> Column:
    """Length of a closed ring of (x, y) structs."""
    at = lambda i: F.element_at(ring, i)
    step = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: distance(at(i)["x"], at(i)["y"], at(i + 1)["x"], at(i + 1)["y"]))
    return F.aggregate(step, F.lit(0.0), lambda a, b: a + b)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring, by counting crossings."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n) + 1)

    def crosses(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1
