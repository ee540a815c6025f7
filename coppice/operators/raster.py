"""Rasters as tables of cells (row, col, value); a missing cell or NULL is nodata."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from .graph import components as connected
from .spatial import in_ring


def difference(surface: DataFrame, terrain: DataFrame) -> DataFrame:
    """Surface minus terrain on the surface's grid, negatives as 0; nodata of either side stays nodata."""
    joined = surface.select("row", "col", F.col("value").alias("_s")).join(terrain.select("row", "col", F.col("value").alias("_t")), ["row", "col"], "left")
    delta = F.col("_s") - F.col("_t")
    return joined.select("row", "col", F.when(delta < 0, F.lit(0.0)).otherwise(delta).alias("value"))


def clipped(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def cell_of(x: Column, y: Column, x0: float, y0: float, size: float) -> list[Column]:
    """Row and column of a point in a north-up grid whose upper left corner is (x0, y0)."""
    return [F.floor((F.lit(y0) - y) / size).cast("long").alias("row"), F.floor((x - F.lit(x0)) / size).cast("long").alias("col")]


def sampled(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (with row, col, z) plus ground, whether it is valid, and the height above it."""
    joined = points.join(cells.select("row", "col", F.col("value").alias("ground")), ["row", "col"], "left")
    return joined.withColumn("valid", F.col("ground").isNotNull()).withColumn("above_ground", F.col("z") - F.col("ground"))


def kernel(t: Column) -> Column:
    """The cubic convolution kernel (a = -1/2)."""
    d = F.abs(t)
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(F.lit(0.0))


def refined(cells: DataFrame, k: int) -> DataFrame:
    """Cubic resampling onto a grid k times finer; weights of missing neighbours are shared out."""
    reach = F.explode(F.sequence(F.lit(-2 * k), F.lit(3 * k - 1)))
    spread = cells.where("value is not null").withColumn("_dr", reach)
    spread = spread.withColumn("_dc", F.explode(F.sequence(F.lit(-2 * k), F.lit(3 * k - 1))))
    at = lambda c, d: F.col(c) * k + F.col(d)
    off = lambda d: (F.col(d) + 0.5) / k - 0.5
    weighted = spread.select(at("row", "_dr").alias("row"), at("col", "_dc").alias("col"), (kernel(off("_dr")) * kernel(off("_dc"))).alias("_w"), "value")
    inside = cells.where("value is not null").select(F.explode(F.sequence(F.col("row") * k, F.col("row") * k + k - 1)).alias("row"), "col").select("row", F.explode(F.sequence(F.col("col") * k, F.col("col") * k + k - 1)).alias("col"))
    summed = weighted.where("_w != 0").groupBy("row", "col").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
    return inside.join(summed, ["row", "col"], "left")


def masked(cells: DataFrame, ring: Column, fill: float = 128.0) -> DataFrame:
    """Cells whose centre is outside a ring (of x = col, y = row) take the fill value; ``inside`` says which are not."""
    inside = in_ring(F.col("col") + 0.5, F.col("row") + 0.5, ring)
    return cells.withColumn("inside", inside).withColumn("value", F.when(F.col("inside"), F.col("value")).otherwise(F.lit(fill)))


def scaled_to_byte(value: Column) -> Column:
    """A share from 0 to 1 (others are cut off) as a whole number from 0 to 255; nodata stays."""
    return F.when(value.isNotNull(), F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


def in_tiles(cells: DataFrame, size: int, stride: int) -> DataFrame:
    """Cells with every tile (tile_row, tile_col) that holds them; tile t covers [t*stride, t*stride+size)."""
    tiles = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride) + 1).cast("long"), F.floor(F.col(c) / stride).cast("long"))
    return cells.withColumn("tile_row", F.explode(tiles("row"))).withColumn("tile_col", F.explode(tiles("col")))


def off_edge(tiled: DataFrame, size: int, stride: int) -> DataFrame:
    """Tiled cells at least half the overlap away from their tile's edges."""
    margin = (size - stride) / 2
    inside = lambda c, t: (F.col(c) - F.col(t) * stride >= margin) & (F.col(c) - F.col(t) * stride < size - margin)
    return tiled.where(inside("row", "tile_row") & inside("col", "tile_col"))


_CELL = 1 << 31


def components(mask: DataFrame) -> DataFrame:
    """4-connected parts of equal ids: (row, col, id) plus ``part``, the part's least cell number. Id 0 is background.

    Neighbours become edges between cell numbers (row and col from 0 to 2**31 - 1), whose components
    are found by contraction: the rounds are logarithmic and the edges shrink.
    """
    key = F.col("row") * F.lit(_CELL) + F.col("col")
    cells = written(mask.where("id != 0").select("row", "col", "id", key.alias("_cell")))
    there = cells.select(F.col("_cell").alias("b"), "id")
    sides = F.explode(F.array(F.col("_cell") + 1, F.col("_cell") + F.lit(_CELL))).alias("b")
    edges = cells.select(F.col("_cell").alias("a"), "id", sides).join(there, ["b", "id"]).select("a", "b")
    roots = connected(edges).withColumnsRenamed({"node": "_cell"})
    return cells.join(roots, "_cell", "left").select("row", "col", "id", F.coalesce("root", "_cell").alias("part"))


def outlines(parts: DataFrame) -> DataFrame:
    """(id, part, n_cells, rings): the polygons of ``components``, each as rings of corner points (x = col, y = row), holes included.

    Only the sides between a cell and another part remain for a task, not the cells.
    """
    sides = [(-1, 0, 0, 0, 1, 0), (1, 0, 1, 1, 0, 1), (0, 1, 1, 0, 1, 1), (0, -1, 0, 1, 0, 0)]  # neighbour's row and col; from x, y to x, y, clockwise
    one = [F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), *[(F.col(k) + v).alias(n) for n, k, v in (("x0", "col", x0), ("y0", "row", y0), ("x1", "col", x1), ("y1", "row", y1))]) for r, c, x0, y0, x1, y1 in sides]
    all_ = parts.select("id", "part", F.explode(F.array(*one)).alias("_s")).select("id", "part", "_s.*")
    edge = all_.join(parts.select("row", "col", "id", "part"), ["row", "col", "id", "part"], "left_anti").drop("row", "col")
    point = "array<array<struct<x:bigint,y:bigint>>>"
    rings = edge.groupBy("id", "part").applyInPandas(lambda rows: _rings(rows), f"id {parts.schema['id'].dataType.simpleString()}, part bigint, rings {point}")
    return parts.groupBy("id", "part").agg(F.count("*").alias("n_cells")).join(rings, ["id", "part"])


def _rings(rows: pd.DataFrame) -> pd.DataFrame:
    """Chains directed sides into closed rings; where two begin at one corner, the turn to the right keeps 4-connected rings apart."""
    after: dict[tuple, list[tuple]] = {}
    for a, b in zip(zip(rows["x0"], rows["y0"]), zip(rows["x1"], rows["y1"])):
        after.setdefault(a, []).append(b)
    out = []
    while after:
        start = min(after, key=lambda p: (p[1], p[0]))
        ring, at, step = [], start, None
        while at in after:
            ends = after[at]
            if step is not None and len(ends) > 1:  # a clockwise turn, seen with y downwards
                right = (-step[1], step[0])
                nxt = next((e for e in ends if (e[0] - at[0], e[1] - at[1]) == right), ends[0])
            else:
                nxt = ends[0]
            ends.remove(nxt)
            if not ends:
                del after[at]
            now = (nxt[0] - at[0], nxt[1] - at[1])
            if now != step:
                ring.append({"x": int(at[0]), "y": int(at[1])})
            step, at = now, nxt
        out.append([*ring, ring[0]])
    return pd.DataFrame({"id": [rows["id"].iloc[0]], "part": [rows["part"].iloc[0]], "rings": [out]})
