"""Rasters of unlike grids, and dense tiles with a margin.

A raster is a table of cells (row, col, value) on a north-up grid; a grid has the corner of
cell (0, 0) with the least x and y and the cells' size, x growing with the column, y with the row.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import difference, kernel

c = F.col


class Grid(NamedTuple):
    x: float
    y: float
    size: float


def _span(at: Column, reach: tuple[float, float], of: Grid, to: Grid, axis: int) -> Column:
    """The whole numbers of ``to``'s cells (or, where the reach is of centres, their centres) that a cell of ``of`` may reach."""
    low = (F.lit(of[axis]) + (at + reach[0]) * of.size - to[axis]) / to.size
    high = (F.lit(of[axis]) + (at + reach[1]) * of.size - to[axis]) / to.size
    return F.sequence(F.floor(low).cast("long"), F.ceil(high).cast("long"))


def averaged(cells: DataFrame, of: Grid, to: Grid) -> DataFrame:
    """Cells of the grid ``to``: means of what they cover, weighted by the common area. Nodata (null or no row) has no weight.

    Every cell is sent to the few that it overlaps, summed on the map side, so one shuffle moves a row a target cell and task.
    """
    rows = cells.where("value is not null").withColumn("_r", F.explode(_span(c("row"), (0, 1), of, to, 1))).withColumn("_c", F.explode(_span(c("col"), (0, 1), of, to, 0)))

    def common(at: str, target: str, axis: int) -> Column:
        low, start = of[axis] + c(at) * of.size, to[axis] + c(target) * to.size
        return F.least(low + of.size, start + to.size) - F.greatest(low, start)

    rows = rows.select(c("_r").alias("row"), c("_c").alias("col"), common("row", "_r", 1).alias("_h"), common("col", "_c", 0).alias("_w"), "value")
    w = c("_h") * c("_w")
    rows = rows.where((c("_h") > 1e-12 * to.size) & (c("_w") > 1e-12 * to.size))
    return rows.groupBy("row", "col").agg((F.sum(w * c("value")) / F.sum(w)).alias("value"))


def cubic(cells: DataFrame, of: Grid, to: Grid) -> DataFrame:
    """Cells of the grid ``to`` by cubic convolution at their centres; weights of missing neighbours are shared out.

    A target cell is nodata (no row) where the cell that holds its centre is.
    """
    seen = cells.where("value is not null")
    spread = seen.withColumn("_r", F.explode(_span(c("row"), (-2, 3), of, to, 1))).withColumn("_c", F.explode(_span(c("col"), (-2, 3), of, to, 0)))

    def off(at: str, target: str, axis: int) -> Column:
        """How far a target's centre lies from a cell's, in cells."""
        return (to[axis] + (c(target) + 0.5) * to.size - of[axis]) / of.size - 0.5 - c(at)

    dy, dx = off("row", "_r", 1), off("col", "_c", 0)
    # floor(centre) names the cell that holds it
    home = ((dy >= -0.5) & (dy < 0.5) & (dx >= -0.5) & (dx < 0.5)).cast("int")
    rows = spread.select(c("_r").alias("row"), c("_c").alias("col"), (kernel(dy) * kernel(dx)).alias("_w"), home.alias("_home"), "value").where("_w != 0")
    sums = rows.groupBy("row", "col").agg((F.sum(c("_w") * c("value")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("value"), F.max("_home").alias("_home"))
    return sums.where("_home = 1").select("row", "col", "value")


def aligned(cells: DataFrame, of: Grid, to: Grid) -> DataFrame:
    """Onto another grid: by means where that is coarser, else by cubic convolution; unchanged where it is the same."""
    if of == to:
        return cells.select("row", "col", "value")
    return averaged(cells, of, to) if of.size < to.size else cubic(cells, of, to)


def height_model(surface: DataFrame, surface_grid: Grid, terrain: DataFrame, terrain_grid: Grid, resolution: float | None = None) -> tuple[DataFrame, Grid]:
    """Surface minus terrain, negatives as 0, and its grid: the surface's, or that of another resolution with the same corner."""
    to = surface_grid if resolution is None else surface_grid._replace(size=resolution)
    return difference(aligned(surface, surface_grid, to), aligned(terrain, terrain_grid, to)), to


Tile = Callable[[np.ndarray, int, int], tuple[np.ndarray, ...]]


def by_tile(cells: DataFrame, size: int, margin: int, work: Tile, made: str) -> DataFrame:
    """``work`` on dense tiles: (tile with its margin, row, col of its core's first cell) to columns ``made``.

    Tile t's core is [t * size, (t + 1) * size); cells near a border are sent to its neighbours too, so that what looks no farther
    than the margin sees at a border what it sees anywhere. A task holds one tile of (size + 2 * margin)**2 numbers at a time; nodata is NaN. Tiles
    without cells in their core have no row. A repeated cell counts once.
    """
    tiles = lambda at: F.sequence(F.floor((c(at) - margin) / size).cast("long"), F.floor((c(at) + margin) / size).cast("long"))
    rows = cells.select("row", "col", c("value").cast("double").alias("value"), F.explode(tiles("row")).alias("tr")).withColumn("tc", F.explode(tiles("col")))
    side = size + 2 * margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, core = None, None, False

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and core:
                columns = work(tile, now[0] * size, now[1] * size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[m.split()[0] for m in made.split(", ")])

        for batch in batches:
            tr, tc, row, col, value = (np.asarray(batch.column(x)) for x in ("tr", "tc", "row", "col", "value"))
            cut = [0, *(np.flatnonzero((tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])) + 1).tolist(), len(tr)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if (int(tr[a]), int(tc[a])) != now:
                    yield from done()
                    now, tile, core = (int(tr[a]), int(tc[a])), np.full((side, side), np.nan), False
                r, q = row[a:b] - now[0] * size, col[a:b] - now[1] * size
                tile[r + margin, q + margin] = value[a:b]
                core = core or bool(((r >= 0) & (r < size) & (q >= 0) & (q < size)).any())
        yield from done()

    return rows.repartition("tr", "tc").sortWithinPartitions("tr", "tc", "row", "col").mapInArrow(run, made)


def focal_maximum(cells: DataFrame, radius: int, size: int = 256) -> DataFrame:
    """(row, col, value, most): cells with the greatest value no farther than ``radius`` cells away (a disc); nodata is passed over."""
    reach = range(-radius, radius + 1)
    disc = [(dr, dc) for dr in reach for dc in reach if dr * dr + dc * dc <= radius * radius]

    def work(tile: np.ndarray, row0: int, col0: int) -> tuple[np.ndarray, ...]:
        core = tile[radius : radius + size, radius : radius + size]
        most = np.full(core.shape, -np.inf)
        for dr, dc in disc:
            np.fmax(most, tile[radius + dr : radius + dr + size, radius + dc : radius + dc + size], out=most)
        r, q = np.nonzero(~np.isnan(core))
        return r + row0, q + col0, core[r, q], most[r, q]

    return by_tile(cells, size, radius, work, "row long, col long, value double, most double")


def local_peaks(cells: DataFrame, radius: int, size: int = 256) -> DataFrame:
    """Cells as high as anything within ``radius``; of equal ones the one with the least (row, col) among them."""
    reach = range(-radius, radius + 1)
    before = [(dr, dc) for dr in reach for dc in reach if 0 < dr * dr + dc * dc <= radius * radius and (dr, dc) < (0, 0)]

    def work(tile: np.ndarray, row0: int, col0: int) -> tuple[np.ndarray, ...]:
        core = tile[radius : radius + size, radius : radius + size]
        top = ~np.isnan(core)
        for dr in reach:
            for dc in reach:
                if 0 < dr * dr + dc * dc <= radius * radius:
                    beside = tile[radius + dr : radius + dr + size, radius + dc : radius + dc + size]
                    with np.errstate(invalid="ignore"):
                        top &= ~((beside >= core) if (dr, dc) in before else (beside > core))
        r, q = np.nonzero(top)
        return r + row0, q + col0, core[r, q]

    return by_tile(cells, size, radius, work, "row long, col long, value double")


def chips(cells: DataFrame, boxes: DataFrame, fill: int = 128) -> DataFrame:
    """(chip, rows, cols, pixels) of ``boxes`` (chip, row0, col0, row1, col1, ends not included): bytes row by row, cells without a value as ``fill``.

    ``value`` is a byte (0 to 255). Boxes without a chip's name, rows or columns have none; names are expected once. A chip is sent what lies in it and nothing else; it is the one thing that a task holds.
    """
    step = 64
    cover = lambda a, b: F.sequence(F.floor(c(a) / step).cast("long"), F.floor((c(b) - 1) / step).cast("long"))
    some = boxes.where("chip is not null and row1 > row0 and col1 > col0")
    wide = some.withColumn("_tr", F.explode(cover("row0", "row1"))).withColumn("_tc", F.explode(cover("col0", "col1")))
    tiled = cells.where("value is not null").select("row", "col", c("value").cast("int").alias("value"), F.floor(c("row") / step).cast("long").alias("_tr"), F.floor(c("col") / step).cast("long").alias("_tc"))
    inside = wide.join(tiled, ["_tr", "_tc"]).where("row >= row0 and row < row1 and col >= col0 and col < col1")
    at = ((c("row") - c("row0")) * (c("col1") - c("col0")) + c("col") - c("col0")).alias("at")
    rows = inside.select("chip", "row0", "col0", "row1", "col1", at, "value")
    rows = rows.unionByName(some.select("chip", "row0", "col0", "row1", "col1"), allowMissingColumns=True)
    kind = boxes.schema["chip"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pixels, shape = None, None, (0, 0)
        names = ["chip", "rows", "cols", "pixels"]

        def done() -> pa.RecordBatch:
            columns = [pa.array([now]), pa.array([shape[0]], pa.int64()), pa.array([shape[1]], pa.int64()), pa.array([pixels.tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for chip, r0, c0, r1, c1, place, value in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if chip != now:
                    if now is not None:
                        yield done()
                    now, shape = chip, (r1 - r0, c1 - c0)
                    pixels = np.full(shape[0] * shape[1], fill, np.uint8)
                if place is not None:
                    pixels[place] = value
        if now is not None:
            yield done()

    return rows.repartition("chip").sortWithinPartitions("chip").mapInArrow(run, f"chip {kind}, rows long, cols long, pixels binary")
