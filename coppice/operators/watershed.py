"""Crowns by a watershed from markers: every cell goes to the marker it reaches with the least descent."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from .graph import components

_CELL = 1 << 31


def watershed(cells: DataFrame, markers: DataFrame, floor: float | None = None) -> DataFrame:
    """(row, col, value, marker): cells of a surface with the cell number of their marker, or null where none is reached.

    Neighbours (4 of them) are joined by an edge as high as the lower of the two; a path is as high as its lowest edge. Flooding from the
    markers downwards, edge after edge in order of (height descending, cell numbers), gives each cell to the first marker that
    reaches it. That is the greatest spanning forest rooted in the markers, whatever finds it: here, in each round, every part
    without a marker takes its first edge to another part (in the first round a cell's steepest way up, plateaus by cell number),
    and parts so joined are one; parts with a marker only wait. Rounds are logarithmic, edges inside of a part are
    dropped, and the parts are an equi-join, so a plateau or a basin of any size is no task of its own.

    ``markers`` has row and col (others than cells of the surface are ignored, repeated ones are one). Cells whose value is null or not above
    ``floor`` are left out. Rows and columns lie between 0 and 2**31 - 1; a repeated cell counts with its greatest value.
    """
    key = F.col("row") * F.lit(_CELL) + F.col("col")
    some = F.col("value").isNotNull() & (F.lit(True) if floor is None else F.col("value") > floor)
    land = written(cells.where(some).groupBy("row", "col").agg(F.max("value").alias("value")).withColumn("cell", key))
    tops = written(markers.select("row", "col").distinct().join(land.select("row", "col", "cell"), ["row", "col"]).select(F.col("cell").alias("top")))
    there = land.select(F.col("cell").alias("y"), F.col("value").alias("beside"))
    sides = F.explode(F.array(F.col("cell") + 1, F.col("cell") + F.lit(_CELL))).alias("y")
    edges = land.select(F.col("cell").alias("x"), "value", sides).join(there, "y").select(F.least("value", "beside").alias("h"), "x", "y")
    now = written(edges.select(F.col("x").alias("a"), F.col("y").alias("b"), "h", "x", "y"))
    part = land.select("cell", F.col("cell").alias("part"))
    while True:
        both = now.select("a", "b", "h", "x", "y").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "h", "x", "y"))
        free = both.join(tops, both.a == tops.top, "left_anti")
        taken = written(free.groupBy("a").agg(F.min_by("b", F.struct(-F.col("h"), F.col("x"), F.col("y"))).alias("b")))
        if taken.isEmpty():
            break
        joint = components(taken)
        # at most one marker is in a joint part, and names it
        name = joint.join(tops, joint.node == tops.top).select("root", "top")
        to = written(joint.join(name, "root", "left").select("node", F.coalesce("top", "root").alias("to")))
        part = written(part.join(to, part.part == to.node, "left").select("cell", F.coalesce("to", "part").alias("part")))
        moved = now.join(to.toDF("a", "ta"), "a", "left").join(to.toDF("b", "tb"), "b", "left")
        moved = moved.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"), "h", "x", "y").where("a != b")
        # of the edges between two parts only the first can ever be taken
        first = F.min_by(F.struct("h", "x", "y"), F.struct(-F.col("h"), F.col("x"), F.col("y"))).alias("e")
        now = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "h", "x", "y").groupBy("a", "b").agg(first).select("a", "b", "e.*"))
    out = land.join(part, "cell").join(tops, F.col("part") == F.col("top"), "left")
    return out.select("row", "col", "value", F.col("top").alias("marker"))
