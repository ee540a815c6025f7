"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); a root is the least node of its component.

    In each round every node points to the one with the least lot among itself and its neighbours, and
    the edges move to what their ends point to, until none joins two nodes. A node's own edge to what it
    points to moves along, so nothing comes apart. In odd rounds a node's lot is its number, which
    merges stars at once; in even rounds it is a hash that differs from round to round, which merges a
    share of the nodes however they are numbered (in a chain numbered from end to end, the least
    number would merge one). So the expected rounds are logarithmic, and the edges shrink. An empty
    table has no nodes.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots, turn = None, 0
    while True:
        turn += 1
        lot = lambda c: F.struct((F.col(c) if turn % 2 else F.xxhash64(F.col(c), F.lit(turn))).alias("lot"), F.col(c).alias("at"))  # noqa: B023, E731
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), lot("b").alias("beside")), F.struct(F.col("b").alias("node"), lot("a").alias("beside")))).alias("_e")).select("_e.*")
        to = written(both.groupBy("node").agg(F.least(lot("node"), F.min("beside"))["at"].alias("to")))
        if roots is None:
            roots = to.withColumnRenamed("to", "root")
        else:
            step = to.withColumnRenamed("node", "root")
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        moved = now.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        moved = moved.join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        now = written(moved.where(F.col("ta") != F.col("tb")).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if now.isEmpty():
            least = written(roots.groupBy("root").agg(F.min("node").alias("least")))
            return written(roots.join(least, "root").select("node", F.col("least").alias("root")))
