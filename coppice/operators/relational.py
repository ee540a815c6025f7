"""Joins on key sets, suffixes, deduplication, cumulative cuts, chunking, set algebra."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written


def with_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed; rows with a missing key stay."""
    return df.join(keys, on, "left_anti")


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], how: str, suffixes: tuple[str, str]) -> DataFrame:
    """A join in which colliding columns other than the keys get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    for_side = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c in both})
    return for_side(left, suffixes[0]).join(for_side(right, suffixes[1]), on, how)


#: Pairs of an equi-join that one task may form before keys are divided.
PAIRS = 20_000_000


def spread(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], weights: tuple[Column | str, Column | str] | None = None) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Both sides of an inner equi-join and its columns, dealt so that a task forms about PAIRS pairs however many rows a key has.

    Adaptive execution puts partitions together (or takes them apart) by their bytes, but the work of a join with frequent keys is
    its pairs. These are counted first. If there are more than PAIRS, the more frequent side's rows of a crowded key are dealt into
    parts by their hash and the other side's go to each part, under one more column, and the number of partitions follows from the pairs.
    With ``weights`` (a column of each side) a row counts as so many.
    """
    names = [f"_key{i}" for i in range(len(on))]
    rows = lambda side: F.sum(weights[side]) if weights else F.count("*")
    count = lambda df, side, n: df.groupBy(*[F.col(pair[side]).alias(k) for pair, k in zip(on, names, strict=True)]).agg(rows(side).alias(n))
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    load = written(count(left, 0, "_nl").join(count(right, 1, "_nr"), names).withColumn("_parts", F.ceil(pairs / PAIRS).cast("int")))
    total = load.agg(F.sum(pairs)).first()[0] or 0
    if total <= PAIRS:
        return left, right, list(on)
    tasks = int(min(10_000, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PAIRS)))

    def dealt(df: DataFrame, side: int, into: str) -> DataFrame:
        mine = [pair[side] for pair in on]
        own = F.pmod(F.xxhash64(*df.columns), F.col("_parts")).cast("int")
        divided = F.col("_nl") >= F.col("_nr") if side == 0 else F.col("_nl") < F.col("_nr")
        part = F.explode(F.when(divided, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1)))
        known = df.join(load, reduce(lambda p, q: p & q, [F.col(c) == F.col(k) for c, k in zip(mine, names, strict=True)]))
        return known.select(*df.columns, part.alias(into)).repartition(tasks, *mine, into)

    return dealt(left, 0, "_pl"), dealt(right, 1, "_pr"), [*on, ("_pl", "_pr")]


def first_per_key(df: DataFrame, keys: list[str], order: Sequence[Column]) -> DataFrame:
    """Of the rows with equal keys the first in ascending order (give a total order; negate a number to turn it round; nulls come first).

    A least struct, so that map tasks send one row a key and a hot key costs nothing more.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[c if c in keys else F.col("_best")[c].alias(c) for c in df.columns])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """``df`` plus ``_rank`` (from 1, in order, within the keys) and, with a weight, ``_before``: the sum of the weights of earlier rows.

    Rows are dealt by ranges of (keys, order), so that a hot key lies in several partitions; each
    starts where the one before ends. Bounds of range partitions are drawn from a sample, so the
    partitioned rows are written once and all sums come from that table.
    """
    parts = written(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    rows = parts.withColumn("_rank", F.row_number().over(local).cast("long"))
    sums = [F.count("*").alias("_n")]
    if weight:
        rows = rows.withColumn("_before", F.sum(weight).over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
        sums.append(F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = parts.groupBy("_part", *keys).agg(*sums)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    shift = per.select(F.col("_part").alias("_p"), *[F.col(k).alias(n) for k, n in names.items()], *[F.sum(c).over(earlier).alias(c + "0") for c in ("_n", "_s") if c in per.columns])
    # of the keys of a partition only one can have begun in an earlier partition, so this is at most a row a partition
    shift = F.broadcast(shift.where("_n0 > 0"))
    on = F.col("_part") == F.col("_p")
    for k, n in names.items():
        on &= F.col(k).eqNullSafe(F.col(n))
    out = rows.join(shift, on, "left").withColumn("_rank", F.col("_rank") + F.coalesce("_n0", F.lit(0)))
    if weight:
        out = out.withColumn("_before", F.col("_before") + F.coalesce("_s0", F.lit(0)))
    return out.select(*df.columns, "_rank", *["_before"] * bool(weight))


def until_reached(df: DataFrame, keys: list[str], order: Sequence[Column], weight: str, target: Column) -> DataFrame:
    """Rows in order up to the one whose cumulative weight reaches the target; the first row always.

    If the target is never reached, only the first row stays.
    """
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_total")).withColumnsRenamed({k: f"_t_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    out = running(df, keys, order, weight).withColumn("_target", target).join(totals, same)
    return out.where("_rank = 1 or (_total >= _target and _before < _target)").select(*df.columns)


def chunked(df: DataFrame, order: Sequence[Column], batch: int, sub: int, keys: Sequence[str] = ()) -> DataFrame:
    """Batch ids, and sub-batch ids that never cross a batch; both from 0, within ``keys``."""
    n = F.col("_rank") - 1
    out = running(df, keys, order)
    return out.withColumn("batch_id", F.floor(n / batch).cast("long")).withColumn("sub_id", F.floor((n % batch) / sub).cast("long")).drop("_rank")


def enumerated(df: DataFrame, order: Sequence[Column], into: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in order."""
    return running(df, (), order).withColumn(into, F.col("_rank") + F.lit(start - 1)).drop("_rank")


def label_index(df: DataFrame, label: str, into: str) -> DataFrame:
    """Whole numbers from 0 for the distinct labels in ascending order; a missing label has none."""
    names = enumerated(df.where(F.col(label).isNotNull()).select(label).distinct(), [F.col(label)], into, 0)
    return df.join(names, label, "left").select(*df.columns, into)


def top_by_size(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k rows with the greatest absolute values; ties by the second column."""
    return df.orderBy(F.abs(F.col(value)).desc(), F.col(tie)).limit(k)


def remainder(everything: DataFrame, *parts: DataFrame) -> DataFrame:
    """Distinct rows of the first table that no other has."""
    for part in parts:
        everything = everything.subtract(part)
    return everything


def disjoint(a: DataFrame, b: DataFrame, what: str) -> DataFrame:
    """``a``, unless some row is in both: then the query fails."""
    n = a.intersect(b).agg(F.count("*").alias("_n"))
    checked = n.select(F.when(F.col("_n") > 0, F.raise_error(F.lit(f"{what} overlap"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return a.crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")


def not_yet_written(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What an interrupted run has left to do."""
    return without_keys(df, done.select(*on).distinct(), on)
