"""Grouped statistics, votes, pivots and reports."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import correlation
from .relational import running


def counts_per_group(df: DataFrame, group: str, distinct: str, names: tuple[str, str]) -> DataFrame:
    """Rows and distinct values per group; a missing group is dropped."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias(names[0]), F.countDistinct(distinct).alias(names[1]))


def percentiles(df: DataFrame, keys: list[str], value: Column | str, shares: list[float], into: str = "_p") -> DataFrame:
    """Per key an array of exact percentiles, interpolated between neighbours; missing values do not count.

    Rows are ranked once, by ranges of (key, value), and picked by rank: no buffer holds a group's values. A group's size is a plain count.
    """
    value = F.col(value) if isinstance(value, str) else value
    some = df.select(*keys, value.alias("_v")).where("_v is not null")
    ranked = running(some, keys, [F.col("_v")])
    size = some.groupBy(*keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    at = [(F.col("_n") - 1) * s for s in shares]
    place = F.col("_rank") - 1
    picked = ranked.join(size, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    picked = picked.where(reduce(lambda a, b: a | b, [(place == F.floor(a)) | (place == F.ceil(a)) for a in at]))

    def between(a: Column) -> Column:
        low, high = (F.max(F.when(place == end, F.col("_v"))) for end in (F.floor(a), F.ceil(a)))
        return low + (high - low) * F.max(a - F.floor(a))

    return picked.groupBy(*keys).agg(F.array(*map(between, at)).alias(into))


def altitude_summary(df: DataFrame, keys: list[str], value: Column, ground: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Mean, coefficient of variation, correlation with the ground, and spread within percentiles (inclusive, population)."""
    rows = df.withColumn("_v", value).withColumn("_g", ground)
    limits = percentiles(rows, keys, "_v", [low, high]).withColumnsRenamed({k: f"_l_{k}" for k in keys})
    inside = F.when(F.col("_v").between(F.col("_p")[0], F.col("_p")[1]), F.col("_v"))
    joined = rows.join(limits, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys], "left")
    return joined.groupBy(*keys).agg(
        F.avg("_v").alias("mean_altitude"),
        (F.stddev_pop("_v") / F.nullif(F.avg("_v"), F.lit(0.0))).alias("cv_altitude"),
        correlation(F.col("_g"), F.col("_v")).alias("terrain_correlation"),
        F.stddev_pop(inside).alias("sd_trimmed"),
    )


def majority(df: DataFrame, key: str, vote: str, yes: str, no: str) -> DataFrame:
    """``yes`` where more votes are 1 than 0; a tie is ``no``."""
    return df.groupBy(key).agg(F.when(F.count_if(F.col(vote) == 1) > F.count_if(F.col(vote) == 0), yes).otherwise(no).alias("status"))


def weighted_pivot(df: DataFrame, rows: DataFrame, key: str, column: str, values: list[str], weight: str | None = None) -> DataFrame:
    """One column per value: counts times the row's weight; keys of ``rows`` without data get zeros."""
    counts = df.groupBy(key).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    times = F.col(weight) if weight else F.lit(1)
    return rows.join(counts, key, "left").select(key, *[(F.coalesce(F.col(v), F.lit(0)) * times).cast("long").alias(v) for v in values])


def split_report(counts: DataFrame, key: str, split: str, weight: str) -> DataFrame:
    """Per key: train and val totals, proportions, and their rounded difference."""
    wide = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(split) == s, F.col(weight))), F.lit(0)).cast("long").alias(s) for s in ("train", "val")])
    totals = wide.agg(F.sum("train").alias("_t"), F.sum("val").alias("_v"))
    joined = wide.crossJoin(F.broadcast(totals))
    p, q = F.col("train") / F.nullif("_t", F.lit(0)), F.col("val") / F.nullif("_v", F.lit(0))
    return joined.select(key, "train", "val", F.round(p, 3).alias("train_prop"), F.round(q, 3).alias("val_prop"), F.round(F.abs(p - q), 3).alias("diff"), (F.col("train") + F.col("val")).alias("total"))


def split_gap(report: DataFrame, key: str) -> DataFrame:
    """One row about a split report: sum of squared differences, greatest difference with its key (ties: the least), mean difference."""
    p, q = F.col("train") / F.nullif("_t", F.lit(0)), F.col("val") / F.nullif("_v", F.lit(0))
    totals = report.agg(F.sum("train").alias("_t"), F.sum("val").alias("_v"))
    worst = F.min(F.struct((-F.col("diff")).alias("d"), F.col(key).alias("k")))
    out = report.crossJoin(F.broadcast(totals)).agg(F.sum((p - q) * (p - q)).alias("balance"), worst.alias("_w"), F.avg("diff").alias("mean_diff"), F.sum("total").cast("long").alias("total"))
    return out.select("balance", (-F.col("_w.d")).alias("max_diff"), F.col("_w.k").alias("max_key"), "mean_diff", "total", F.concat(F.format_number("total", 0), F.lit(" trees")).alias("text"))


def unmatched(df: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """Rows per split after a left join onto the split table; rows without a split are counted too, under NULL."""
    return df.join(splits.select(key, split), key, "left").groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def inconsistent(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def above_group_share(df: DataFrame, key: str, value: str, share: float = 0.5) -> DataFrame:
    """Rows whose value is above a share of their group's greatest (strictly), with that as ``group_max``.

    The greatest values are combined on the map side and joined back, so a hot group is no task of its own.
    """
    most = df.groupBy(F.col(key).alias("_of")).agg(F.max(value).alias("group_max"))
    joined = df.join(most, F.col(key).eqNullSafe(F.col("_of"))).where(F.col(value) > share * F.col("group_max"))
    return joined.select(*df.columns, "group_max")


def bounds(df: DataFrame, keys: list[str], box: tuple[str, str, str, str], least: float = 0.0) -> DataFrame:
    """The box around each group's boxes, if both edges are above ``least``."""
    x0, y0, x1, y1 = box
    out = df.groupBy(*keys).agg(F.min(x0).alias("minx"), F.min(y0).alias("miny"), F.max(x1).alias("maxx"), F.max(y1).alias("maxy"))
    return out.where((F.col("maxx") - F.col("minx") > least) & (F.col("maxy") - F.col("miny") > least))


def vector_sum(df: DataFrame, vector: str, keys: list[str] = ()) -> DataFrame:
    """Element-wise sums as (position, total) rows."""
    return df.select(*keys, F.posexplode(vector).alias("position", "_x")).groupBy(*keys, "position").agg(F.sum(F.col("_x").cast("double")).alias("total"))


def block_average(cells: DataFrame, k: int, row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Means over k by k blocks; empty cells do not count."""
    block = lambda c: F.floor(F.col(c) / k).cast("long").alias(c)
    return cells.groupBy(block(row), block(col)).agg(F.avg(value).alias(value))


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, population spread, extremes and median per group."""
    middle = percentiles(df, keys, value, [0.5], "_m").withColumnsRenamed({k: f"_l_{k}" for k in keys})
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    joined = out.join(middle, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys], "left")
    return joined.select(*out.columns, F.col("_m")[0].alias("median"))


def summary_text(df: DataFrame, key: str, species: str) -> DataFrame:
    """A sentence per group: its rows and distinct values."""
    return df.groupBy(key).agg(F.concat(F.count("*").cast("string"), F.lit(" trees from "), F.countDistinct(species).cast("string"), F.lit(" species")).alias("summary"))
