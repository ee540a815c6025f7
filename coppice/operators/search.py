"""Balanced splits, orthogonal matching pursuit, selection schedules and parameter grids."""

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import written


def shuffled_trials(items: DataFrame, key: str, weight: str, trials: int, share: float, seed: int) -> DataFrame:
    """(trial, key) of every trial's validation part: items in an order drawn from md5 until the weight reaches the share.

    What is broadcast are the trials' numbers, a parameter; the items are streamed past them. The
    first digits of the draw deal a trial's items into 4,096 ranges. Their sums say which ranges come
    before the cut, and only within a range items are sorted, so no task holds a whole trial.
    """
    spark = items.sparkSession
    total = items.agg(F.floor(F.sum(weight) * share).cast("long").alias("_target"))
    numbers = spark.range(trials).select(F.col("id").alias("trial"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col(key).cast("string")))
    every = items.select(key, weight).crossJoin(F.broadcast(numbers)).withColumn("_draw", draw).withColumn("_range", F.substring("_draw", 1, 3))
    w = Window.partitionBy("trial").orderBy("_range")
    ranges = every.groupBy("trial", "_range").agg(F.sum(weight).alias("_sum"))
    ranges = ranges.withColumn("_base", F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).withColumn("_nth", F.row_number().over(w))
    ranges = ranges.crossJoin(F.broadcast(total)).where("_base < _target or _nth = 1").drop("_sum")
    w = Window.partitionBy("trial", "_range").orderBy("_draw", key)
    before = F.col("_base") + F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    rows = every.join(ranges, ["trial", "_range"]).withColumn("_before", before).withColumn("_rn", F.row_number().over(w))
    return rows.where("_before < _target or (_nth = 1 and _rn = 1)").select("trial", key)


def balanced_split(items: DataFrame, counts: DataFrame, key: str, weight: str, label: str, n: str, trials: int = 200, share: float = 0.2, seed: int = 35) -> DataFrame:
    """Trials scored by the squared difference of label proportions between the parts; scores are rounded to nine digits, so that ties are ties.

    ``counts``: key, label, n. Only validation sums are formed per trial; the other part's follow from the totals.
    """
    val = written(shuffled_trials(items, key, weight, trials, share, seed))
    totals = counts.groupBy(label).agg(F.sum(n).alias("_all"))
    sums = val.join(counts, key).groupBy("trial", label).agg(F.sum(n).alias("_v"))
    trial = val.select("trial").distinct()  # at most ``trials`` rows
    full = totals.crossJoin(F.broadcast(trial)).join(sums, ["trial", label], "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    both = full.groupBy("trial").agg(F.sum("_v").alias("_v_all"), F.sum(F.col("_all") - F.col("_v")).alias("_t_all"))
    full = full.join(F.broadcast(both), "trial")
    gap = F.col("_v") / F.nullif("_v_all", F.lit(0)) - (F.col("_all") - F.col("_v")) / F.nullif("_t_all", F.lit(0))
    return full.groupBy("trial").agg(F.round(F.sum(gap * gap), 9).alias("score"), F.sum("_v").cast("long").alias("n_val")).where("score is not null")


def best_trial(scores: DataFrame) -> DataFrame:
    """The trial with the least (rounded) score, of equal ones the first."""
    return scores.orderBy("score", "trial").limit(1)


def budget(ratio: float, parts: int) -> int:
    """How many of so many parts a selection may take: the whole part of their share."""
    return int(ratio * parts)


def pursuit(columns: DataFrame, budget: int, key: str = "id", vector: str = "vector", tolerance: float = 1e-4, ridge: float = 1.0) -> DataFrame:
    """Orthogonal matching pursuit towards the sum of all vectors: (key, weight, rank) of ``budget`` columns.

    Each round is one distributed dot product and arg-max; the driver holds only the chosen vectors
    (at most ``budget``). The first weight is not regularised. If the pursuit stops early, columns with
    weight 0 fill up by key. An empty table selects nothing.
    """
    spark = columns.sparkSession
    kind = columns.schema[key].dataType
    columns = written(columns.select(key, vector))  # read once for every pick
    size = columns.select(F.size(vector).alias("n")).limit(1).collect()
    chosen, weights, vectors = [], np.zeros(0), []
    if size and budget > 0:
        total = columns.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("s"))
        b = np.zeros(size[0]["n"])
        for r in total.toLocalIterator():
            b[r["i"]] = r["s"]
        rest = b.copy()
        while len(chosen) < budget and np.linalg.norm(rest) > tolerance * np.linalg.norm(b):
            residual = F.lit(rest.tolist())
            dot = F.aggregate(F.zip_with(vector, residual, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda p, q: p + q)
            best = columns.select(F.col(key).alias("_k"), F.abs(dot).alias("_d"), F.col(vector).alias("_v")).orderBy(F.desc("_d"), "_k").limit(1).collect()[0]
            if best["_k"] in chosen:
                break
            chosen.append(best["_k"])
            vectors.append(np.array(best["_v"], float))
            a = np.stack(vectors)
            weights = a @ b / max(float(a[0] @ a[0]), 1e-30) if len(chosen) == 1 else np.linalg.solve(a @ a.T + ridge * np.eye(len(chosen)), a @ b)
            rest = b - weights @ a
    got = spark.createDataFrame([(k, float(w)) for k, w in zip(chosen, weights, strict=True)], f"{key} {kind.simpleString()}, weight double")
    others = columns.select(key).join(F.broadcast(got), key, "left_anti").select(key, F.lit(0.0).alias("weight")).orderBy(key).limit(max(0, budget - len(chosen)))
    ranked = got.unionByName(others)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("weight").desc(), key)).cast("long"))


def schedule(runs: DataFrame, epochs: str, warm: int, interval: int) -> DataFrame:
    """``runs`` with a row for each ``epoch`` (from 0) at which a new selection is made; runs no longer than the warm-up have none."""
    n = F.col(epochs).cast("long")
    return runs.where(n > warm).withColumn("epoch", F.explode(F.sequence(F.lit(warm).cast("long"), n - 1, F.lit(interval).cast("long"))))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few parameter values."""
    return spark.createDataFrame([tuple(x) for x in product(*values.values())], list(values))


def budgeted(sizes: DataFrame, grid: DataFrame, n: str, ratio: str = "ratio") -> DataFrame:
    """Every row of ``sizes`` with every combination of a parameter grid and the ``budget`` that it leaves of its ``n`` parts."""
    return sizes.crossJoin(F.broadcast(grid)).withColumn("budget", F.floor(F.col(ratio) * F.col(n)).cast("long"))


#: Numbers (items times labels) that a split search sends to its tasks, 4 bytes each; beyond it trials are scored by joins.
SEARCHED = 32_000_000

_SHIFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINE = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_heads(head: bytes, tails: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 8 bytes, as big-endian numbers, of the md5 of ``head`` followed by each tail: rows of bytes, the first ``sizes`` of which count.

    All rows at once, as a call a row would take most of a search's time. Messages have one block: at most 55 bytes.
    """
    rows, width = tails.shape
    block = np.zeros((rows, 64), np.uint8)
    block[:, : len(head)] = np.frombuffer(head, np.uint8)
    block[:, len(head) : len(head) + width] = tails
    ends = sizes + len(head)
    block[np.arange(rows), ends] = 0x80
    block[:, 56], block[:, 57] = (ends * 8) & 255, (ends * 8) >> 8
    used = (len(head) + width) // 4 + 1
    words = block.view("<u4").T
    words = [np.ascontiguousarray(words[j]) if j < used or j == 14 else None for j in range(16)]
    a, b, c, d = (np.full(rows, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINE[i]
        if words[g] is not None:
            f += words[g]
        s = _SHIFT[i // 16][i % 4]
        turned = f << np.uint32(s)
        turned |= f >> np.uint32(32 - s)
        turned += b
        a, d, c, b = d, c, b, turned
    a, b = a + _START[0], b + _START[1]
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def _first(draw: np.ndarray, weights: np.ndarray, target: int, head: bytes, keys: list[bytes]) -> np.ndarray:
    """The places of the items in the order of their draws until the weight reaches the target, one at least."""
    if not len(draw):
        return np.zeros(0, int)
    # a cut a little beyond the expected one leaves few to be sorted
    part = target / max(1.0, weights.sum()) + 8 / np.sqrt(len(draw))
    some = np.flatnonzero(draw <= np.uint64(min(part, 0.999) * 2.0**64)) if part < 0.9 else np.arange(len(draw))
    if len(some) == 0 or weights[some].sum() < target:
        some = np.arange(len(draw))
    order = some[np.argsort(draw[some], kind="stable")]
    if (np.diff(draw[order].view(np.int64)) == 0).any():  # equal halves of a draw: the rest decides
        order = np.array(sorted(order.tolist(), key=lambda i: (md5(head + keys[i], usedforsecurity=False).digest(), i)), int)
    before = np.cumsum(weights[order]) - weights[order]
    return order[(before < target) | (np.arange(len(order)) == 0)]


def best_of_many(items: DataFrame, counts: DataFrame, key: str, weight: str, label: str, n: str, trials: int = 100_000, share: float = 0.2, seed: int = 35) -> DataFrame:
    """(trial, score, n_val): the best of very many trials, the same that ``best_trial(balanced_split(...))`` finds.

    The items' counts by label go to the tasks as one matrix (if it has at most SEARCHED numbers), trials are dealt out. A
    trial's draws are made for all items at once, its validation sums are those of the items before the cut; a task sends its best trial, so no row of
    a trial and an item is ever made or shuffled. Keys are expected once; items without counts weigh all the same.
    """
    spark = items.sparkSession
    size = items.agg(F.count("*").alias("n")).crossJoin(counts.agg(F.countDistinct(label).alias("m"))).first()
    if size["n"] * max(1, size["m"]) > SEARCHED:
        return best_trial(balanced_split(items, counts, key, weight, label, n, trials, share, seed))
    plots = items.select(F.col(key).cast("string").alias("k"), F.col(weight).cast("double").alias("w")).where("k is not null").orderBy("k").toPandas()
    names = [r["l"] for r in counts.select(F.col(label).alias("l")).distinct().orderBy("l").collect()]
    # one row an item, its counts in the labels' order
    per = [F.coalesce(F.sum(F.when(F.col(label).eqNullSafe(F.lit(x)), F.col(n))), F.lit(0)).cast("double") for x in names] or [F.lit(0.0)]
    table = counts.groupBy(F.col(key).cast("string").alias("k")).agg(F.array(*per).alias("n"))
    total = np.array(table.agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(per))]).alias("n")).first()["n"] or [0.0] * len(per), float)
    at = {k: i for i, k in enumerate(plots["k"])}
    matrix = np.zeros((len(plots), len(per)), np.float32)
    for r in table.join(items.select(F.col(key).cast("string").alias("k")).distinct(), "k").toLocalIterator(prefetchPartitions=True):
        matrix[at[r["k"]]] = r["n"]
    if matrix.size and matrix.max() >= 2**24:  # beyond, these numbers are not exact
        return best_trial(balanced_split(items, counts, key, weight, label, n, trials, share, seed))
    held = spark.sparkContext.broadcast((plots["k"].tolist(), plots["w"].to_numpy(), matrix, total, int(np.floor(plots["w"].sum() * share))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, matrix, total, target = held.value
        keys = [f":{k}".encode() for k in keys]
        sizes = np.array([len(k) for k in keys], int)
        width = int(sizes.max(initial=0))
        plain = len(f"{seed}:{trials}") + width <= 55
        tails = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), np.uint8).reshape(-1, width) if keys and plain else None
        best = None
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for i in range(0, len(numbers), 256):
                block = numbers[i : i + 256]
                val = np.zeros((len(block), matrix.shape[1]))
                for row, trial in zip(val, block, strict=True):
                    head = f"{seed}:{trial}".encode()
                    if plain:
                        draw = np.concatenate([md5_heads(head, tails[j : j + 16384], sizes[j : j + 16384]) for j in range(0, len(keys), 16384)] or [np.zeros(0, np.uint64)])
                    else:
                        draw = np.frombuffer(b"".join([md5(head + k, usedforsecurity=False).digest() for k in keys]), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
                    order = _first(draw, weights, target, head, keys)
                    row[:] = matrix[order].sum(axis=0, dtype=np.float64)
                train = total - val
                sums, rest = val.sum(axis=1), train.sum(axis=1)
                fit = np.flatnonzero((sums > 0) & (rest > 0))
                gap = val[fit] / sums[fit, None] - train[fit] / rest[fit, None]
                score = np.round((gap * gap).sum(axis=1), 9)
                found = [(float(s), block[j], int(sums[j])) for s, j in zip(score, fit.tolist(), strict=True)]
                best = min(found + ([best] if best else []), default=best)
        if best:
            columns = [pa.array([best[1]], pa.int64()), pa.array([best[0]]), pa.array([best[2]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["trial", "score", "n_val"])

    pieces = max(8, min(4096, trials // 2000))
    tried = spark.range(0, trials, 1, pieces).mapInArrow(run, "trial long, score double, n_val long")
    return best_trial(tried)
