"""Vector code compression: product codes with integer codebooks, exact on any machine.

Every component becomes floor(scale * x). A vector is cut into ``parts`` equal
consecutive pieces; every piece has a codebook of ``entries`` integer centres,
which start as the pieces of the vectors with the least keys. A round assigns
every piece to its nearest centre and moves the centre to the floor of its
pieces' mean. The codebooks (parts * entries * width integers, a bound that no
data can raise) go to the tasks with the round; an Arrow batch gets all distances
of a piece from one matrix product, |x|^2 - 2 x.c + |c|^2, in exact int64, and
takes the first least one. A task adds up what it has seen and sends one row a
component of a centre, so a grouped shuffle of a few thousand rows a task merges
a round; nothing else moves, and equal vectors or labels cannot be hot.

Defined results. Rows whose vector is null or holds a null or non-finite
component are dropped. Others keep their row: those whose length is not that of
the codebooks (the length of the least key's vector, among lengths that are a
positive multiple of ``parts``) have no code and no error (null). Null keys come
last, equal keys go by their vectors, repeated rows count as often as they come.
With fewer vectors than ``entries`` the codebooks are shorter. A centre that
nothing is assigned to stays. Batches whose squares could leave int64 are computed with
Python's integers; an error that does not fit a long is null, and so is the sum over its
label. An empty table gives an empty one. The vectors are read once a round: give
a table, not a long plan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, picked, small, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Sums travel in limbs of so many bits, so that no sum of longs can overflow.
LIMB = 40

Books = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    some = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(some, F.lit(False))


def bounded(most: float, length: int) -> bool:
    """Whether squared distances of ``length`` components of at most this size fit int64."""
    return 4 * length * most * most < 2.0**63


def integers(array: pa.Array, length: int, scale: int) -> np.ndarray:
    """(rows, length) floors of ``scale`` times the components; int64, or Python's integers where their squares could leave it."""
    values = np.asarray(array.flatten()).astype(np.float64).reshape(-1, length)
    if bounded(scale * float(np.abs(values).max(initial=0)) + 1, length):
        return np.floor(values * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**60 else math.floor(v * scale) for v in values.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(-1, length)


def nearest(piece: np.ndarray, book: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first nearest centre of every row, and the squared distance to it."""
    if piece.dtype != object and bounded(float(max(map(abs, book.ravel().tolist()), default=0)), length):
        book = book.astype(np.int64)
    else:
        piece = piece.astype(object)
    score = (book * book).sum(axis=1)[None, :] - 2 * (piece @ book.T)
    entry = np.argmin(score, axis=1)
    return entry, (piece * piece).sum(axis=1) + score[np.arange(len(piece)), entry]


def limbs(value: int) -> list[int]:
    """``value`` in base 2**LIMB; the last limb is small and has the sign."""
    out = []
    while not -(1 << 20) <= value < 1 << 20:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def round_sums(vectors: DataFrame, vector: str, books: Books, scale: int) -> dict[tuple[int, int, int], int]:
    """Sums by (part, entry, component), with the counts at component -1, of one assignment of all vectors."""
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {np.dtype(t): np.zeros((parts, entries, width), t) for t in (np.int64, object)}
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            ints = integers(batch.column(0), parts * width, scale)
            for p, book in enumerate(books):
                piece = ints[:, p * width : (p + 1) * width]
                entry, _ = nearest(piece, book, parts * width)
                count[p] += np.bincount(entry, minlength=entries)
                np.add.at(total[ints.dtype][p], entry, piece)
        rows = []
        for p, e in zip(*(x.tolist() for x in np.nonzero(count)), strict=True):
            rows.append((p, e, -1, 0, int(count[p, e])))
            for c in range(width):
                rows += [(p, e, c, k, x) for k, x in enumerate(limbs(sum(int(t[p, e, c]) for t in total.values())))]
        if rows:  # a task without rows has nothing to add
            kinds = [pa.int32()] * 4 + [pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "total"])

    sent = vectors.select(vector).mapInArrow(run, "part int, entry int, place int, limb int, total long")
    out: dict[tuple[int, int, int], int] = {}
    for r in sent.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect():
        at = (r["part"], r["entry"], r["place"])
        out[at] = out.get(at, 0) + (r["total"] << (LIMB * r["limb"]))
    return out


def moved(books: Books, sums: dict[tuple[int, int, int], int]) -> Books:
    """The centres at the floors of their pieces' means; unused ones stay."""
    out = []
    for p, book in enumerate(books):
        book = book.copy()
        for e in range(len(book)):
            if n := sums.get((p, e, -1)):
                book[e] = [sums[p, e, c] // n for c in range(book.shape[1])]
        out.append(book)
    return out


def trained(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Books:
    """The codebooks, as arrays of Python's integers; none if no vector is usable."""
    all_ = picked(df, key, vector)
    all_ = all_.where(usable(F.col(vector)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    order = [F.col(key).asc_nulls_last(), F.col(vector)]
    head = all_.orderBy(*order).limit(1).collect()
    if not head:
        return []
    length = len(head[0][vector])
    all_ = all_.where(F.size(vector) == length)
    first = all_.orderBy(*order).limit(entries).select(vector).collect()
    ints = integers(pa.array([r[vector] for r in first], pa.list_(pa.float64())), length, scale).astype(object)
    books = np.split(ints, parts, axis=1)
    for _ in range(rounds):
        books = moved(books, round_sums(all_, vector, books, scale))
    return books


def coded(df: DataFrame, books: Books, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector: their columns without ``vector``, plus ``code`` and ``error``; columns of these names give way."""
    return guarded(df, (vector,), lambda d: _coded(d, books, vector, scale))


def _coded(df: DataFrame, books: Books, vector: str, scale: int) -> DataFrame:
    keep = [c for c in df.columns if c != vector]
    df = df.where(usable(F.col(vector))).select(*keep, vector)
    schema = df.select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).schema
    width = books[0].shape[1] if books else 0
    length = len(books) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            array = batch.column(vector)
            sizes = np.asarray(pa.compute.list_value_length(array))
            fits = (sizes == length) & (length > 0)
            code, error = np.full(len(array), "", object), np.full(len(array), -1, object)
            if fits.any():
                ints = integers(array.filter(pa.array(fits)), length, scale)
                found = [nearest(ints[:, p * width : (p + 1) * width], book, length) for p, book in enumerate(books)]
                code[fits] = ["".join(row) for row in digits[np.stack([f[0] for f in found], axis=1)]]
                error[fits] = sum(f[1] for f in found)
            kept = [int(e) if 0 <= e < 1 << 63 else None for e in error]
            made = [pa.array(code.tolist(), pa.string(), mask=~fits), pa.array(kept, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "code", "error"])

    return df.mapInArrow(run, schema)


def digest(books: Books) -> str:
    """SHA-256 of all centres' components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compressed(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", **how: int) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): every usable vector's code under codebooks trained on all of them."""
    df = picked(df, key, vector, label).toDF("_key", "_vector", "_label")
    books = trained(df, "_vector", "_key", **how)
    codes = written(coded(df, books, "_vector", how.get("scale", SCALE)))
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    per = codes.groupBy(F.col("_label").alias("_of")).agg(total.alias("_sum"))
    per = written(per.select("_of", F.expr("try_cast(_sum as bigint)").alias("label_error")))
    out = codes.join(small(per), F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
