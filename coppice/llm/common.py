"""Shared pieces: table access, Arrow batches as numpy bytes, stable row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder, written

__all__ = ["chunks", "flat", "guarded", "held_out", "lowered", "mixed", "picked", "powers", "row_id", "row_key", "shared_folder", "small", "table", "word_hashes", "word_spans", "written"]

#: Bytes of text that a Python worker handles at once (bounds its memory).
CHUNK_BYTES = 2 << 20


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: whole texts are large.
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; the session's Arrow batches are bounded for texts on the way."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guarded(df: DataFrame, known: Iterable[str], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change(df)`` with all columns but the ``known`` ones renamed meanwhile, so that no name of the caller's, in
    upper or lower case, can meet one that the operator uses. A column called like one of the result gives way.
    """
    known = set(known)
    names = [c if c in known else f"_x{i}" for i, c in enumerate(df.columns)]
    out = change(df.toDF(*names))
    back = dict(zip(names, df.columns, strict=True))
    made = {c.lower() for c in out.columns if c not in back}
    kept = [c for c in out.columns if c not in back or back[c].lower() not in made]
    return out.select(*[F.col(c).alias(back.get(c, c)) for c in kept])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Some columns by their exact names, whatever others are called like them in other letters."""
    return df.toDF(*[c if c in names else f"_x{i}" for i, c in enumerate(df.columns)]).select(*names)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def row_key(*cols: str) -> Column:
    """A key made of a row's own values: the same for equal rows, whatever task reads them."""
    return F.xxhash64(*[F.col(c) for c in cols])


def row_halves(*cols: str) -> tuple[Column, Column]:
    """Two hashes of a row's values: over the columns in order, and in reverse order under another seed."""
    return row_key(*cols), F.xxhash64(F.lit(7919), *[F.col(c) for c in reversed(cols)])


def row_id(*cols: str) -> Column:
    """A key of 16 bytes made of a row's own values, for what must not be mistaken: of 1e10 rows a pair meets with odds of 1.5e-19."""
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in row_halves(*cols)]))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch holding about ``limit`` bytes of text each; a longer text stands alone."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array laid end to end, and the n+1 offsets (a null is empty)."""
    array = pa.compute.fill_null(array.cast(pa.large_string()), "")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case; other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross texts, and the n+1 offsets of each text's words."""
    inside = is_word[raw]
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[1:-1]
    before[cut[cut < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[(cut > 0) & (cut <= len(raw))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, made of their bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    # position of every byte in its word: words are laid end to end first
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    at = within + np.repeat(starts, lengths)
    weight = powers(0x9E3779B97F4A7C15, int(lengths.max()) + 1)
    terms = mixed(raw[at].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * weight[within]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


#: Rows of a few numbers, elements of an array of longs, and bytes of strings that may be broadcast (tens of megabytes); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_ELEMENTS = 4_000_000
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, array: str | None = None) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its rows, its array's elements and its strings are within the limits."""
    elements = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    strings = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n = df.agg(F.count("*").alias("rows"), elements.cast("long").alias("elements"), sum(strings, F.lit(0)).cast("long").alias("bytes")).first()
    return F.broadcast(df) if n["rows"] <= BROADCAST_ROWS and n["elements"] <= BROADCAST_ELEMENTS and n["bytes"] <= BROADCAST_BYTES else df
