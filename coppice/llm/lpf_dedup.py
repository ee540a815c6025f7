"""Exact removal of repeated byte strings with longest-previous-factor arrays.

A string of ``length`` bytes counts as repeated if it starts anywhere else too.
Each such window has a minimizer, the leftmost least hash among its k-grams, and
equal windows have equal minimizers at equal offsets. So the windows of a text
fall into contexts, one per minimizer occurrence, and only contexts with the
same minimizer hash can share a window.

1. Minimizer hashes that occur once in the corpus are dropped.
2. Contexts that are equal as a whole are counted (map-side first): all windows
   of a context that occurs twice are repeated.
3. Minimizers with several distinct contexts send one copy of each context to a
   suffix array. In suffix order, the previous and next smaller text positions
   give the longest previous factor, the previous and next larger ones the
   longest following factor; a window is repeated where one of them reaches
   ``length``.
4. Where a minimizer has more than ``CONTEXTS`` distinct contexts, the windows of
   each are dealt into two halves, those with more of the window before the
   minimizer and those with more after it. All windows of a half share a longer
   gram, which becomes its key; then steps 1 to 3 apply to the halves, and so on
   until no key has too many contexts. After at most eight divisions (for 200
   bytes) the key is the whole window, and its contexts are all equal.

Only hashes and positions of repeated minimizers, contexts of steps 3 and 4 and
spans are shuffled; texts are, unless what is joined to them may be broadcast.
Rows are told apart by 128 bits, other hashes have 64. Grams' hashes only bring contexts together; contexts count
as equal by a second hash, so two of m distinct contexts of one minimizer are
taken for copies with a chance of about m * m / 2**65 (1e-8 for a million).

Null and empty texts, and texts shorter than ``length``, lose nothing. Very long
texts are worked through in pieces that overlap by ``length`` - 1 bytes. Repeated
rows are copies like any others. Extra columns are kept, whatever their names;
one that is called like a column of the result gives way. An empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, guarded, mixed, powers, row_id, small, written

LENGTH = 200
GRAM = 48
CHUNK = 1 << 20
#: Distinct contexts of one key that go into one suffix array; more are divided under longer keys.
CONTEXTS = 2048
#: Copies of a context from which it may count as hot, and hot contexts that there can be at most.
HOT_COPIES, MOST_HOT = 1024, 100_000
#: Bytes of contexts that go into one suffix array (more only for a single minimizer).
ARRAY_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15


class RangeHashes:
    """64-bit hashes of any ranges of some bytes, equal for equal bytes."""

    def __init__(self, raw: np.ndarray, base: int = BASE):
        values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(base >> 7))[raw]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * powers(base, len(raw))[: len(raw)], out=self.sums[1:])
        self.down = powers(pow(base, -1, 1 << 64), len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def minimizers(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every minimizer: text, position, first and last window's distance before it, hash, context's hash. Positions are absolute."""
    sizes = np.diff(offsets)
    width = length - gram + 1
    n = len(raw) - gram + 1
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < width or not (sizes >= length).any():
        return none
    hashes = RangeHashes(raw)
    at = np.arange(n)
    grams = hashes.of(at, at + gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(raw) + 1, np.int64)  # windows that end inside their text
    some = np.flatnonzero(sizes >= length)
    valid[offsets[some]] += 1
    valid[offsets[some + 1] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(valid)[:count] > 0)
    point = least[start]
    change = np.concatenate([[True], point[1:] != point[:-1]])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    p, a, b = point[first], start[first], start[last]
    return np.searchsorted(offsets, p, side="right") - 1, p, p - a, p - b, grams[p], hashes.of(a, b + length)


def suffix_order(seq: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes ordered by their first ``depth`` (at least) symbols, ties by position; and ranks by prefixes of 1, 2, 4, ... symbols."""
    n = len(seq)
    rank = seq.astype(np.int64)
    levels, k = [(1, rank.astype(np.int32))], 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        if k < n:
            after[: n - k] = rank[k:] + 1
        key = rank * (max(n, 257) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        k *= 2
        levels.append((k, rank.astype(np.int32)))
    return order, levels


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to twice the deepest level less one."""
    n = len(levels[0][1])
    out = np.zeros(len(a), np.int64)
    for k, rank in reversed(levels):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        # near the end a rank stands for fewer symbols; what it stands for is still equal
        out[ok] = np.minimum(out[ok] + k, n - np.maximum(a[ok], b[ok]))
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1; by descent through minima of 2**k neighbours."""
    n = len(values)
    tables, span = [values], 1
    while span < n:  # tables[k][i]: minimum of the 2**k values that end at i
        t = tables[-1].copy()
        t[span:] = np.minimum(t[span:], tables[-1][:-span])
        tables.append(t)
        span *= 2
    at = np.arange(n) - 1
    for k in range(len(tables) - 1, -1, -1):
        inside = at >= 0
        skip = np.zeros(n, bool)
        skip[inside] = tables[k][at[inside]] > values[inside]
        at = np.where(skip, at - (1 << k), at)
    return np.maximum(at, -1)


def factors(seq: np.ndarray, depth: int, least: int = 0, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest following factor at each position, cut at ``depth`` or somewhat more.

    With ``least`` only positions whose neighbour in suffix order shares that many symbols are worked
    out (others stay 0: they cannot reach it); with ``inside`` only marked positions take part.
    """
    n = len(seq)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return before, after
    order, levels = suffix_order(seq, depth)
    if inside is not None:
        order = order[inside[order]]
    if least and len(order) > 1:
        near = common_prefix(order[:-1], order[1:], levels) >= least
        order = order[np.concatenate([near, [False]]) | np.concatenate([[False], near])]
    if len(order) < 2:
        return before, after
    for values, out in ((order, before), (-order, after)):
        left = previous_smaller(values)
        right = len(order) - 1 - previous_smaller(values[::-1])[::-1]
        for there in (left, right):
            ok = (there >= 0) & (there < len(order))
            here = order[ok]
            out[here] = np.maximum(out[here], common_prefix(here, order[there[ok]], levels))
    return before, after


def contexts(docs: DataFrame, length: int, gram: int, text: str = "text") -> DataFrame:
    """(_row, pos, lo, hi, h, c) of each minimizer; its windows start from pos - lo to pos - hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, CHUNK):
                raw, offsets = flat(part.column(text))
                for begin in range(0, len(raw), CHUNK):  # a piece holds the windows that start in it
                    piece = raw[begin : begin + CHUNK + length - 1]
                    doc, p, lo, hi, h, c = minimizers(piece, np.clip(offsets - begin, 0, len(piece)), length, gram)
                    rows = pa.compute.take(part.column("_row"), pa.array(doc))
                    yield pa.RecordBatch.from_arrays([rows, pa.array((p + begin - offsets[doc]).astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))], names=["_row", "pos", "lo", "hi", "h", "c"])

    return docs.select("_row", text).mapInArrow(run, "_row binary, pos int, lo short, hi short, h long, c long")


def packed(pos: Column, lo: Column, hi: Column, several: Column) -> Column:
    """A context's place and a flag in one long, as ``unpacked`` reads it: lists of them stay small."""
    out = pos.cast("long")
    for part, bits in ((lo, 14), (hi, 14), (several, 1)):
        out = F.shiftleft(out, bits).bitwiseOR(part.cast("long"))
    return out


def unpacked(x: int) -> tuple[int, int, int, int]:
    return x >> 29, x >> 15 & 0x3FFF, x >> 1 & 0x3FFF, x & 1


#: A context with its bytes: its windows start from pos - lo to pos - hi and all hold the gram from pos - left on, with ``right`` more bytes; n > 1 if they are known to be repeated.
PART = "_row binary, pos int, lo short, hi short, left short, right short, n long, h long, bytes binary"


def cut_out(docs: DataFrame, wanted: DataFrame, length: int, gram: int, text: str = "text") -> DataFrame:
    """The wanted contexts with their bytes and minimizers' hashes: ``wanted`` has _row and an array of packed places."""
    places = wanted.select("_row", packed(F.col("pos"), F.col("lo"), F.col("hi"), F.col("n") > 1).alias("item")).groupBy("_row").agg(F.collect_list("item").alias("items"))

    def emit(out: list[tuple]) -> pa.RecordBatch:
        row, pos, lo, hi, n, data = zip(*out, strict=True)
        data = pa.array(data, pa.binary())
        raw, offsets = flat_binary(data)
        at = offsets[:-1] + np.array(lo, np.int64)
        h = RangeHashes(raw).of(at, at + gram).view(np.int64)
        none = pa.array(np.zeros(len(out), np.int16))
        small_ = [pa.array(x, pa.int16()) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array(row, pa.binary()), pa.array(pos, pa.int32()), *small_, none, none, pa.array(n, pa.int64()), pa.array(h), data], names=["_row", "pos", "lo", "hi", "left", "right", "n", "h", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for row, t, items in zip(batch.column("_row").to_pylist(), batch.column(text), batch.column("items"), strict=True):
                raw = t.as_buffer()
                for pos, lo, hi, several in map(unpacked, items.as_py()):
                    data = raw.slice(pos - lo, lo - hi + length).to_pybytes()
                    out.append((row, pos, lo, hi, 1 + several, data))
                    held += len(data)
                    if held >= CHUNK:
                        yield emit(out)
                        out, held = [], 0
        if out:
            yield emit(out)

    cut = docs.select("_row", text).join(small(written(places), "items"), "_row").mapInArrow(run, PART)
    return cut.dropDuplicates(["_row", "pos", "lo"])  # equal rows share a key, and one of them is enough here


def divided(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """The windows of each context in two halves, each under the hash of the longer gram that all its windows hold; ``c`` is the half's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = flat_binary(batch.column("bytes"))
            pos, lo, hi, left, right = (np.asarray(batch.column(x)).astype(np.int64) for x in ("pos", "lo", "hi", "left", "right"))
            hashes, at = RangeHashes(raw), offsets[:-1] + lo
            slack = length - gram - left - right
            half = (slack + 1) // 2
            before = (lo, np.maximum(hi, left + half), left + half, right)
            after = (np.minimum(lo, left + half - 1), hi, left, right + slack - half + 1)
            for a, b, more, rest in (before, after):
                ok = np.flatnonzero((a >= b) & (slack > 0))
                a, b, more, rest, here = a[ok], b[ok], more[ok], rest[ok], at[ok]
                key = mixed(hashes.of(here - more, here + gram + rest) + more.astype(np.uint64) * np.uint64(BASE))
                own = hashes.of(here - a, here - b + length)
                data = pa.array([raw[x:y].tobytes() for x, y in zip((here - a).tolist(), (here - b + length).tolist(), strict=True)], pa.binary())
                kept = [pa.compute.take(batch.column(x), pa.array(ok)) for x in ("_row", "pos", "n")]
                yield pa.RecordBatch.from_arrays([kept[0], kept[1], *(pa.array(x.astype(np.int16)) for x in (a, b, more, rest)), kept[2], pa.array(key.view(np.int64)), data, pa.array(own.view(np.int64))], names=["_row", "pos", "lo", "hi", "left", "right", "n", "h", "bytes", "c"])

    return parts.mapInArrow(run, PART + ", c long")


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def by_factors(parts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(_row, start, end): the covered bytes that the suffix arrays of contexts find."""

    def solved(rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)  # text order: by row and position
        raw = [np.frombuffer(r[5], np.uint8).astype(np.int64) + 1 for r in rows]
        seq = np.concatenate([x for r in raw for x in (r, np.zeros(1, np.int64))])
        inside = np.concatenate([np.arange(len(r) + 1) <= len(r) - length for r in raw])
        before, after = factors(seq, length, length, inside)
        hit = (before >= length) | (False if keep_first else after >= length)
        out, at = [], 0
        for (row, pos, lo, _, n, data), r in zip(rows, raw, strict=True):
            if keep_first or n == 1:
                begin = pos - lo
                out += [(row, begin + a, begin + b - 1 + length) for a, b in ranges(hit[at : at + len(r)])]
            at += len(r) + 1
        return out

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out := solved(rows) if len(rows) > 1 else []:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["_row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row, pos, lo, h, n, data in zip(*(batch.column(c).to_pylist() for c in ("_row", "pos", "lo", "h", "n", "bytes")), strict=True):
                if size >= ARRAY_BYTES and h != last:
                    yield from emit(held)
                    held, size = [], 0
                held.append((row, pos, lo, h, n, data))
                size, last = size + len(data), h
        yield from emit(held)

    return parts.select("_row", "pos", "lo", "h", "n", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(run, "_row binary, start int, end int")


def flat_binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, text: str = "text") -> DataFrame:
    """(_row, spans): the byte ranges to remove, merged and in order, each as start * 2**32 + end, of each row key that has some. ``docs`` has _row and the text.

    With ``keep_first`` the first of equal windows, by row key and position, stays; rows that are equal
    in id and text share a key, so they stay or go together.
    """
    found = contexts(docs, length, gram, text)
    # as written tables, so that a join's sides are dealt for the join alone and a hot key can be split
    twice = written(found.groupBy("h").count().where("count > 1").select("h"))
    found = written(found.join(twice, "h", "left_semi").withColumn("n", F.lit(1).cast("long")))
    out, several = sorted_out(found, ["pos", "lo", "hi", "n"], length, keep_first)
    out = out.unionByName(by_factors(cut_out(docs, several.where(F.col("many") <= CONTEXTS), length, gram, text), length, keep_first))
    crowded = several.where(F.col("many") > CONTEXTS)
    if not crowded.isEmpty():
        parts = cut_out(docs, crowded, length, gram, text)
        while True:
            halves = written(divided(parts, length, gram))
            twice = written(halves.groupBy("h").count().where("count > 1").select("h"))
            halves = halves.join(small(twice), "h", "left_semi")
            copies, several = sorted_out(halves, ["pos", "lo", "hi", "left", "right", "n", "bytes"], length, keep_first)
            out = out.unionByName(copies).unionByName(by_factors(several.where(F.col("many") <= CONTEXTS), length, keep_first))
            parts = several.where(F.col("many") > CONTEXTS)
            if parts.isEmpty():
                break
    return merged(out.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def sorted_out(found: DataFrame, columns: list[str], length: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Spans (_row, start, end) of contexts that are equal as a whole; and one of each of the contexts whose key has several, with their number ``many``."""
    rep = F.min(F.struct("_row", *columns)).alias("rep")
    kinds = written(found.groupBy("h", "c").agg(F.count("*").alias("times"), rep))
    whole = kinds.where("times > 1").select("h", "c", "times", F.col("rep._row").alias("_first"), F.col("rep.pos").alias("_at"), F.col("rep.lo").alias("_lo"))
    members = found.select("h", "c", "_row", "pos", "lo", "hi", "n")
    # contexts with very many copies are broadcast (there cannot be more than MOST_HOT of them), the others joined by key
    total = kinds.agg(F.sum("times").alias("n")).first()["n"] or 0
    often = F.col("times") > max(HOT_COPIES, total // MOST_HOT)
    hot = F.broadcast(whole.where(often))
    copies = members.join(hot, ["h", "c"]).unionByName(members.join(hot, ["h", "c"], "left_anti").join(whole.where(~often), ["h", "c"]))
    if keep_first:
        copies = copies.where((F.col("_row") != F.col("_first")) | (F.col("pos") != F.col("_at")) | (F.col("lo") != F.col("_lo")))
    else:
        copies = copies.where("n = 1")
    copies = copies.select("_row", (F.col("pos") - F.col("lo")).cast("int").alias("start"), (F.col("pos") - F.col("hi") + length).cast("int").alias("end"))
    crowd = kinds.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    kept = [F.col(f"rep.{x}").alias(x) for x in columns if x != "n"]
    several = kinds.join(written(crowd), "h").select("h", "many", "rep._row", *kept, F.when(F.col("times") > 1, 2).otherwise(F.col("rep.n")).cast("long").alias("n"))
    return copies, written(several)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def merged(rows: DataFrame) -> DataFrame:
    """Overlapping and touching spans of each row joined, and packed into longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column("spans").to_pylist():
                joint: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in items):
                    if joint and a <= joint[-1][1]:
                        joint[-1][1] = max(joint[-1][1], b)
                    else:
                        joint.append([a, b])
                out.append([a << 32 | b for a, b in joint])
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.list_(pa.int64()))], names=["_row", "spans"])

    return rows.mapInArrow(run, "_row binary, spans array<long>")


def removed(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without ``text`` plus ``n_bytes``, ``spans`` (merged byte ranges), ``n_removed`` and ``kept_sha256``."""
    return guarded(docs, (text, key), lambda d: _removed(d, length, keep_first, text, key))


def _removed(docs: DataFrame, length: int, keep_first: bool, text: str, key: str) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    rows = docs.withColumn("_row", row_id(key, text))
    found = written(spans(rows.select("_row", text), length, keep_first=keep_first, text=text))
    joined = rows.select(*keep, "_row", text).join(small(found, "spans"), "_row", "left").drop("_row")
    span = "array<struct<start:int,end:int>>"
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast(span).alias("spans"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans_, gone, sums = [], [], [], []
            for t, longs in zip(batch.column(text), batch.column("spans").to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                items = [{"start": x >> 32, "end": x & 0xFFFFFFFF} for x in longs or ()]
                rest, at = hashlib.sha256(), 0
                for x in items:
                    rest.update(raw[at : x["start"]])
                    at = x["end"]
                rest.update(raw[at:])
                sizes.append(len(raw))
                spans_.append(items)
                gone.append(sum(x["end"] - x["start"] for x in items))
                sums.append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans_, SPANS), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=[*keep, "n_bytes", "spans", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, schema)
