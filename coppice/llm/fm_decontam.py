"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a slice of a partition, about two megabytes of whole documents. Its
words become integers of the benchmark's vocabulary. Maximal runs of vocabulary
words that are too short for any test phrase cannot match and collapse into
separators; this loses nothing. Over what is left an FM-index is built: suffix
array, Burrows-Wheeler transform, wavelet tree for ranks, and suffix positions
sampled by text position. All test phrases are searched backwards at once;
occurrences are located by walking to sampled positions, and overlapping or
touching occurrences merge into removal spans.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A
test phrase is a window of ``n`` consecutive words of an item; an item of fewer
words, but not none, is one phrase. Words are compared by hash first and byte by
byte before they enter the index.

The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text (a longer
item is a block of its own). With several blocks a task gathers ``GROUP_BYTES`` of
documents, loads one block after the other, searches all of them with it and
lets it go. All blocks judge the same text; cleaning cuts the union of what they
found and searches what is left with all blocks again, until nothing is found.

Null and empty texts have no words. Very long texts are shards of their own.
Rows are independent, so repeated rows and empty tables need nothing special.
Extra columns are kept, whatever their names; one that is called like a column
of the result gives way. A null item id counts as the empty string. An empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, guarded, lowered, picked, word_hashes, word_spans

#: Text of the benchmark that one index of phrases holds, and text of documents that a task holds where there are several.
BLOCK_BYTES, GROUP_BYTES = 4 << 20, 32 << 20
SAMPLING = 8
SENTINEL, SEPARATOR, FIRST = 0, 1, 2


def word_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x80:] = True
    return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class WaveletTree:
    """Ranks over a sequence of small integers: one bit vector per level, nodes laid end to end."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(sigma - 1).bit_length())
        now = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            zeros = len(now) - int(ones[-1])
            self.levels.append((ones, zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        lo, hi = np.zeros_like(i), i
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones, zeros in self.levels:
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int):
        """``seq`` ends with the only SENTINEL."""
        order = suffix_array(seq)
        self.size = len(seq)
        self.tree = WaveletTree(seq[order - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        kept = order % SAMPLING == 0
        self.sampled = kept
        self.slot = np.cumsum(kept) - 1
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with each pattern; patterns are right-aligned rows."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for step in range(width):
            alive = alive[(hi[alive] > lo[alive]) & (lengths[alive] > step)]
            if not len(alive):
                break
            symbol = patterns[alive, width - 1 - step].astype(np.int64)
            lo[alive] = self.before[symbol] + self.tree.rank(symbol, lo[alive])
            hi[alive] = self.before[symbol] + self.tree.rank(symbol, hi[alive])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their place in order."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            here = self.sampled[at[left]]
            done = left[here]
            out[done] = self.positions[self.slot[at[done]]] + steps[done]
            left = left[~here]
            symbol = self.tree.access(at[left])
            at[left] = self.before[symbol] + self.tree.rank(symbol, at[left])
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its vocabulary by hash, distinct phrases, and the items of each phrase; arrays only, as it is broadcast."""

    hashes: np.ndarray  # sorted
    words: np.ndarray  # the vocabulary's bytes, end to end, in the order of hashes
    offsets: np.ndarray
    patterns: np.ndarray  # right-aligned, symbols from FIRST on
    lengths: np.ndarray
    names: list[str]  # item ids
    items: np.ndarray  # places in ``names``, phrase by phrase
    first: np.ndarray  # where a phrase's items begin, and the end of all

    def arrays(self) -> tuple:
        return tuple(self.__dict__.values())

    def item_of(self, phrase: int) -> list[str]:
        return [self.names[i] for i in self.items[self.first[phrase] : self.first[phrase + 1]].tolist()]


def phrases(items: list[tuple[str, str]], n: int = 10) -> Phrases:
    raw, offsets = flat(pa.array([t or "" for _, t in items], pa.string()))
    raw = lowered(raw)
    starts, ends, per = word_spans(raw, offsets, word_table())
    words = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    vocabulary = sorted(set(words))
    sizes = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    ends_ = sizes(vocabulary)
    hashes = word_hashes(np.frombuffer(b"".join(vocabulary), np.uint8), ends_[:-1], ends_[1:]) if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    vocabulary = [vocabulary[i] for i in order]
    symbol = {w: FIRST + i for i, w in enumerate(vocabulary)}
    names = sorted({item for item, _ in items})
    place = {x: i for i, x in enumerate(names)}
    by: dict[tuple, dict[int, None]] = {}
    for k, (item, _) in enumerate(items):
        line = [symbol[w] for w in words[per[k] : per[k + 1]]]
        for at in range(max(1, len(line) - n + 1) if line else 0):
            by.setdefault(tuple(line[at : at + n]), {})[place[item]] = None
    patterns = np.zeros((len(by), n), np.int32)
    for i, p in enumerate(by):
        patterns[i, n - len(p) :] = p
    flat_items = np.array([x for v in by.values() for x in v], np.int32)
    return Phrases(hashes[order], np.frombuffer(b"".join(vocabulary), np.uint8), sizes(vocabulary), patterns, np.array([len(p) for p in by], np.int64), names, flat_items, sizes(by.values()))


def symbols(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Phrases) -> np.ndarray:
    """Each word's symbol, or 0 for a word outside the vocabulary."""
    h = word_hashes(raw, starts, ends)
    at = np.minimum(np.searchsorted(p.hashes, h), len(p.hashes) - 1)
    return np.where(p.hashes[at] == h, at + FIRST, 0)


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbol: np.ndarray, p: Phrases) -> np.ndarray:
    """Whether each word is, byte by byte, the vocabulary's word."""
    first, sizes = p.offsets[symbol - FIRST], ends - starts
    ok = (p.offsets[symbol - FIRST + 1] - first) == sizes
    starts, first, sizes = starts[ok], first[ok], sizes[ok]
    begin = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    equal = raw[np.repeat(starts, sizes) + within] == p.words[np.repeat(first, sizes) + within]
    if len(begin):
        ok[ok] = np.logical_and.reduceat(equal, begin)
    return ok


def occurrences(symbol: np.ndarray, per: np.ndarray, exact, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, phrase) of every occurrence in a shard; ``exact(words)`` says which symbols are true."""
    least = int(p.lengths.min())
    inside = symbol > 0
    breaks = np.zeros(len(symbol) + 1, bool)
    breaks[per] = True
    first = inside & (breaks[:-1] | ~np.concatenate([[False], inside[:-1]]))
    run = np.cumsum(first) - 1
    size = np.bincount(run[inside], minlength=int(first.sum()))
    keep = np.flatnonzero(inside)
    keep = keep[size[run[keep]] >= least]
    keep = keep[exact(keep)]
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs end to end, a separator wherever neighbours are not adjacent words of one text
    gap = np.concatenate([[False], (keep[1:] != keep[:-1] + 1) | breaks[keep[1:]]])
    place = np.arange(len(keep)) + np.cumsum(gap)
    seq = np.full(int(place[-1]) + 2, SEPARATOR, np.int64)
    word = np.full(len(seq), -1, np.int64)
    seq[place], word[place] = symbol[keep], keep
    seq[-1] = SENTINEL
    index = FMIndex(seq, FIRST + len(p.hashes))
    lo, hi = index.search(p.patterns, p.lengths)
    found = np.flatnonzero(hi > lo)
    many = (hi - lo)[found]
    rows = np.repeat(lo[found], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return word[index.locate(rows)], np.repeat(found, many)


def searched(texts: pa.Array, p: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[set[str]]]:
    """Per text: its number of words; merged spans (first word, word after the last, first byte, byte after the last); item ids."""
    raw, offsets = flat(texts)
    raw = lowered(raw)
    starts, ends, per = word_spans(raw, offsets, word_table())
    spans: list[list] = [[] for _ in range(len(texts))]
    items: list[set[str]] = [set() for _ in range(len(texts))]
    if len(p.hashes) and len(starts):
        symbol = symbols(raw, starts, ends, p)
        at, which = occurrences(symbol, per, lambda w: same_bytes(raw, starts[w], ends[w], symbol[w], p), p)
        doc = np.searchsorted(per, at, side="right") - 1
        for d, k in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            items[d].update(p.item_of(k))
        depth = np.zeros(len(starts) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + p.lengths[which], -1)
        hit = np.cumsum(depth)[:-1] > 0
        breaks = np.zeros(len(starts) + 1, bool)
        breaks[per] = True
        begin = np.flatnonzero(hit & (breaks[:-1] | ~np.concatenate([[False], hit[:-1]])))
        stop = np.flatnonzero(hit & (breaks[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
        for d, a, b in zip((np.searchsorted(per, begin, side="right") - 1).tolist(), begin.tolist(), stop.tolist(), strict=True):
            spans[d].append((a - int(per[d]), b - int(per[d]), int(starts[a] - offsets[d]), int(ends[b - 1] - offsets[d])))
    return np.diff(per), spans, items


def blocks(benchmark: DataFrame, n: int) -> list[Broadcast]:
    """The benchmark, broadcast in blocks of bounded size; every item is in one block. The driver holds one block at a time."""
    rows = picked(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    context, out = benchmark.sparkSession.sparkContext, []
    held, size = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        held.append((r["item"], r["text"]))
        size += len(r["text"].encode())
        if size >= BLOCK_BYTES:
            out.append(context.broadcast(phrases(held, n).arrays()))
            held, size = [], 0
    if held or not out:
        out.append(context.broadcast(phrases(held, n).arrays()))
    return out


def loaded(handles: list[Broadcast]) -> Iterator[Phrases]:
    """One block after the other; of several none stays in the worker's memory."""
    for handle in handles:
        yield Phrases(*handle.value)
        if len(handles) > 1:
            handle.__dict__.pop("_value", None)


def groups(batches: Iterator[pa.RecordBatch], text: str, several: bool) -> Iterator[list[pa.RecordBatch]]:
    """Shards to search together: with one block each by itself."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, text):
            held.append(part)
            size += pa.compute.sum(pa.compute.binary_length(part.column(text))).as_py() or 0
            if not several or size >= GROUP_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def found(texts: list[pa.Array], handles: list[Broadcast]) -> list[tuple[np.ndarray, list[list], list[set[str]]]]:
    """What ``searched`` says of each array of texts, united over all blocks."""
    out: list = [None] * len(texts)
    for p in loaded(handles):
        for i, x in enumerate(texts):
            count, spans, items = searched(x, p)
            if out[i] is not None:
                spans = [united(a + b) if a and b else a or b for a, b in zip(out[i][1], spans, strict=True)]
                items = [a | b for a, b in zip(out[i][2], items, strict=True)]
            out[i] = (count, spans, items)
    return out


def united(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def marked(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``spans`` (words and UTF-8 bytes, ends exclusive, merged) and ``items`` (sorted ids)."""
    return guarded(docs, (text,), lambda d: _marked(d, benchmark, n, text))


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> DataFrame:
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<first:int,last:int,start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema
    handles = blocks(benchmark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, text, len(handles) > 1):
            for part, (count, spans, items) in zip(group, found([x.column(text) for x in group], handles), strict=True):
                rows = [[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in x] for x in spans]
                made = [pa.array(count, pa.int64()), pa.array(rows, SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def cut(x: pa.Scalar, spans: list[tuple[int, int]]) -> str:
    """The text without its spans of bytes."""
    raw, out, last = x.as_buffer().to_pybytes(), [], 0
    for a, b in spans:
        out.append(raw[last:a])
        last = b
    return b"".join([*out, raw[last:]]).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text``, again where a cut has joined a phrase anew, until none is left.

    What is cut at once is the union of all blocks' spans of the same text, and what was cut is searched
    with all blocks again, so the blocks' size and order change nothing.
    """
    return guarded(docs, (text,), lambda d: _cleaned(d, benchmark, n, text))


def _cleaned(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> DataFrame:
    handles = blocks(benchmark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, text, len(handles) > 1):
            now = [part.column(text) for part in group]  # what is left to search of each shard, its rows' places and new texts
            places = [np.arange(len(x)) for x in now]
            changed: list[dict[int, str]] = [{} for _ in group]
            open_ = list(range(len(group)))
            while open_:
                for i, (_, spans, _) in zip(open_, found([now[i] for i in open_], handles), strict=True):
                    again = [k for k, s in enumerate(spans) if s]
                    for k in again:
                        changed[i][int(places[i][k])] = cut(now[i][k], [s[2:] for s in spans[k]])
                    places[i] = places[i][again]
                    now[i] = pa.array([changed[i][int(k)] for k in places[i]], pa.string())
                open_ = [i for i in open_ if len(places[i])]
            for part, texts in zip(group, changed, strict=True):
                if texts:
                    values = part.column(text).to_pylist()
                    for k, x in texts.items():
                        values[k] = x
                    part = part.set_column(part.schema.get_field_index(text), text, pa.array(values, part.schema.field(text).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
