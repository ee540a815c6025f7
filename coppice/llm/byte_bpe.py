"""Byte-level BPE: encoding by length-bucketed padded numpy matrices, and decoding.

A text is cut into pieces by the vocabulary's pattern. Distinct new pieces of a
batch are put, by length, into padded matrices of token ids; in each round every
row merges its leftmost pair of least rank, found by a hashed table of pairs,
and rows are compacted. Pieces longer than the widest bucket are merged exactly
with a heap, in n log n steps. Decoding maps ids back to bytes.

Null and empty texts have no ids and decode to no bytes. Rows are independent, so
repeated rows and empty tables need nothing special; a text may be of any length.
Extra columns are kept, whatever their names; one that is called like a column of
the result gives way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded

#: Characters of pieces that the table of known pieces may hold.
KNOWN_CHARS = 1 << 24
BUCKETS = (4, 8, 16, 32, 64, 128)
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of byte strings, and the rank that a pair of adjacent ids merges into."""

    def __init__(self, packed: bytes):
        self.tokens: dict[int, bytes] = {}
        for line in packed.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ranks = {v: k for k, v in self.tokens.items()}
        single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        if min(single) < 0:
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.single = np.array(single, np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pairs = pairs
        # open addressing: two arrays of a power of two slots, linear probing
        self.bits = max(4, (len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), 1
        for key, rank in pairs.items():
            slot, n = self._slot(key), 1
            while self.keys[slot] != -1:
                slot, n = (slot + 1) & (size - 1), n + 1
            self.keys[slot], self.values[slot], self.probes = key, rank, max(self.probes, n)

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, NONE where it does not (ids under 0 are padding)."""
        key = (left << np.int64(20)) | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, NONE)
        open_ = (left >= 0) & (right >= 0)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = open_ & (found == key)
            out[hit] = self.values[slot[hit]]
            open_ &= ~hit & (found != -1)
            if not open_.any():
                break
            slot = (slot + 1) & np.int64(len(self.keys) - 1)
        return out


def encode_matrix(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[list[int]]:
    """Ids of pieces of at most ``width`` bytes each, merged side by side."""
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
    ids = np.where(np.arange(width) < lengths[:, None], vocab.single[raw], -1)
    out: list[list[int]] = [[]] * len(pieces)
    rows = np.arange(len(pieces))
    ranks = vocab.merged(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE)
    while len(rows):
        best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
        over = least == NONE
        if over.any():
            for row, line in zip(rows[over].tolist(), ids[over].tolist(), strict=True):
                out[row] = [x for x in line if x >= 0]
            go = ~over
            rows, ids, ranks, best, least = rows[go], ids[go], ranks[go], best[go], least[go]
            if not len(rows):
                break
        # merge: the pair's left id becomes the new one, what stands right of the pair moves up by one
        n, at = np.arange(len(rows)), np.arange(ids.shape[1])
        source = np.minimum(at + (at > best[:, None]), ids.shape[1] - 1)
        ids = np.take_along_axis(ids, source, axis=1)
        ids[:, -1] = -1
        ids[n, best] = least
        at = at[:-1]
        ranks = np.take_along_axis(ranks, np.minimum(at + (at > best[:, None]), ranks.shape[1] - 1), axis=1)
        ranks[:, -1] = NONE
        for side in (best - 1, best):  # only the pairs beside the new id are new
            ok = (side >= 0) & (side < ranks.shape[1])
            r, c = n[ok], side[ok]
            ranks[r, c] = vocab.merged(ids[r, c], ids[r, c + 1])
        used = int((ids >= 0).sum(axis=1).max())
        if used < ids.shape[1] // 2:  # compaction
            ids, ranks = ids[:, : max(used, 2)], ranks[:, : max(used, 2) - 1]
    return out


def encode_long(piece: bytes, vocab: Vocabulary) -> list[int]:
    """Ids of one piece of any length, by a heap over its pairs: least rank first, then leftmost."""
    ids = vocab.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), vocab.pairs
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i] << 20) | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := pairs.get((ids[k] << 20) | ids[after[k]])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
    return [x for x in ids if x >= 0]


def encode_pieces(pieces: list[bytes], vocab: Vocabulary, rows: int = 1 << 14) -> list[list[int]]:
    """Ids of each piece; ``rows`` bounds a matrix."""
    out: list[list[int]] = [[]] * len(pieces)
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if p in vocab.ranks:
            out[i] = [vocab.ranks[p]]
        else:
            by.setdefault(next((b for b in BUCKETS if len(p) <= b), 0), []).append(i)
    for width, members in by.items():
        if not width:
            for i in members:
                out[i] = encode_long(pieces[i], vocab)
            continue
        step = max(1, rows * BUCKETS[0] // width)
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, encode_matrix([pieces[i] for i in part], width, vocab), strict=True):
                out[i] = ids
    return out


def encoded(docs: DataFrame, packed: bytes, pattern: str, text: str = "text", known: int = 400_000, with_ids: bool = False) -> DataFrame:
    """``docs`` without ``text`` plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    ``packed`` is the content of a rank file; ``known`` bounds the table of pieces already encoded.
    """
    return guarded(docs, (text,), lambda d: _encoded(d, packed, pattern, text, known, with_ids))


def _encoded(docs: DataFrame, packed: bytes, pattern: str, text: str, known: int, with_ids: bool) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    new = [F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    new += [F.array(F.lit(0)).alias("ids")] if with_ids else []
    schema = docs.select(*keep, *new).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        vocab, cut = Vocabulary(packed), regex.compile(pattern).findall
        table: dict[str, str] = {}  # a piece's ids as decimal text
        held = 0
        names = {str(k): v for k, v in vocab.tokens.items()}
        for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            counts, ids_hash, back_hash, all_ids = [], [], [], []
            pieces = [cut(t) if t else [] for t in part.column(text).to_pylist()]
            if len(table) > known or held > KNOWN_CHARS:
                table.clear()
                held = 0
            new = list({p for x in pieces for p in x}.difference(table))
            held += sum(map(len, new))
            for p, ids in zip(new, encode_pieces([p.encode() for p in new], vocab), strict=True):
                table[p] = " ".join(map(str, ids))
            for x in pieces:
                line = " ".join(map(table.__getitem__, x))
                ids = line.split(" ") if line else []
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(line.encode()).hexdigest())
                back_hash.append(hashlib.sha256(b"".join(map(names.__getitem__, ids))).hexdigest())
                if with_ids:
                    all_ids.append(np.array(list(map(int, ids)), np.int32))
            arrays = [*(part.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*keep, text).mapInArrow(run, schema)
