"""Prefix trie of conversations: every distinct sequence of first turns, and what sharing it saves.

A turn is a 128-bit digest of its role and text (and its number of words); texts
never move. Conversations become arrays of turn digests, equal ones are one row,
and the distinct arrays are sorted by ranges over the whole cluster. In sorted
order the node of depth d is a run of arrays whose adjacent longest common
prefixes (LCPs) are at least d, so one sweep with a stack makes all nodes: an
array closes what is deeper than its LCP with the one before and opens the rest.
A partition knows the LCPs with its neighbours' ends; what is open there
(at most a path a border) is emitted in part, and equal paths' parts, whose sums
and minima add up, are stitched by a grouped shuffle. Parents are joined by the
digest of their path.

Distinct arrays cannot make a hot range. Members that end at one node pass a task
as a sorted stream (their hash is sequential by definition), never held. A
conversation's digests (20 bytes a turn) lie in one row, and 20 conversations
that may share a head in one task.

Defined results. Turns come in order of ``turn``, null first; equal ones by the
SHA-256 of role and text, repeated rows one after the other. A null role or text
is empty. Rows without a conversation's id belong to none. Texts may be of any
length. Every other column is ignored. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, written

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, key, words) of ``conv_id``, ``turn``, ``role``, ``text``; ``key`` is a turn's digest of 16 bytes."""
    df = picked(df, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    key = F.unhex(F.substring(whole, 1, 32)).alias("key")
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key, F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))


def sequences(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as an array of (key, words)."""
    one = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"), F.col("key"), F.col("words"))
    all_ = turn_rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("seq"))
    return all_.withColumn("seq", F.transform("seq", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))))


def shared_heads(turn_rows: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % kinds.

    All rows of ``every`` conversations are dealt to one task at once, so that grouping and heads need no other shuffle.
    """
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    dealt = turn_rows.select("*", base).repartition("base")
    one = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"), F.col("key"), F.col("words"))
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(one)).alias("own"))
    own = own.withColumn("own", F.transform("own", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, kinds - 1))
    own = own.withColumn("head", F.max(first).over(Window.partitionBy("base")))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int"))
    none = F.slice("own", 1, 0)
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    return own.select("conv_id", F.concat(head, rest).alias("seq"))


def _path(above: bytes, key: bytes) -> bytes:
    """The digest of a path by its parent's and its last turn's."""
    return hashlib.blake2b(above + key, digest_size=16).digest()


def with_paths(convs: DataFrame) -> DataFrame:
    """(conv_id, keys, words, path): the turns as two arrays, and the digest of the whole sequence."""
    flat = convs.select("conv_id", F.col("seq.key").alias("keys"), F.col("seq.words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for keys in batch.column("keys"):
                path = ROOT
                for key in keys:
                    path = _path(path, key.as_py())
                made.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "path"])

    return flat.mapInArrow(run, "conv_id long, keys array<binary>, words array<int>, path binary")


def ends(convs: DataFrame) -> DataFrame:
    """(path, ends): the SHA-256 of the ascending ids, as decimals joined by commas, of the conversations that end at a path. A stream: no list is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hashed = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            ids = np.asarray(batch.column("conv_id"))
            cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                text = ",".join(map(str, ids[a:b].tolist())).encode()
                if paths[a] == now:
                    hashed.update(b"," + text)
                else:
                    if hashed is not None:
                        done.append((now, hashed.hexdigest()))
                    now, hashed = paths[a], hashlib.sha256(text)
            yield _rows(done)
            done = []
        if hashed is not None:
            yield _rows([(now, hashed.hexdigest())])

    def _rows(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.string())], names=["path", "ends"])

    return convs.select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(run, "path binary, ends string")


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two different arrays."""
    return (F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1).cast("int")


def borders(parts: DataFrame) -> DataFrame:
    """(part, before, after): each partition's LCPs with the neighbours' nearest arrays, -1 where there is none. One row a partition."""
    edge = parts.groupBy("part").agg(F.min("keys").alias("first"), F.max("keys").alias("last"))
    by = Window.orderBy("part")
    near = edge.select("part", "first", "last", F.lag("last").over(by).alias("left"), F.lead("first").over(by).alias("right"))
    none = F.lit(-1)
    return near.select("part", F.coalesce(lcp(F.col("left"), F.col("first")), none).alias("before"), F.coalesce(lcp(F.col("last"), F.col("right")), none).alias("after"))


NODE = "path binary, above binary, depth long, least long, n_convs long, n_children long, n_leaves long, saved long, ends string, open boolean"


class _Sweep:
    """The stack over one partition's sorted arrays; entry d of every list belongs to the open node of depth d."""

    def __init__(self, before: int, after: int):
        self.before, self.after, self.keys = before, after, None
        self.out: list[tuple] = []
        self.stack: list[list] = []

    def add(self, keys: list[bytes], words: list[int], n: int, least: int, ended: str) -> None:
        common = self.before if self.keys is None else _common(self.keys, keys)
        if self.keys is None:
            self._open(ROOT, None, 0, started=common < 0)
        else:
            self._close(common)
        for d in range(len(self.stack), len(keys) + 1):
            # what the partition before has open is no new child, and its words are charged there
            self._open(_path(self.stack[-1][0], keys[d - 1]), self.stack[-1][0], words[d - 1], started=d > common)
        top = self.stack[-1]
        top[3] += n
        top[2] = min(top[2], least)
        top[7] = ended
        self.keys = keys

    def _open(self, path: bytes, above: bytes | None, words: int, started: bool) -> None:
        if started and self.stack:
            self.stack[-1][4] += 1
        # path, above, least id, members, children begun here, leaves, saved tokens below and here, ends, words, begun here
        self.stack.append([path, above, 1 << 63, 0, 0, 0, 0, None, words, started])

    def _close(self, to: int, after: int = -1) -> None:
        """Closes all nodes deeper than ``to``; up to the depths ``before`` and ``after`` neighbours have parts of them."""
        while len(self.stack) > to + 1:
            depth = len(self.stack) - 1
            path, above, least, n, children, leaves, saved, ended, words, started = self.stack.pop()
            goes_on = depth <= after
            if ended is not None and children == 0 and not goes_on:  # an array that ends here comes first among those of its node
                leaves += 1
            saved += words * (n - (1 if started else 0))
            if self.stack:
                up = self.stack[-1]
                up[2], up[3], up[5], up[6] = min(up[2], least), up[3] + n, up[5] + leaves, up[6] + saved
            self.out.append((path, above, depth, least, n, children, leaves, saved, ended, goes_on or not started))

    def finish(self) -> None:
        self._close(-1, self.after)

    def rows(self) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_()]
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in kinds]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def swept(parts: DataFrame, near: DataFrame) -> DataFrame:
    """The nodes (``NODE``) that the sweeps over all partitions make; of those that several have parts of, ``open`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep = None, None
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            columns = (batch.column(c).to_pylist() for c in ("part", "before", "after", "keys", "words", "n", "least", "ends"))
            for name, before, after, keys, words, n, least, ended in zip(*columns, strict=True):
                if name != part:
                    if sweep is not None:
                        sweep.finish()
                        yield sweep.rows()
                    part, sweep = name, _Sweep(before, after)
                sweep.add(keys, words, n, least, ended)
                if len(sweep.out) >= 4096:
                    yield sweep.rows()
        if sweep is not None:
            sweep.finish()
            yield sweep.rows()

    rows = parts.join(F.broadcast(near), "part").select("part", "before", "after", "keys", "words", "n", "least", "ends")
    return rows.repartition("part").sortWithinPartitions("part", "keys").mapInArrow(run, NODE)


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, seq of (key, words))."""
    convs = written(with_paths(convs))
    distinct = convs.groupBy("path").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = distinct.join(ends(convs), "path")
    # the ranges' bounds come from a sample, so what they deal out is written once and all sweeps read that
    parts = written(distinct.repartitionByRange("keys").withColumn("part", F.spark_partition_id()))
    nodes = written(swept(parts, borders(parts)))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    stitched = nodes.where("open").groupBy("path").agg(F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("least").alias("least"), *sums, F.max("ends").alias("ends"))
    whole = nodes.where("not open").drop("open").unionByName(stitched)
    parents = whole.where("n_children > 0").select(F.col("path").alias("above"), F.col("least").alias("parent_conv_id"))
    out = whole.join(parents, "above", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("least").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(none)).alias("ends_sha256"),
    )
