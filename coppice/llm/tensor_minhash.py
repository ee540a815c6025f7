"""Near-duplicate detection by MinHash with tensored banding.

A document's set holds its distinct shingles of ``words`` words. Two collections
of ``m`` short bands (``rows`` minima each) are computed; the keys of the hash
tables are all pairs of a band of the first and one of the second collection, so
2*m*rows minima serve m*m tables of 2*rows minima each. ``m`` follows from the
similarity and the accepted chance of missing a pair that has just that
similarity. Documents with equal sets share a node from the start. Map tasks
combine equal keys of a batch before anything is shuffled, so a hot key moves
once per batch.

Nodes that meet in a table form candidate clusters (connected components).
Inside a cluster, links are confirmed on the full sets, and the classes are the
components of confirmed links. Big clusters are split into blocks of bounded
size, each with a few of the whole cluster's nodes (pivots) beside its own: what
is alike everywhere meets through them. Then the nodes outside a cluster's
largest class, packed into as few groups as hold them, are compared with all
blocks. So every pair of candidates is either compared or already in one class,
and no task holds more than a block, a group and the pivots.

Shingles are compared as 64-bit hashes, and a node is a 64-bit hash of a set; sets
that differ in a second hash and share a node are named by the second one instead.
Rows are told apart by 128 bits.
Null and empty texts, and texts without words, have empty sets and are alone.
A text with fewer words than a shingle has its whole sequence as its only
shingle. Repeated rows are copies like any others. Null ids sort last. A text may
be of any length; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, flat, guarded, lowered, mixed, picked, row_id, small, word_hashes, word_spans, written
from .components import components

ROWS = 3
MISS = 5e-5
#: Shingles in one block of a cluster (8 bytes each; a longer set is a block of its own), and a big cluster's pivots (about).
BLOCK, PIVOTS = 1 << 16, 24


def bands(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands per collection so that a pair of just this similarity is missed with a chance of at most ``miss``."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**rows)))


def word_table() -> np.ndarray:
    out = np.ones(256, bool)
    out[[0x20, 9, 10, 11, 12, 13]] = False
    return out


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, end to end, and the n+1 offsets."""
    raw, offsets = flat(texts)
    raw = lowered(raw)
    starts, ends, per = word_spans(raw, offsets, word_table())
    h = word_hashes(raw, starts, ends)
    weights = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) | 1) for k in range(words)]
    n = max(0, len(h) - words + 1)
    all_ = np.zeros(n, np.uint64)
    for k, w in enumerate(weights):
        all_ += mixed(h[k : k + n] * w + np.uint64(k + 1))
    all_ = mixed(all_)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, b = int(per[i]), int(per[i + 1])
        if b - a >= words:
            s = np.unique(all_[a : b - words + 1])
        elif b > a:
            s = mixed(np.array([sum(int(x) * int(weights[k]) for k, x in enumerate(h[a:b])) % (1 << 64) ^ (b - a)], np.uint64))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def nodes_of(values: np.ndarray, offsets: np.ndarray, bits: int = 64, clashing: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Each set's node and a second hash of it; 0 for an empty one. A node that is known as ``clashing`` is the second hash instead.

    Fewer ``bits`` of the first hash make sets meet in it (for tests).
    """
    first, second = (np.zeros(len(offsets) - 1, np.uint64) for _ in range(2))
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        n = np.diff(offsets)[some].astype(np.uint64)
        first[some] = mixed(np.add.reduceat(mixed(values ^ np.uint64(0xD6E8FEB86659FD93)), offsets[some]) + n) >> np.uint64(64 - bits)
        second[some] = mixed(np.add.reduceat(mixed(values ^ np.uint64(0xA0761D6478BD642F)), offsets[some]) ^ n)
    node = first.view(np.int64)
    if clashing:
        node = np.where(np.isin(node, np.fromiter(clashing, np.int64)), second.view(np.int64), node)
    return node, second.view(np.int64)


def minima(values: np.ndarray, offsets: np.ndarray, many: int) -> np.ndarray:
    """(sets, many) minima of ``many`` hash functions; every set has a shingle."""
    rng = np.random.default_rng(1009)
    out = np.empty((len(offsets) - 1, many), np.uint64)
    for k in range(many):
        a, b = np.uint64(int(rng.integers(1 << 63)) * 2 + 1), np.uint64(int(rng.integers(1 << 63)))
        out[:, k] = np.minimum.reduceat(values * a + b, offsets[:-1])
    return out >> np.uint64(20)


def band_hashes(values: np.ndarray, offsets: np.ndarray, m: int, rows: int) -> np.ndarray:
    """(sets, 2, m) hashes of the short bands of both collections."""
    least = minima(values, offsets, 2 * m * rows).reshape(-1, 2, m, rows)
    out = np.zeros(least.shape[:3], np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[..., k] + np.uint64(k + 1))
    return out


def with_nodes(docs: DataFrame, words: int, text: str = "text", bits: int = 64, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """``docs`` without ``text`` plus ``_node`` and ``_second`` (null for an empty set) and ``n_shingles``."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, *[F.lit(None).cast("long").alias(x) for x in ("_node", "_second")], F.lit(0).cast("long").alias("n_shingles")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                values, offsets = shingle_sets(part.column(text), words)
                n = np.diff(offsets)
                both = [pa.array(x, pa.int64(), mask=n == 0) for x in nodes_of(values, offsets, bits, clashing)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *both, pa.array(n)], names=[*keep, "_node", "_second", "n_shingles"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def table_keys(docs: DataFrame, words: int, m: int, rows: int = ROWS, text: str = "text", bits: int = 64, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """(key, node) rows; nodes of one batch with an equal key are combined: one row for them, and the pair under a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for part in chunks(batch, text):
                values, offsets = shingle_sets(part.column(text), words)
                names, n = nodes_of(values, offsets, bits, clashing)[0], np.diff(offsets)
                new = [i for i in np.flatnonzero(n).tolist() if int(names[i]) not in seen]
                new = list({int(names[i]): i for i in new}.values())
                if not new:
                    continue
                pick = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in new])
                hashes = band_hashes(values[pick], np.concatenate([[0], np.cumsum(n[new])]), m, rows)
                seen |= {int(names[i]): h for i, h in zip(new, hashes, strict=True)}
            if not seen:
                continue
            node = np.array(list(seen), np.int64)
            hashes = np.stack(list(seen.values()))
            order = np.argsort(node)
            node, hashes = node[order], hashes[order]
            pairs: set[tuple[int, int]] = set()
            for i in range(m):
                for j in range(m):
                    key = mixed(hashes[:, 0, i] * np.uint64(0xA24BAED4963EE407) + hashes[:, 1, j] + np.uint64(i * m + j)).view(np.int64)
                    key, first, back = np.unique(key, return_index=True, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[first])], names=["key", "node"])
                    if len(key) < len(node):
                        other = np.flatnonzero(first[back] != np.arange(len(node)))
                        pairs.update(zip(node[first[back[other]]].tolist(), node[other].tolist(), strict=True))
            if pairs:
                ends = np.array(sorted(pairs), np.int64)
                key = mixed(mixed(ends[:, 0].view(np.uint64).copy()) + ends[:, 1].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, 2)), pa.array(ends.ravel())], names=["key", "node"])

    return docs.select(text).mapInArrow(run, "key long, node long")


def sets(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` plus the set as bytes."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep, F.lit(b"").alias("_set")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                values, offsets = shingle_sets(part.column(text), words)
                made = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "_set"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def linked(group: np.ndarray, probe: np.ndarray, members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """What confirmed links between sets of different groups, at least one of them a probe, make of the groups: (least, other) of each joint class.

    Sets are compared through their shingles' postings, one node against all before it. Stars and not the
    links themselves are reported, so that few rounds unite what several tasks have found.
    """
    order = np.argsort([len(x) for x in members], kind="stable")
    sizes = np.array([len(members[i]) for i in order], np.int64)
    flat_values = np.concatenate([members[i] for i in order])
    _, ids = np.unique(flat_values, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(ids, kind="stable")
    posting, bounds = owner[by], np.concatenate([[0], np.cumsum(np.bincount(ids))])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    place = np.empty(len(flat_values), np.int64)  # where a shingle's own entry stands in its posting list
    place[by] = np.arange(len(by))
    for k in range(1, len(order)):
        mine = slice(offsets[k], offsets[k + 1])
        low, high = bounds[ids[mine]], place[mine]
        many = high - low
        total = int(many.sum())
        if not total:
            continue
        at = np.repeat(low, many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        common = np.bincount(posting[at], minlength=k)
        hit = np.flatnonzero(100 * common >= percent * (sizes[:k] + sizes[k] - common))
        me = int(order[k])
        for i in order[hit].tolist():
            if probe[i] or probe[me]:
                a, b = root(int(group[i])), root(int(group[me]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(least, g) for g in list(parent) if (least := root(g)) != g]


def confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """Groups (a, b) that links of each task join; ``tasks``: task, node, group (a node), probe, _set. A task's rows fit one worker; a node may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def done():
            if len(held) > 1:
                rows = list(held.values())
                links = linked(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for name, node, group, probe, set_ in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "group", "probe", "_set")), strict=True):
                if name != task:
                    yield from done()
                    task, held = name, {}
                held[node] = (group, probe or (node in held and held[node][1]), set_)
        yield from done()

    return tasks.select("task", "node", "group", "probe", "_set").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links inside every block, with a big cluster's pivots in each of its blocks. ``members``: cluster, block, blocks, nodes, node, _set."""
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(29)), F.col("nodes")) < PIVOTS)
    blocks = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = members.withColumn("_at", F.explode(blocks))
    return confirmed(rows.select(F.xxhash64("cluster", "_at").alias("task"), "node", F.col("node").alias("group"), F.lit(True).alias("probe"), "_set"), percent)


def outside_links(members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of the nodes outside the largest classes of clusters of several blocks with all other nodes of their clusters. ``members`` is written."""
    classed = members.join(components(links), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
    main = classed.groupBy("cluster", "group").count().groupBy("cluster").agg(F.max_by("group", F.struct("count", "group")).alias("main"))
    classed = written(classed.join(main, "cluster").withColumn("probe", F.col("group") != F.col("main")))
    outside = classed.where("probe")
    packs = written(outside.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("_set")) / F.lit(8 * BLOCK)).cast("int").alias("packs")))
    task = F.xxhash64("cluster", "pack", "to").alias("task")
    probes = outside.join(packs, "cluster").withColumn("pack", F.pmod(F.xxhash64("node", F.lit(31)), F.col("packs")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    targets = classed.join(packs, "cluster").withColumn("to", F.col("block")).withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).withColumn("probe", F.lit(False))
    return confirmed(probes.select(task, "node", "group", "probe", "_set").unionByName(targets.select(task, "node", "group", "probe", "_set")), percent)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id`` (least ``key`` of the class), ``_row``, ``_first``.

    ``_row`` is the row's key, made of ``key`` and ``text``; ``_first`` says whether the row stands for its class.
    """
    docs = picked(docs, key, text)
    rows = docs.select(key, text, row_id(key, text).alias("_row"))
    named = written(with_nodes(rows, words, text, bits))
    # different sets of one node: of n sets about n * n / 2**65 pairs, so these few may go to the driver
    twice = named.where("_node is not null").groupBy("_node").agg(F.min("_second").alias("a"), F.max("_second").alias("b")).where("a != b")
    clashing = frozenset(r["_node"] for r in twice.select("_node").collect())
    if clashing:
        named = written(with_nodes(rows, words, text, bits, clashing))
    named = named.drop("_second")
    tables = table_keys(docs, words, bands(percent / 100), text=text, bits=bits, clashing=clashing)
    meet = tables.withColumn("least", F.min("node").over(Window.partitionBy("key"))).where("node != least")
    clusters = components(meet.select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
    # one row stands for each node of a cluster; its set is made where its text lies
    stands = named.where("_node is not null").join(clusters.withColumnRenamed("node", "_node"), "_node").groupBy("_node", "cluster").agg(F.min("_row").alias("_row"), F.max("n_shingles").alias("n"))
    stands = written(stands)
    blocks = stands.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("nodes"))
    stands = written(stands.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("_node", F.lit(17)), F.col("blocks")).cast("int")))
    standing = rows.select("_row", text).join(small(stands), "_row")
    if not named.groupBy("_row").count().where("count > 1").isEmpty():  # rows that are equal in key and text
        standing = standing.dropDuplicates(["_row"])
    members = sets(standing.select("cluster", "block", "blocks", "nodes", F.col("_node").alias("node"), text), words, text)
    if stands.where("blocks > 1").isEmpty():
        links = block_links(members, percent)
    else:
        members = written(members)
        links = written(block_links(members, percent))
        links = links.unionByName(outside_links(members.where("blocks > 1"), links, percent))
    classes = components(links).withColumnRenamed("node", "_node")
    named = named.join(small(classes), "_node", "left").withColumn("_class", F.coalesce("root", "_node"))
    least = F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), F.col("_row").alias("row")))
    first = named.where("_class is not null").groupBy("_class").agg(F.count("*").alias("_n"), F.min(key).alias("_id"), least.alias("_least")).where("_n > 1")
    out = named.join(small(written(first)), "_class", "left")
    alone = F.col("_n").isNull()
    return out.select(key, "n_shingles", F.when(alone, F.col(key)).otherwise(F.col("_id")).alias("component_id"), "_row", (alone | (F.col("_row") == F.col("_least.row"))).alias("_first"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their classes: one of each, the one with the least key. Extra columns are kept, whatever their names."""
    return guarded(docs, (text, key), lambda d: _deduplicated(d, words, percent, text, key))


def _deduplicated(docs: DataFrame, words: int, percent: int, text: str, key: str) -> DataFrame:
    found = written(near_duplicates(docs.select(key, text), words, percent, text, key).select("_row", "_first"))
    rows = docs.withColumn("_row", row_id(key, text))
    out = rows.join(small(written(found.where("not _first").select("_row").distinct())), "_row", "left_anti")
    again = written(found.where("_first").groupBy("_row").count().where("count > 1").select("_row"))
    if not again.isEmpty():  # rows that are equal in id and text
        again = small(again)
        out = out.join(again, "_row", "left_anti").unionByName(out.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*docs.columns)
