"""N-gram Jaccard join: an exact similarity join of shingle sets in their metric space.

Two documents link when 100 * |x & y| >= percent * |x | y|, that is, when their
Jaccard distance is at most r = 1 - percent / 100. The distance is a metric, so
pivots cut the space into Voronoi regions, and the triangle inequality says which
documents near a border must be in several regions for no link to be lost.

First level: the pivots are all one-element sets. All that a set holds are equally
near, and ties go to the least in one fixed order, so a set's region is that of
its first shingle. A set within r of x lacks at most r|x| of x's shingles, so its
region is that of one of x's first floor(r|x|) + 1 shingles: that is the window in
which x is replicated. (Documents as pivots cannot do this step: nearly all pairs
of texts have no shingle in common, so every distance to them would be 1.) The
distance to the empty set, |x|, cuts each region into rings of a ratio of 1 / (1 - r);
a set is in its own ring and the one below. Shingles that many sets hold
come last in the order (counts over all documents, of three sixteenths of all shingles
by hash); the order decides what is compared, never what is found.

In a region of few sets all pairs are named, and each is tested by its distances to 64
(for large sets up to 4,096) more pivots, classes of hashes: how many shingles two sets
have in each of them differs, in sum, by no more than the sets do. That leaves out
nearly all that meet by chance. What is left, and the larger regions, whose sets are
mostly copies, are joined where they overlap, so that a set moves once. Where that is more
than a block, it is cut recursively: some sets become pivots, everything within r of a pivot is linked to it at once, and pivots that lie
apart make regions. A set belongs to the nearest pivot if that is nearer than
1 - r, else to the outside; it is also sent wherever a set within r could belong:
to pivots at most 2r farther away than its nearest, and to the outside if its
nearest is not nearer than 1 - 2r. After each level, linked sets are one group and only pairs of different groups
matter: all that is not in a region's largest group is compared with everything in
it, block by block. A region that the cut does not make smaller, or whose
windows would send most of it everywhere, is compared block against block. Links are confirmed on full sets (of 64-bit hashes).

Defined results. Null and empty texts and texts without words have empty sets and
are alone; a text with fewer words than a shingle has its whole sequence as its only
shingle. Documents with equal sets are one from the start, repeated rows among them.
Sets are told apart by 128 bits. Null ids are no smallest id unless a class has no other. A text may
be of any length; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mixed, picked, row_key, small, written
from .components import components
from .tensor_minhash import confirmed, shingle_sets

#: Weight of sets (shingles, LIGHT at least for each; 8 bytes each) that one task compares.
BLOCK, LIGHT = 1 << 19, 64
#: How many times its weight the parts of a region may have together; beyond it the windows cut nothing.
SPREAD = 3
#: Rows of a region whose pairs are all named.
FEW = 24
#: Pivots of a region at most, and how far apart those lie that make regions.
PIVOTS, APART = 64, 0.5
#: Shingles that so many sets hold come last; of the counted part of all hashes; at most so many (they are broadcast, 8 bytes each).
CROWD, COUNTED, CROWDED = FEW, 3 << 60, 1 << 20

_SALTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def numbers(values: np.ndarray, offsets: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set as longs, 0 for an empty one; the first of ``bits`` bits."""
    out = []
    some = np.flatnonzero(np.diff(offsets))
    for salt in _SALTS:
        h = np.zeros(len(offsets) - 1, np.uint64)
        if len(some):
            sums = np.add.reduceat(mixed(values ^ salt), offsets[some])
            h[some] = mixed(sums + np.diff(offsets)[some].astype(np.uint64) * salt)
        out.append(h)
    out[0] >>= np.uint64(64 - bits)
    return out[0].view(np.int64), out[1].view(np.int64)


class Sets:
    """How a task makes the sets of a text column and names them."""

    def __init__(self, words: int, text: str, bits: int, twice: np.ndarray | None = None):
        self.words, self.text, self.bits, self.twice = words, text, bits, twice

    def nodes(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A set's number: its first hash, or the second where several sets share the first."""
        first, second = numbers(values, offsets, self.bits)
        return np.where(np.isin(first, self.twice), second, first)

    def each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in chunks(batch, self.text):
                yield part, *shingle_sets(part.column(self.text), self.words)

    def fresh(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, values, offsets) of the sets that this task has not seen before."""
        seen: set[int] = set()
        for _, values, offsets in self.each(batches):
            nodes, sizes = self.nodes(values, offsets), np.diff(offsets)
            new = {}
            for i in np.flatnonzero(sizes).tolist():
                if int(nodes[i]) not in seen:
                    seen.add(int(nodes[i]))
                    new[i] = None
            if new:
                pick = np.fromiter(new, np.int64)
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in pick.tolist()])
                yield nodes[pick], values[at], np.concatenate([[0], np.cumsum(sizes[pick])])


def classes_of(size: int) -> int:
    """How many classes of hashes a sketch of a set of this size has; each is four of the finer kind."""
    return 64 if size < 1 << 11 else 256 if size < 1 << 13 else 1024 if size < 1 << 17 else 4096


def sketches(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """How many shingles of each set are in each class, as numbers of 16 bits (counts beyond that stay at the end of the scale)."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        many = classes_of(b - a)
        # the values themselves decide on order and windows, so classes are of a hash of their own
        at = mixed(values[a:b] + np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(64 - many.bit_length() + 1)
        out.append(np.minimum(np.bincount(at.astype(np.int64), minlength=many), 65535).astype("<u2").tobytes())
    return out


def unlike(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference, by their sketches."""
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if len(x) != len(y):
        x, y = (v.reshape(min(len(x), len(y)), -1).sum(axis=1) for v in (x, y))
        if max(x.max(), y.max()) >= 65535:
            return 0
    return int(np.abs(x - y).sum())


def named(docs: DataFrame, key: str, sets: Sets) -> DataFrame:
    """(key, row, first, second, n_shingles, sketch) of every row; the hashes and the sketch are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in sets.each(batches):
            n = np.diff(offsets)
            both = [pa.array(h, pa.int64(), mask=n == 0) for h in numbers(values, offsets, sets.bits)]
            sketch = pa.array(sketches(values, offsets), pa.binary(), mask=n == 0)
            columns = [part.column("id"), part.column("row"), *both, pa.array(n), sketch]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "first", "second", "n_shingles", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), row_key(key, sets.text).alias("row"), sets.text)
    return rows.mapInArrow(run, f"id {kind}, row long, first long, second long, n_shingles long, sketch binary")


def crowded(docs: DataFrame, sets: Sets) -> np.ndarray:
    """The counted shingles that most sets hold, ascending: at least CROWD, and at most CROWDED of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, _ in sets.fresh(batches):
            shingle, n = np.unique(values[values < COUNTED], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    counts = docs.select(sets.text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= CROWD).orderBy(F.col("n").desc(), "shingle").limit(CROWDED)
    return np.sort(np.array([r["shingle"] for r in most.select("shingle").collect()], np.int64).view(np.uint64))


def windows(values: np.ndarray, offsets: np.ndarray, last: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The regions (first-level pivots) that each set is in, and the set's place in the batch; none where only equal sets can be near."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.where(values < COUNTED, 0, 1)
    if len(last):
        rank[last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values] = 2
    order = np.argsort(owner * 4 + rank, kind="stable")  # the values of a set are ascending
    within = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
    many = np.where(sizes * (100 - percent) >= percent, sizes * (100 - percent) // 100 + 1, 0)
    # the larger of two unlike sets has percent / (100 - percent) + 1 shingles at least, the smaller one less
    pick = within < many[owner]
    return values[order[pick]], owner[pick]


def ring(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Rings of sizes; of two sets that are near, the larger is in the same or the next."""
    return np.floor(np.log(sizes) / (math.log(100 / min(percent, 99)) * 1.0001)).astype(np.int64)


def region_rows(docs: DataFrame, sets: Sets, last: np.ndarray, percent: int) -> DataFrame:
    """(region, node, crowded): every set in the regions and rings of its window.

    Of a region with many sets of one batch only the least goes on, marked as ``crowded``, and each other one meets it in a region
    of their own; so the rows of a hot region are few for each batch.
    """
    held = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, values, offsets in sets.fresh(batches):
            pivot, owner = windows(values, offsets, held.value, percent)
            at = ring(np.diff(offsets), percent)[owner].view(np.uint64)
            region = np.concatenate([mixed(pivot * np.uint64(0x9E3779B97F4A7C15) + at - np.uint64(k)).view(np.int64) for k in (0, 1)])
            node = np.tile(nodes[owner], 2)
            order = np.lexsort((node, region))
            region, node = region[order], node[order]
            start, size = _runs(region)
            many = size > FEW
            first, long = np.repeat(start, size), np.repeat(many, size)
            crowd = long.copy()
            stays = ~long | (np.arange(len(region)) == first)
            pairs = np.unique(np.stack([node[first[~stays]], node[~stays]]), axis=1)
            own = mixed(mixed(pairs[0].view(np.uint64)) + pairs[1].view(np.uint64)).view(np.int64)
            columns = [np.concatenate([region[stays], np.repeat(own, 2)]), np.concatenate([node[stays], pairs.T.ravel()]), np.concatenate([crowd[stays], np.ones(2 * len(own), bool)])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["region", "node", "crowded"])

    return docs.select(sets.text).mapInArrow(run, "region long, node long, crowded boolean")


def _runs(region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal regions."""
    start = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(region) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(region)))


def _pairs(region: np.ndarray, node: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure) of whole regions in order of (region, node): all pairs of small ones, of others the least with each other one."""
    start, size = _runs(region)
    star = (size > FEW) | (np.logical_or.reduceat(crowded, start) if len(start) else np.zeros(0, bool))
    a, b, sure = [], [], []
    for n in np.unique(size[~star & (size > 1)]).tolist():
        left, right = np.triu_indices(n, 1)
        at = start[~star & (size == n)][:, None]
        a.append(node[at + left].ravel())
        b.append(node[at + right].ravel())
        sure.append(np.zeros(len(a[-1]), bool))
    first = np.repeat(start, size)
    rest = np.repeat(star, size) & (np.arange(len(region)) != first)
    a.append(node[first[rest]])
    b.append(node[rest])
    sure.append(np.ones(len(b[-1]), bool))
    return np.concatenate(a), np.concatenate(b), np.concatenate(sure)


def meetings(rows: DataFrame) -> DataFrame:
    """(a, b, sure) of all regions' sets. A stream in order of regions: a region that goes on is reduced to its least set meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

        def made(parts: tuple) -> pa.RecordBatch:
            a, b, sure = _pairs(*parts)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"])

        for batch in batches:
            new = (np.asarray(batch.column("region")), np.asarray(batch.column("node")), batch.column("crowded").to_numpy(zero_copy_only=False))
            region, node, crowded = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
            again = np.append(False, (region[1:] == region[:-1]) & (node[1:] == node[:-1]))
            if again.any():  # the same set from several tasks; what one of them says of the region holds
                crowded = np.logical_or.reduceat(crowded, np.flatnonzero(~again))
                region, node = region[~again], node[~again]
            start, size = _runs(region)
            if not len(start):
                continue
            if size[-1] > FEW:
                crowded[start[-1]] = True
                yield made((region, node, crowded))
                at = slice(start[-1], start[-1] + 1)
            else:
                at = slice(start[-1], None)
                yield made((region[: start[-1]], node[: start[-1]], crowded[: start[-1]]))
            held = (region[at], node[at], crowded[at])
        yield made(held)

    return rows.repartition("region").sortWithinPartitions("region", "node").mapInArrow(run, "a long, b long, sure boolean")


def met(rows: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs whose components hold all near pairs. Of a region of few sets the pairs that are not certainly far from each other,
    of a larger one the least set with each other one.
    """
    found = written(meetings(rows).distinct())
    return found.where("sure").select("a", "b").unionByName(maybe_near(found.where("not sure").select("a", "b"), names, percent))


def maybe_near(pairs: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that their sketches do not tell to be farther from each other than links reach."""
    one = names.where("node is not null").groupBy("node").agg(F.first("sketch").alias("sketch"), F.max("n_shingles").alias("n"))
    one = small(written(one))
    side = lambda s: one.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = [unlike(x.as_py(), y.as_py()) for x, y in zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)]
            total = np.asarray(batch.column("n_a")) + np.asarray(batch.column("n_b"))
            near = np.array(bound, np.int64) * (100 + percent) <= total * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def standing(docs: DataFrame, key: str, names: DataFrame, sets: Sets, clusters: DataFrame) -> DataFrame:
    """(region, node, weight, _set): the sets of all ``clusters``, each made once where one of its texts lies."""
    stands = names.join(clusters, "node").groupBy("node", "region").agg(F.min("row").alias("row"))
    rows = docs.select(row_key(key, sets.text).alias("row"), sets.text).join(small(written(stands)), "row").select("region", "node", sets.text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, offsets in sets.each(batches):
            # rows of other texts may have an equal key
            right = np.flatnonzero(sets.nodes(values, offsets) == np.asarray(part.column("node")))
            made = [values[offsets[i] : offsets[i + 1]].tobytes() for i in right.tolist()]
            weight = np.maximum(np.diff(offsets)[right], LIGHT)
            part = part.take(pa.array(right))
            columns = [part.column("region"), part.column("node"), pa.array(weight), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "node", "weight", "_set"])

    out = rows.mapInArrow(run, "region long, node long, weight long, _set binary")
    # repeated rows make a set again
    return out if names.groupBy("row").count().where("count > 1").isEmpty() else out.dropDuplicates(["node"])


class Pivots:
    """The pivots of one region, as postings of their shingles."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        rows = sorted(dict(rows).items())
        self.nodes = np.array([n for n, _ in rows], np.int64)
        self.sizes = np.array([len(s) for _, s in rows], np.int64)
        flat = np.concatenate([s for _, s in rows])
        order = np.argsort(flat, kind="stable")
        self.values, start = np.unique(flat[order], return_index=True)
        self.owner, self.bounds = np.repeat(np.arange(len(rows)), self.sizes)[order], np.append(start, len(flat))
        #: pivots that are far from all others of the kind before them
        self.apart: list[int] = []
        for i, (_, s) in enumerate(rows):
            if (self.distances(s)[1][self.apart] >= APART).all():
                self.apart.append(i)

    def distances(self, set_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the common parts with all pivots, and the distances to them."""
        at = np.searchsorted(self.values, set_)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == set_)]
        low, many = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        common = np.bincount(self.owner[place], minlength=len(self.nodes))
        return common, 1 - common / (self.sizes + len(set_) - common)


def places(distance: np.ndarray, radius: float) -> list[tuple[int, bool]]:
    """(pivot, whether it is home) of a set at these distances from the pivots that make regions; -1 is the outside."""
    near, far, slack = int(np.argmin(distance)), 1 - radius, 1e-9
    least = distance[near]
    home = near if least < far else -1
    # what belongs to a pivot is nearer than 1 - r to it, so what has nothing in common with a pivot is not near that
    window = (distance <= least + 2 * radius + slack) & (distance < 1)
    out = [(int(p), int(p) == home) for p in np.flatnonzero(window)]
    if least >= far - radius - slack:
        out.append((-1, home == -1))
    return out


def cut(regions: DataFrame, percent: int, level: int) -> DataFrame:
    """One level of Voronoi regions: rows (region, node, weight, probe, was, _set, parent) of the parts, and links (a, b) of what is near a pivot.

    ``regions``: region, node, group, weight, probe, outside, outsiders (the weight of all that is outside the largest
    group), total, many (rows that are outside), _set. Members are dealt by hash; every task of a region has its pivots.
    """
    radius, lot = 1 - percent / 100, F.xxhash64("node", F.lit(100 + level))
    wanted = F.least(F.lit(PIVOTS), F.ceil(8 * F.col("outsiders") / F.lit(BLOCK)) + 4)
    pivots = regions.where("outside").where(F.pmod(lot, F.col("many")) < wanted)
    tasks = F.ceil(F.col("total") / F.lit(BLOCK)).cast("int")
    dealt = pivots.withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1))).withColumn("member", F.lit(False))
    dealt = dealt.unionByName(regions.withColumn("task", F.pmod(lot, tasks).cast("int")).withColumn("member", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, pivots, out = None, [], None, []
        for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            columns = (batch.column(c).to_pylist() for c in ("region", "task", "member", "node", "weight", "probe", "outsiders", "_set"))
            for region, task, member, node, weight, probe, outsiders, raw in zip(*columns, strict=True):
                if (region, task) != now:
                    now, found, pivots = (region, task), [], None
                set_ = np.frombuffer(raw, np.uint64)
                if not member:
                    found.append((node, set_))
                    continue
                pivots = pivots or (Pivots(found) if found else None)
                if pivots is None:  # by chance no set has become a pivot: all is outside
                    out.append((_child(region, None), node, weight, probe, outsiders, raw, None, None, region))
                    continue
                common, distance = pivots.distances(set_)
                close = 100 * common >= percent * (pivots.sizes + len(set_) - common)
                out += [(None, None, None, None, None, None, int(p), node, None) for p in pivots.nodes[close] if p != node]
                for p, home in places(distance[pivots.apart], radius):
                    child = _child(region, None if p < 0 else int(pivots.nodes[pivots.apart[p]]))
                    out.append((child, node, weight, probe and home, outsiders, raw, None, None, region))
            yield _parts(out)
            out = []

    rows = dealt.select("region", "task", "member", "node", "weight", "probe", "outsiders", "_set")
    return rows.repartition("region", "task").sortWithinPartitions("region", "task", "member").mapInArrow(run, _PARTS)


_PARTS = "region long, node long, weight long, probe boolean, was long, _set binary, a long, b long, parent long"


def _child(region: int, pivot: int | None) -> int:
    name = np.array([region, 0 if pivot is None else pivot, pivot is None], np.int64).view(np.uint64)
    return int(mixed(mixed(mixed(name[:1]) + name[1:2]) + name[2:]).view(np.int64)[0])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PARTS.split(", ")])


def grouped(parts: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``parts`` with each set's group and, by region: total, outsiders, many, and whether a row is outside the largest group. Regions of one group go."""
    if groups is not None:
        parts = parts.join(small(groups.withColumnsRenamed({"root": "_root"})), "node", "left").withColumn("group", F.coalesce("_root", "node")).drop("_root")
        parts = written(parts)
    else:
        parts = parts.withColumn("group", F.col("node"))
    by = parts.groupBy("region", "group").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    per = by.groupBy("region").agg(F.sum("w").alias("total"), F.max(F.struct("w", "group", "n")).alias("main"), F.sum("n").alias("n"))
    per = per.select("region", "total", F.col("main.group").alias("main"), (F.col("total") - F.col("main.w")).alias("outsiders"), (F.col("n") - F.col("main.n")).alias("many"))
    per = written(per.where("outsiders > 0"))
    return parts.join(small(per), "region").withColumn("outside", F.col("group") != F.col("main")).drop("main")


def tasks(regions: DataFrame, settled: bool) -> DataFrame:
    """(task, node, group, probe, _set): pieces of regions such that each pair of an outsider and another set is in one.

    A region of a block's weight is a task. Else the largest group is dealt to blocks and all outsiders to every block;
    where even the outsiders are too many (``settled`` is false), they are dealt too, and blocks meet block by block.
    """
    whole, half = F.col("total") <= BLOCK, F.lit(BLOCK // 2)
    blocks = F.when(whole, F.lit(1)).otherwise(F.ceil((F.col("total") - F.col("outsiders")) / half)).cast("int")
    packs = F.lit(1) if settled else F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("outsiders") / half)).cast("int")
    lot = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    base = regions.withColumn("blocks", blocks).withColumn("packs", packs)
    task = lambda kind: F.xxhash64("region", F.lit(kind), "block", "pack").alias("task")
    out = lambda df, kind: df.select(task(kind), "node", "group", "probe", "_set")
    main = base.where("not outside").withColumn("block", lot(F.col("blocks"), 3)).withColumn("pack", F.explode(every(F.col("packs"))))
    mine = lot(F.col("packs"), 5)
    beside = base.where("outside").withColumn("pack", mine).withColumn("block", F.explode(every(F.col("blocks"))))
    both = out(main.unionByName(beside), "main")
    if settled:
        return both
    # outsiders of pack i and of pack j meet in (i, j), the lesser first
    ends = F.transform(every(F.col("packs")), lambda j: F.struct(F.least(F.col("own"), j).alias("block"), F.greatest(F.col("own"), j).alias("pack")))
    pairs = base.where("outside and packs > 1").withColumn("own", mine).withColumn("end", F.explode(ends))
    return both.unionByName(out(pairs.withColumn("block", F.col("end.block")).withColumn("pack", F.col("end.pack")), "packs"))


def links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose components are those of all links between ``members`` (region, node, weight, _set) of one region."""
    start = members.select("region", "node", "weight", F.lit(True).alias("probe"), F.lit(None).cast("long").alias("was"), "_set")
    regions, found, level, stars = grouped(start, None), [], 0, None
    while True:
        ready = (F.col("total") <= BLOCK) | (F.col("outsiders") <= BLOCK // 2)
        found.append(confirmed(tasks(regions.where(ready), True), percent))
        rest = regions.where(~ready)
        stuck = F.coalesce(F.col("outsiders") > 0.8 * F.col("was"), F.lit(False))
        if not (same := rest.where(stuck)).isEmpty():
            found.append(confirmed(tasks(same, False), percent))
        rest = rest.where(~stuck)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level += 1
        parts = written(cut(rest, percent, level))
        near = parts.where("a is not null").select("a", "b").distinct()
        found.append(near)
        groups = components(near if stars is None else near.unionByName(stars))
        stars = groups.select(F.col("root").alias("a"), F.col("node").alias("b"))
        placed = parts.where("a is null").drop("a", "b")
        total = rest.groupBy("region").agg(F.first("total").alias("total")).withColumnsRenamed({"region": "parent"})
        wide = placed.groupBy("parent").agg(F.sum("weight").alias("placed")).join(total, "parent").where(F.col("placed") > SPREAD * F.col("total"))
        wide = small(written(wide.select("parent")))
        same = rest.select(*start.columns).join(wide.withColumnRenamed("parent", "region"), "region", "left_semi")
        if not wide.isEmpty():
            found.append(confirmed(tasks(grouped(same, groups), False), percent))
        regions = grouped(placed.join(wide, "parent", "left_anti").select(*start.columns), groups)


def joined(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_shingles``, ``component_id`` (the least ``key`` reachable by links).

    ``bits`` is for tests: how many bits of the first of the two hashes of a set are used.
    """
    docs = picked(docs, key, text)
    names = written(named(docs, key, Sets(words, text, bits)))
    # numbers that several sets share: about n * n / 2**65 of n
    twice = names.groupBy("first").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a < b").select("first").collect()
    twice = np.array([r["first"] for r in twice], np.int64)
    sets = Sets(words, text, bits, twice)
    node = F.when(F.col("first").isin(twice.tolist()), F.col("second")).otherwise(F.col("first")) if len(twice) else F.col("first")
    names = names.withColumn("node", node)
    last = crowded(docs, sets)
    rows = region_rows(docs, sets, last, percent)
    clusters = components(met(rows, names, percent)).withColumnRenamed("root", "region")
    members = written(standing(docs, key, names, sets, clusters))
    classes = components(links(members, percent))
    all_ = names.join(small(classes), "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = all_.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    out = all_.join(small(written(least)), "class", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
