"""Polygons with holes as tables of edges: overlay, dissolve, buffer and points inside, over cells of a grid.

Everything is one operation, ``region``: of the closed rings of a group (turning
counter-clockwise around what they hold, holes the other way) the border of all
places that are wound around at least k times. With one polygon's rings k = 1
cleans crossings of its own, with a class's polygons it is their union, with two
polygons k = 2 is their intersection, with an offset curve it is a buffer.

Edges are cut where they cross, touch or lie on each other: pairs meet in the cells
that they run through. Equal pieces become one with the sum of their directions,
so what is passed both ways cancels. How often the place beside a piece is wound
around is found without leaving its cell: the sum over the cell's own pieces
between the piece's middle and the cell's corner, plus the corner's number, a running
sum along the cell's lower line. A piece is border where its two sides differ.
So no task holds a polygon or a group, however large; a crowded cell is a hot key of
a join, which adaptive execution splits. Only a finished ring is a row.

Coordinates are rounded to UNIT, points nearer than NEAR are one. Columns ``by``
name the group; an edge has x0, y0, x1, y1. Null rings and rings of fewer than
three corners have no edges; repeated polygons count as often as they come, which
changes a union not at all; an empty table gives an empty one.
"""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .graph import components
from .spatial import BOX, box_join

#: A power of two, so that rounding to it is exact; and how near is equal.
UNIT = 2.0**-34
NEAR = 4 * UNIT
EDGE = ("x0", "y0", "x1", "y1")
#: Cells' origin, in cells: off the whole and half numbers that coordinates like to have.
_ORIGIN = 0.3819660112501051

c = F.col


def snapped(x: Column) -> Column:
    return F.rint(x / UNIT) * UNIT + 0.0  # no negative zero


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_edges(rings: DataFrame, by: Sequence[str], ring: str = "ring", hole: str = "hole") -> DataFrame:
    """(by, EDGE) of rows with a ring of (x, y) structs, closed or open, and whether it is a hole; rings may turn either way."""
    at = F.transform(ring, lambda p: point(snapped(p["x"].cast("double")), snapped(p["y"].cast("double"))))
    rows = rings.where(F.size(ring) >= 3).select(*by, c(hole).alias("_hole"), at.alias("_at"))
    nxt = lambda i: F.try_element_at("_at", i % F.greatest(F.size("_at"), F.lit(1)) + 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_at") - 1), lambda i: F.struct(nxt(i).alias("a"), nxt(i + 1).alias("b")))
    twice = F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])
    rows = rows.withColumn("_pairs", pairs).withColumn("_turn", (twice > 0) == ~F.coalesce("_hole", F.lit(False)))
    # outer, though never empty: for an inner explode Spark tests the arrays beforehand and makes all of them anew in every step
    p = rows.select(*by, "_turn", F.explode_outer("_pairs").alias("_p"))
    way = lambda i, j, k: F.when(c("_turn"), c(f"_p.{i}.{k}")).otherwise(c(f"_p.{j}.{k}"))
    out = p.select(*by, way("a", "b", "x").alias("x0"), way("a", "b", "y").alias("y0"), way("b", "a", "x").alias("x1"), way("b", "a", "y").alias("y1"))
    return out.where("x0 != x1 or y0 != y1")


def _merged(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges from left to right (or upwards), equal ones as one with ``m``, how much more often it runs that way than back."""
    ahead = (c("x0") < c("x1")) | ((c("x0") == c("x1")) & (c("y0") < c("y1")))
    ends = [F.when(ahead, c(a)).otherwise(c(b)).alias(a) for a, b in zip(EDGE, ("x1", "y1", "x0", "y0"), strict=True)]
    m = F.when(ahead, c("m")).otherwise(-c("m")) if "m" in edges.columns else F.when(ahead, 1).otherwise(-1)
    return edges.select(*by, *ends, m.cast("long").alias("m")).groupBy(*by, *EDGE).agg(F.sum("m").alias("m")).where("m != 0")


def _line(i: Column, cell: float) -> Column:
    return (i + _ORIGIN) * cell


def _index(x: Column, cell: float) -> Column:
    return F.floor(x / cell - _ORIGIN).cast("long")


def _at_y(y: Column) -> Column:
    """x of an edge at a height; an end's own where it is level with it."""
    return F.when(y == c("y0"), c("x0")).when(y == c("y1"), c("x1")).otherwise(c("x0") + (y - c("y0")) * (c("x1") - c("x0")) / F.nullif(c("y1") - c("y0"), F.lit(0.0)))


def _at_x(x: Column) -> Column:
    return F.when(c("y0") == c("y1"), c("y0")).otherwise(c("y0") + (x - c("x0")) * (c("y1") - c("y0")) / F.nullif(c("x1") - c("x0"), F.lit(0.0)))


def _in_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Edges with every cell (cx, cy) that they run through or come near to."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumn("cy", F.explode(F.sequence(_index(low - NEAR, cell), _index(high + NEAR, cell))))
    flat = c("y0") == c("y1")
    a, b = _at_y(F.greatest(low, _line(c("cy"), cell))), _at_y(F.least(high, _line(c("cy") + 1, cell)))
    # where a row is only come near to, its line may be outside of the edge
    inside = lambda x: F.greatest(c("x0"), F.least(c("x1"), x))
    left, right = F.when(flat, c("x0")).otherwise(inside(F.least(a, b))), F.when(flat, c("x1")).otherwise(inside(F.greatest(a, b)))
    slack = NEAR + cell * 1e-9
    return rows.withColumn("cx", F.explode(F.sequence(_index(left - slack, cell), _index(right + slack, cell))))


#: Of a pair of edges the names of each one's ends.
_BOTH = ((("x0", "y0"), ("x1", "y1")), (("x0_b", "y0_b"), ("x1_b", "y1_b")))


def _parted(a: tuple, b: tuple, near: float) -> Column:
    """Whether both ends of ``b`` lie on one side of ``a``, farther than ``near``."""
    size = near * F.sqrt((c(a[1][0]) - c(a[0][0])) ** 2 + (c(a[1][1]) - c(a[0][1])) ** 2)
    side = lambda p: (c(a[1][0]) - c(a[0][0])) * (c(p[1]) - c(a[0][1])) - (c(a[1][1]) - c(a[0][1])) * (c(p[0]) - c(a[0][0]))
    s, t = side(b[0]), side(b[1])
    return ((s > size) & (t > size)) | ((s < -size) & (t < -size))


def _span(k: str, near: float) -> Column:
    """Whether the edges of a pair are farther than ``near`` from each other along x or y."""
    return (F.greatest(f"{k}0", f"{k}1") + near < F.least(f"{k}0_b", f"{k}1_b")) | (F.greatest(f"{k}0_b", f"{k}1_b") + near < F.least(f"{k}0", f"{k}1"))


def _cuts(edges: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """(by, EDGE, cut): points inside of an edge where another crosses or touches it, or ends or begins on it."""
    cells = _in_cells(edges.drop("m"), cell)
    other = cells.withColumnsRenamed({k: f"{k}_b" for k in EDGE})
    first = F.lit(False)
    for k in reversed(EDGE):
        first = (c(k) < c(f"{k}_b")) | ((c(k) == c(f"{k}_b")) & first)
    # most pairs of a cell are far from each other, which costs little to see; all of the rest in one join condition would be a method too long to be compiled
    pairs = cells.join(other, [*by, "cx", "cy"]).where(~_span("x", 2 * NEAR) & ~_span("y", 2 * NEAR) & first).select(*by, *EDGE, *[f"{k}_b" for k in EDGE])
    kinds = "".join(f"{k} {edges.schema[k].dataType.simpleString()}, " for k in [*by, *EDGE])
    return pairs.mapInArrow(lambda batches: map(_met, batches), f"{kinds}cut struct<x:double,y:double>")


def _met(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of a batch of pairs of edges the cuts that one makes in the other."""
    col = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names[-8:]}
    a0, a1, b0, b1 = ((col[f"x{i}{side}"], col[f"y{i}{side}"]) for side in ("", "_b") for i in (0, 1))
    r, s, q = ((p[0] - o[0], p[1] - o[1]) for o, p in ((a0, a1), (b0, b1), (a0, b0)))
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1]
    close = lambda o, p: (np.abs(o[0] - p[0]) <= NEAR) & (np.abs(o[1] - p[1]) <= NEAR)

    def on(p: tuple, o: tuple, e: tuple, d: tuple) -> np.ndarray:
        """Whether a point lies on an edge but not at its ends."""
        v = (p[0] - o[0], p[1] - o[1])
        along = dot(v, d)
        return (np.abs(cross(d, v)) <= NEAR * np.sqrt(dot(d, d))) & (along > 0) & (along < dot(d, d)) & ~close(p, o) & ~close(p, e)

    with np.errstate(all="ignore"):
        den = cross(r, s)
        t, u = cross(q, s) / den, cross(q, r) / den
        x = tuple(np.rint((o + t * w) / UNIT) * UNIT + 0.0 for o, w in zip(a0, r, strict=True))
        across = (t > 0) & (t < 1) & (u > 0) & (u < 1) & ~(close(x, a0) | close(x, a1) | close(x, b0) | close(x, b1))
        found = [(on(b0, a0, a1, r), "", b0), (on(b1, a0, a1, r), "", b1), (on(a0, b0, b1, s), "_b", a0), (on(a1, b0, b1, s), "_b", a1), (across, "", x), (across, "_b", x)]
    at = [(np.flatnonzero(which), side, p) for which, side, p in found]
    rows = pa.array(np.concatenate([i for i, _, _ in at]))
    by = [c_.take(rows) for c_ in batch.columns[:-8]]
    ends = [pa.array(np.concatenate([col[f"{k}{side}"][i] for i, side, _ in at])) for k in EDGE]
    cut = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k][i] for i, _, p in at])) for k in (0, 1)], ["x", "y"])
    return pa.RecordBatch.from_arrays([*by, *ends, cut], [*batch.schema.names[:-8], *EDGE, "cut"])


def pieces(edges: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """(by, EDGE, m): the edges cut at all crossings, equal pieces as one."""
    edges = written(_merged(edges, by))
    none = F.lit(None).cast("struct<x:double,y:double>").alias("cut")
    all_ = edges.select(*by, *EDGE, "m", none).unionByName(_cuts(edges, by, cell).withColumn("m", F.lit(None).cast("long")))
    whole = all_.groupBy(*by, *EDGE).agg(F.max("m").alias("m"), F.collect_set("cut").alias("cuts"))
    d = (c("x1") - c("x0"), c("y1") - c("y0"))
    along = lambda p: (p["x"] - c("x0")) * d[0] + (p["y"] - c("y0")) * d[1]
    mid = F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    ends = [point(c("x0"), c("y0")), point(c("x1"), c("y1"))]
    way = F.concat(F.array(ends[0]), F.transform(mid, lambda p: point(p["x"], p["y"])), F.array(ends[1]))
    whole = whole.select(*by, "m", way.alias("way"))
    step = F.transform(F.sequence(F.lit(1), F.size("way") - 1), lambda i: F.struct(F.element_at("way", i).alias("a"), F.element_at("way", i + 1).alias("b")))
    cut = whole.select(*by, "m", F.explode_outer(step).alias("s")).select(*by, c("s.a.x").alias("x0"), c("s.a.y").alias("y0"), c("s.b.x").alias("x1"), c("s.b.y").alias("y1"), "m")
    return _merged(cut.where("x0 != x1 or y0 != y1"), by)


def corners(cut: DataFrame, cells: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """(by, cx, cy, corner): how often the lower right corner of every cell of ``cells`` is wound around.

    The number is the sum over the edges that cross the cell's lower line farther to the right.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = cut.where(low < high).withColumn("cy", F.explode(F.sequence(_index(low, cell), _index(high, cell) + 1)))
    line = _line(c("cy"), cell)
    rows = rows.where((low <= line) & (line < high))
    up = F.when(c("y1") > c("y0"), c("m")).otherwise(-c("m"))
    crossed = rows.select(*by, "cy", _index(_at_y(line), cell).alias("cx"), up.alias("s")).groupBy(*by, "cy", "cx").agg(F.sum("s").alias("s"))
    need = cells.select(*by, "cy", "cx").distinct().withColumn("s", F.lit(0).cast("long")).withColumn("need", F.lit(True))
    both = crossed.withColumn("need", F.lit(False)).unionByName(need)
    right = Window.partitionBy(*by, "cy").orderBy(-c("cx")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("corner", F.coalesce(F.sum("s").over(right), F.lit(0))).where("need").select(*by, "cx", "cy", "corner")


def _beside(px: Column, py: Column, cell: float, own: Column) -> Column:
    """What an edge of the cell adds to the corner's number on the way to a point: along the cell's right side, then to the left."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    side, floor = _line(c("cx") + 1, cell), _line(c("cy"), cell)
    x, y = _at_y(py), _at_x(side)
    up = F.when(c("y1") > c("y0"), c("m")).otherwise(-c("m"))
    across = F.when(~own & (low <= py) & (py < high) & (x > px) & (x <= side), up).otherwise(0)
    along = F.when((c("x0") <= side) & (side < c("x1")) & (y > floor) & (y <= py), c("m")).otherwise(0)
    return across + along


def region(edges: DataFrame, by: Sequence[str], k: int, cell: float) -> DataFrame:
    """(by, EDGE): the border of what the rings of a group wind around at least k times, as edges with that on their left.

    ``cell`` is the size of the cells, a few edges' length.
    """
    by = list(by)
    cut = written(pieces(edges, by, cell))
    cells = _in_cells(cut, cell)  # several rows an edge, made again rather than written
    corner = corners(cut, cells, by, cell)
    mx, my = ((c(a) + c(b)) / 2 for a, b in (("x0", "x1"), ("y0", "y1")))
    mine = cut.select(*by, *[c(e).alias(f"{e}_") for e in EDGE], c("m").alias("m_"), mx.alias("px"), my.alias("py"), _index(mx, cell).alias("cx"), _index(my, cell).alias("cy"))
    near = mine.join(cells, [*by, "cx", "cy"])
    own = (c("x0") == c("x0_")) & (c("y0") == c("y0_")) & (c("x1") == c("x1_")) & (c("y1") == c("y1_"))
    local = near.groupBy(*by, "cx", "cy", *[f"{e}_" for e in EDGE], "m_").agg(F.sum(_beside(c("px"), c("py"), cell, own)).alias("w"))
    wound = local.join(corner, [*by, "cx", "cy"]).withColumn("w", c("w") + c("corner"))
    rising = c("y1_") > c("y0_")  # then the place found is on the right of the piece, else on its left
    left, right = F.when(rising, c("w") + c("m_")).otherwise(c("w")), F.when(rising, c("w")).otherwise(c("w") - c("m_"))
    sides = wound.select(*by, *[f"{e}_" for e in EDGE], (left >= k).alias("l"), (right >= k).alias("r")).where("l != r")
    ends = [F.when(c("l"), c(f"{a}_")).otherwise(c(f"{b}_")).alias(a) for a, b in zip(EDGE, ("x1", "y1", "x0", "y0"), strict=True)]
    return sides.select(*by, *ends)


def area(border: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, area) of a border's groups."""
    return border.groupBy(*by).agg((F.sum(c("x0") * c("y1") - c("x1") * c("y0")) / 2).alias("area"))


def rings(border: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ring, area): the closed rings of a border, their corners as (x, y) structs; holes have a negative area.

    A border's edge goes on in the one that turns left most sharply, so rings that touch in a point are two. Which
    edges make a ring is found by joining neighbours, and only one ring at a time is put in order.
    """
    by = list(by)
    name = F.xxhash64(*by, *EDGE)
    edges = written(border.withColumn("edge", name))
    after = edges.select(*by, c("x0").alias("x1"), c("y0").alias("y1"), c("x1").alias("x2"), c("y1").alias("y2"), c("edge").alias("next"))
    back, out = F.atan2(c("y0") - c("y1"), c("x0") - c("x1")), F.atan2(c("y2") - c("y1"), c("x2") - c("x1"))
    turn = back - out
    turn = F.when(turn <= 0, turn + 2 * 3.141592653589793).otherwise(turn)
    one = edges.join(after, [*by, "x1", "y1"]).groupBy(*by, *EDGE, "edge").agg(F.min_by(F.struct("x2", "y2", "next"), turn).alias("n"))
    one = written(one.select(*by, *EDGE, "edge", c("n.x2").alias("x2"), c("n.y2").alias("y2"), c("n.next").alias("next")))
    # two edges may have one name: their rings are one part then, which ``_chained`` takes apart
    part = components(one.select(c("edge").alias("a"), c("next").alias("b"))).withColumnsRenamed({"node": "edge", "root": "part"})
    whole = one.join(part, "edge").select(*by, "part", *EDGE, "x2", "y2")
    parts = whole.groupBy(*by, "part").agg(F.collect_list(F.struct(*EDGE, "x2", "y2")).alias("_edges")).drop("part")
    kinds = "".join(f"{b} {border.schema[b].dataType.simpleString()}, " for b in by)
    return parts.mapInArrow(lambda batches: map(_in_order, batches), f"{kinds}ring array<struct<x:double,y:double>>, area double")


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for every ring of a batch's parts."""
    parts = batch.column("_edges")
    edges = list(zip(*[f.to_pylist() for f in parts.flatten().flatten()], strict=True))
    of, areas, corners_, ends, at = [], [], [], [0], 0
    for i, n in enumerate(pc.list_value_length(parts).to_pylist()):
        for ring, size in _chained(edges[at : at + n]):
            of.append(i)
            areas.append(size)
            corners_ += ring
            ends.append(len(corners_))
        at += n
    xy = pa.StructArray.from_arrays([pa.array([p[k] for p in corners_], pa.float64()) for k in (0, 1)], ["x", "y"])
    rows = batch.drop_columns(["_edges"]).take(pa.array(of, pa.int64()))
    ring = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), xy)
    return pa.RecordBatch.from_arrays([*rows.columns, ring, pa.array(areas, pa.float64())], [*rows.schema.names, "ring", "area"])


def _chained(edges: list[tuple]) -> Iterator[tuple[list[tuple], float]]:
    """The rings of a part from their least corner on, without corners on straight lines, and their areas."""
    after = {e[:4]: e[4:] for e in edges}
    for edge in sorted(after):
        if edge not in after:
            continue
        ring = [edge[:2]]
        while (nxt := after.pop(edge, None)) is not None:
            ring.append(edge[2:])
            edge = (*edge[2:], *nxt)
        ring = _bent(ring[:-1])
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        yield [*ring, ring[0]], twice / 2


def _bent(ring: list[tuple]) -> list[tuple]:
    """The corners at which a ring turns."""

    def turns(a: tuple, b: tuple, d: tuple) -> bool:
        u, v = (b[0] - a[0], b[1] - a[1]), (d[0] - b[0], d[1] - b[1])
        size = max(abs(u[0]), abs(u[1])) + max(abs(v[0]), abs(v[1]))
        return abs(u[0] * v[1] - u[1] * v[0]) > 2 * NEAR * size

    kept = [b for a, b, d in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if turns(a, b, d)]
    return kept if len(kept) > 2 else ring


def bounds(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, BOX) of groups of edges."""
    low, high = lambda k: F.min(F.least(f"{k}0", f"{k}1")), lambda k: F.max(F.greatest(f"{k}0", f"{k}1"))
    return edges.groupBy(*by).agg(low("x").alias(BOX[0]), low("y").alias(BOX[1]), high("x").alias(BOX[2]), high("y").alias(BOX[3]))


def overlay(left: DataFrame, right: DataFrame, key: str, on: Sequence[str], cell: float, boxes: float) -> DataFrame:
    """(on, key_1, key_2, EDGE, touching): the borders of the common parts of polygons of the two sides with equal ``on``.

    ``left`` and ``right`` are edges (on, key, EDGE). A pair that only touches has one row, without an edge. ``boxes`` is the size of the
    cells in which bounding boxes meet, ``cell`` that for edges.
    """
    on = list(on)
    keys = [f"{key}_1", f"{key}_2"]
    by = [*on, *keys]

    def box(edges: DataFrame, s: str) -> DataFrame:
        out = bounds(edges, [*on, key])
        return out.withColumnsRenamed({n: f"{n}{s}" for n in [*on, key, *BOX]})

    names = [tuple(f"{n}{s}" for n in BOX) for s in ("_1", "_2")]
    pairs = box_join(box(left, "_1"), box(right, "_2"), *names, boxes, [(f"{o}_1", f"{o}_2") for o in on])
    pairs = written(pairs.select(*[c(f"{o}_1").alias(o) for o in on], *keys))
    mine = left.withColumnRenamed(key, keys[0]).join(pairs, [*on, keys[0]])
    theirs = right.withColumnRenamed(key, keys[1]).join(pairs, [*on, keys[1]])
    both = written(mine.select(*by, *EDGE).withColumn("side", F.lit(1)).unionByName(theirs.select(*by, *EDGE).withColumn("side", F.lit(2))))
    common = written(region(both.drop("side"), by, 2, cell))
    # most pairs have something in common: only the others' edges are looked at again
    meet = _touching(both.join(common.select(*by).distinct(), by, "left_anti"), by, cell)
    return common.withColumn("touching", F.lit(False)).unionByName(meet.withColumn("touching", F.lit(True)), allowMissingColumns=True)


def _touching(both: DataFrame, by: list[str], cell: float) -> DataFrame:
    """(by) of the pairs of which an edge of one side has a point in common with one of the other."""
    ahead = (c("x0") < c("x1")) | ((c("x0") == c("x1")) & (c("y0") < c("y1")))
    ends = [F.when(ahead, c(a)).otherwise(c(b)).alias(a) for a, b in zip(EDGE, ("x1", "y1", "x0", "y0"), strict=True)]
    cells = _in_cells(both.select(*by, "side", *ends), cell)
    other = cells.where("side = 2").withColumnsRenamed({k: f"{k}_b" for k in EDGE}).drop("side")
    pairs = cells.where("side = 1").join(other, [*by, "cx", "cy"])
    return pairs.where(~_span("x", NEAR) & ~_span("y", NEAR)).where(~_parted(*_BOTH, NEAR) & ~_parted(*_BOTH[::-1], NEAR)).select(*by).distinct()


def points_inside(points: DataFrame, edges: DataFrame, by: Sequence[str], cell: float, x: str = "x", y: str = "y", condition: Column | None = None) -> DataFrame:
    """``points`` with ``by`` of every polygon that they are inside of (a point on a border may be either) and that meets ``condition`` (of ``by`` and the points' columns).

    ``edges`` have what they hold on their left. A polygon is prepared once: its edges by cell, and the numbers of the corners of these cells and of those between.
    """
    by = list(by)
    cut = written(_merged(edges, by))
    cells = written(_in_cells(cut, cell))
    corner = written(corners(cut, cells, by, cell))
    at = points.withColumn("cx", _index(c(x), cell)).withColumn("cy", _index(c(y), cell))
    allowed = F.lit(True) if condition is None else condition
    near = at.join(corner, ["cx", "cy"]).where(allowed)
    shape = cells.groupBy(*by, "cx", "cy").agg(F.collect_list(F.struct(*EDGE, "m")).alias("_edges"))
    near = near.join(shape, [*by, "cx", "cy"])
    side, floor = _line(c("cx") + 1, cell), _line(c("cy"), cell)

    def adds(e: Column) -> Column:
        y_at = lambda v: e["y0"] + (v - e["x0"]) * (e["y1"] - e["y0"]) / F.nullif(e["x1"] - e["x0"], F.lit(0.0))
        x_at = e["x0"] + (c(y) - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))
        low, high = F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"])
        up = F.when(e["y1"] > e["y0"], e["m"]).otherwise(-e["m"])
        across = F.when((low <= c(y)) & (c(y) < high) & (x_at > c(x)) & (x_at <= side), up).otherwise(0)
        along = F.when((e["x0"] <= side) & (side < e["x1"]) & (y_at(side) > floor) & (y_at(side) <= c(y)), e["m"]).otherwise(0)
        return across + along

    wound = c("corner") + F.aggregate("_edges", F.lit(0).cast("long"), lambda s, e: s + adds(e))
    beside = near.where(wound > 0).select(*by, *points.columns)
    # cells without edges between two of a row: all of such a cell is as its neighbour's corner on the left
    gap = corner.withColumn("_to", F.lead("cx").over(Window.partitionBy(*by, "cy").orderBy("cx"))).where("corner > 0 and _to > cx + 1")
    inner = gap.select(*by, F.explode(F.sequence(c("cx") + 1, c("_to") - 1)).alias("cx"), "cy")
    return beside.unionByName(at.join(inner, ["cx", "cy"]).where(allowed).select(*by, *points.columns))


def offset_edges(edges: DataFrame, by: Sequence[str], d: float, steps: int = 16) -> DataFrame:
    """(by, EDGE): the curve at distance d on the right of rings, whose ``region`` with k = 1 is the buffer (d < 0 shrinks).

    ``edges`` are those of valid polygons. Every edge is moved aside; at a corner that turns left for d > 0 an arc of ``steps``
    edges a quarter joins them, at one that turns right the corner itself does: loops turn backwards there and have no number.
    """
    by = list(by)
    after = edges.select(*by, c("x0").alias("x1"), c("y0").alias("y1"), c("x1").alias("x2"), c("y1").alias("y2"))
    back, out = F.atan2(c("y0") - c("y1"), c("x0") - c("x1")), F.atan2(c("y2") - c("y1"), c("x2") - c("x1"))
    turn = F.when(back - out <= 0, back - out + 2 * 3.141592653589793).otherwise(back - out)
    rows = edges.join(after, [*by, "x1", "y1"]).groupBy(*by, *EDGE).agg(F.min_by(F.struct("x2", "y2"), turn).alias("n"))
    rows = rows.select(*by, *EDGE, c("n.x2").alias("x2"), c("n.y2").alias("y2"))
    moved = lambda x0, y0, x1, y1: ((y1 - y0) / F.hypot(x1 - x0, y1 - y0) * d, (x0 - x1) / F.hypot(x1 - x0, y1 - y0) * d)
    n0, n1 = moved(*map(c, EDGE)), moved(c("x1"), c("y1"), c("x2"), c("y2"))
    rows = rows.withColumns({"ax": n0[0], "ay": n0[1], "bx": n1[0], "by_": n1[1]})
    cross, dot = c("ax") * c("by_") - c("ay") * c("bx"), c("ax") * c("bx") + c("ay") * c("by_")
    angle = F.atan2(cross, dot)
    bulges = (angle > 0) if d > 0 else (angle < 0)
    many = F.greatest(F.lit(1), F.ceil(F.abs(angle) * (2 * steps) / 3.141592653589793)).cast("int")
    start = F.atan2("ay", "ax")
    size = abs(d)
    on_arc = lambda i: point(snapped(c("x1") + size * F.cos(start + angle * i / many)), snapped(c("y1") + size * F.sin(start + angle * i / many)))
    arc = F.when(many > 1, F.transform(F.sequence(F.lit(1), F.greatest(many - 1, F.lit(1))), on_arc)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    joint = F.when(bulges, arc).otherwise(F.array(point(c("x1"), c("y1"))))
    p = lambda x, y, dx, dy: point(snapped(c(x) + c(dx)), snapped(c(y) + c(dy)))
    way = F.concat(F.array(p("x0", "y0", "ax", "ay"), p("x1", "y1", "ax", "ay")), joint, F.array(p("x1", "y1", "bx", "by_")))
    rows = rows.select(*by, way.alias("way"))
    step = F.transform(F.sequence(F.lit(1), F.size("way") - 1), lambda i: F.struct(F.element_at("way", i).alias("a"), F.element_at("way", i + 1).alias("b")))
    out_ = rows.select(*by, F.explode_outer(step).alias("s")).select(*by, c("s.a.x").alias("x0"), c("s.a.y").alias("y0"), c("s.b.x").alias("x1"), c("s.b.y").alias("y1"))
    return out_.where("x0 != x1 or y0 != y1")


def within_distance(points: DataFrame, edges: DataFrame, by: Sequence[str], d: float, cell: float, key: Sequence[str], x: str = "x", y: str = "y", steps: int = 3, condition: Column | None = None) -> DataFrame:
    """(by, key) of the pairs that meet ``condition`` (of ``by`` and ``key``) whose point is inside of the polygon or no farther than d > 0 from it, exactly.

    A buffer with few edges that lies outside of the round one names the pairs; only these are measured. ``edges`` are those of valid polygons.
    """
    by, key = list(by), list(key)
    edges = written(edges.select(*by, *EDGE))
    outer = d / math.cos(math.pi / (4 * steps)) * (1 + 1e-9) + NEAR
    wide = region(offset_edges(edges, by, outer, steps), by, 1, cell)
    near = points_inside(points.select(*key, x, y), wide, by, cell, x, y, condition).select(*by, *key, c(x).alias("_x"), c(y).alias("_y"))
    rows = near.join(edges.select(*by, *EDGE), by)
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("_x") - c("x0")) * dx + (c("_y") - c("y0")) * dy) / (dx * dx + dy * dy)))
    gap = (c("_x") - c("x0") - t * dx) ** 2 + (c("_y") - c("y0") - t * dy) ** 2
    passed = ((c("y0") <= c("_y")) != (c("y1") <= c("_y"))) & (c("x0") + (c("_y") - c("y0")) * dx / F.nullif(dy, F.lit(0.0)) > c("_x"))
    found = rows.groupBy(*by, *key).agg(F.min(gap).alias("_gap"), F.count_if(passed).alias("_n"))
    return found.where((c("_gap") <= d * d) | (c("_n") % 2 == 1)).select(*by, *key)
