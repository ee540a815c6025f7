"""Polygons against plain geometry: slabs for areas, distances for buffers, planted contacts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from coppice.operators import polygons

SCHEMA = "g int, id int, ring array<struct<x:double,y:double>>, hole boolean"


def made(spark, rows):
    return spark.createDataFrame([(g, i, [tuple(map(float, p)) for p in ring], hole) for g, i, ring, hole in rows], SCHEMA).repartition(3)


def directed(rows):
    """Edges with what is held on their left, for plain area."""
    out = []
    for g, _, ring, hole in rows:
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        ring = ring if (twice > 0) != bool(hole) else ring[::-1]
        out += [(g, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return out


def slab_area(edges, k):
    ys = {p[1] for e in edges for p in e}
    for i, (a, b) in enumerate(edges):
        for q, w in edges[:i]:
            r, s = (b[0] - a[0], b[1] - a[1]), (w[0] - q[0], w[1] - q[1])
            den = r[0] * s[1] - r[1] * s[0]
            if den:
                t = ((q[0] - a[0]) * s[1] - (q[1] - a[1]) * s[0]) / den
                u = ((q[0] - a[0]) * r[1] - (q[1] - a[1]) * r[0]) / den
                if 0 < t < 1 and 0 < u < 1:
                    ys.add(a[1] + t * r[1])
    total, ys = 0.0, sorted(ys)
    for low, high in zip(ys, ys[1:], strict=False):
        y = (low + high) / 2
        at = sorted((a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), 1 if b[1] > a[1] else -1) for a, b in edges if min(a[1], b[1]) < y < max(a[1], b[1]))
        wound = 0
        for i in range(len(at) - 1, 0, -1):
            wound += at[i][1]
            total += (at[i][0] - at[i - 1][0]) * (high - low) * (wound >= k)
    return total


def star(rng, x, y, n=9, size=6.0, f=1.0):
    radii = [size * rng.uniform(0.2, 1) for _ in range(n)]
    ring = lambda f: [(x + r * f * math.cos(2 * math.pi * i / n), y + r * f * math.sin(2 * math.pi * i / n)) for i, r in enumerate(radii)]
    return ring(1.0), ring(0.5)


def stars(seed, groups=4, each=9):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        for i in range(each):
            shell, hole = star(rng, rng.uniform(0, 14), rng.uniform(0, 14))
            rows.append((g, i, shell[::-1] if i % 2 else shell, False))
            if i % 3:
                rows.append((g, i, hole, True))
    return rows


@pytest.mark.parametrize("cell", [0.9, 4.0, 100.0])
def test_union_and_rings(spark, cell):
    rows = stars(1)
    border = polygons.region(polygons.ring_edges(made(spark, rows), ["g"]), ["g"], 1, cell).cache()
    got = {r["g"]: r["area"] for r in polygons.area(border, ["g"]).collect()}
    for g in range(4):
        want = slab_area([(a, b) for h, a, b in directed(rows) if h == g], 1)
        assert got[g] == pytest.approx(want, abs=1e-7)
    rings = polygons.rings(border, ["g"]).collect()
    for g in range(4):
        assert sum(r["area"] for r in rings if r["g"] == g) == pytest.approx(got[g], abs=1e-7)
    assert all(r["ring"][0] == r["ring"][-1] and len(r["ring"]) > 3 for r in rings)


def test_union_in_any_order(spark):
    rows = stars(2, groups=1)
    shapes = []
    for seed in (1, 2):
        mixed = rows * 2
        random.Random(seed).shuffle(mixed)
        mixed = [(g, i, ring[seed:] + ring[:seed], hole) for g, i, ring, hole in mixed]
        border = polygons.region(polygons.ring_edges(made(spark, mixed), ["g"]), ["g"], 1, 3.0)
        shapes.append(sorted(tuple((p["x"], p["y"]) for p in r["ring"]) for r in polygons.rings(border, ["g"]).collect()))
    # repeated holes take nothing from a union that their repeated shells give
    assert shapes[0] == shapes[1]


def square(x, y, n=1.0):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


def test_shared_sides_and_corners(spark):
    """Squares side by side become one ring without inner corners; ones that meet in a corner stay two; a frame has a hole."""
    row = [(1, i, square(i, 0), False) for i in range(4)] + [(1, 9, square(0, 0), False)]
    corner = [(2, 0, square(0, 0), False), (2, 1, square(1, 1), False)]
    frame = [(3, i, square(x, y), False) for i, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1))]
    back = [(4, 0, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], False), (4, 0, square(1, 1), True), (4, 1, square(1, 1), False)]
    none = [(5, 0, [], False), (5, 0, [(0, 0), (1, 1)], False), (5, 1, [(0, 0), (2, 2), (4, 4)], False)]
    border = polygons.region(polygons.ring_edges(made(spark, row + corner + frame + back + none), ["g"]), ["g"], 1, 1.0)
    rings = [(r["g"], round(r["area"], 9), len(r["ring"])) for r in polygons.rings(border, ["g"]).collect()]
    assert sorted(rings) == [(1, 4.0, 5), (2, 1.0, 5), (2, 1.0, 5), (3, -1.0, 5), (3, 9.0, 5), (4, 16.0, 5)]


def test_crossing_rings_are_cleaned(spark):
    bow = [(1, 0, [(0, 0), (4, 0), (0.5, 3), (3.5, 3)], False)]
    border = polygons.region(polygons.ring_edges(made(spark, bow), ["g", "id"]), ["g", "id"], 1, 0.7)
    assert polygons.area(border, ["g"]).first()["area"] == pytest.approx(slab_area([(a, b) for _, a, b in directed(bow)], 1))


def test_overlay(spark):
    rows = stars(3, groups=3, each=8)
    e = polygons.ring_edges(made(spark, rows), ["g", "id"])
    out = polygons.overlay(e.where("id % 2 = 0"), e.where("id % 2 = 1"), "id", ["g"], 2.0, 5.0)
    assert out.where("touching").count() == 0
    got = {(r["g"], r["id_1"], r["id_2"]): r["area"] for r in polygons.area(out, ["g", "id_1", "id_2"]).collect()}
    for g in range(3):
        for i in range(0, 8, 2):
            for j in range(1, 8, 2):
                want = slab_area([(a, b) for h, a, b in directed([r for r in rows if r[0] == g and r[1] in (i, j)])], 2)
                assert got.get((g, i, j), 0.0) == pytest.approx(want, abs=1e-8)


def test_overlay_keeps_what_touches(spark):
    left = [(1, 0, square(0, 0, 2), False), (1, 2, square(10, 10, 8), False), (1, 2, square(11, 11, 6), True), (1, 4, square(30, 0), False)]
    right = [(1, 1, square(2, 1), False), (1, 3, square(12, 12), False), (1, 5, square(11, 13), False), (1, 7, square(2, 2), False), (1, 9, square(30, 0), False)]
    a, b = (polygons.ring_edges(made(spark, r), ["g", "id"]) for r in (left, right))
    out = polygons.overlay(a, b, "id", ["g"], 1.0, 4.0)
    sums = out.groupBy("id_1", "id_2", "touching").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))
    got = sorted((r["id_1"], r["id_2"], r["touching"], r["area"]) for r in sums.collect())
    # along a side, in a corner, inside of a hole (nothing), at a hole's side, and equal ones
    assert got == [(0, 1, True, None), (0, 7, True, None), (2, 5, True, None), (4, 9, False, 1.0)]
    assert polygons.overlay(a.limit(0), b, "id", ["g"], 1.0, 4.0).count() == 0


def inside(p, rings):
    n = 0
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] <= p[1]) != (b[1] <= p[1]) and a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > p[0]:
                n += 1
    return n % 2 == 1


def distance(p, rings):
    best = math.inf
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            d = (b[0] - a[0], b[1] - a[1])
            t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
            best = min(best, math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1]))
    return best


@pytest.mark.parametrize("d", [1.5, -0.4])
def test_buffers_agree_with_distances(spark, d):
    rng, rows = random.Random(5), []
    for i in range(5):
        shell, hole = star(rng, 20.0 * i, 0.0, n=11, size=7.0)
        rows += [(1, i, shell, False), (1, i, hole, True)]
    e = polygons.ring_edges(made(spark, rows), ["id"])
    wide = polygons.region(polygons.offset_edges(e, ["id"], d, steps=64), ["id"], 1, 1.7).withColumn("m", F.lit(1))
    points = [(k, rng.uniform(-10, 90), rng.uniform(-10, 10)) for k in range(10_000)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    got = {(r["id"], r["k"]) for r in polygons.points_inside(df, wide, ["id"], 1.7).collect()}
    near = 0
    for i in range(5):
        rings = [ring for _, j, ring, _ in rows if j == i]
        for k, x, y in points:
            if abs(x - 20.0 * i) < 10:
                apart = distance((x, y), rings)
                if abs(apart - abs(d)) < 1e-3 * abs(d):
                    near += 1
                    continue
                within = inside((x, y), rings)
                want = within or apart < d if d > 0 else within and apart > -d
                assert ((i, k) in got) == want, (i, k, apart)
    assert near < 60
    if d > 0:
        found = {(r["id"], r["k"]) for r in polygons.within_distance(df, e, ["id"], d, 1.7, ["k"]).collect()}
        for i in range(5):
            rings = [ring for _, j, ring, _ in rows if j == i]
            want = {k for k, x, y in points if abs(x - 20.0 * i) < 10 and (inside((x, y), rings) or distance((x, y), rings) <= d)}
            assert {k for j, k in found if j == i} == want


def test_points_in_polygons_of_many_cells(spark):
    rows = stars(6, groups=2, each=5)
    e = polygons.ring_edges(made(spark, rows), ["g", "id"]).withColumn("m", F.lit(1))
    rng = random.Random(7)
    points = [(k, rng.uniform(-7, 21), rng.uniform(-7, 21)) for k in range(2000)]
    for cell in (0.3, 50.0):
        got = {(r["g"], r["id"], r["k"]) for r in polygons.points_inside(spark.createDataFrame(points, "k int, x double, y double"), e, ["g", "id"], cell).collect()}
        want = {(g, i, k) for g in range(2) for i in range(5) for k, x, y in points if inside((x, y), [r for h, j, r, _ in rows if (h, j) == (g, i)])}
        assert got == want
