"""Grids, tiles, watersheds, gradients and searches against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators import grids, learning, search
from coppice.operators.watershed import watershed

CELLS = "row long, col long, value double"


def surface(seed=1, rows=23, cols=19, levels=None, holes=0.05):
    rng = random.Random(seed)
    value = (lambda: float(rng.randrange(levels))) if levels else (lambda: rng.uniform(0, 100))
    out = [(r, q, None if rng.random() < holes else value()) for r in range(rows) for q in range(cols)]
    return [x for x in out if rng.random() > holes / 2]


def flooded(cells, markers, floor=None):
    """Edge after edge, from the highest down: two parts become one unless both have a marker."""
    height = {(r, q): v for r, q, v in cells if v is not None and (floor is None or v > floor)}
    up = {x: x for x in height}
    marked = {m: m for m in markers if m in height}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    edges = [(-min(v, height[y]), x, y) for x, v in height.items() for y in ((x[0], x[1] + 1), (x[0] + 1, x[1])) if y in height]
    for _, x, y in sorted(edges):
        a, b = root(x), root(y)
        if a != b and not (a in marked and b in marked):
            if a in marked:
                a, b = b, a
            up[a] = b
    return {x: marked.get(root(x)) for x in height}


@pytest.mark.parametrize("seed,levels,floor,holes", [(1, None, None, 0.05), (2, 3, None, 0.05), (3, 2, 0.5, 0.2), (4, 1, None, 0.0)])
def test_watershed_equals_flooding(spark, seed, levels, floor, holes):
    cells = surface(seed, levels=levels, holes=holes)
    rng = random.Random(seed + 10)
    markers = [(r, q) for r, q, _ in rng.sample(cells, 9)] + [(500, 500)]
    df = spark.createDataFrame(cells, CELLS).repartition(3)
    out = watershed(df, spark.createDataFrame(markers + markers[:2], "row long, col long"), floor).collect()
    got = {(r["row"], r["col"]): None if r["marker"] is None else (r["marker"] >> 31, r["marker"] & ((1 << 31) - 1)) for r in out}
    assert got == flooded(cells, markers, floor)


def test_watershed_of_nothing(spark):
    none = spark.createDataFrame([], CELLS)
    assert watershed(none, none).count() == 0
    one = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (9, 9, 1.0)], CELLS)
    assert [r["marker"] for r in watershed(one, none).collect()] == [None] * 3


@pytest.mark.parametrize("size", [4, 7, 64])
def test_tiles_see_at_borders_what_they_see_anywhere(spark, size):
    cells = [(r - 5, q - 3, v) for r, q, v in surface(6, levels=9)]
    at = {(r, q): v for r, q, v in cells if v is not None}
    near = lambda x, d: [(y, v) for y, v in at.items() if (x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 <= d * d]
    df = spark.createDataFrame(cells, CELLS).repartition(3)
    got = {(r["row"], r["col"]): (r["value"], r["most"]) for r in grids.focal_maximum(df, 2, size).collect()}
    assert got == {x: (v, max(w for _, w in near(x, 2))) for x, v in at.items()}
    peaks = sorted((r["row"], r["col"]) for r in grids.local_peaks(df, 2, size).collect())
    assert peaks == sorted(x for x, v in at.items() if min(near(x, 2), key=lambda y: (-y[1], y[0]))[0] == x)


def test_chips(spark):
    cells = [(r, q, None if (r + q) % 7 == 0 else (r * 13 + q) % 256) for r in range(150) for q in range(80)]
    boxes = [("a", 60, 60, 70, 90), ("b", -3, -2, 2, 3), ("far", 900, 900, 902, 901), ("none", 5, 5, 5, 9), (None, 0, 0, 2, 2)]
    df = spark.createDataFrame(cells, "row long, col long, value int").repartition(3)
    out = {r["chip"]: r for r in grids.chips(df, spark.createDataFrame(boxes, "chip string, row0 long, col0 long, row1 long, col1 long")).collect()}
    at = {(r, q): v for r, q, v in cells if v is not None}
    assert set(out) == {"a", "b", "far"}
    for name, r0, c0, r1, c1 in boxes[:3]:
        assert list(out[name]["pixels"]) == [at.get((r, q), 128) for r in range(r0, r1) for q in range(c0, c1)]
        assert (out[name]["rows"], out[name]["cols"]) == (r1 - r0, c1 - c0)


def test_unlike_grids(spark):
    cells = surface(7, 17, 15)
    at = {(r, q): v for r, q, v in cells if v is not None}
    df = spark.createDataFrame(cells, CELLS).repartition(3)
    fine, coarse = grids.Grid(2.0, -1.0, 0.7), grids.Grid(1.3, -1.7, 1.0)
    got = {(r["row"], r["col"]): r["value"] for r in grids.averaged(df, fine, coarse).collect()}
    sums = {}
    for (r, q), v in at.items():
        y, x = fine.y + r * 0.7, fine.x + q * 0.7
        for i in range(-2, 20):
            for j in range(-2, 20):
                high = min(y + 0.7, coarse.y + i + 1) - max(y, coarse.y + i)
                wide = min(x + 0.7, coarse.x + j + 1) - max(x, coarse.x + j)
                if high > 1e-9 and wide > 1e-9:
                    w, s = sums.get((i, j), (0.0, 0.0))
                    sums[i, j] = (w + high * wide, s + high * wide * v)
    assert set(got) == set(sums)
    assert all(got[k] == pytest.approx(s / w) for k, (w, s) in sums.items())
    cube = lambda d: (1.5 * d - 2.5) * d * d + 1 if d <= 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0
    got = {(r["row"], r["col"]): r["value"] for r in grids.cubic(df, coarse, fine).collect()}
    want = {}
    for i in range(-4, 40):
        for j in range(-4, 40):
            y, x = (fine.y + (i + 0.5) * 0.7 - coarse.y), (fine.x + (j + 0.5) * 0.7 - coarse.x)
            if (math.floor(y), math.floor(x)) in at:
                w = {k: cube(abs(y - 0.5 - k[0])) * cube(abs(x - 0.5 - k[1])) for k in at if abs(y - 0.5 - k[0]) < 2 and abs(x - 0.5 - k[1]) < 2}
                want[i, j] = sum(w[k] * at[k] for k in w) / sum(w.values())
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in want.items())
    model, grid = grids.height_model(df, coarse, df.withColumn("value", F.col("value") / 2), fine, resolution=1.5)
    assert grid == grids.Grid(1.3, -1.7, 1.5)
    assert model.where("value < 0").count() == 0
    assert grids.averaged(df.limit(0), fine, coarse).count() == 0


def loss(x, y, w):
    z = w @ np.append(x, 1.0)
    return np.log(np.exp(z - z.max()).sum()) + z.max() - z[y]


def test_gradients_equal_finite_differences(spark):
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=(3, 4)), rng.normal(size=3)
    rows = [(int(i), int(i) % 2 if i > 4 else 9, rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    odd = [(100, 0, None, 1), (101, 0, [1.0], 1), (102, 1, [float("nan")] * 4, 0), (103, 1, [1.0] * 4, 7), (104, 5, [1.0] * 4, None)]
    df = spark.createDataFrame(rows + odd, "id int, chunk int, vector array<double>, label int").repartition(5)
    got = {(r["chunk"], r["class"], r["place"]): r["gradient"] for r in learning.chunk_gradients(df, learning.packed(weights, bias), ["chunk"]).collect()}
    w = np.concatenate([weights, bias[:, None]], axis=1)
    assert {k[0] for k in got} == {0, 1, 9}
    for (chunk, c, j), g in got.items():
        mine = [(np.array(v), y) for _, k, v, y in rows if k == chunk]
        step = np.zeros_like(w)
        step[c, j] = 1e-5
        want = np.mean([(loss(x, y, w + step) - loss(x, y, w - step)) / 2e-5 for x, y in mine])
        assert g == pytest.approx(want, abs=1e-7)


def test_predictions_and_failures(spark):
    weights, bias = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]), np.zeros(3)
    rows = [(1, [2.0, 1.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0]), (5, [float("inf"), 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    out = {r["id"]: r for r in learning.predicted(df, learning.packed(weights, bias)).collect()}
    assert [out[i]["predicted"] for i in range(1, 7)] == [0, 1, None, None, None, None]
    assert [out[i]["failure"] is None for i in range(1, 7)] == [True, True, False, False, False, False]
    assert learning.predicted(df.limit(0), learning.packed(weights, bias)).count() == 0


def test_best_of_many_splits(spark, monkeypatch):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, 1 + i % 3) for i in range(25)], "plot long, weight long")
    counts = spark.createDataFrame([(i, x, rng.randrange(1, 9)) for i in range(27) for x in "abc" if rng.random() < 0.7], "plot long, species string, n long")
    plain = search.best_trial(search.balanced_split(items, counts, "plot", "weight", "species", "n", trials=150)).first()
    many = search.best_of_many(items, counts, "plot", "weight", "species", "n", trials=150).first()
    assert (many["trial"], many["score"], many["n_val"]) == (plain["trial"], plain["score"], plain["n_val"])
    monkeypatch.setattr(search, "SEARCHED", 10)
    joined = search.best_of_many(items, counts, "plot", "weight", "species", "n", trials=150).first()
    assert (joined["trial"], joined["score"]) == (plain["trial"], plain["score"])
    monkeypatch.undo()
    assert search.best_of_many(items.limit(0), counts, "plot", "weight", "species", "n", trials=5).count() == 0
