import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators import aggregates, pairwise, raster, relational, search, spatial


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_until_reached(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 3), ("g", 3, 2)], "k string, o int, w int")
    keep = lambda t: [r["o"] for r in relational.until_reached(df, ["k"], [F.col("o")], "w", F.lit(t)).orderBy("o").collect()]
    assert keep(3) == [1, 2]
    assert keep(0) == [1]
    assert keep(100) == [1]


def test_enumeration_and_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = relational.enumerated(df, [F.col("v")], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in got)
    chunks = {r["v"]: (r["batch_id"], r["sub_id"]) for r in relational.chunked(df, [F.col("v")], 250, 32).collect()}
    assert all(chunks[v] == (v // 250, v % 250 // 32) for v in range(1000))


def test_joins_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "q")], "k int, v string")
    assert [r["v"] for r in relational.without_keys(a, b, ["k"]).orderBy("v").collect()] == ["y", "z"]
    assert relational.suffixed_join(a, b, ["k"], "left", ("_1", "_2")).columns == ["k", "v_1", "v_2"]
    assert rows(relational.remainder(a.select("k").where("k is not null"), b.select("k"))) == [(2,)]
    with pytest.raises(Exception, match="overlap"):
        relational.disjoint(a.select("k"), b.select("k"), "parts overlap").collect()
    assert relational.disjoint(a.where("k = 2").select("k"), b.select("k"), "x").count() == 1
    assert rows(relational.not_yet_written(a.where("k > 0"), b, ["k"])) == [(2, "y")]


def test_trimmed_spread(spark):
    df = spark.createDataFrame([("m", float(v), float(v * 2)) for v in (1, 2, 3, 4)], "k string, v double, g double")
    r = aggregates.altitude_summary(df, ["k"], F.col("v"), F.col("g")).first()
    assert r["sd_trimmed"] == 0.5
    assert r["mean_altitude"] == 2.5
    assert r["terrain_correlation"] == pytest.approx(1)


def test_votes_and_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 0)], "k string, p int")
    assert rows(aggregates.majority(df, "k", "p", "Live", "Dead")) == [("a", "Dead"), ("b", "Live")]
    parts = spark.createDataFrame([("i", 10.0), ("i", 5.0), ("i", 6.0)], "k string, v double")
    assert sorted(r["v"] for r in aggregates.above_group_share(parts, "k", "v").collect()) == [6.0, 10.0]


def test_weighted_pivot_has_empty_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, s string")
    plots = spark.createDataFrame([(1, 2), (2, 1), (3, 5)], "k int, w int")
    assert rows(aggregates.weighted_pivot(df, plots, "k", "s", ["a", "b"], "w")) == [(1, 4, 0), (2, 0, 1), (3, 0, 0)]


def test_box_join_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(i, x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.choice([0, 1, 7]), y + rng.choice([0, 3, 5])) for i in range(n)]
    a, b = make(60), make(60)
    names = [tuple(f"{s}{c}" for c in ("i", "x0", "y0", "x1", "y1")) for s in "ab"]
    got = spatial.box_join(spark.createDataFrame(a, list(names[0])), spark.createDataFrame(b, list(names[1])), names[0][1:], names[1][1:], cell=2.5).select("ai", "bi")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert rows(got) == want


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    r = spark.range(1).select(spatial.ring_area(ring), spatial.in_ring(F.lit(1.0), F.lit(1.0), ring), spatial.in_ring(F.lit(5.0), F.lit(1.0), ring)).first()
    assert tuple(r) == (12.0, True, False)


def test_overstory(spark):
    df = spark.createDataFrame([("g", 1, 0.0, 0.0, 10.0), ("g", 2, 0.5, 0.0, 20.0), ("g", 3, 9.0, 0.0, 5.0)], "ds string, id long, x double, y double, h double")
    assert [r["id"] for r in pairwise.overstory(df).orderBy("id").collect()] == [2, 3]
    assert pairwise.overstory(df.limit(0)).count() == 0


def test_greedy_match(spark):
    edges = spark.createDataFrame([("g", 1, 1, 1.0), ("g", 1, 2, 0.5), ("g", 2, 2, 0.6)], "ds string, left_id long, right_id long, dist double")
    assert rows(pairwise.greedy_match(edges)) == [("g", 1, 2, 0.5)]
    rng = random.Random(4)
    data = [(str(rng.randrange(2)), rng.randrange(8), rng.randrange(8), float(rng.randrange(5))) for _ in range(60)]
    data = list({d[:3]: d for d in data}.values())
    want, used = [], set()
    for g, f, d, dist in sorted(data, key=lambda e: (e[3], e[1], e[2])):
        if (g, "f", f) not in used and (g, "d", d) not in used:
            used |= {(g, "f", f), (g, "d", d)}
            want.append((g, f, d, dist))
    assert rows(pairwise.greedy_match(spark.createDataFrame(data, edges.schema))) == sorted(want)


def test_chains_are_finished_in_parts(spark, monkeypatch):
    """Ever nearer neighbours: each round of mutual bests would match one pair."""
    monkeypatch.setattr(pairwise, "ROUNDS", 2)
    chain = [("g", k // 2 + k % 2, k // 2, 100.0 - k) for k in range(40)]  # l0-r0, l1-r0, l1-r1, ...
    want, used = [], set()
    for g, a, b, dist in sorted(chain, key=lambda e: e[3]):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            want.append((g, a, b, dist))
    df = spark.createDataFrame(chain, "ds string, left_id long, right_id long, dist double")
    assert rows(pairwise.greedy_match(df)) == sorted(want)
    boxes = [("g", i, float(i), i * 1.0, 0.0, i + 1.5, 1.0) for i in range(30)] + [("g", 99, 1.0, 500.0, 0.0, 501.0, 1.0)]
    df = spark.createDataFrame(boxes, "ds string, id long, score double, minx double, miny double, maxx double, maxy double")
    assert sorted(r["id"] for r in pairwise.suppressed(df, 0.3, 3.0).collect()) == [*range(1, 30, 2), 99]


def test_huge_heights_make_classes_not_cells(spark):
    rng = random.Random(6)
    data = [("g", i, rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(1, 30)) for i in range(80)] + [("g", 900, 25.0, 25.0, 1e6), ("g", 901, 1e7, 0.0, 2.0)]
    df = spark.createDataFrame(data, "ds string, id long, x double, y double, h double")
    far = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5
    want = [a[1] for a in data if not any(b[4] > a[4] and far(a, b) < (b[4] - a[4]) * 0.1 + 1 for b in data)]
    assert sorted(r["id"] for r in pairwise.overstory(df).collect()) == sorted(want)
    want = [a[1] for a in data if not any(far(a, b) <= 0.3 * a[4] + 0.25 and (b[4], -b[1]) > (a[4], -a[1]) for b in data)]
    assert sorted(r["id"] for r in pairwise.local_maxima(df, 0.0, 0.3, 0.25).collect()) == sorted(want)


def test_ranks_and_sums_over_hot_keys(spark):
    rng = random.Random(7)
    data = [(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 7919 % 1009, rng.randrange(4)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, o long, w long").repartition(7)
    want = []
    for key in {d[0] for d in data}:
        total = 0
        for n, (k, o, w) in enumerate(sorted((d for d in data if d[0] == key), key=lambda d: d[1]), 1):
            want.append((str(k), o, w, n, total))
            total += w
    got = relational.running(df, ["k"], [F.col("o")], "w").collect()
    assert sorted((str(r["k"]), r["o"], r["w"], r["_rank"], r["_before"]) for r in got) == sorted(want)
    medians = {r["k"]: r["_p"] for r in aggregates.percentiles(df, ["k"], F.col("o").cast("double"), [0.0, 0.37, 0.5]).collect()}
    for key in medians:
        assert medians[key] == pytest.approx(np.quantile([d[1] for d in data if d[0] == key], [0.0, 0.37, 0.5]).tolist())


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from coppice.operators import graph

    tables = []
    monkeypatch.setattr(graph, "written", lambda df, plain=graph.written: tables.append(1) or plain(df))
    roots = graph.components(spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["root"] for r in roots.collect()} == {0}
    assert roots.count() == 401
    assert len(tables) < 3 * 20


def test_equal_scores_go_to_the_first_trial(spark):
    scores = spark.createDataFrame([(5, 0.25, 1), (3, 0.25, 1), (4, 0.5, 1)], "trial long, score double, n_val long")
    assert search.best_trial(scores).first()["trial"] == 3


def test_outlines(spark):
    grid = ["111", "101", "111", "001"]
    cells = spark.createDataFrame([(r, c, int(v)) for r, line in enumerate(grid) for c, v in enumerate(line)], "row long, col long, id int")
    (row,) = raster.outlines(raster.components(cells)).collect()
    assert (row["n_cells"], len(row["rings"])) == (9, 2)
    outer, hole = sorted(row["rings"], key=len, reverse=True)
    assert [(p["x"], p["y"]) for p in outer] == [(0, 0), (3, 0), (3, 4), (2, 4), (2, 3), (0, 3), (0, 0)]
    assert {(p["x"], p["y"]) for p in hole} == {(1, 1), (2, 1), (2, 2), (1, 2)}


def test_suppression(spark):
    rng = random.Random(5)
    data = [("g", i, float(rng.randrange(4)), x := rng.uniform(0, 10), y := rng.uniform(0, 10), x + rng.uniform(1, 4), y + rng.uniform(1, 4)) for i in range(30)]
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    shared = lambda a, b: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4])) / min(area(a), area(b))
    kept = []
    for b in sorted(data, key=lambda b: (-b[2], -b[1])):
        if all(shared(k, b) <= 0.3 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(data, "ds string, id long, score double, minx double, miny double, maxx double, maxy double")
    assert sorted(r["id"] for r in pairwise.suppressed(df, 0.3, 3.0).collect()) == sorted(b[1] for b in kept)


def test_raster(spark):
    cell = "row long, col long, value double"
    dsm = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (0, 2, None)], cell)
    dtm = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (0, 2, 1.0)], cell)
    assert [r["value"] for r in raster.difference(dsm, dtm).orderBy("col").collect()] == [3.0, 0.0, None]
    flat = spark.range(16).select((F.col("id") / 4).cast("long").alias("row"), (F.col("id") % 4).alias("col"), F.lit(7.0).alias("value"))
    fine = raster.refined(flat, 2).collect()
    assert len(fine) == 64
    assert all(r["value"] == pytest.approx(7) for r in fine)
    tiled = raster.in_tiles(flat, 3, 2)
    assert {(r["tile_row"], r["tile_col"]) for r in tiled.where("row = 2 and col = 2").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_mask_components(spark):
    grid = ["1101", "0101", "0111", "2000"]
    cells = spark.createDataFrame([(r, c, int(v)) for r, line in enumerate(grid) for c, v in enumerate(line)], "row long, col long, id int")
    got = raster.components(cells)
    assert sorted(r["count"] for r in got.groupBy("id", "part").count().collect()) == [1, 8]


def test_pursuit(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    got = search.pursuit(df, 4).orderBy("rank").collect()
    assert len(got) == 4
    first = int(np.argmax(np.abs(a @ a.sum(axis=0))))
    assert first in {r["id"] for r in got}
    assert [abs(r["weight"]) for r in got] == sorted((abs(r["weight"]) for r in got), reverse=True)
    assert search.pursuit(df.limit(0), 4).count() == 0


def test_pursuit_equals_a_plain_one(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(15, 7))
    target = a.sum(axis=0)
    rest, chosen, weights = target.copy(), [], np.zeros(0)
    while len(chosen) < 5:
        best = int(np.argmax(np.abs(a @ rest)))
        if best in chosen:
            break
        chosen.append(best)
        some = a[chosen]
        gram = some @ some.T + (np.eye(len(chosen)) if len(chosen) > 1 else 0)
        weights = np.linalg.solve(gram, some @ target)
        rest = target - weights @ some
    got = {r["id"]: r["weight"] for r in search.pursuit(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>"), 5).collect()}
    assert {i: got[i] for i in chosen} == pytest.approx(dict(zip(chosen, weights, strict=True)))
    assert len(got) == 5


def test_split_is_balanced(spark):
    plots = spark.range(12).select(F.col("id").alias("plot"), F.lit(1).alias("w"))
    counts = spark.range(12).select(F.col("id").alias("plot"), (F.col("id") % 2).alias("label"), F.lit(3).alias("n"))
    scores = search.balanced_split(plots, counts, "plot", "w", "label", "n", trials=30, share=0.34)
    best = search.best_trial(scores).first()
    assert best["score"] == 0
    assert best["n_val"] == 12
    assert search.parameter_grid(spark, a=[1, 2], b=[3, 4, 5]).count() == 6
    runs = spark.createDataFrame([(1, 10), (2, 2), (3, 3)], "run int, n int")
    assert sorted((r["run"], r["epoch"]) for r in search.schedule(runs, "n", 2, 3).collect()) == [(1, 2), (1, 5), (1, 8), (3, 2)]
    assert search.budgeted(runs, search.parameter_grid(spark, ratio=[0.5, 0.29]), "n").selectExpr("sum(budget)").first()[0] == 5 + 2 + 1 + 0 + 1 + 0
