"""Work that must not grow with the square of how often a place, a box or a key comes."""

import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from coppice.operators import pairwise, polygons, relational, search, spatial
from coppice.plans import pairing


@pytest.fixture
def tables(spark, tmp_path):
    def put(**rows):
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_crowded_keys_are_divided(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 1000)
    left = spark.range(600).select(F.col("id").alias("a"), F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(600).select(F.col("id").alias("b"), F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("l"))
    lefts, rights, keys = relational.spread(left, right, [("k", "l")])
    joined = lefts.join(rights, [F.col(x) == F.col(y) for x, y in keys])
    assert sorted(joined.select("a", "b").collect()) == sorted(left.join(right, F.col("k") == F.col("l")).select("a", "b").collect())
    per = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 400 * 300 + 200 and max(per) < 20_000


def test_plots_of_one_spot_are_paired_once(spark, tables, monkeypatch):
    made = []
    kept = lambda *a, f=pairing.box_join, **k: made.append(f(*a, **k)) or made[-1]
    monkeypatch.setattr(pairing, "box_join", kept)
    day = datetime.datetime(1995, 3, 1)
    d = tables(
        customer=([(1000 * i + 7, "BUILDING") for i in range(30)], "c_custkey long, c_mktsegment string"),
        orders=([(i, day + datetime.timedelta(days=i % 5)) for i in range(20_000)], "o_orderkey long, o_orderdate timestamp"),
    )
    got = entry.queries()["entry_pairing"](spark, d)
    assert got.count() > 0 and got.select("plot_id").distinct().count() == 30
    assert sum(x.count() for x in made) < 1_000  # at most the thousand squares that there are over one spot, not thirty plots under each flight


def test_plots_of_one_spot_and_survey_year_meet_flights_as_one(spark, tables, monkeypatch):
    """Before rows are listed, flights meet kinds of plots; however keys repeat or crowd, the result is that of the SQL."""
    import duckdb

    monkeypatch.setattr(relational, "PAIRS", 1000)
    monkeypatch.setattr(spatial, "TOGETHER", 16)
    formed = []

    def kept(left, right, on, *rest):
        lefts, rights, keys = relational.spread(left, right, on, *rest)
        formed.append((lefts.join(rights, [F.col(a) == F.col(b) for a, b in keys]), "_p_ids" in right.columns))
        return lefts, rights, keys

    monkeypatch.setattr(pairing, "spread", kept)
    day = datetime.datetime(1995, 3, 1)
    plots = [(9000 * i + 7, "BUILDING") for i in range(200)] + [(1000 * i + 11, ["BUILDING", "MACHINERY", None][i % 3]) for i in range(60)]
    plots += [(1011, "BUILDING"), (1011, None), (9007, "FURNITURE"), (None, "BUILDING")]
    flown = lambda i: day + datetime.timedelta(days=i * 7 % 2000, hours=i % 30)
    flights = [(i, flown(i)) for i in range(12_000)] + [(i, flown(i + 5)) for i in range(0, 3000, 7)] + [(21, None), (None, day)]
    d = tables(customer=(plots, "c_custkey long, c_mktsegment string"), orders=(flights, "o_orderkey long, o_orderdate timestamp_ntz"))
    got = entry.queries()["entry_pairing"](spark, d)
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["entry_pairing"]).fetchall()
    assert len(want) > 10_000
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert all(listed for _, listed in formed)
    assert sum(pairs.count() for pairs, _ in formed) < len(want) / 3


def test_equal_boxes_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 1000, raising=False)
    box = lambda p: ("n" + p, "a" + p, "b" + p, "c" + p, "d" + p)
    rows = [(i, 1.0, 1.0, 2.0, 2.0) for i in range(300)]
    left, right = (spark.createDataFrame(rows, list(box(p))) for p in "12")
    pairs = spatial.box_join(left, right, box("1")[1:], box("2")[1:], cell=4.0)
    per = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 90_000 and max(per) < 15_000


def test_equal_boxes_are_tested_once(spark, tables, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 1000)
    monkeypatch.setattr(spatial, "TOGETHER", 16, raising=False)
    made = []
    monkeypatch.setattr(spatial, "box_join", lambda *a, f=spatial.box_join, **k: made.append(f(*a, **k)) or made[-1])
    rng = random.Random(12)
    rows = [(i, ["SMALL TIN", "LARGE TIN", "PROMO TIN", None][i % 4], 3 if i % 9 else 30, 901.0 + (i % 5 == 0)) for i in range(1200)]
    rows += [(2000 + i, rng.choice(["SMALL", "LARGE"]), rng.choice([None, 2, 3, 4, 5]), rng.choice([None, 900.0, 902.5, 905.0])) for i in range(100)]
    d = tables(part=(rows, "p_partkey long, p_type string, p_size int, p_retailprice double"))
    boxes = [(k, t, float(s), p, float(s + k % 3), p + 2) for k, t, s, p in rows if t and s and p]
    want = [
        (a[0], b[0], max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), min(a[5], b[5]))
        for a in boxes
        if a[1].startswith("SMALL")
        for b in boxes
        if b[1].startswith("LARGE") and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    ]
    got = entry.queries()["q12_box_overlap_pairs"](spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50_000
    assert sum(x.count() for x in made) < 10_000
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per) < len(want) / 4


def test_crowds_are_suppressed_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairwise, "PAIRS", 100, raising=False)
    monkeypatch.setattr(pairwise, "CROWD", 4, raising=False)
    made = []
    monkeypatch.setattr(pairwise, "box_join", lambda *a, f=pairwise.box_join, **k: made.append(f(*a, **k)) or made[-1])
    rng = random.Random(27)
    rows = [(i % 2, i, float(rng.randrange(50)), x, y, x + 2.0 + i % 3, y + 3.0) for i in range(1500) for x, y in [(rng.uniform(-1, 3), rng.uniform(-1, 3))]]
    rows += [(0, 2000 + i, 99.0, 1.0, 1.0, 1.0, 4.0) for i in range(5)]  # without area nothing is in the way
    kept = []
    for b in sorted(rows, key=lambda b: (b[2], b[1]), reverse=True):
        area = lambda p: (p[5] - p[3]) * (p[6] - p[4])
        shared = lambda k: max(min(k[5], b[5]) - max(k[3], b[3]), 0) * max(min(k[6], b[6]) - max(k[4], b[4]), 0)  # noqa: B023, E731
        if not any(k[0] == b[0] and min(area(k), area(b)) and shared(k) / min(area(k), area(b)) > 0.4 for k in kept):
            kept.append(b)
    df = spark.createDataFrame(rows, "ds long, id long, score double, minx double, miny double, maxx double, maxy double")
    assert sorted(r["id"] for r in pairwise.suppressed(df, 0.4, 8.0).collect()) == sorted(b[1] for b in kept)
    assert (n := sum(x.count() for x in made)) < 5_000, n


def test_rings_cost_no_group_of_pandas_and_no_array_twice(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    square = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0)]
    rows = [(i % 3, square(3.0 * i, 0.0), False) for i in range(30)] + [(i % 3, square(3.0 * i + 1, 1.0), False) for i in range(30)]
    edges = polygons.ring_edges(spark.createDataFrame(rows, "ds long, ring array<struct<x:double,y:double>>, hole boolean"), ["ds"])
    assert not [line for line in plan(edges).splitlines() if "Filter" in line and "transform(" in line]
    made = polygons.rings(polygons.region(edges, ["ds"], 1, 2.0), ["ds"])
    assert "InPandas" not in plan(made)
    got = sorted((r["ds"], r["area"], len(r["ring"]), tuple(r["ring"][0])) for r in made.collect())
    assert got == sorted((i % 3, 7.0, 9, (3.0 * i, 0.0)) for i in range(30))  # two squares that share a quarter of their area


def test_species_of_trees_are_not_broadcast(spark):
    plan = entry.queries()["q69_chip_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert ["SortMergeJoin" in line for line in plan.splitlines() if "LeftOuter" in line] == [True]


def test_nearest_marker_looks_at_few(spark, monkeypatch):
    looked = []
    monkeypatch.setattr(pairwise, "within_reach", lambda *a, f=pairwise.within_reach, **k: looked.append(f(*a, **k)) or looked[-1])
    rng = random.Random(60)
    place = lambda: (rng.randrange(120) / 10, rng.randrange(120) / 10)
    cells = [(i % 2, i, *place()) for i in range(1200)] + [(0, 5000, 40.0, 5.0), (1, 5001, 22.0, 5.0), (2, 5002, 1.0, 1.0), (None, 5003, 1.0, 1.0)]
    markers = [(i % 2, i, *place()) for i in range(800)] + [(None, 900, 1.0, 1.0)]
    want = {}
    for ds, i, x, y in cells:
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, m) for g, m, a, b in markers if g == ds is not None]
        if near and min(near)[0] <= 15:
            want[i] = min(near)[1]
    schema = "ds long, id long, x double, y double"
    got = pairwise.nearest_marker(spark.createDataFrame(cells, schema), spark.createDataFrame(markers, schema), 15.0).collect()
    assert {r["id"]: r["marker_id"] for r in got} == want and len(got) == len(want)
    assert sum(x.count() for x in looked) < 30_000  # all within reach are some 480,000


def test_draws_of_a_block_are_those_of_md5():
    rng = random.Random(82)
    tails = [f":{rng.randrange(10 ** rng.randrange(1, 19))}".encode() for _ in range(500)]
    width = max(map(len, tails))
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tails), np.uint8).reshape(-1, width)
    for head in (b"35:0", b"35:99999", b"35:" + b"7" * (52 - width)):
        want = [int.from_bytes(hashlib.md5(head + t, usedforsecurity=False).digest()[:8], "big") for t in tails]
        assert search.md5_heads(head, rows, np.array([len(t) for t in tails])).tolist() == want


def test_points_meet_only_polygons_of_their_own(spark):
    rows = [(g, i, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)], False) for g in range(5) for i in range(4)]
    edges = polygons.ring_edges(spark.createDataFrame(rows, "ds long, id long, ring array<struct<x:double,y:double>>, hole boolean"), ["ds", "id"])
    points = spark.createDataFrame([(g, k, 0.5 + k % 5, 1.25) for g in range(5) for k in range(10)], "point_ds long, k long, x double, y double")
    got = polygons.points_inside(points, edges, ["ds", "id"], 2.0, condition=F.col("ds") == F.col("point_ds"))
    assert sorted((r["ds"], r["id"], r["point_ds"], r["k"]) for r in got.collect()) == [(g, i, g, k) for g in range(5) for i in range(4) for k in range(10) if k % 5 < 3]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "cx#" in line and "_edges" not in line]
    assert sum("ds#" in line for line in joins) >= 2, plan


def test_only_pairs_without_a_common_part_are_looked_at_for_touching(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(polygons, "_touching", lambda both, *a, f=polygons._touching: seen.append(both) or f(both, *a))
    square = lambda x: [(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0)]
    put = lambda rows: polygons.ring_edges(spark.createDataFrame([(1, i, square(x), False) for i, x in rows], "ds long, id long, ring array<struct<x:double,y:double>>, hole boolean"), ["ds", "id"])
    got = polygons.overlay(put([(0, 0.0)]), put([(1, 1.0), (3, 2.0), (5, 9.0)]), "id", ["ds"], 2.0, 8.0)
    assert {(r["id_2"], r["touching"]) for r in got.select("id_2", "touching").collect()} == {(1, False), (3, True)}
    assert {r["id_2"] for r in seen[0].select("id_2").collect()} == {3}
