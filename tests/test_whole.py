"""Queries that must take in their whole tables, on small tables of our own with rows beyond any slice."""

import hashlib
import random

import pytest

import __spark_entry__ as entry


@pytest.fixture()
def tables(spark, tmp_path):
    def put(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


LINES = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"


def test_split_search_takes_every_plot(spark, tables):
    rng = random.Random(44)
    plots = range(1, 131)
    brand = {k: f"Brand#{k % 4}" for k in range(12)}
    lines = [(i, 1, rng.randrange(12), rng.choice(plots), 1.0, 1.0) for i in range(900)]
    d = tables(supplier=([(p,) for p in plots], "s_suppkey long"), part=(list(brand.items()), "p_partkey long, p_brand string"), lineitem=(lines, LINES))
    weight = {p: 1 + p % 3 for p in plots}
    target = sum(weight.values()) * 2 // 10
    want = {}
    for trial in range(200):
        val, reached = set(), 0
        for p in sorted(plots, key=lambda p: (hashlib.md5(f"35:{trial}:{p}".encode()).hexdigest(), p)):
            if reached >= target:
                break
            val.add(p)
            reached += weight[p]
        count = {b: [0, 0] for b in brand.values()}
        for _, _, part, p, *_ in lines:
            count[brand[part]][p in val] += 1
        t, v = (sum(c[k] for c in count.values()) for k in (0, 1))
        want[trial] = (sum((c[1] / v - c[0] / t) ** 2 for c in count.values()), v)
    got = {r["trial"]: (r["score"], r["n_val"]) for r in entry.queries()["q44_balanced_split"](spark, d).collect()}
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-9) for k in want)
    best = entry.queries()["q44_best_split"](spark, d).collect()
    assert [r["trial"] for r in best] == [min(want, key=lambda k: (want[k][0], k))]


def test_refined_raster_covers_the_surface(spark, tables):
    rng = random.Random(61)
    cells = {(r, c): round(rng.uniform(900, 1100), 2) for r in range(17, 26) for c in range(15, 24) if (r, c) != (21, 20)} | {(99, 99): 5.0}
    d = tables(lineitem=([(i, 1, r, c, v, 1.0) for i, ((r, c), v) in enumerate(cells.items())], LINES))

    def cubic(t):
        t = abs(t)
        return (1.5 * t - 2.5) * t * t + 1 if t <= 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2 if t < 2 else 0.0

    def fine(row, col):
        y, x = (row + 0.5) / 3 - 0.5, (col + 0.5) / 3 - 0.5
        near = [(cubic(y - r) * cubic(x - c), v) for (r, c), v in cells.items()]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    got = {(r["row"], r["col"]): r["value"] for r in entry.queries()["q61_refined_raster"](spark, d).collect()}
    assert set(got) == {(3 * r + i, 3 * c + j) for r, c in cells for i in range(3) for j in range(3)}
    assert all(v == pytest.approx(fine(*k), abs=1e-2) for k, v in got.items())


def test_pivot_takes_every_brand_and_plot(spark, tables):
    rng = random.Random(43)
    brand = {k: f"Brand#{1 + k // 5}{1 + k % 5}" for k in range(25)}
    lines = [(i, 1, rng.randrange(25), rng.choice([1, 4, 10, 20]), 1.0, 1.0) for i in range(300)]
    d = tables(supplier=([(p,) for p in (1, 4, 10, 20, 30)], "s_suppkey long"), part=(list(brand.items()), "p_partkey long, p_brand string"), lineitem=(lines, LINES))
    got = {r["plot"]: r.asDict() for r in entry.queries()["q43_weighted_pivot"](spark, d).collect()}
    assert set(got) == {1, 4, 10, 20, 30}
    for p, row in got.items():
        assert {b: row[b] for b in brand.values()} == {b: (3 if p % 4 == 0 else 1) * sum(x[3] == p and brand[x[2]] == b for x in lines) for b in brand.values()}
    assert sum(got[30][b] for b in brand.values()) == 0


def test_every_point_is_translated(spark, tables):
    d = tables(embeddings=([(i, i % 13, [i / 100, i / 50, 0.5]) for i in range(60)], "vec_id long, label int, embedding array<float>"))
    got = {r["id"]: (r["x"], r["y"]) for r in entry.queries()["q36_translate"](spark, d).collect()}
    assert set(got) == set(range(60))
    assert all(got[i] == pytest.approx((i + i % 13 / 10, 2 * i - i % 13 / 5), abs=1e-4) for i in got)
