"""The metric join against brute force, with its recursion forced by small blocks."""

import random

import numpy as np
import pytest

from coppice.llm import metric_join

from . import brute


def compared(spark, docs, words, percent, bits=64):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in metric_join.joined(df, words, percent, bits=bits).collect()), key=str)
    sets, root = brute.near(docs, words, percent)
    least = {}
    for (i, _), r in zip(docs, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, len(s), least.get(r) if s else i) for (i, _), s, r in zip(docs, sets, root, strict=True)), key=str)
    assert got == want


@pytest.mark.parametrize("words,percent,bits", [(3, 90, 64), (5, 80, 64), (3, 90, 5), (2, 100, 64), (3, 60, 64)])
def test_equals_brute_force(spark, words, percent, bits):
    """With five bits most sets share their first hash with others."""
    compared(spark, brute.documents(), words, percent, bits)


def clouds(seed=4):
    """Groups of texts at all distances from each other, one large, a hub line in many, and chains."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    text = lambda n: [word() for _ in range(n)]

    def changed(base, n):
        out = list(base)
        for _ in range(n):
            out[rng.randrange(len(out))] = word()
        return out

    docs, hub = [], text(12)
    for size, most, n in ((60, 3, 120), (40, 12, 200), (25, 1, 90)):
        base = text(n)
        docs += [changed(base, rng.randrange(most + 1)) for _ in range(size)]
    chain = text(150)
    for _ in range(30):
        chain = changed(chain, 2)
        docs.append(chain)
    docs += [text(5) + hub + text(6) for _ in range(30)] + [text(rng.randrange(1, 60)) for _ in range(30)]
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("percent,block,spread", [(90, 1 << 9, 3), (90, 1 << 11, 100), (75, 1 << 10, 1)])
def test_recursion_equals_brute_force(spark, monkeypatch, percent, block, spread):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "SPREAD", spread)
    calls = []
    for name in ("cut", "tasks"):
        plain = getattr(metric_join, name)
        monkeypatch.setattr(metric_join, name, lambda *a, f=plain, n=name: calls.append((n, *a[1:])) or f(*a))
    compared(spark, clouds(), 3, percent)
    assert [c for c in calls if c[0] == "cut"]


def test_windows_lose_no_pair():
    rng = np.random.default_rng(8)
    for _ in range(200):
        percent = int(rng.choice([60, 80, 90]))
        pool = rng.integers(1, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
        base = rng.choice(pool, int(rng.integers(9, 120)), replace=False)
        other = np.unique(np.concatenate([base[int(rng.integers(0, 12)) :], rng.choice(pool, int(rng.integers(0, 6)))]))
        base = np.unique(base)
        common = len(np.intersect1d(base, other))
        if 100 * common < percent * (len(base) + len(other) - common) or common == len(base) == len(other):
            continue
        last = np.sort(rng.choice(pool, 50, replace=False))
        values, offsets = np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])
        pivot, owner = metric_join.windows(values, offsets, last, percent)
        rings = metric_join.ring(np.diff(offsets), percent)
        keys = [{(p, rings[i] - k) for p in pivot[owner == i].tolist() for k in (0, 1)} for i in (0, 1)]
        assert keys[0] & keys[1]


def test_places_lose_no_pair():
    """Random sets near each other: wherever one is at home, the other is too."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        percent = int(rng.choice([75, 80, 90]))
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[int(rng.integers(0, 55)) :], rng.integers(0, 1 << 40, int(rng.integers(1, 30))).astype(np.uint64)])) for _ in range(8)]
        pivots = metric_join.Pivots(list(enumerate(sets[2:])))
        x = sets[0]
        y = np.unique(np.concatenate([x[int(rng.integers(0, 6)) :], rng.integers(0, 1 << 40, int(rng.integers(0, 3))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common):
            continue
        a, b = (dict(metric_join.places(pivots.distances(s)[1][pivots.apart], 1 - percent / 100)) for s in (x, y))
        assert sum(a.values()) == sum(b.values()) == 1
        assert next(p for p, home in a.items() if home) in b
        assert next(p for p, home in b.items() if home) in a


def test_empty_table_and_clashing_columns(spark):
    assert metric_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = brute.documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, TEXT string, node int")
    assert metric_join.joined(df, 3, 90).columns == ["doc_id", "n_shingles", "component_id"]
    assert metric_join.joined(df, 3, 90).count() == len(docs)
