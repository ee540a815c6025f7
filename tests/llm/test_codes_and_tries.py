"""Vector codes and prefix tries against plain versions, with every odd case."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from coppice.llm import prefix_trie, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lengths = [len(r[1]) for r in kept if len(r[1]) and len(r[1]) % parts == 0]
    if not lengths:
        return [(r[0], None, None, None) for r in kept], []
    width = lengths[0] // parts
    whole = lambda x: math.floor(x * scale) if abs(x) < 1e200 else int(x) * scale
    cut = lambda v: [[whole(x) for x in v[p * width : (p + 1) * width]] for p in range(parts)]
    fits = [cut(r[1]) if len(r[1]) == lengths[0] else None for r in kept]
    some = [f for f in fits if f]
    books = [[f[p] for f in some[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(f[p], books[p])[1] for f in some]
            for e in range(len(books[p])):
                mine = [f[p] for f, g in zip(some, got, strict=True) if g == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for f in fits:
        found = [near(f[p], books[p]) for p in range(parts)] if f else None
        error = sum(d for d, _ in found) if found else None
        out.append(("".join(f"{i:02x}" for _, i in found) if found else None, error if error is None or error < 1 << 63 else None))
    per = {}
    for r, (_, e) in zip(kept, out, strict=True):
        per.setdefault(r[2], []).append(e)
    total = {k: None if None in v or sum(v) >= 1 << 63 else sum(v) for k, v in per.items()}
    return [(r[0], c, e, total[r[2]]) for r, (c, e) in zip(kept, out, strict=True)], books


def vectors(seed=3, n=120, length=16, far=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, far) for _ in range(length)], rng.choice([1, 1, 2, None])) for i in range(n)]
    rows += [(500 + i, rows[2][1], 7) for i in range(40)]  # one vector very often
    return rows + [(7, rows[3][1], 3), (7, rows[3][1], 3), (None, rows[4][1], 1), (901, [0.5 / 4096] * length, None), (902, [-0.5 / 4096] * length, 2)]


ODD = [(800, None, 1), (801, [None] + [0.1] * 15, 1), (802, [math.nan] + [0.1] * 15, 1), (803, [math.inf] + [0.1] * 15, 1), (804, [0.1] * 8, 4), (805, [], 5), (806, [0.1] * 3, None)]


@pytest.mark.parametrize("rows", [vectors() + ODD, vectors(n=7, far=1e30), vectors(n=5, far=3e8)[:3], ODD[:4], ODD[5:]])
def test_codes_equal_the_plain_version(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = vector_codes.compressed(df).collect()
    want, books = plain_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=key) == sorted(want, key=key)
    text = ",".join(str(x) for book in books for c in book for x in c)
    assert {r["codebooks_sha256"] for r in out} <= {hashlib.sha256(text.encode()).hexdigest()}


def test_no_vectors(spark):
    assert vector_codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_sizes_and_columns(spark):
    rows = vectors(n=60, length=12)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("mine").alias("code"), F.lit(1).alias("Vec_Id"))
    books = vector_codes.trained(df, parts=4, entries=5, rounds=2)
    assert [[list(map(int, c)) for c in b] for b in books] == plain_codes(rows, 4, 5, 2)[1]
    out = vector_codes.coded(df, books)
    assert out.columns == ["vec_id", "label", "Vec_Id", "code", "error"]
    assert [r[2] for r in out.collect()] == [1] * len(rows)
    assert {len(r["code"]) for r in out.collect()} == {8}


WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_trie(rows, every=20, kinds=4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, role, text))
    seqs = {}
    for turns in own.values():
        turns.sort()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % kinds
        base = c - int(math.fmod(c, every))
        seqs[c] = tuple((t[2], t[3]) for t in own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed=2, n=150):
    rng = random.Random(seed)
    say = lambda: rng.choice(["yes", "no  no", "", None, "what is é\tthis", " x "])
    rows = []
    for c in [*range(n), -3, -20, -21, 10**12]:
        if c not in (40, 60):  # heads that are absent
            rows += [(c, t, rng.choice(["user", "assistant", None]), say()) for t in range(rng.choice([1, 1, 2, 3, 5, 9]))]
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(70) for t in range(4)]  # one conversation very often
    rows += [(2000, t, "user", f"long {t}") for t in range(700)] + [(2001, t, "user", f"long {t}") for t in range(650)]
    rows += [(3000, None, "user", "null"), (3000, 1, "b", "tie"), (3000, 1, "a", "tie"), (3000, 1, "a", "tie"), (None, 1, "a", "none"), (3000, -1, "a", "w " * 9000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_trie_equals_the_plain_version(spark, partitions):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit("x").alias("key"), F.lit(5).alias("Turn")).repartition(6)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turns(df))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((tuple(r) for r in out), key=str) == plain_trie(rows)


def test_trie_of_plain_conversations_and_of_none(spark):
    rows = [(1, 0, "u", "a b"), (2, 0, "u", "a b"), (2, 1, "u", "c")]
    out = prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns(spark.createDataFrame(rows, TURNS)))).collect()
    assert sorted((r["depth"], r["n_convs"], r["saved_tokens"]) for r in out) == [(0, 2, 2), (1, 2, 2), (2, 1, 0)]
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turns(none))).count() == 0
