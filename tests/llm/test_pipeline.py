import numpy as np
import pytest

import corpus_pipeline
from coppice.llm import queries

from . import brute

VECTORS = "vec_id long, label int, embedding array<float>"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    good = lambda n=120: " ".join(rng.choice(words, n)) + "."
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((i, "!! ".join(rng.choice(words, 90)).upper() if bad else good()))
        labels.append((i, int(not bad), 0))
    item = good(30)
    rows += [(300, rows[1][1]), (301, rows[1][1] + " more"), (302, good(40) + " " + item + " " + good(40)), (303, good() + " password: hunter22xyz " + good()), (304, None), (305, ""), (306, rows[2][1]), (306, rows[2][1])]
    full = [(i, t, "en", "s", None if t is None else len(t), f"e{i}", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, _row int"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, item


def test_stages(spark, tables):
    from coppice.llm.common import written

    sf_dir, rows, item = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert all(r["score"] == f"e{i}" for i, r in kept[-1].items())
        assert name
    quality, dedup, clean, redacted = kept
    assert sum(i % 4 == 0 for i in quality if i < 200) <= 3
    assert sum(i % 4 != 0 for i in quality if i < 200) >= 148
    assert 1 in dedup
    assert not {300, 301, 306} & set(dedup)
    assert len(dedup) >= len(quality) - 6
    assert not any(brute.contaminated(r["text"], [(1, item)])[4] for r in clean.values())
    assert set(clean) == set(dedup)
    assert not any(brute.secrets(r["text"]) for r in redacted.values())
    assert "[redacted]" in redacted[303]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.values() if r["text"] is not None)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in last} == set(redacted)
    assert all(r["decoded_sha256"] == brute.sha(redacted[r["doc_id"]]["text"] or "") for r in last)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole) == sorted((r["doc_id"], r["ids_sha256"]) for r in last)


def test_queries_on_tables(spark, tables):
    sf_dir, rows, _ = tables
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{sf_dir}/pages.parquet")
    vectors = [(i, i % 3, [0.25 * i] * 8) for i in range(20)] + [(20, None, None)]
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{sf_dir}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yes")], TURNS).write.parquet(f"{sf_dir}/conversations.parquet")
    # no conversation 0 lends turns; 1 drops its first three (it has one), 2 its first: the root and one node
    want = {"op3": 1, "op11": 20, "op13": 2}
    for name, query in queries.queries().items():
        n = query(spark, sf_dir).count()
        assert n == want.get(name.split("_")[0], len(rows)), name


def test_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    labels, benchmark = "doc_id long, quality int, toxic int", "item_id long, text string"

    def made(name, docs, marks, items):
        spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, benchmark).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        return f"{tmp_path}/{name}"

    assert corpus_pipeline.run(spark, made("none", [], [], [])).collect() == []
    docs = [(i, t, None, None, None) for i, t in enumerate(["one two three", None, "", "one two three", "another text"])]
    # without labels every text has the score 0.5 and stays; without benchmark nothing is cut
    rows = corpus_pipeline.run(spark, made("unlabelled", docs, [], [])).collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2, 4]
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: brute.sha(docs[i][1] or "") for i in (0, 1, 2, 4)}
    for name, query in queries.queries().items():
        if not name.startswith("op3_"):
            assert query(spark, f"{tmp_path}/none").count() == 0, name
