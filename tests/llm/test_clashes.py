"""Every operator with extra columns called like its own, in upper and lower case, and on an empty table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from coppice.llm import byte_bpe, compress_quality, fm_decontam, gru_langid, lpf_dedup, media, tag_paths, tensor_minhash, token_count, trigram_secrets
from coppice.llm.queries import _vocabulary

NAMES = (
    "_row _key _id _full _part _vkey _text _folded _rules _node _class _first _least _label _fold _h _item _place place block blocks cluster node root task probe group _set key least count "
    "h c n pos lo hi left right bytes many times rep items spans n_bytes n_removed kept_sha256 n_words n_tokens n_shingles ids ids_sha256 decoded_sha256 score predicted lang_pred "
    "position caption digest stored feature payload_bytes n_chars sequence html Doc_ID TEXT _x0 _x1 parts label x"
).split()


def words(i: int) -> str:
    return " ".join(f"word{i}x{k}" for k in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [words(1), words(1), words(2) + " password: hunter22x", None, "", words(3) + " " + words(1)]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *[StructField(n, StringType()) for n in NAMES]])
    return spark.createDataFrame([(i, t, *[f"{n}={i}" for n in NAMES]) for i, t in enumerate(texts)], schema).repartition(2)


def benchmark(spark):
    return spark.createDataFrame([("a", words(2))], "item_id string, text string")


def packed() -> bytes:
    with open(_vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def op2(spark, d):
    page = F.lit("<p>a</p><img src='sha256:abc' alt='x'><p>b</p>")
    named = d.toDF(*[c if c not in ("html", "text") else {"html": "other", "text": "html"}[c] for c in d.columns])
    named = named.withColumn("html", page)
    table = spark.createDataFrame([("abc", 7)], "digest string, payload_bytes long")
    return media.resolved(media.sequences(named), table)


def op3(spark, d):
    return tag_paths.extracted(d.toDF(*[c if c not in ("html", "text") else {"html": "other", "text": "html"}[c] for c in d.columns]))


#: How each operator is called, and whether it leaves rows or columns out: names that give way.
CALLS = {
    "op1": (lambda s, d: fm_decontam.marked(d, benchmark(s)), {"n_words", "spans", "items"}),
    "op1_cleaned": (lambda s, d: fm_decontam.cleaned(d, benchmark(s)), set()),
    "op2": (op2, {"position", "caption", "digest", "payload_bytes", "sequence", "html", "TEXT"}),
    "op3": (op3, {"n_chars", "html", "TEXT"}),
    "op4": (lambda s, d: gru_langid.predicted(d, gru_langid.train(*gru_langid.sampled(d.withColumn("lang", F.lit("en"))), steps=2)), {"lang_pred", "score"}),
    "op5": (lambda s, d: lpf_dedup.removed(d), {"n_bytes", "spans", "n_removed", "kept_sha256"}),
    "op6": (lambda s, d: compress_quality.scored(d, compress_quality.fit(d, s.createDataFrame([(1, 1, 0), (5, 0, 1)], "doc_id long, quality int, DOC_ID int"), "quality")), {"score", "predicted"}),
    "op7": (lambda s, d: token_count.token_counts(d, token_count.model_text(_vocabulary("word_bpe_49k.json"))), {"n_bytes", "n_tokens"}),
    "op8": (lambda s, d: trigram_secrets.scanned(d), {"spans"}),
    "op9": (lambda s, d: byte_bpe.encoded(d, packed(), r"\S+|\s+", with_ids=True), {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}),
    "op10": (lambda s, d: tensor_minhash.deduplicated(d), set()),
}


@pytest.mark.parametrize("name", CALLS)
def test_columns_of_any_name_are_carried(spark, docs, name):
    call, gives_way = CALLS[name]
    out = call(spark, docs)
    rows = out.collect()
    assert len(rows) == (5 if name == "op10" else 6)
    columns = out.columns
    for n in NAMES:
        if n not in gives_way:
            assert [r[columns.index(n)] for r in rows] == [f"{n}={r[columns.index('doc_id')]}" for r in rows], n
    assert len(columns) == len(set(columns))
    empty = call(spark, docs.limit(0))
    assert empty.columns == columns
    assert empty.count() == 0
