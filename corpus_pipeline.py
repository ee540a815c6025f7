"""A corpus pipeline: stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. Columns other than doc_id and text, whatever their names, are carried
along untouched (n_chars follows the text).

quality: documents that the compression classifier scores under 0.3 go.
near_dedup: of each class of near duplicates (five words, 0.8) the row with the
    least doc_id stays; texts without words are alone and stay.
decontaminate: spans of benchmark phrases (ten words) are cut out of the texts.
redact_secrets: secrets are replaced by a mark.
encode: byte-level BPE ids, their count and hashes. A null text has no ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm import byte_bpe, compress_quality, fm_decontam, tensor_minhash, trigram_secrets
from coppice.llm.common import guarded, held_out, picked, table, written


def _carried(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change(docs)`` with the columns of ``docs`` alone, whatever their names; n_chars follows the text."""

    def changed(d: DataFrame) -> DataFrame:
        out = change(d).select(*d.columns)
        if "n_chars" in docs.columns:
            i = docs.columns.index("n_chars")
            out = out.withColumn(d.columns[i], F.coalesce(F.length("text").cast(docs.schema[i].dataType), F.col(d.columns[i])))
        return out

    return guarded(docs, ("doc_id", "text"), changed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = compress_quality.fit(docs, labels, "quality")
    return _carried(docs, lambda d: compress_quality.scored(d, model).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, lambda d: tensor_minhash.deduplicated(d, words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, lambda d: fm_decontam.cleaned(d, table(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, lambda d: trigram_secrets.scanned(d).withColumn("text", trigram_secrets.redacted(F.col("text"), F.col("spans"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        packed = f.read()
    return byte_bpe.encoded(picked(docs, "doc_id", "text"), packed, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact_secrets", redact_secrets), ("encode", encode)]

#: Compressors, hash families and token merges are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
