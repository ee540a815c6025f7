"""The queries that apply this subpackage's operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compress_quality, fm_decontam, gru_langid, lpf_dedup, media, metric_join, oracle, prefix_trie, tag_paths, tensor_minhash, token_count, trigram_secrets, vector_codes
from .common import held_out, table, written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fm_decontam.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return marked.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    payloads = written(media.described(media.kept(docs)))
    n_bytes = F.octet_length("text").cast("long")
    page = media.illustrated(F.col("text"), F.sha2(media.stored_image(F.col("text")), 256), F.concat(n_bytes.cast("string"), F.lit(" bytes")))
    out = media.resolved(media.sequences(docs.select("doc_id", n_bytes.alias("n_bytes"), page.alias("html"))), payloads)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature", "position", "caption")


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = gru_langid.train(*gru_langid.sampled(docs.where(~held_out())))
    return gru_langid.predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), net)


def op5_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpf_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = compress_quality.fit(docs, labels, "quality")
    return compress_quality.scored(docs.withColumn("held_out", held_out()), model).drop("text")


def op7_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_count.token_counts(docs, token_count.model_text(_vocabulary("word_bpe_49k.json")))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(trigram_secrets.BASE))
    return found.select("doc_id", *[count(r.kind) for r in trigram_secrets.BASE], F.sha2(trigram_secrets.rendered(base), 256).alias("base_sha256"), trigram_secrets.rendered(F.col("spans")).alias("spans"))


def op9_matrix_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(_vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        packed = f.read()
    return byte_bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), packed, public_tokenizers.PATTERN)


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tensor_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.joined(table(spark, sf_dir, "documents"), words=3, percent=90)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_fm_index_decontamination,
        op2_interleaved_media,
        op3_tag_path_ratios,
        op4_gru_language,
        op5_longest_previous_factors,
        op6_compression_quality,
        op7_overlap_token_counts,
        op8_trigram_secrets,
        op9_matrix_byte_bpe,
        op10_tensored_minhash,
        op11_vector_codes,
        op12_jaccard_metric_join,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_fm_index_decontamination": oracle.decontamination(),
        "op2_interleaved_media": oracle.media(),
        "op8_trigram_secrets": oracle.secrets(),
        "op10_tensored_minhash": oracle.near_duplicates(),
        "op11_vector_codes": oracle.vector_codes(),
        "op12_jaccard_metric_join": oracle.near_duplicates(3, 90, kept=False),
        "op13_prefix_trie": oracle.prefix_trie(),
    }
