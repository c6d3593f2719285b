"""``opN_<name>``: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality import QUALITY_SQL, quality_rules
from .queries import register

SHARDS = 40


@register("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``key``: doc_id and the shard count decide, 40 equal shards, grown by one."""
    from .sharding import shard_records

    out = shard_records(table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, grown_weight=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded_digests

    return encoded_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@register("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the ``source`` of each document."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("removed_lines")


@register("op1_warc")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no capture time; page_id counts the seconds from 2020-01-01."""
    from .warc import capture_history

    pages = table(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id")))
    history = capture_history(pages, "page_id", "url", "captured", "html")
    return history.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey")


@register("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    from .token_counts import attribute_tokens

    return attribute_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("stays")


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, five-word shingles, similarity 0.8: pairs of a document and the document whose
    passage it repeats, with the words of both."""
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("source", "source_doc_id")


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"))


@register("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark."""
    from .decontamination import benchmark_leaks

    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("answer", "answer_share")


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four components of 256ths; ``deviation`` is null where it goes beyond a long (the operator has it as a decimal)."""
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@register("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, two differing bits."""
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))
