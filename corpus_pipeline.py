"""Training-corpus pipeline over ``documents``: five stages, each one operator of ``seqflip.llm``.

Every stage gets what its predecessor kept and returns the columns of documents; the last one returns the encoded
corpus.  ``run`` writes each stage as Parquet in the shared folder and rereads it, so a lost executor replays one stage at
most; a stage's scratch tables go when it is written, its input when the next one is.

Defined cases: columns that a stage does not name pass through, whatever they are called; columns of the input called
``token_ids`` or ``n_tokens`` come out as ``input_token_ids`` and ``input_n_tokens``; ``n_chars`` is always that of the text as it
has become; null and empty texts have no words
and go in the first stage; rows without a doc_id are documents like any other, but decontamination knows a document by its
doc_id, so all of them go if one leaks; equal rows are copies, of which one stays; a null source is a host of its own;
texts of any length are processed whole; empty tables give an empty corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqflip.llm.bpe import encode
from seqflip.llm.common import forget, settled
from seqflip.llm.decontamination import benchmark_leaks
from seqflip.llm.near_dedup import drop_near_duplicates
from seqflip.llm.passages import remove_passages
from seqflip.llm.quality import quality_rules, without_lines

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are depleted; boilerplate lines leave the others."""
    kept = quality_rules(docs, with_row=True).filter("kept")
    text = without_lines(F.coalesce(F.col("row.text"), F.lit("")), F.col("removed_lines"))
    row = F.col("row").withField("text", text)
    return kept.select(row.alias("row")).select("row.*").withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8): the smallest doc_id."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur elsewhere leave all documents but one; emptied documents go."""
    rest = remove_passages(docs)
    return rest.withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; a document is known by its doc_id."""
    leaks = benchmark_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.alias("d").join(leaks.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left."""
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c.lower() in ("token_ids", "n_tokens")})
    encoded = encode(docs, public_tokenizers.path(VOCABULARY), out="token_ids")
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate), ("bpe", bpe)]

#: Passage windows, the latent space and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
