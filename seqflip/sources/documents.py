"""Document texts as token sequences.

Every text of at least ``L`` characters is cut into ``ceil(n / L)`` windows of
``L`` characters: window ``w`` starts at ``least(w*L, n-L)``, so the last
window is aligned to the end and every character of the whole text is in some
window.  Token = ``code point % K``.  Texts shorter than ``L`` (or NULL) are
reported by :func:`short_documents` instead.

The text of a document is tokenised once, in blocks of ``BLOCK_WINDOWS`` windows, and the windows are slices of
the blocks; nothing is re-scanned per window.  The work is map-only: no
shuffle, and a scan task's share of windows is proportional to its share of
text bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import char_tokens
from ..functions.hashing import split_name
from ..spec import SequenceSpec


#: Windows that are cut from one block of text at a time.
BLOCK_WINDOWS = 1_000


def _blocks(documents: DataFrame, L: int, keep: Sequence[str], block_windows: int) -> DataFrame:
    """``(doc_id, *keep, _first, _chunk)``: every text as blocks of whole windows, and the window aligned to its end as a
    block of its own where the length is no multiple of ``L``.  Arrays of characters are made from blocks, so their size
    has a bound however long a text is."""
    docs = documents.where(F.length("text") >= L)
    n = F.length("text")
    full = F.floor(n / L).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), full - 1, F.lit(block_windows)), lambda s: F.struct(
        s.alias("first"), F.substr("text", s * L + 1, F.least(F.lit(block_windows), full - s) * L).alias("chunk")))
    tail = F.struct(full.alias("first"), F.substr("text", n - L + 1, F.lit(L)).alias("chunk"))
    both = F.when(n % L != 0, F.concat(blocks, F.array(tail))).otherwise(blocks)
    return (docs.select("doc_id", *keep, F.explode_outer(both).alias("_b")).where(F.col("_b").isNotNull())
            .select("doc_id", *keep, F.col("_b.first").alias("_first"), F.col("_b.chunk").alias("_chunk")))


def document_windows(documents: DataFrame, spec: SequenceSpec = SequenceSpec(),
                     keep: Sequence[str] = (), block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``documents(doc_id, text, ...)`` -> ``(doc_id, *keep, win INT, tokens ARRAY<INT>)``."""
    L, K = spec.length, spec.alphabet
    docs = _blocks(documents, L, keep, block_windows).select("doc_id", *keep, "_first", char_tokens("_chunk", K).alias("_toks"))
    # One expression builds all windows of a block from the tokenised array
    # (referenced twice, so the optimiser keeps it materialised once).
    windows = F.transform(F.sequence(F.lit(0), (F.size("_toks") / L).cast("int") - 1), lambda w: F.slice(F.col("_toks"), w * L + 1, L))
    return (docs.select("doc_id", *keep, "_first", F.posexplode(windows).alias("_w", "tokens"))
            .select("doc_id", *keep, (F.col("_first") + F.col("_w")).cast("int").alias("win"), "tokens"))


def document_text_windows(documents: DataFrame, spec: SequenceSpec = SequenceSpec(),
                          keep: Sequence[str] = (), block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The same windows as raw text: ``(doc_id, *keep, win INT, chunk STRING)``."""
    L = spec.length
    docs = _blocks(documents, L, keep, block_windows)
    windows = F.transform(F.sequence(F.lit(0), F.floor(F.length("_chunk") / L).cast("int") - 1),
                          lambda w: F.substr(F.col("_chunk"), w * L + 1, F.lit(L)))
    return (docs.select("doc_id", *keep, "_first", F.posexplode(windows).alias("_w", "chunk"))
            .select("doc_id", *keep, (F.col("_first") + F.col("_w")).cast("int").alias("win"), "chunk"))


def short_documents(documents: DataFrame, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """Documents that cannot form one window (quarantine of the text source)."""
    return (documents.where(F.col("text").isNull() | (F.length("text") < spec.length))
            .select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"),
                    F.when(F.col("text").isNull(), "null_text").otherwise("too_short").alias("reason")))


def labelled_documents(documents: DataFrame, labels: DataFrame, spec: SequenceSpec = SequenceSpec(),
                       label_col: str = "quality") -> DataFrame:
    """Join documents to their labels (on whole document rows, before windowing,
    so the join moves one row per document) and assign the hash split."""
    lab = labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
    return (documents.select("doc_id", "text").join(lab, "doc_id")
            .withColumn("split", split_name(spec.seed, F.col("doc_id"))))


def labelled_windows(documents: DataFrame, labels: DataFrame, spec: SequenceSpec = SequenceSpec(),
                     label_col: str = "quality") -> DataFrame:
    """``(doc_id, label, split, win, tokens)`` for every window of every labelled text."""
    return document_windows(labelled_documents(documents, labels, spec, label_col), spec,
                            keep=("label", "split"))
