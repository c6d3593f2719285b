"""Document quality rules with a cross-document line frequency per host.

Lines are normalised (ASCII lower case, single spaces) and hashed; the documents that hold a line are counted per host;
lines above the limits are removed; a document that loses too much is depleted and rejected, as is one that fails
the base rules on its own text.

Copies count as one document: a document is known by a digest of all its line hashes, so a page that was crawled a
thousand times does not turn its own lines into boilerplate, and documents that share some lines stay apart.

Scale: one Arrow pass makes a few numbers and 12 bytes a line for each document; the texts never shuffle.  Counting
goes by (host, line, document) and then (host, line), both with map-side partial sums, so a line or a host with a third
of all rows is summed before it moves.  The join of lines with the frequent ones is an equi-join that adaptive
execution splits where a line is hot; verdicts join back on a unique row number.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; null and
repeated keys and repeated rows each keep a row of their own; other columns are dropped, or come along inside one
struct whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, row_slices, shingle_hashes, stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

#: Base rules of the contract.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

#: A line is boilerplate of its host if more than this many documents hold it and more than this share of them.
MAX_LINE_DOCS = 10
MAX_LINE_SHARE = 0.01
#: A document is depleted if less than this share of its words is left.
MIN_SHARE_LEFT = 0.3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_hash(line: bytes) -> int:
    """64 bits of the MD5 of the normalised line, unsigned."""
    return int.from_bytes(hashlib.md5(b" ".join(line.lower().split())).digest()[:8], "big")


def document_digest(hashes: Iterable[int]) -> int:
    """64 bits of the MD5 of the distinct line hashes in order, unsigned: equal for documents of the same lines only."""
    return int.from_bytes(hashlib.md5(np.unique(np.fromiter(hashes, np.uint64)).tobytes()).digest()[:8], "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def repeat_words(words: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    h = shingle_hashes(words, window)
    if len(h) < 2:
        return 0
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    if not repeated.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(h)] += repeated
    edge[window:window + len(h)] -= repeated
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str, hasher: WordHash) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The five base measures, and (hash, line number, words) of each line with a word."""
    data = text.encode()
    words = data.split()
    lines = data.split(b"\n")
    full = [(n, line, len(w)) for n, line in enumerate(lines) if (w := line.split())]
    base = [len(words),
            len(text) - (len(data) - len(data.translate(None, SPACES))),
            len(data) - len(data.translate(None, SYMBOLS)),
            len(full) - len({line for _, line, _ in full}),
            repeat_words(hasher.array(words))]
    return base, [(line_hash(line), n, k) for n, line, k in full]


LINE = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.IntegerType())]))


def document_measures(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, the base measures, ``_digest`` and ``_lines`` of every document."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *[T.StructField(m, T.LongType(), False) for m in MEASURES],
                           T.StructField("_digest", T.LongType()), T.StructField("_lines", LINE)])
    arrow_line = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for whole in batches:
            for b in row_slices(whole, text):
                found = [measure(t or "", hasher) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                base = np.array([m for m, _ in found], np.int64).reshape(len(found), len(MEASURES))
                digest = [_signed(document_digest(h for h, _, _ in lines)) if lines else None for _, lines in found]
                flat = [x for _, lines in found for x in lines]
                offsets = np.concatenate([[0], np.cumsum([len(lines) for _, lines in found])])
                inner = pa.StructArray.from_arrays(
                    [pa.array([_signed(x[0]) for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int32()),
                     pa.array([x[2] for x in flat], pa.int32())], names=["h", "n", "words"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner).cast(arrow_line)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.get_field_index(c)) for c in keep], *[pa.array(base[:, i]) for i in range(len(MEASURES))],
                     pa.array(digest, pa.int64()), lists], names=schema.fieldNames())

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def frequent_lines(lines: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(_host, h) of the lines that more than ``max_docs`` and more than ``max_share`` of a host's documents hold.
    ``lines``: (_host, _digest, h), a row for each line of each document."""
    pairs = lines.select("_host", "h", "_digest").distinct()
    per_line = pairs.groupBy("_host", "h").agg(F.count("*").alias("docs"))
    hosts = lines.select("_host", "_digest").distinct().groupBy("_host").agg(F.count("*").alias("host_docs"))
    busy = per_line.filter(F.col("docs") > max_docs)
    return (busy.join(hosts, "_host").filter(F.col("docs") > max_share * F.col("host_docs")).select("_host", "h"))


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", with_row: bool = False,
                  max_docs: int = MAX_LINE_DOCS, max_share: float = MAX_LINE_SHARE,
                  min_left: float = MIN_SHARE_LEFT) -> DataFrame:
    """(key, measures, removed_lines, n_words_left, base_failed, kept) of every row, and ``row``, a struct of all its
    columns, if asked for.

    ``removed_lines`` has the numbers of the lines (split at newlines, from 0) above the limits."""
    keep = ["_key", *(["_source"] if with_row else [])]
    source = df.select(F.col(key).alias("_key"), *([F.struct("*").alias("_source")] if with_row else []),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"),
                       # a null host must not meet an empty one
                       F.when(F.col(host).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(host).cast("string"))).alias("_host"))
    docs = stored(document_measures(source, "_text", [*keep, "_host"]).withColumn("_row", F.monotonically_increasing_id()), "measures")
    lines = docs.select("_row", "_host", "_digest", F.explode("_lines").alias("_l")).select("_row", "_host", "_digest", "_l.h", "_l.n", "_l.words")
    frequent = frequent_lines(lines, max_docs, max_share)
    removed = (lines.select("_row", "_host", "h", "n", "words").join(frequent, ["_host", "h"])
               .groupBy("_row").agg(F.collect_list("n").alias("_n"), F.sum("words").alias("_words")))
    out = docs.drop("_lines", "_digest", "_host").join(removed, "_row", "left")
    left = F.col("n_words") - F.coalesce("_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        F.col("_key").alias(key), *([F.col("_source").alias("row")] if with_row else []), *MEASURES, F.sort_array(F.coalesce("_n", F.array().cast("array<int>"))).alias("removed_lines"),
        left.cast("long").alias("n_words_left"), failed.alias("base_failed"),
        (~failed & (left >= min_left * F.col("n_words"))).alias("kept"))


def without_lines(text, removed):
    """The text without the numbered lines (column expression)."""
    rest = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) > 0, F.array_join(rest, "\n")).otherwise(text)


#: The same in SQL; {max_docs}, {max_share} and {min_left} are the limits.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, array_to_string(list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS gram,
             count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS len FROM w),
rg AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE len = 8) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rg, (SELECT unnest(range(8)) AS k) GROUP BY rid),
l AS (SELECT rid, source, unnest(ls) AS line FROM (SELECT rid, source, string_split(text, chr(10)) AS ls FROM d)),
f AS (SELECT rid, source, line,
             md5(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS h,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, md5(string_agg(DISTINCT h, '' ORDER BY h)) AS sketch FROM f GROUP BY rid),
freq AS (SELECT source, h, count(DISTINCT sketch) AS docs FROM f JOIN dl USING (rid) GROUP BY source, h),
hosts AS (SELECT source, count(DISTINCT sketch) AS host_docs FROM f JOIN dl USING (rid) GROUP BY source),
bad AS (SELECT freq.source, h FROM freq JOIN hosts ON freq.source IS NOT DISTINCT FROM hosts.source
        WHERE docs > {max_docs} AND docs > {max_share} * host_docs),
gone AS (SELECT rid, sum(words) AS words FROM f JOIN bad ON f.h = bad.h AND f.source IS NOT DISTINCT FROM bad.source GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.words, 0) AS gone
      FROM d LEFT JOIN rw USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words - gone)::BIGINT AS n_words_left,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - gone >= {min_left} * n_words AS kept
FROM m
""".replace("{max_docs}", str(MAX_LINE_DOCS)).replace("{max_share}", str(MAX_LINE_SHARE)).replace("{min_left}", str(MIN_SHARE_LEFT))
