"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

1. One Arrow pass turns each whole text into a 64-bit fingerprint; equal fingerprints become one row before anything is
   searched, so copies cost one row each of one aggregation.
2. A fingerprint has two segments of 32 bits.  Of two fingerprints at ``RADIUS`` = 2 or fewer differing bits one segment
   differs in one bit at most.  So each fingerprint enumerates the Hamming ball of radius 1 in each of its segments (33
   values), and fetches from the segment's table the fingerprints that hold one of the values.  Complete distances verify them.
3. A table entry that more than ``MAX_ENTRY`` fingerprints share is not fetched, as its members would all be paired.  Who
   holds or fetches such an entry posts the complete fingerprints of its two balls instead (65): of two fingerprints at two or
   fewer bits one of either's postings is the same, and all that meet in one posting are at two or fewer bits of each
   other, so a link of each to the smallest of them keeps them connected.  Distances verify these links too.  The work is
   65 rows a fingerprint however many share the entry, and no link is lost.
4. Components of the links; each is named by the smallest key of its documents.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; with fewer words than a shingle the
whole sequence is the one shingle; null keys name a component only if all its keys are null; repeated rows are copies and
all stay; other columns are dropped, whatever they are called; an empty table gives an empty result; a text's shingles are
hashed in blocks, so its length has no limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, row_slices, stored
from .components import connected_components

SEED = 42
RADIUS = 2
SEGMENT_BITS = 32
#: Fingerprints that a table entry may hold and still be fetched; beyond that complete fingerprints are posted.
MAX_ENTRY = 32


def fingerprint(text: str | None, width: int = 3, block: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(width, len(words))
    n = len(words) - size + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = words[at:at + block + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8", len(part) - size + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, fp long) of every row."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text"):
                prints = [fingerprint(t, width) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def flips(first: int, last: int) -> Column:
    """The masks of the Hamming ball of radius 1 in the bits from ``first`` to ``last``."""
    ones = [1 << b for b in range(first, last + 1)]
    return F.array(F.lit(0).cast("long"), *[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in ones])


def segments(fp: str) -> Column:
    """(s, v) of both segments."""
    return F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned(F.col(fp), s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).alias("v"))
                     for s in (0, 1)])


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def entries(prints: DataFrame) -> DataFrame:
    """The tables of both segments: (s, v, fp)."""
    return prints.select("fp", F.explode(segments("fp")).alias("x")).select("x.s", "x.v", "fp")


def probes(prints: DataFrame) -> DataFrame:
    """(s, v, fp): the values of the balls in both segments."""
    ball = flips(0, SEGMENT_BITS - 1)
    return entries(prints).select("s", "fp", F.explode(F.transform(ball, lambda m: F.col("v").bitwiseXOR(m))).alias("v")).select("s", "v", "fp")


def met_entries(prints: DataFrame, max_entry: int) -> DataFrame:
    """(fp, members, full): the entries that each fingerprint fetches; a full one has no members."""
    table = entries(prints)
    sizes = table.groupBy("s", "v").agg(F.count("*").alias("size"))
    # An entry is a row of its members, or none where they are too many; the probes meet it once.
    member_lists = (table.hint("merge").join(sizes, ["s", "v"]).groupBy("s", "v")
                    .agg(F.max("size").alias("size"), F.collect_list(F.when(F.col("size") <= max_entry, F.col("fp"))).alias("members")))
    # Spark takes an exploded table to be as small as the table before; without the hint it would send all probes to the driver.
    return (probes(prints).hint("merge").join(member_lists, ["s", "v"])
            .filter((F.col("size") > max_entry) | (F.size("members") > 1) | (F.get("members", F.lit(0)) != F.col("fp")))
            .select("fp", "members", (F.col("size") > max_entry).alias("full")))


def fetched_links(prints: DataFrame, radius: int, max_entry: int) -> tuple[DataFrame, DataFrame]:
    """The verified links (a < b) over entries that can be fetched, and the fingerprints (fp) that hold or fetch another."""
    met = stored(met_entries(prints, max_entry), "met")
    pairs = met.filter("NOT full").select(F.col("fp").alias("a"), F.explode("members").alias("b"))
    links = pairs.filter(F.col("a") < F.col("b")).filter(distance("a", "b") <= radius).distinct()
    return links, met.filter("full").select("fp").distinct()


def posted_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links that connect all pairs (of these fingerprints) at ``radius`` = 2: those that meet in a posting, with the
    smallest of them."""
    posted = prints.select("fp", F.explode(F.transform(flips(0, 63), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = posted.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("point", "least")
    pairs = posted.hint("merge").join(least, "point").filter("fp <> least")
    return pairs.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct().filter(distance("a", "b") <= radius)


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, max_entry: int = MAX_ENTRY) -> DataFrame:
    """(key, fingerprint, component_id) of every row: 16 lower-case hex digits, and the smallest key reachable over
    fingerprints at two or fewer differing bits."""
    rows = stored(fingerprints(df, key, text, width), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    fetched, crowded = fetched_links(prints.select("fp"), RADIUS, max_entry)
    links = stored(fetched.unionByName(posted_links(crowded, RADIUS)).distinct(), "links")
    nodes = connected_components(links)
    forget(links)
    placed = prints.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(names, "component").select("fp", "component_id"), "named")
    forget(prints)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select(F.col("key").alias(key), hexed.alias("fingerprint"), "component_id")
