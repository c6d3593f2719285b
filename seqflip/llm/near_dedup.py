"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. One Arrow pass turns each whole text into its set of word shingles, a digest of the set, and a signature of
   ``n_coordinates`` minima.  Documents of equal sets become one class.
2. Classes are posted under each (coordinate, value).  Postings met once cannot collide and go; a class with fewer than
   the match threshold of the others cannot reach it and goes too.
3. Prefix and skip merging: with the rarest postings first, two classes that agree in ``t`` of ``m`` coordinates share one
   of the ``m - t + 1`` rarest of either.  Only those prefixes are merged; the long lists behind them are skipped, and their
   collisions are counted by comparing the signatures of a candidate pair.  Pairs below the threshold go.
4. Links are confirmed on the full shingle sets, in integers.

The threshold is the largest one that a pair at the similarity limit misses with a chance below ``MISS``.

Large groups of near copies: a posting list is first joined as a star around its most central member (the one with the
smallest share of shingles that no other has), which needs a pair for each posting and not for each pair of postings, and
the links found are contracted to components.  Then only
pairs between different components can still matter.  They are taken from the lists that hold two components or
more, between members outside a list's largest component and the rest of it, and only where the shingles that a class
shares with any other leave room for the limit (sizes and shared counts are exact bounds).  No list is capped and no
link between components is lost.

Defined cases: texts without words have an empty set and link with nothing; with fewer words than a shingle the whole
sequence is the one shingle; null keys are never the name of a component unless all its keys are null; repeated rows
are copies; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_shingles, forget, mix, row_slices, settled, stored
from .components import connected_components

N_COORDINATES = 32
#: Parts of the hash space in which the shingles of a class are counted.
PARTS = 64
#: Chance that a pair at the similarity limit has fewer matches than the threshold.
MISS = 1e-7


def match_threshold(n: int, percent: int, miss: float = MISS) -> int:
    """The largest t with P(fewer than t matches of n) <= miss at a similarity of ``percent``."""
    p, total = percent / 100, 0.0
    for t in range(n + 1):
        total += comb(n, t) * p ** t * (1 - p) ** (n - t)
        if total > miss:
            return max(1, t)
    return n


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Distinct shingles (64-bit hashes, ascending) of the words of each text, ASCII letters in lower case."""
    return [np.unique(s) for s in column_shingles(texts, width, short=True)]


def coordinate_factors(n: int) -> np.ndarray:
    """Odd multipliers, one for each coordinate."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray, block: int = 8192) -> np.ndarray:
    """The top 31 bits of each coordinate's minimum."""
    least = None
    for at in range(0, len(shingles), block):
        m = (shingles[at:at + block, None] * factors[None, :]).min(axis=0)
        least = m if least is None else np.minimum(least, m)
    return (least >> np.uint64(33)).astype(np.int32)


def document_signatures(df: DataFrame, key: str, text: str, width: int, n: int) -> DataFrame:
    """(key, text_id, n_shingles, set_key, sig) of every row; set_key and sig are null for an empty set."""
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), T.StructField("text_id", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])
    factors = coordinate_factors(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text"):
                sets = shingle_sets(b.column(2), width)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, factors) if len(s) else None for s in sets], pa.list_(pa.int32()))], names=schema.fieldNames())

    return _texts(df, key, text).mapInArrow(run, schema)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("key"), F.unhex(F.md5(t.cast("binary"))).alias("text_id"), t.alias("text"))


def class_sets(df: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(c, shingles) of the wanted classes (c, key, text_id of one of their documents), from the whole texts."""
    rows = _texts(df, key, text).alias("d").join(
        wanted.alias("w"), F.col("d.key").eqNullSafe(F.col("w.key")) & (F.col("d.text_id") == F.col("w.text_id")))
    one = rows.select("w.c", "d.text").dropDuplicates(["c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(b.column(1), width)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])

    return one.mapInArrow(run, "c long, shingles array<long>")


def prefix_postings(classes: DataFrame, threshold: int) -> DataFrame:
    """(posting, c, score): the prefix of every class that can reach the threshold.  ``score`` is how often the class's
    postings occur in all, which is greatest for the most central member of a group."""
    spread = classes.select("c", F.posexplode("sig").alias("i", "v")).select(
        "c", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long")).alias("posting"))
    spread = stored(spread, "postings")
    met = spread.groupBy("posting").agg(F.count("*").alias("freq")).filter("freq > 1")
    mine = Window.partitionBy("c")
    ranked = (spread.join(met, "posting")
              .withColumn("m", F.count("*").over(mine)).filter(F.col("m") >= threshold)
              .withColumn("score", F.sum("freq").over(mine))
              .withColumn("r", F.row_number().over(mine.orderBy("freq", "posting")))
              .filter(F.col("r") <= F.col("m") - threshold + 1).select("posting", "c", "score"))
    out = stored(ranked, "prefixes")
    forget(spread)
    return out


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures match often enough and whose sets reach the limit."""
    sig_a = classes.select(F.col("c").alias("a"), F.col("sig").alias("sa"))
    sig_b = classes.select(F.col("c").alias("b"), F.col("sig").alias("sb"))
    matches = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    close = pairs.join(sig_a, "a").join(sig_b, "b").filter(matches >= threshold).select("a", "b")
    set_a = sets.select(F.col("c").alias("a"), F.col("shingles").alias("xa"))
    set_b = sets.select(F.col("c").alias("b"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    return (close.join(set_a, "a").join(set_b, "b")
            .withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("xa") + F.size("xb") - F.col("common")))
            .select("a", "b"))


def shared_counts(sets: DataFrame) -> DataFrame:
    """(c, n, shared, parts): the shingles of a class, those that another class has too, and the latter counted by parts of
    the hash space."""
    part = lambda s: F.pmod(s, F.lit(PARTS)).cast("int")
    alone = (sets.select("c", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("c").alias("c"))
             .filter("n = 1").groupBy("c").agg(F.collect_list(part(F.col("s"))).alias("own")))
    none = F.array().cast("array<int>")
    all_parts = F.transform("shingles", part)
    rows = sets.join(alone, "c", "left").select("c", F.size("shingles").alias("n"), all_parts.alias("all"), F.coalesce("own", none).alias("own"))
    count = lambda xs, i: F.size(F.filter(xs, lambda x: x == i))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: count(F.col("all"), i) - count(F.col("own"), i))
    return rows.select("c", "n", (F.col("n") - F.size("own")).alias("shared"), parts.alias("parts"))


def live_postings(prefixes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The postings of the classes that share enough shingles with others to link at all, with ``n``, ``shared`` and
    ``central``, which is greatest for the member with the smallest share of shingles of its own."""
    return (prefixes.join(sizes, "c").filter(F.col("shared") * 100 >= F.col("n") * percent)
            .withColumn("central", F.struct((F.col("shared") / F.col("n")).alias("s"), "score", "c")).drop("score"))


def star_pairs(live: DataFrame) -> DataFrame:
    """Each member of a posting list with the list's most central member."""
    centres = live.groupBy("posting").agg(F.max("central").alias("x")).select("posting", F.col("x.c").alias("centre"))
    return (live.join(centres, "posting").filter("c <> centre")
            .select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct())


def remaining_pairs(live: DataFrame, components: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one posting list in different components that can still reach the limit.

    Of its ``n`` shingles a class has ``shared`` with any other.  A pair has at most min(shared) shingles in common, so
    n(a) + n(b) <= min(shared) * (100 + percent) / percent; the same holds for the sum of the minima over any parts of the
    hash space, which tells apart members that differ from the group in different places."""
    known = (live.join(components.withColumnRenamed("node", "c"), "c", "left")
             .select("posting", "c", F.coalesce("component", "c").alias("k"), "n",
                     (F.floor(F.col("shared") * (100 + percent) / F.lit(percent)) - F.col("n")).alias("room")))
    per = known.groupBy("posting", "k").agg(F.count("*").alias("members"))
    main = (per.groupBy("posting").agg(F.count("*").alias("ks"), F.max(F.struct("members", "k")).alias("x"))
            .filter("ks > 1").select("posting", F.col("x.k").alias("main")))
    mixed = stored(known.join(main, "posting").join(sizes.select("c", "parts"), "c"), "mixed")
    few, rest = mixed.filter("k <> main").alias("x"), mixed.alias("y")
    most = F.aggregate(F.zip_with("x.parts", "y.parts", lambda p, q: F.least(p, q)), F.lit(0), lambda total, p: total + p)
    fits = ((F.col("x.k") != F.col("y.k")) & (F.col("y.n") <= F.col("x.room")) & (F.col("x.n") <= F.col("y.room"))
            & (100 * F.col("y.n") >= percent * F.col("x.n")) & (100 * F.col("x.n") >= percent * F.col("y.n"))
            & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
    return (few.join(rest, (F.col("x.posting") == F.col("y.posting")) & fits)
            .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    n_coordinates: int = N_COORDINATES) -> DataFrame:
    """(key, n_shingles, component_id, kept, stays) of every row.

    ``component_id`` is the smallest key reachable over links of ``percent`` similarity or more; ``kept`` says that the
    row has that key; ``stays`` is true for exactly one row of each component.  ``df`` is read twice (signatures, and
    the sets of the classes in question)."""
    out = judged_rows(df, key, text, width, percent, n_coordinates)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", "kept", "stays")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, with all their columns, that stay: one of each component."""
    judged = judged_rows(df, key, text, width, percent, N_COORDINATES)
    # Rows of equal key and text belong to one component; only there a choice between equal rows is left.
    staying = judged.groupBy("key", "text_id").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("stays")
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = df.select(F.struct("*").alias("r"), F.col(key).alias("k"), digest.alias("d")).join(
        staying, F.col("k").eqNullSafe(F.col("key")) & (F.col("d") == F.col("text_id"))).select("r", "k", "d", "n")
    many = rows.filter("n > 1").dropDuplicates(["k", "d"])
    return rows.filter("n = 1").unionByName(many).select("r.*")


def judged_rows(df: DataFrame, key: str, text: str, width: int, percent: int, n_coordinates: int) -> DataFrame:
    """``near_duplicates`` with the key as ``key``, and ``text_id``; stored, and the tables on the way to it deleted."""
    return settled(df.sparkSession, lambda: _judged(df, key, text, width, percent, n_coordinates), "judged")


def _judged(df: DataFrame, key: str, text: str, width: int, percent: int, n_coordinates: int) -> DataFrame:
    threshold = match_threshold(n_coordinates, percent)
    rows = stored(document_signatures(df, key, text, width, n_coordinates).withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = rows.filter("set_key IS NOT NULL")
    of_set = stored(full.groupBy("set_key").agg(F.min("row").alias("c")), "classes")
    classes = stored(full.join(of_set.select(F.col("c").alias("row")), "row").select(F.col("row").alias("c"), "key", "text_id", "n_shingles", "sig"), "class_rows")
    prefixes = prefix_postings(classes, threshold)
    wanted = classes.join(prefixes.select("c").distinct(), "c", "left_semi").select("c", "key", "text_id")
    sets = stored(class_sets(df, key, text, wanted, width), "sets")

    sizes = stored(shared_counts(sets), "sizes")
    live = stored(live_postings(prefixes, sizes.drop("parts"), percent), "live")
    links = stored(confirmed(star_pairs(live), classes, sets, threshold, percent), "links")
    first = stored(connected_components(links), "components")
    more = stored(confirmed(remaining_pairs(live, first, sizes, percent), classes, sets, threshold, percent), "links")
    components = stored(connected_components(links.unionByName(more)), "components") if more.take(1) else first

    named = (rows.join(of_set, "set_key", "left").join(components.withColumnRenamed("node", "c"), "c", "left")
             .withColumn("k", F.coalesce("component", "c", "row")))
    named = stored(named.select("row", "key", "text_id", "n_shingles", "k"), "named")
    names = named.groupBy("k").agg(F.min("key").alias("component_id"))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.col("key").isNull() & F.col("component_id").isNull())
    out = named.join(names, "k").withColumn("kept", kept)
    stay = out.filter("kept").groupBy("k").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("stays"))
    return out.join(stay, "row", "left").select("key", "text_id", "n_shingles", "component_id", "kept", F.coalesce("stays", F.lit(False)).alias("stays"))
