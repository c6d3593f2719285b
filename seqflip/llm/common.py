"""Helpers shared by the training-data operators: tables, the shared folder, stored intermediates,
Arrow batches and word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, shuffles_released, store_result

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once into the shared folder (spark.checkpoint.dir) and read it back: lineage ends here,
    so a lost executor never replays what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_released(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``build`` gives and delete the tables that it stored on the way."""
    path = scratch_path(spark, name)
    out = store_result(spark, build, path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df.stored_at
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class WordHash(dict):
    """word bytes -> stable 64-bit hash; forgets all when it holds ``limit`` words (results do not change)."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift) so that sums and products of hashes spread evenly again."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h = mix(h) + words[k:k + n]
    return mix(h)


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))).astype(np.uint8)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian long.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, splits): a 64-bit hash of every word of every text of a string column, ASCII letters in lower case, in order;
    those of text i are hashes[splits[i]:splits[i + 1]].

    Works on the column's bytes, eight at a time: a word is the sum of the mixed longs that it is made of, each
    mixed with its place, and its length.  Nulls have no words."""
    wide = pa.types.is_large_string(column.type)
    _, places, held = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    n = int(at[-1] - at[0])
    data = np.frombuffer(held, np.uint8)[at[0]:at[-1]] if n else np.empty(0, np.uint8)
    at = at - at[0]
    inside = ~_SPACE[data]
    heads = at[:-1][at[:-1] < at[1:]]
    fresh = np.ones(n, bool)  # a word cannot go on from the byte before
    fresh[1:] = ~inside[:-1]
    fresh[heads] = True
    ends = np.ones(n, bool)
    ends[:-1] = fresh[1:] | ~inside[1:]
    begin, length = np.flatnonzero(inside & fresh), np.flatnonzero(inside & ends) + 1
    splits = np.searchsorted(begin, at)
    length -= begin
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data]
    longs = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = mix((longs[begin] & _FIRST[np.minimum(length, 8)]) ^ _GOLDEN)
    more = np.flatnonzero(length > 8)
    if len(more):
        parts = (length[more] - 1) // 8  # longs after the first
        firsts = np.cumsum(parts) - parts
        k = np.arange(int(parts.sum())) - np.repeat(firsts, parts) + 1
        left = np.repeat(length[more], parts) - 8 * k
        value = longs[np.repeat(begin[more], parts) + 8 * k] & _FIRST[np.minimum(left, 8)]
        h[more] += np.add.reduceat(mix(value + mix(k.astype(np.uint64) * _GOLDEN)), firsts)
    return mix(h + length.astype(np.uint64)), splits


def column_shingles(column: pa.Array, width: int, short: bool) -> list[np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, in order; of fewer words the whole sequence if ``short``, else none."""
    words, splits = column_words(column)
    runs = shingle_hashes(words, width)
    out = []
    for a, z in zip(splits[:-1].tolist(), splits[1:].tolist()):
        out.append(shingle_hashes(words[a:z], z - a) if short and 0 < z - a < width else runs[a:max(a, z - width + 1)])
    return out


def row_slices(batch: pa.RecordBatch, column: str, target_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``target_bytes`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > target_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield batch.slice(start)
