import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqflip.llm.common import column_shingles, column_words, settled, stored
from seqflip.session import SHUFFLE_CLEANUP, shuffles_released


def words(text):
    return (text or "").encode().lower().split()


def texts():
    rng = random.Random(4)
    letters = "aAbBzZ0\x00éÉ\U0001f600 \x1f \t\n\x0b\f\r  "
    out = ["", None, " ", "a", "A", "a\x00", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "X" * 16 + "y", "y" + "x" * 16, "q" * 100_000, "ab" * 50_000,
           "no space at the end", "at the start", "12345678abcdefgh abcdefgh12345678", " \n"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    return out + ["a"] * 3


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_hashes_tell_words_apart(kind):
    rows = texts()
    for column in (pa.array(rows, kind), pa.array(["cut off", *rows], kind).slice(1), pa.array(rows, kind).slice(0, 40)):
        hashes, splits = column_words(column)
        want = [words(t) for t in column.to_pylist()]
        assert np.diff(splits).tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(flat) == len(hashes) and len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist())))


def test_empty_columns():
    for rows in ([], [""], [None, None], ["", "  "]):
        hashes, splits = column_words(pa.array(rows, pa.string()))
        assert len(hashes) == 0 and splits.tolist() == [0] * (len(rows) + 1)
        assert [len(s) for s in column_shingles(pa.array(rows, pa.string()), 3, short=True)] == [0] * len(rows)


@pytest.mark.parametrize("short", [True, False])
def test_shingles_are_runs_of_words(short):
    column = pa.array(texts(), pa.string())
    seen = {}
    for text, got in zip(column.to_pylist(), column_shingles(column, 3, short)):
        w = words(text)
        runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if short and w else [])
        assert len(got) == len(runs)
        for run, h in zip(runs, got.tolist()):
            assert seen.setdefault(h, run) == run
    assert len(set(seen.values())) == len(seen)


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}


@pytest.mark.parametrize("store", [lambda spark, df: stored(df, "t"), lambda spark, df: settled(spark, lambda: df, "t")])
def test_a_stored_table_leaves_no_shuffle_files(spark, store):
    # They fill the executors' disks: one driver may run many such steps before it collects its garbage.
    numbers = spark.range(20_000).withColumn("k", F.col("id") % 997)
    df = numbers.groupBy("k").agg(F.collect_list("id").alias("ids")).join(numbers.hint("merge"), "k").groupBy("id").agg(F.max(F.size("ids")).alias("n"))
    before = shuffle_files(spark)
    out = store(spark, df)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:  # blocks are dropped after the query has ended
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert out.count() == 20_000 and df.count() == 20_000


def test_shuffle_setting_is_put_back(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with pytest.raises(KeyError), shuffles_released(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        raise KeyError
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    spark.conf.set(SHUFFLE_CLEANUP, "false")
    try:
        with shuffles_released(spark):
            pass
        assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)
