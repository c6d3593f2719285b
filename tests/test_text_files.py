"""Bare-line ids (S13), text files with places and rejects (S1/S3), result files that split."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqflip.operators import prepare
from seqflip.operators.prepare import assign_id, assign_line_id
from seqflip.session import scratch_path
from seqflip.sources.text import (escape_lines, place_lines, read_labelled_text, read_results, unescape_lines, write_labelled_text,
                                  write_lines, write_results)
from seqflip.spec import SequenceSpec


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def line_ids(lines):
    seen, out = Counter(), []
    for v in lines:
        d = md5("n" if v is None else f"{len(v)}:{v}")
        out.append((md5(f"{d}#{seen[v]}"), v))
        seen[v] += 1
    return sorted(out, key=repr)


def test_ids_of_keys_that_join_alike(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "a"), ("a", None), ("", "a"), ("n", "a"), ("1:a", ""), ("a", "1:")]
    got = assign_id(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).collect()
    assert len({r["seq_id"] for r in got}) == len(rows)


@pytest.mark.parametrize("partitions,bits", [(1, 16), (7, 3), (30, 16)])
def test_bare_line_ids(spark, monkeypatch, partitions, bits):
    monkeypatch.setattr(prepare, "SLICE_BITS", bits)
    rng = random.Random(1)
    lines = ["hot"] * 300 + [None] * 40 + [""] * 60 + [f"l{rng.randrange(200)}é" for _ in range(500)]
    rng.shuffle(lines)
    df = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, _n int").repartition(partitions)
    got = [(r["seq_id"], r["value"]) for r in assign_line_id(df).collect()]
    assert sorted(got, key=repr) == line_ids(lines) and len({i for i, _ in got}) == len(lines)


def test_a_hot_line_stays_in_many_groups(spark, monkeypatch):
    """The window's groups are (line, slice): none has more rows than a slice."""
    monkeypatch.setattr(prepare, "SLICE_BITS", 5)
    lines = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("value")).repartition(4)
    out = assign_line_id(lines)
    assert out.select("seq_id").distinct().count() == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_digest" in plan and "_slice" in plan


def test_no_lines(spark):
    assert assign_line_id(spark.createDataFrame([], "value string")).collect() == []


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("\\nr\n\ra\"", max_size=8), min_size=1, max_size=6))
def test_escaped_line_breaks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(escape_lines("t").alias("e"), unescape_lines(escape_lines("t")).alias("t")).collect()
    assert [r["t"] for r in got] == texts and not any("\n" in r["e"] or "\r" in r["e"] for r in got)


@pytest.mark.parametrize("header", [False, True])
def test_one_result_file_is_read_by_many_tasks(spark, header):
    schema = "id BIGINT, log STRING"
    rows = [(i, "\n".join(f'{i},"{j}"\\n,x\r' for j in range(i % 7)) or None) for i in range(4000)]
    path = scratch_path(spark, "one-file")
    write_results(spark.createDataFrame(rows, schema).coalesce(1), path, header=header)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        back = read_results(spark, path, schema, header=header)
        assert back.rdd.getNumPartitions() > 5
        assert sorted((r["id"], r["log"] or None) for r in back.collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_places_in_split_files(spark):
    lines = [f"{i} " + "x" * (i % 50) if i % 9 else "" for i in range(5000)]
    path = scratch_path(spark, "places")
    write_lines(spark.createDataFrame([(v,) for v in lines], "line string").coalesce(1), f"{path}/a")
    write_lines(spark.createDataFrame([("one",), ("two",)], "line string").coalesce(1), f"{path}/b")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        placed = place_lines(spark, f"{path}/*")
        got = placed.collect()
        assert placed.select("file").distinct().count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r["value"] for r in sorted((r for r in got if "/a/" in r["file"]), key=lambda r: r["line_no"])] == lines
    assert sorted(r["line_no"] for r in got if "/a/" in r["file"]) == list(range(1, 5001))
    assert sorted((r["line_no"], r["value"]) for r in got if "/b/" in r["file"]) == [(1, "one"), (2, "two")]


def test_labelled_text_files(spark):
    spec = SequenceSpec(length=3, alphabet=4, start=0, active=1)
    path = scratch_path(spark, "labelled")
    write_labelled_text(spark.createDataFrame([([0, 1, 2], 1), ([3, 3, 3], 0)], "tokens array<int>, label int").coalesce(1), f"{path}/good")
    bad = ["", "  ", "0,1,2,2", "0,1,2,", "0,1,2", "0,1,2,3,1", "0,1,4,1", "0,a,1,1", "x"]
    write_lines(spark.createDataFrame([(v,) for v in bad], "line string").coalesce(1), f"{path}/bad")
    good, rejected = read_labelled_text(spark, f"{path}/*", spec)
    assert sorted((r["line_no"], r["tokens"], r["label"]) for r in good.collect()) == [(1, [0, 1, 2], 1), (2, [3, 3, 3], 0)]
    assert [(r["value"], r["reason"]) for r in sorted(rejected.collect(), key=lambda r: r["line_no"])] == list(zip(
        bad, ["blank", "blank", "bad_label", "bad_label", "bad_label", "bad_length", "bad_token", "bad_token", "bad_label"]))
