import random

import numpy as np
from pyspark.sql import functions as F

from seqflip.functions.encode import (csv_to_tokens, default_vocab, one_hot_dense, one_hot_long, one_hot_to_tokens,
                                      symbols_to_tokens, tokens_to_csv, tokens_to_symbols)
from seqflip.operators.prepare import validate_sequences
from seqflip.session import scratch_path
from seqflip.sources.documents import document_windows, short_documents
from seqflip.sources.text import (format_labelled_lines, parse_change_log, parse_labelled_lines, read_results,
                                  write_results)
from seqflip.spec import SequenceSpec


def _seqs(spark, n=50, L=60, K=20, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.randrange(K) for _ in range(L)], rng.randrange(2)) for i in range(n)],
                                 "seq_id BIGINT, tokens ARRAY<INT>, label INT")


def test_round_trips(spark):
    df = _seqs(spark)
    vocab = default_vocab(20)
    out = df.select("tokens",
                    csv_to_tokens(tokens_to_csv("tokens")).alias("a"),
                    symbols_to_tokens(tokens_to_symbols("tokens", vocab), vocab).alias("b"),
                    one_hot_to_tokens(one_hot_dense("tokens", 20), 20).alias("c"),
                    F.aggregate(one_hot_dense("tokens", 20), F.lit(0.0), lambda a, x: a + x).alias("ones")).collect()
    for r in out:
        assert r["tokens"] == r["a"] == r["b"] == r["c"] and r["ones"] == 60.0
    assert one_hot_long(df, ["seq_id"], 20).count() == 50 * 60


def test_fields_are_parsed_by_one_cast(spark):
    odd = spark.createDataFrame([(" 3 ,4",), ("",), (None,), ("1,,2",), ("x,2",), ("1.5,99999999999",)], "line STRING").coalesce(1)
    parsed = odd.select(csv_to_tokens("line").alias("t"))
    assert [r["t"] for r in parsed.collect()] == [[3, 4], [None], None, [1, None, 2], [None, 2], [None, None]]
    # A function of each field is interpreted, not compiled.
    plan = odd.select(tokens_to_csv(csv_to_tokens("line")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_labelled_lines_round_trip(spark):
    df = _seqs(spark)
    lines = format_labelled_lines(df).select("seq_id", F.col("line").alias("value"))
    back = parse_labelled_lines(lines).select("seq_id", "tokens", "label")
    assert sorted(back.collect()) == sorted(df.collect())


def test_validation_quarantines(spark):
    rows = [(0, [1, 2, 3]), (1, [1, 25, 3]), (2, [1, 2]), (3, None), (4, [0, None, 1])]
    df = spark.createDataFrame(rows, "seq_id BIGINT, tokens ARRAY<INT>")
    spec = SequenceSpec(length=3, alphabet=20, start=0, active=1)
    good, bad = validate_sequences(df, spec)
    assert [r["seq_id"] for r in good.collect()] == [0]
    assert {r["seq_id"]: r["reason"] for r in bad.collect()} == {1: "bad_token", 2: "bad_length", 3: "null",
                                                                   4: "bad_token"}


def test_document_windows_cover_whole_text(spark):
    texts = [(1, "a" * 59), (2, "".join(chr(97 + i % 26) for i in range(60))), (3, "x" * 125 + "é😀"), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    w = {(r["doc_id"], r["win"]): r["tokens"] for r in document_windows(docs).collect()}
    assert sorted(w) == [(2, 0), (3, 0), (3, 1), (3, 2)]
    t3 = [ord(c) % 20 for c in "x" * 125 + "é😀"]
    assert w[(3, 0)] == t3[0:60] and w[(3, 1)] == t3[60:120] and w[(3, 2)] == t3[-60:]
    assert {r["doc_id"]: r["reason"] for r in short_documents(docs).collect()} == {1: "too_short", 4: "null_text"}


def test_result_csv_keeps_multiline_logs(spark):
    rows = [(1, "0,1,2", "0,3,1,2,0.50000000,\n1,4,0,1,0.91000000,\n"), (2, "3,4", "")]
    df = spark.createDataFrame(rows, "seq_id BIGINT, seq STRING, change_log STRING")
    path = scratch_path(spark, "csvtest")
    write_results(df, path)
    back = read_results(spark, path, "seq_id BIGINT, seq STRING, change_log STRING")
    got = {r["seq_id"]: r["change_log"] or "" for r in back.collect()}
    assert got == {1: rows[0][2], 2: ""}
    parsed = parse_change_log(back, ["seq_id"]).orderBy("change_num").collect()
    assert [(r["change_num"], r["position"], r["new_pred"]) for r in parsed] == [(0, 3, 0.5), (1, 4, 0.91)]


def test_long_form_round_trip(spark):
    from seqflip.functions.encode import to_array, to_long
    df = _seqs(spark, n=20, L=12, K=5)
    back = to_array(to_long(df, ["seq_id"]), ["seq_id"], 12)
    assert sorted(back.collect()) == sorted(df.select("seq_id", "tokens").collect())


def test_spread_is_explicit_and_round_robin(spark):
    from seqflip.sources.tables import SPREAD_CONF, spread
    one = spark.range(1000).coalesce(1)
    assert spread(one) is one                      # unset: nothing moves, whatever the number of splits
    spark.conf.set(SPREAD_CONF, "5")
    try:
        s = spread(one)
        plan = s._jdf.queryExecution().executedPlan().toString()
        assert s.rdd.getNumPartitions() == 5 and "RoundRobinPartitioning" in plan
        assert sorted(r[0] for r in s.collect()) == list(range(1000))
    finally:
        spark.conf.unset(SPREAD_CONF)


def test_arg_max_of_any_scores(spark):
    nan, k = float("nan"), 3
    lists = [[0.5, 2.0, 2.0, -1.0, -3.0, -1.5], [1.0, nan, 2.0, None, None, None], [None, -5.0, float("-inf")], [0.0, -0.0, None, None, nan, 1.0, 4.0],
             [float("-inf"), None, float("-inf")], None, [9.0, 8.0], [], [7.0] * 3 + [1.0, 2.0, 3.0]]
    want = [[1, 0], [1, None], [1], [0, 1], [0], None, None, None, [0, 2]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>").repartition(2)
    found = df.select("i", one_hot_to_tokens("v", k).alias("t"), one_hot_to_tokens(F.expr("transform(sequence(1, 6), x -> x * (i - 4))"), k).alias("u"))
    # A slice of a list for each position copies its scores one by one as objects.
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    got = {r["i"]: r["t"] for r in rows}
    assert [got[i] for i in range(6)] + [got[8]] == want[:6] + [want[8]]
    assert got[6] == [0, 0] and got[7] == [None, None]  # lists shorter than a position, as before
    assert {r["i"]: r["u"] for r in rows} == {i: [2, 2] if i > 4 else [0, 0] for i in range(9)}
