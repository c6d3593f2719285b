"""Hypothesis property tests: search semantics and encodings over drawn shapes.

Each example is one small Spark job over a drawn batch of sequences, so the
example count stays low; the draws cover shapes, tie-heavy weights, thresholds,
caps and round limits that the fixed-seed tests do not."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reference_loop import greedy_reference
from seqflip.functions.encode import (csv_to_tokens, default_vocab, one_hot_dense, one_hot_to_tokens,
                                      symbols_to_tokens, tokens_to_csv, tokens_to_symbols)
from seqflip.operators.model import LinearModel
from seqflip.operators.search import greedy_search
from seqflip.spec import MICRO, SequenceSpec

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@st.composite
def search_cases(draw):
    L = draw(st.integers(1, 9))
    K = draw(st.integers(2, 5))
    # few distinct weight levels, so ties between positions and tokens are common
    w = tuple(draw(st.lists(st.integers(-3, 3), min_size=L * K, max_size=L * K)))
    w = tuple(v * 250_000 for v in w)
    bias = draw(st.integers(-6, 3)) * MICRO
    seqs = draw(st.lists(st.lists(st.integers(0, K - 1), min_size=L, max_size=L), min_size=1, max_size=25))
    threshold = draw(st.sampled_from([0.6, 0.9, 0.99]))
    cap = draw(st.integers(1, L + 2))
    rounds = draw(st.sampled_from([None, 1, 2, 4]))
    return L, K, w, bias, seqs, threshold, cap, rounds


@SETTINGS
@given(search_cases())
def test_window_search_equals_literal_loop(spark, case):
    L, K, w, bias, seqs, threshold, cap, rounds = case
    spec = SequenceSpec(length=L, alphabet=K, start=0, active=0, cap=cap, threshold=threshold)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id BIGINT, tokens ARRAY<INT>")
    got = {r["seq_id"]: r for r in greedy_search(df, LinearModel(L, K, w, bias), spec, rounds=rounds).collect()}
    for i, s in enumerate(seqs):
        x, z, n, status, log = greedy_reference(s, w, bias, K, spec.threshold_micro, cap, rounds)
        g = got[i]
        assert (g["current_tokens"], g["current_z"], g["total_changes"], g["status"]) == (x, z, n, status)
        assert [tuple(e) for e in g["log"]] == log
        assert g["total_changes"] == len(g["log"]) <= cap
        assert g["working"] == (status == "working")


@SETTINGS
@given(st.integers(2, 30).flatmap(lambda K: st.tuples(
    st.just(K), st.lists(st.lists(st.integers(0, K - 1), min_size=1, max_size=12), min_size=1, max_size=20))))
def test_encodings_round_trip(spark, case):
    K, seqs = case
    vocab = default_vocab(K)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id BIGINT, tokens ARRAY<INT>")
    rows = df.select("seq_id", "tokens",
                     csv_to_tokens(tokens_to_csv("tokens")).alias("a"),
                     symbols_to_tokens(tokens_to_symbols("tokens", vocab), vocab).alias("b"),
                     one_hot_to_tokens(one_hot_dense("tokens", K), K).alias("c"),
                     F.aggregate(one_hot_dense("tokens", K), F.lit(0.0), lambda a, x: a + x).alias("ones")).collect()
    for r in rows:
        assert r["tokens"] == seqs[r["seq_id"]] == r["a"] == r["b"] == r["c"]
        assert r["ones"] == float(len(r["tokens"]))
