import math
import random

import pytest
from pyspark.sql import functions as F

from reference_loop import greedy_reference
from seqflip.operators.edits import apply_edits
from seqflip.operators.model import LinearModel
from seqflip.operators.search import (best_substitution, candidates, change_log, greedy_search, linear_choice, linear_search_loop,
                                      working_count)
from seqflip.spec import MICRO, SequenceSpec


def _frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id BIGINT, tokens ARRAY<INT>")


def _collect_state(df):
    return {r["seq_id"]: r for r in df.collect()}


def test_hand_fixture_three_positions(spark):
    """L=3, K=2, w[pos,1] = 2,1,0 (micro-logits x1e6), threshold 0.9."""
    spec = SequenceSpec(length=3, alphabet=2, start=0, active=1, cap=60)
    w = tuple(v * MICRO for v in (0, 2, 0, 1, 0, 0))
    expect = {-3: ("stuck", 2, -1 * MICRO + MICRO), 0: ("reached", 2, 3 * MICRO), 3: ("reached", 1, 5 * MICRO)}
    for bias, (status, n, zf) in expect.items():
        model = LinearModel(3, 2, w, bias * MICRO)
        st = _collect_state(greedy_search(_frame(spark, [[0, 0, 0]]), model, spec))[0]
        assert (st["status"], st["total_changes"], st["current_z"]) == (status, n, zf), bias


@pytest.mark.parametrize("rounds", [None, 1, 5])
def test_window_search_equals_literal_loop(spark, rounds):
    rng = random.Random(7 + (rounds or 0))
    L, K = 12, 5
    spec = SequenceSpec(length=L, alphabet=K, start=2, active=4, cap=8, threshold=0.9)
    seqs = [[rng.randrange(K) for _ in range(L)] for _ in range(150)]
    for trial in range(3):
        w = tuple(rng.randrange(-3, 4) * 250_000 for _ in range(L * K))   # many ties on purpose
        bias = rng.randrange(-6, 3) * MICRO
        model = LinearModel(L, K, w, bias)
        got = _collect_state(greedy_search(_frame(spark, seqs), model, spec, rounds=rounds))
        for i, s in enumerate(seqs):
            x, z, n, status, log = greedy_reference(s, w, bias, K, spec.threshold_micro, spec.cap, rounds)
            g = got[i]
            assert g["current_tokens"] == x and g["current_z"] == z and g["total_changes"] == n, (trial, i)
            assert g["status"] == status, (trial, i, g["status"], status)
            assert [tuple(e) for e in g["log"]] == log


def test_loop_path_equals_window_path(spark):
    rng = random.Random(3)
    L, K = 10, 4
    spec = SequenceSpec(length=L, alphabet=K, start=1, active=3, cap=6)
    seqs = [[rng.randrange(K) for _ in range(L)] for _ in range(80)]
    w = tuple(rng.randrange(-4, 5) * 300_000 for _ in range(L * K))
    model = LinearModel(L, K, w, -2 * MICRO)
    cols = ["seq_id", "current_tokens", "current_z", "total_changes", "status", "working", "finish_round", "log"]
    norm = lambda rows: sorted((r["seq_id"], r["current_tokens"], r["current_z"], r["total_changes"], r["status"],
                                r["working"], r["finish_round"], [tuple(e) for e in r["log"]]) for r in rows)
    for rounds in (None, 3, 5):
        a = norm(greedy_search(_frame(spark, seqs), model, spec, rounds=rounds).select(*cols).collect())
        # chunk=1: one checkpoint per round; chunk=4 chains rounds (3 and 5 end on a partial chunk)
        for chunk in (1, 4):
            b = linear_search_loop(_frame(spark, seqs), model, spec, rounds=rounds, chunk=chunk).select(*cols)
            assert a == norm(b.collect()), (rounds, chunk)


def test_properties_of_a_search(spark):
    rng = random.Random(11)
    L, K = 15, 6
    spec = SequenceSpec(length=L, alphabet=K, start=0, active=5, cap=10)
    seqs = [[rng.randrange(K) for _ in range(L)] for _ in range(200)]
    w = tuple(rng.randrange(-5, 6) * 100_000 for _ in range(L * K))
    model = LinearModel(L, K, w, -4 * MICRO)
    df = _frame(spark, seqs)
    st = greedy_search(df, model, spec).cache()
    rows = st.collect()
    for r in rows:
        assert r["total_changes"] == len(r["log"]) <= spec.cap
        zs = [e["new_z"] for e in r["log"]]
        assert zs == sorted(zs) and (not zs or zs[0] > r["init_z"])          # scores never fall
        assert all(0.0 < r[c] < 1.0 for c in ("init_pred", "current_pred"))
    # replaying the change log on the input gives the output
    edits = change_log(st, ["seq_id"], model).select("seq_id", F.col("position").alias("pos"),
                                                     F.col("new_token").alias("token"), "change_num")
    replay = {r["seq_id"]: r["edited_tokens"] for r in apply_edits(df, edits, ["seq_id"], length=spec.length, order="change_num").collect()}
    assert all(replay[r["seq_id"]] == r["current_tokens"] for r in rows)
    # a finished row is unchanged by another search of its output
    again = greedy_search(st.select("seq_id", F.col("current_tokens").alias("tokens")), model, spec, rounds=1)
    for r in again.where("init_z >= %d" % spec.threshold_micro).collect():
        assert r["init_z"] >= spec.threshold_micro
    # working count per round is non-increasing and ends at 0
    wc = sorted((r["round"], r["working"]) for r in working_count(st).collect())
    counts = [c for _, c in wc]
    assert counts[0] == len(seqs) and counts[-1] == 0 and counts == sorted(counts, reverse=True)
    st.unpersist()


def test_best_substitution_and_skip_satisfied(spark):
    L, K = 4, 3
    spec = SequenceSpec(length=L, alphabet=K, start=0, active=2, cap=60)
    w = tuple(v * MICRO for v in (0, 1, 1,  0, 0, 2,  0, 0, 0,  3, 0, 0))
    model = LinearModel(L, K, w, 10 * MICRO)
    df = _frame(spark, [[0, 0, 0, 1], [1, 2, 0, 0]])
    best = {r["seq_id"]: (r["position"], r["prev_token"], r["new_token"], r["gain"])
            for r in best_substitution(df, model).collect()}
    assert best[0] == (3, 1, 0, 3 * MICRO)
    assert best[1] == (None, None, None, None)
    st = _collect_state(greedy_search(df, model, spec, skip_satisfied=True))
    assert st[0]["total_changes"] == 0 and st[0]["status"] == "reached"
    st = _collect_state(greedy_search(df, model, spec))          # the default still makes one change
    assert st[0]["total_changes"] == 1 and st[0]["status"] == "reached"
    assert st[1]["total_changes"] == 0 and st[1]["status"] == "stuck"


def test_threshold_is_inclusive():
    spec = SequenceSpec()
    assert spec.threshold_micro == math.ceil(1e6 * math.log(9))
    assert 1 / (1 + math.exp(-spec.threshold_micro / 1e6)) >= 0.9
    assert 1 / (1 + math.exp(-(spec.threshold_micro - 1) / 1e6)) < 0.9


def test_a_round_takes_the_best_candidate_without_sorting_them(spark):
    rng = random.Random(6)
    model = LinearModel(4, 3, tuple(rng.randrange(-3, 4) for _ in range(12)), 0, integer=True)
    rows = [(i, [rng.randrange(3) for _ in range(4)]) for i in range(60)] + [(60, [0, 7, None, -9]), (61, []), (62, None)]
    df = spark.createDataFrame(rows, "id INT, tokens ARRAY<INT>").withColumn("current_z", F.lit(0).cast("bigint"))
    both = df.select(linear_choice(model, "tokens").alias("c"), F.get(candidates("tokens", model), 0).alias("first"))
    for r in both.collect():
        assert (r["c"] and tuple(r["c"])) == (r["first"] and (r["first"]["pos"], r["first"]["prev"], r["first"]["new"], -r["first"]["ng"]))
    plan = df.select(linear_choice(model, "tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan
