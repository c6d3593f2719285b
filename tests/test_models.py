import numpy as np
from pyspark.sql import functions as F

from seqflip.operators.nonlinear import mlp_best_choice, mlp_input_gradient, mlp_logits, mlp_search_loop
from seqflip.operators.train import MLPModel, count_weight_table, train_count_weights
from seqflip.spec import SequenceSpec


def _random_mlp(L, K, hidden=(5, 4), seed=0):
    rng = np.random.default_rng(seed)
    layers = [L * K, *hidden, 2]
    n = sum(a * b + b for a, b in zip(layers[:-1], layers[1:]))
    return MLPModel(L, K, tuple(layers), tuple(rng.normal(0, 1.0, n)))


def test_mlp_gradient_matches_finite_differences():
    L, K = 4, 3
    m = _random_mlp(L, K)
    mats = m.matrices()
    tokens = np.array([[0, 2, 1, 1], [2, 2, 0, 1]])
    G = mlp_input_gradient(mats, tokens, K)

    def loss(x):            # -log p0 for a dense one-hot input row
        h = x
        for W, b in mats[:-1]:
            h = 1 / (1 + np.exp(-(h @ W + b)))
        o = h @ mats[-1][0] + mats[-1][1]
        return -(o[0] - np.log(np.exp(o).sum()))

    eps = 1e-6
    for n in range(2):
        x = np.zeros(L * K)
        x[np.arange(L) * K + tokens[n]] = 1.0
        for j in range(L * K):
            d = np.zeros(L * K)
            d[j] = eps
            fd = (loss(x + d) - loss(x - d)) / (2 * eps)
            assert abs(fd - G[n].reshape(-1)[j]) < 1e-6


def test_mlp_choice_raises_score_and_loop_runs(spark):
    L, K = 6, 3
    m = _random_mlp(L, K, seed=3)
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, K, size=(30, L))
    ok, pos, prev, new, nz = mlp_best_choice(m.matrices(), tokens, K)
    assert (prev == tokens[np.arange(30), pos]).all()
    df = spark.createDataFrame([(i, [int(t) for t in row]) for i, row in enumerate(tokens)],
                               "seq_id BIGINT, tokens ARRAY<INT>")
    spec = SequenceSpec(length=L, alphabet=K, start=0, active=2, cap=6)
    st = mlp_search_loop(df, m, spec, rounds=3).collect()
    assert len(st) == 30
    first = {i: (bool(ok[i]), int(pos[i]), int(new[i])) for i in range(30)}
    for r in st:
        assert r["total_changes"] == len(r["log"]) <= 3
        if r["log"]:
            e = r["log"][0]
            assert first[r["seq_id"]] == (True, e["position"], e["new_token"])
            assert abs(e["new_z"] - float(nz[r["seq_id"]])) < 1e-9
        else:
            assert not first[r["seq_id"]][0]
    z0 = mlp_logits(m.matrices(), tokens, K)
    assert np.isfinite(z0).all()


def test_count_weights_by_hand(spark):
    spec = SequenceSpec(length=2, alphabet=2, start=0, active=1)
    df = spark.createDataFrame([([0, 1], 1), ([1, 1], 1), ([0, 0], 0)], "tokens ARRAY<INT>, label INT")
    tab = {(r["pos"], r["token"]): (r["n1"], r["n0"], r["w"]) for r in count_weight_table(df, spec).collect()}
    import math
    w = lambda n1, n0: round(1e6 * (math.log((n1 + 1) / (2 + 2)) - math.log((n0 + 1) / (1 + 2))))
    assert tab[(0, 0)] == (1, 1, w(1, 1)) and tab[(1, 1)] == (2, 0, w(2, 0)) and tab[(1, 0)] == (0, 1, w(0, 1))
    model = train_count_weights(df, spec)
    assert model.bias == round(1e6 * math.log(2 / 1))


def _windows(spark, n=400, L=6, K=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = rng.integers(0, K, L)
        rows.append((i, [int(x) for x in t], int(t[0] + t[1] + rng.integers(0, 2) > 3)))
    return spark.createDataFrame(rows, "seq_id BIGINT, tokens ARRAY<INT>, label INT"), SequenceSpec(length=L, alphabet=K, start=1, active=2)


def test_logistic_equals_mllib_and_is_at_its_optimum(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from seqflip.operators.score import score_sequences
    from seqflip.operators.train import one_hot_features, train_logistic

    df, spec = _windows(spark)
    model = train_logistic(df, spec, reg_param=0.05)
    data = one_hot_features(df.withColumn("label", F.col("label").cast("double")), spec)
    fitted = LogisticRegression(maxIter=100, regParam=0.05, standardization=False, family="binomial").fit(data)
    theirs = {r.seq_id: r.p for r in fitted.transform(data).select("seq_id", vector_to_array("probability")[1].alias("p")).collect()}
    ours = {r.seq_id: r.pred for r in score_sequences(df, model).collect()}
    assert max(abs(ours[i] - theirs[i]) for i in ours) < 1e-9
    # the gradient of the penalised loss vanishes
    rows = df.collect()
    x = np.zeros((len(rows), 24))
    for n, r in enumerate(rows):
        x[n, [i * 4 + t for i, t in enumerate(r.tokens)]] = 1
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    g = x.T @ (p - np.array([r.label for r in rows])) / len(rows) + 0.05 * w
    assert np.abs(g).max() < 1e-3


def test_mlp_equals_mllib_and_survives_a_round_trip(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array
    from seqflip.operators.nonlinear import mlp_score
    from seqflip.operators.train import one_hot_features, train_mlp
    from seqflip.sources.tables import load_mlp_model, save_mlp_model

    df, spec = _windows(spark)
    model = train_mlp(df, spec, hidden=(5, 3), max_iter=30, seed=9)
    save_mlp_model(model, spark, str(tmp_path / "m"))
    assert load_mlp_model(spark, str(tmp_path / "m")) == model
    data = one_hot_features(df.withColumn("label", F.col("label").cast("double")), spec)
    fitted = MultilayerPerceptronClassifier(layers=list(model.layers), maxIter=30, seed=9).fit(data)
    theirs = {r.seq_id: r.p for r in fitted.transform(data).select("seq_id", vector_to_array("probability")[1].alias("p")).collect()}
    ours = {r.seq_id: r.pred for r in mlp_score(df, model).collect()}
    assert max(abs(ours[i] - theirs[i]) for i in ours) < 1e-9


def test_change_log_with_times_round_trips_and_malformed_lines_become_null(spark):
    from seqflip.sources.text import change_log_text, parse_change_log

    entry = "struct<change_num:int,position:int,prev_token:int,new_token:int,new_z:double,time_s:double>"
    df = spark.createDataFrame([(1, [(0, 3, 1, 2, 0.5, 1.25), (1, 4, 0, 3, 0.75, 0.5)]), (2, [])], f"k INT, log ARRAY<{entry}>")
    text = df.select("k", change_log_text("log", lambda z: z, times=True).alias("change_log"))
    back = parse_change_log(text, ["k"]).orderBy("change_num").collect()
    assert [(r.k, r.change_num, r.position, r.new_pred, r.time_s) for r in back] == [(1, 0, 3, 0.5, 1.25), (1, 1, 4, 0.75, 0.5)]
    odd = spark.createDataFrame([(1, "\n  \n0,x,1,2,oops,\n"), (2, None)], "k INT, change_log STRING")
    r = parse_change_log(odd, ["k"]).collect()
    assert len(r) == 1 and r[0].change_num == 0 and r[0].position is None and r[0].new_pred is None and r[0].time_s is None


def test_loop_result_has_few_partitions_and_no_rounds_left(spark, tmp_path):
    import os
    from seqflip.operators.search import linear_search_loop

    df, spec = _windows(spark)
    model = train_count_weights(df, spec)
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    before = {x for x in os.listdir(base) if x.startswith("search-round")}
    out = linear_search_loop(df, model, spec, chunk=1)
    assert out.count() == df.count() and out.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert {x for x in os.listdir(base) if x.startswith("search-round")} == before


def test_append_changes_twice_adds_nothing(spark, tmp_path):
    from seqflip.sources.text import append_changes

    path = str(tmp_path / "log")
    for _ in range(2):
        for r in (1, 2):
            append_changes(spark.createDataFrame([(r, 7)], "round INT, position INT"), path)
    assert sorted((x.round, x.position) for x in spark.read.parquet(path).collect()) == [(1, 7), (2, 7)]


def test_raise_mode_and_working_count_of_fixed_rounds(spark):
    import pytest
    from seqflip.operators.prepare import validate_sequences
    from seqflip.operators.search import greedy_search, working_count

    df, spec = _windows(spark)
    with pytest.raises(Exception):
        bad = spark.createDataFrame([(1, [9] * 6)], "seq_id BIGINT, tokens ARRAY<INT>")
        validate_sequences(bad, spec, mode="raise_error")[0].collect()
    model = train_count_weights(df, spec)
    st = greedy_search(df.select("seq_id", "tokens"), model, spec, rounds=2)
    counts = {r["round"]: r["working"] for r in working_count(st, rounds=2).collect()}
    assert set(counts) == {0, 1, 2} and counts[2] == st.where("working").count()


def test_incomplete_weights_and_zero_probabilities_are_refused(spark):
    import pytest
    from seqflip.operators.generate import Profile
    from seqflip.operators.model import LinearModel

    full = [(i, b, float(i + b)) for i in range(2) for b in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "pos INT, token INT, w DOUBLE")
    assert LinearModel.from_df(frame(full), 0.5, 2, 3, integer=False).weights == tuple(w for _, _, w in full)
    for rows in (full[:-1], full + full[:1], full[:-1] + full[:1]):
        with pytest.raises(ValueError):
            LinearModel.from_df(frame(rows), 0.5, 2, 3, integer=False)
    with pytest.raises(ValueError):
        Profile((0.5, 0.5), (0.0, 1.0), ((0.5, 0.5),)).log_ratios()


def test_mlp_logits_hold_no_rows_of_all_cells():
    """The first layer is the sum over all positions, to the bit, without n x L x h numbers."""
    import tracemalloc

    import numpy as np

    from seqflip.operators.nonlinear import mlp_logits

    rng = np.random.default_rng(3)
    mats = [(rng.normal(size=(1200, 32)), rng.normal(size=32)), (rng.normal(size=(32, 2)), rng.normal(size=2))]
    tokens = rng.integers(0, 20, (3000, 60))
    tracemalloc.start()
    found = mlp_logits(mats, tokens, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = mats[0][0][np.arange(60) * 20 + tokens].sum(axis=1) + mats[0][1]
    out = 1.0 / (1.0 + np.exp(-first)) @ mats[1][0] + mats[1][1]
    assert np.array_equal(found, out[:, 1] - out[:, 0])
    assert peak < 3000 * 60 * 32 * 8 / 3
    assert mlp_logits(mats, tokens[:0], 20).shape == (0,)
