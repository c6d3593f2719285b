"""Bundles, MLlib models by path, models fitted once, certificates, the non-linear gradient, and what queries leave behind."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import SF001
from seqflip.operators.certify import logistic_certificate, search_certificate
from seqflip.operators.nonlinear import mlp_gradient, mlp_logits, mlp_score, mlp_search_loop
from seqflip.operators.score import score_sequences
from seqflip.operators.train import MLPModel, fit_logistic, fit_mlp
from seqflip.session import Scope, persisted, remove_path, scratch_path, store_result
from seqflip.sources.bundle import IncompleteBundle, bundle_versions, read_bundle, write_bundle
from seqflip.sources.models import fitted_once, load_mllib_model, model_from_parts, model_parts
from seqflip.spec import SequenceSpec

SMALL = SequenceSpec(length=4, alphabet=3, start=0, active=1)


def sequences(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, SMALL.alphabet, (n, SMALL.length))
    y = (tokens[:, 0] + tokens[:, 1] * tokens[:, 2] + rng.normal(size=n) > 2).astype(int)
    return spark.createDataFrame([(i, t.tolist(), int(v)) for i, (t, v) in enumerate(zip(tokens, y))], "id BIGINT, tokens ARRAY<INT>, label INT")


def cells(df):
    return df.withColumn("cells", F.transform("tokens", lambda t, i: (i * SMALL.alphabet + t).cast("string")))


# --- bundles ---------------------------------------------------------------------------

def test_bundle_versions(spark):
    path = scratch_path(spark, "bundle")
    assert bundle_versions(spark, path) == []
    with pytest.raises(IncompleteBundle):
        read_bundle(spark, path)
    a = write_bundle(spark, path, {"x": spark.range(5), "y": spark.createDataFrame([("é\n", None)], "a STRING, b ARRAY<INT>")})
    b = write_bundle(spark, path, {"x": spark.range(7), "empty": spark.range(0)})
    assert bundle_versions(spark, path) == [a, b]
    assert {k: v.count() for k, v in read_bundle(spark, path).items()} == {"x": 7, "empty": 0}
    old = read_bundle(spark, path, a)
    assert old["y"].collect() == [("é\n", None)] and old["x"].count() == 5
    with pytest.raises(ValueError):
        write_bundle(spark, path, {"manifest": spark.range(1)})


def test_half_a_bundle_is_refused(spark):
    path = scratch_path(spark, "bundle")
    good = write_bundle(spark, path, {"x": spark.range(5)})
    # A write that stopped before its manifest.
    spark.range(3).write.parquet(f"{path}/v00000002-cut/x")
    assert bundle_versions(spark, path) == [good] and read_bundle(spark, path)["x"].count() == 5
    with pytest.raises(IncompleteBundle):
        read_bundle(spark, path, "v00000002-cut")
    # The next write does not take the number of the cut one; a part that changed later is refused, as is one that is gone.
    third = write_bundle(spark, path, {"x": spark.range(6), "y": spark.range(2)})
    assert third.startswith("v00000003")
    spark.range(1).write.mode("append").parquet(f"{path}/{third}/x")
    with pytest.raises(IncompleteBundle):
        read_bundle(spark, path)
    fourth = write_bundle(spark, path, {"x": spark.range(6), "y": spark.range(2)})
    remove_path(spark, f"{path}/{fourth}/y")
    with pytest.raises(IncompleteBundle):
        read_bundle(spark, path)
    assert read_bundle(spark, path, good)["x"].count() == 5


# --- MLlib ------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["lr", "multinomial", "mlp"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_mllib_models_by_path(spark, kind, shuffled):
    size = SMALL.length * SMALL.alphabet
    order = list(np.random.default_rng(1).permutation(size)) if shuffled else list(range(size))
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in order], inputCol="cells", outputCol="features", binary=True)
    classifier = {"lr": LogisticRegression(regParam=0.01), "multinomial": LogisticRegression(regParam=0.01, family="multinomial"),
                  "mlp": MultilayerPerceptronClassifier(layers=[size, 5, 2], maxIter=15, seed=1)}[kind]
    data = cells(sequences(spark))
    fitted = Pipeline(stages=[cv, classifier]).fit(data)
    path = scratch_path(spark, "mllib")
    fitted.write().save(path)
    model = load_mllib_model(spark, path, SMALL)
    ours = mlp_score(data, model) if kind == "mlp" else score_sequences(data, model)
    rows = fitted.transform(ours).select("pred", vector_to_array("probability")[1].alias("p")).collect()
    np.testing.assert_allclose([r["pred"] for r in rows], [r["p"] for r in rows], atol=1e-9)
    # The classifier alone, whose features are the cells in order.
    if not shuffled:
        fitted.stages[-1].write().save(path + "-alone")
        assert load_mllib_model(spark, path + "-alone", SMALL) == model


def test_mllib_models_of_another_kind(spark):
    cv = CountVectorizerModel.from_vocabulary(["1", "2"], inputCol="cells", outputCol="features")
    path = scratch_path(spark, "mllib")
    cv.write().save(path)
    with pytest.raises(ValueError):
        load_mllib_model(spark, path, SMALL)
    Pipeline(stages=[cv, LogisticRegression()]).fit(cells(sequences(spark))).write().save(path + "-few")
    with pytest.raises(ValueError):
        load_mllib_model(spark, path + "-few", SMALL)


# --- fitted once ------------------------------------------------------------------------

def test_fitted_once(spark):
    data, fits = sequences(spark), []

    def fit():
        fits.append(1)
        return fit_logistic(data, SMALL, reg_param=0.01)[0]

    options = {"reg": 0.01, "test": scratch_path(spark, "key")}
    first = fitted_once(data, "lr", options, fit)
    assert fitted_once(data.repartition(5), "lr", options, fit) == first and len(fits) == 1
    fitted_once(data, "lr", options | {"reg": 0.02}, fit)
    fitted_once(data.where("id > 0"), "lr", options, fit)
    assert len(fits) == 3


def test_parts_of_models(spark):
    mlp = MLPModel(4, 3, (12, 2, 2), tuple(np.linspace(-1, 1, 12 * 2 + 2 + 2 * 2 + 2).tolist()))
    lr = fit_logistic(sequences(spark), SMALL, reg_param=0.1)[0]
    assert model_from_parts(model_parts(spark, mlp)) == mlp and model_from_parts(model_parts(spark, lr)) == lr
    parts = model_parts(spark, mlp)
    with pytest.raises(ValueError):
        model_from_parts(parts | {"weights": parts["weights"].where("i > 0")})


# --- certificates -------------------------------------------------------------------------

def test_logistic_certificate(spark):
    data = sequences(spark)
    model, report = fit_logistic(data, SMALL, max_iter=300, reg_param=0.01, tol=1e-10)
    assert report.stopped == "converged" and report.converged
    rows = logistic_certificate(data, model, 0.01).collect()
    assert len(rows) == 13 and all(r["optimal"] for r in rows)
    raw = [(r["tokens"], r["label"]) for r in data.collect()]
    for r in rows:
        held = [y for t, y in raw if r["pos"] < 0 or t[r["pos"]] == r["token"]]
        assert (r["n"], r["n1"]) == (len(held), sum(held))
    # Stopped early, the report says so and the certificate shows it.
    early, report = fit_logistic(data, SMALL, max_iter=2, reg_param=0.01, tol=1e-10)
    assert report.stopped == "max_iter" and not all(r["optimal"] for r in logistic_certificate(data, early, 0.01).collect())
    # The gradient is that of the loss: central differences in one weight.
    def loss(m):
        z = np.array([m.bias + sum(m.w(i, t) for i, t in enumerate(tokens)) for tokens, _ in raw])
        y = np.array([v for _, v in raw])
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.005 * np.sum(np.square(m.weights))

    for cell in (0, 7):
        up, down = (type(early)(4, 3, tuple(w + s * (i == cell) for i, w in enumerate(early.weights)), early.bias, False) for s in (1e-5, -1e-5))
        got = next(r["gradient"] for r in logistic_certificate(data, early, 0.01).collect() if (r["pos"], r["token"]) == divmod(cell, 3))
        assert got == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-7)


@pytest.fixture(scope="module")
def searched(spark):
    data = sequences(spark, 200)
    model, _ = fit_mlp(data, SMALL, hidden=(6,), max_iter=40)
    spec = SMALL.with_(cap=3, threshold=0.8)
    return data, model, spec, persisted(mlp_search_loop(data.where("label = 0").select("id", "tokens"), model, spec))


def test_search_certificate(spark, searched):
    _, model, spec, state = searched
    rows = search_certificate(state, ["id"], model, spec).collect()
    assert rows and all(r["replayed"] and r["scored"] and r["chosen"] and r["stopped"] for r in rows)
    assert len({r["status"] for r in state.select("status").distinct().collect()}) > 1


@pytest.mark.parametrize("flag,spoil", [
    ("replayed", lambda s: s.withColumn("current_tokens", F.transform("current_tokens", lambda t, i: F.when(i == 0, 2 - t).otherwise(t)))),
    ("scored", lambda s: s.withColumn("log", F.transform("log", lambda e: e.withField("new_z", e["new_z"] + 1e-6)))),
    ("chosen", lambda s: s.withColumn("log", F.transform("log", lambda e: e.withField("new_token", e["prev_token"])))),
    ("stopped", lambda s: s.withColumn("status", F.lit("working")))])
def test_spoiled_searches_are_noticed(spark, searched, flag, spoil):
    _, model, spec, state = searched
    bad = search_certificate(spoil(state.where("total_changes > 0")), ["id"], model, spec).collect()
    assert bad and not any(r[flag] for r in bad if flag != "replayed") and not all(r[flag] for r in bad)


def test_mlp_gradient_by_central_differences(spark, searched):
    data, model, _, _ = searched
    mats, K, L = model.matrices(), 3, 4

    def loss(x):  # -log p0 of a relaxed one-hot input
        (W1, b1), (Wo, bo) = mats
        out = 1 / (1 + np.exp(-(x @ W1 + b1))) @ Wo + bo
        return np.logaddexp(out[0], out[1]) - out[0]

    rows = mlp_gradient(data.where("id < 70"), ["id"], model).collect()
    assert len(rows) == 70 * L * K and {(r["pos"], r["token"]) for r in rows} == {(i, t) for i in range(L) for t in range(K)}
    start = {r["id"]: r["tokens"] for r in data.collect()}
    for r in rows[:300]:
        t = start[r["id"]]
        assert r["current_token"] == t[r["pos"]]
        x = np.zeros(L * K)
        x[np.arange(L) * K + np.asarray(t)] = 1
        d = np.zeros(L * K)
        d[r["pos"] * K + r["token"]] = 1e-5
        assert r["grad"] == pytest.approx((loss(x + d) - loss(x - d)) / 2e-5, abs=1e-7)
    assert mlp_logits(mats, np.array([start[0]]), K).shape == (1,)
    assert mlp_gradient(data.where("id < 0"), ["id"], model).collect() == []


# --- what is left behind --------------------------------------------------------------------

def left_behind(spark):
    p = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


@pytest.mark.parametrize("name", ["assign_line_id", "read_labelled_text", "merge_result_files", "append_change_log", "repartition_cache",
                                  "search_until_done_loop", "mlp_search_certificate", "bundle_round_trip", "write_read_splits", "load_mlp_scores"])
def test_a_scope_leaves_nothing(spark, tmp_path, name):
    from seqflip.plans.registry import queries

    before, cached = left_behind(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    out = store_result(spark, lambda: queries()[name](spark, SF001), str(tmp_path / "out"))
    assert out.count() > 0
    # The store of fitted models outlives queries: that is its purpose.
    assert [n for n in left_behind(spark) if n not in before and n != "models"] == []
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached


def test_a_scope_releases_after_an_error_and_nests(spark):
    before = left_behind(spark)
    with pytest.raises(RuntimeError), Scope(spark):
        spark.range(3).write.parquet(scratch_path(spark, "lost"))
        kept = persisted(spark.range(4))
        kept.count()
        with Scope(spark):
            spark.range(3).write.parquet(scratch_path(spark, "inner"))
        assert not any(n.startswith("inner") for n in left_behind(spark)) and any(n.startswith("lost") for n in left_behind(spark))
        raise RuntimeError
    assert left_behind(spark) == before and not kept.is_cached
