"""The pipeline's stages against brute force on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as cp

random.seed(21)


def words(n, tag="w"):
    return [f"{tag}{random.randrange(10 ** 6)}" for _ in range(n)]


def make():
    clean = {i: words(random.randrange(60, 200)) for i in range(40)}
    docs = dict(clean)
    docs[100], docs[101] = words(5), ["again"] * 80  # too short, too repetitive
    docs[110], docs[111] = list(clean[3]), [*clean[4][:-1], "changed"]  # exact and near copy
    shared = words(70, "p")
    for i in (120, 121, 122):
        docs[i] = words(60, "x") + shared + words(60, "y")
    item = words(40, "q")
    docs[130] = words(50, "z") + item + words(50, "z")
    return clean, docs, item, shared


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    clean, docs, item, shared = make()
    folder = str(tmp_path_factory.mktemp("corpus"))
    # One extra column clashes with names that operators make.
    rows = [(i, " ".join(w), "en", "h", 0, "x", 1) for i, w in docs.items()]
    rows += [(None, " ".join(words(90, "null")), None, None, None, None, None), (200, None, "en", "h", 0, "x", 1), (201, "", "en", "h", 0, "x", 1), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean, docs, shared


def test_stages(spark, corpus):
    folder, clean, texts, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, folder).cache()
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe":
            assert docs.columns == before.columns and docs.count() == len(seen[name])  + (name == "quality_rules"), name
    everything = set(texts) | {None, 200, 201}
    assert everything - seen["quality_rules"] == {100, 101, 200, 201}
    assert seen["quality_rules"] - seen["near_dedup"] == {110, 111}
    assert seen["near_dedup"] == seen["substring_dedup"]
    assert seen["substring_dedup"] - seen["decontamination"] == {130}
    assert seen["bpe"] == seen["decontamination"] and set(clean) <= seen["bpe"]


def test_passages_stay_once(spark, corpus):
    folder, clean, texts, shared = corpus
    docs = cp.near_dedup(spark, cp.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder)
    out = {r.doc_id: r for r in cp.substring_dedup(spark, docs, folder).collect()}
    assert sum(" ".join(shared) in out[i].text for i in (120, 121, 122)) == 1
    for i in (120, 121, 122):
        assert [w for w in out[i].text.split() if not w.startswith("p")] == [w for w in texts[i] if not w.startswith("p")]
        assert out[i].n_chars == len(out[i].text)
    assert all(out[i].text == " ".join(w) for i, w in clean.items())


def test_run_and_empty_table(spark, corpus, tmp_path):
    folder = corpus[0]
    assert cp.run(spark, folder).count() == 44
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_names_of_the_last_stage_and_scratch(spark, corpus, tmp_path):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from pyspark.sql import functions as F

    docs.select("*", F.lit("mine").alias("token_ids"), F.lit(7).alias("N_Tokens")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    p = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
    before = names()
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 44 and {(r.input_token_ids, r.input_N_Tokens) for r in out.collect()} == {("mine", 7)}
    assert all(r.n_tokens == len(r.token_ids) for r in out.collect())
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"stage-bpe"}
