import numpy as np

from seqflip.llm.quality_model import (_shape, word_stats, BAD, GOOD, LABELLERS, WordTable, decode_pattern, document_votes, encode_pattern,
                                       expectation_maximisation, quality_scores, sampled_texts, score_with_model)

SF = "/root/testdata/sf0.01"


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(60_000) < 0.8
    accuracy, coverage = np.array([0.95, 0.9, 0.8, 0.7, 0.6]), np.array([0.9, 0.8, 0.9, 0.7, 1.0])
    right = rng.random((len(truth), 5)) < accuracy
    votes = np.where(rng.random((len(truth), 5)) < coverage, np.where(right == truth[:, None], GOOD, BAD), 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.02 and np.abs(model.accuracy - accuracy).max() < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_patterns_round_trip():
    votes = np.random.default_rng(1).integers(-1, 2, (50, len(LABELLERS)))
    assert [decode_pattern(int(p), len(LABELLERS)) for p in encode_pattern(votes)] == votes.tolist()


def test_word_table_reset_changes_nothing():
    texts = ["Some words, here! And 123 more.", "### $$$ a|b", "", "é É été"] * 3
    big, small = WordTable(64), WordTable(64, limit=1)
    a, b = document_votes(texts, big), [document_votes([t], small) for t in texts]
    assert a[0].tolist() == [x[0][0] for x in b]
    assert all((x == y[1][0]).all() for x, y in zip(a[1], b))


def test_accuracy_on_labels_never_trained_on(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out, accuracies = score_with_model(docs)
    rows = out.join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r.kept == bool(r.quality) for r in rows) / len(rows)
    good = [r.kept for r in rows if r.quality]
    assert right > 0.95 and sum(good) / len(good) > 0.98
    assert set(accuracies) == set(LABELLERS) and min(accuracies.values()) > 0.5


def test_sample_is_bounded_and_a_hot_text_counts_once(spark):
    rows = [(f"text number {i}",) for i in range(400)] + [("one hot text",)] * 200
    source = spark.createDataFrame(rows, "_text string").repartition(5)
    texts = source.selectExpr("xxhash64(_text) AS h", "0 AS pattern").groupBy("h", "pattern").count()
    for most in (1, 50, 401, 10_000):
        got = sampled_texts(source, texts, most)
        assert got.select("h").distinct().count() == min(most, 401)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hot = docs.orderBy("doc_id").limit(1)
    crowd = docs.unionByName(hot.selectExpr("explode(sequence(10000000L, 10000499L)) AS doc_id", "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_scores(crowd, max_rows=300).join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in judged) / len(judged) > 0.95


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, None, 0.0), (1, None, 0.0), (None, "", 1.0), (2, "### $$$ %%%", None), (3, "A plain sentence of words. " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score double")
    got = quality_scores(df).collect()
    assert len(got) == 5 and all(r.kept is not None and 0 <= r.score <= 1 for r in got)
    assert quality_scores(df.limit(0)).count() == 0


def test_word_stats_by_hand():
    assert word_stats("Word.") == ((1, 5, 4, 1, 0, 0, 1, True, False), "Aa.")
    assert word_stats("ÉTÉ!!")[0] == (1, 5, 3, 3, 0, False, True, True, 2) and word_stats("ÉTÉ!!")[1] == "A!"
    assert word_stats("ab$$$")[0] == (1, 5, 2, 0, 3, False, False, False, 0)
    assert word_stats("|")[0] == (1, 1, 0, 0, 1, True, False, False, 0)
    for w in ("a", "A", "aB", "AB", "Ab", "été,", "McDonald?", "x1", "don't", "(yes)", "1,000", "..."):
        stats, shape = word_stats(w)
        assert shape == _shape(w) and stats[2] == sum(map(str.isalpha, w)) and stats[3] == sum(map(str.isupper, w))
        assert stats[8] == w.count("!") and stats[5] == (not any(map(str.isalnum, w)))
