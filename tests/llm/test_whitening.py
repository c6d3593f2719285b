import math

import numpy as np
import pytest

from seqflip.llm.whitening import whiten


def brute(rows, components=4, scale=256):
    """Exact integers and numpy on the whole fit list."""
    kept = [(k, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array([s / n for s in total])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for k, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total))
        for c in range(min(components, len(total))):
            y = (np.array(x) - np.array(total) / n) @ vectors[:, c] / math.sqrt(values[c])
            out.append((k, c + 1, n, deviation, abs(y), values[c] / values.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


def check(got, want):
    got = sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], abs(r["whitened"])))
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in got] == [w[:4] for w in want]
    np.testing.assert_allclose([abs(r["whitened"]) for r in got], [w[4] for w in want], rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose([r["explained"] for r in got], [w[5] for w in want], rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(7, 7)) * np.array([3, 2, 1.5, 1, .5, .2, .1])
    rows = [(i, (rng.normal(size=7) @ mixing.T).astype(np.float32).tolist()) for i in range(150)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(100)]                       # a third of all rows is one vector
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]   # repeated row, null keys
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [float("nan")] * 7), (2003, [float("inf")] * 7)]
    rows += [(2004, [-0.0] * 7), (2005, [0.0] * 7)]
    return rows


def test_equals_brute_force(spark, vectors):
    df = spark.createDataFrame([(k, v, 1, 2, 3, 4) for k, v in vectors], "vec_id long, embedding array<float>, key int, x int, index int, digest int")
    for block_rows, part_bytes in ((16, 1), (1024, 32 << 20)):
        check(whiten(df, block_rows=block_rows, part_bytes=part_bytes).collect(), brute(vectors))


def test_blocks_of_columns(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    check(whiten(df, block_rows=32, block_columns=3, part_bytes=1).collect(), brute(vectors))


def test_signs_are_the_same_for_all_rows(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [r for r in whiten(df).collect() if r["vec_id"] in (3, 1000, 1001)]
    assert all(len({r["whitened"] for r in got if r["component"] == c}) == 1 for c in range(1, 5))


def test_no_rows_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [])], schema)).collect() == []
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in same] == \
        [(c, 1, 0, None, None, None) for _ in range(2) for c in (1, 2)]


def test_dead_components_other_lengths_and_ties(spark):
    # Two axes of equal variance, a third without any; a vector of another length is not of this space.
    rows = [(i, [float(a), float(b), 0.5]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])] + [(9, [1.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3} and {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert {r["component"]: round(r["explained"], 12) for r in got} == {1: 0.5, 2: 0.5, 3: 0.0}
    # The rows lie at the same distance from the centre, whatever axes the tie gives.
    for k in range(4):
        assert sum(r["whitened"] ** 2 for r in got if r["vec_id"] == k and r["component"] < 3) == pytest.approx(2)


def test_wide_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=600).tolist()) for i in range(12)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 48 and got[0]["identity_error"] < 1e-6


def test_query_on_given_table(spark):
    import pyarrow.parquet as pq

    from seqflip.llm.queries import queries

    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    check(queries()["op11_embedding_whitening"](spark, "/root/testdata/sf0.001").collect(), brute([(r["vec_id"], r["embedding"]) for r in t]))
