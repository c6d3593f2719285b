import random

from seqflip.operators.edits import apply_edits, out_of_range_edits


def test_apply_edits_with_a_hot_key(spark):
    """One sequence receives a third of all edits, with repeated and out-of-range
    positions; the result equals a brute-force application (the last edit wins)."""
    rng = random.Random(5)
    L, K, n = 8, 6, 30
    seqs = {i: [rng.randrange(K) for _ in range(L)] for i in range(n)}
    edits = [(rng.randrange(n), rng.randrange(-2, L + 3), rng.randrange(K)) for _ in range(600)]
    edits += [(0, rng.randrange(-2, L + 3), rng.randrange(K)) for _ in range(300)]      # the hot key
    df = spark.createDataFrame(list(seqs.items()), "seq_id BIGINT, tokens ARRAY<INT>")
    ed = spark.createDataFrame([(*e, no) for no, e in enumerate(edits)], "seq_id BIGINT, pos INT, token INT, no INT").repartition(5)
    got = {r["seq_id"]: r["edited_tokens"] for r in apply_edits(df, ed, ["seq_id"], length=L, order="no").collect()}
    want = {i: list(s) for i, s in seqs.items()}
    best: dict = {}
    for i, p, t in edits:
        if 0 <= p < L:
            best[(i, p)] = t
    for (i, p), t in best.items():
        want[i][p] = t
    assert got == want
    # what cannot be applied is reported
    left = out_of_range_edits(ed, L).collect()
    assert len(left) == sum(not 0 <= p < L for _, p, _ in edits) and {r["reason"] for r in left} == {"bad_position"}
