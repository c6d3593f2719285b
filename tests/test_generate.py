import hashlib
import math

from pyspark.sql import functions as F

from seqflip.operators.generate import Profile, generate_sequences, generator_error_rate, generator_posterior
from seqflip.spec import SequenceSpec


def _h32(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def test_profile_rows_are_distributions():
    spec = SequenceSpec()
    prof = Profile.neutral(spec)
    for row in prof.tables():
        assert abs(sum(row) - 1.0) < 1e-12 and min(row) > 0
    for row in prof.thresholds():
        assert row == sorted(row) and row[-1] == 2 ** 32


def test_generation_matches_inverse_cdf_by_hand(spark):
    spec = SequenceSpec()
    prof = Profile.neutral(spec)
    ids = spark.range(40).withColumnRenamed("id", "k")
    rows = generate_sequences(ids, "k", spec, prof).collect()
    cum = prof.thresholds()
    for r in rows:
        label = int(_h32(42, r["seq_id"], "y") < 2 ** 31)
        assert r["label"] == label
        for pos, tok in enumerate(r["tokens"]):
            if spec.start <= pos < spec.start + spec.active:
                table = 2 + pos - spec.start if label else 1
            else:
                table = 0
            u = _h32(42, r["seq_id"], pos)
            assert tok == sum(1 for c in cum[table] if c <= u)


def test_label_share_and_posterior(spark):
    spec = SequenceSpec()
    n = 4000
    g = generate_sequences(spark.range(n).withColumnRenamed("id", "k"), "k", spec)
    share = g.agg(F.avg("label")).first()[0]
    assert abs(share - spec.p) < 4 * math.sqrt(spec.p * (1 - spec.p) / n)
    post = generator_posterior(g, spec).agg(F.min("posterior"), F.max("posterior")).first()
    assert 0.0 <= post[0] <= post[1] <= 1.0


def test_error_rate_falls_with_class_signal(spark):
    rates = []
    for k in (0.5, 2.0, 10.0):
        spec = SequenceSpec(class_signal=k)
        g = generate_sequences(spark.range(3000).withColumnRenamed("id", "k"), "k", spec, Profile.neutral(spec))
        rates.append(generator_error_rate(g, spec, Profile.neutral(spec)).first()["error_rate"])
    assert rates[0] > rates[1] > rates[2]


def test_posterior_equals_brute_force_forward(spark):
    """The posterior from the active segment equals P(branch 1 | x) computed from the
    full joint (both branches, every position)."""
    spec = SequenceSpec(length=8, alphabet=3, start=2, active=3, p=0.3, class_signal=2.0)
    prof = Profile.build([0.2, 0.5, 0.3], [0.6, 0.1, 0.3], [0, 1, 2], 2.0)
    seqs = [[0, 1, 2, 0, 1, 2, 0, 1], [2, 2, 2, 2, 2, 2, 2, 2], [1, 0, 0, 1, 2, 1, 0, 0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id BIGINT, tokens ARRAY<INT>")
    got = {r["seq_id"]: r["posterior"] for r in generator_posterior(df, spec, prof).collect()}
    for i, s in enumerate(seqs):
        def joint(y):
            pr = spec.p if y else 1 - spec.p
            for pos, t in enumerate(s):
                if spec.start <= pos < spec.start + spec.active:
                    pr *= prof.state1[pos - spec.start][t] if y else prof.state0[t]
                else:
                    pr *= prof.background[t]
            return pr
        assert abs(got[i] - joint(1) / (joint(0) + joint(1))) < 1e-12
