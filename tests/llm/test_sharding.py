import struct
import zlib
from math import log

import pytest
import xxhash

from seqflip.llm.sharding import RECORD_OVERHEAD, shard_records


def place(key, weights):
    """The law, one record at a time."""
    best = []
    for s, w in enumerate(weights):
        seed = 42 if key is None else xxhash.xxh64(str(key).encode(), seed=42).intdigest()
        u = ((xxhash.xxh64(struct.pack("<i", s), seed=seed).intdigest() >> 12) + 0.5) / 2 ** 52
        best.append((log(u) / w, -s))
    return -max(best)[1]


def test_brute_force_and_gapless_slots(spark):
    rows = [(i, f"text {i % 7} é") for i in range(700)] + [(None, None)] * 5 + [(3, "same")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weights = [1.0, 2.0, 0.5, 1.0]
    got = shard_records(df, "doc_id", "text", weights, grown_weight=1.5).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.shard == place(r.doc_id, weights)
        assert r.grown_shard == place(r.doc_id, [*weights, 1.5])
        assert r.grown_shard in (r.shard, 4)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = {(i, t): zlib.crc32((t or "").encode()) for i, t in rows}
    size = {(i, t): len((t or "").encode()) + RECORD_OVERHEAD for i, t in rows}
    assert sorted((str(r.doc_id), r.text_crc32, r.size) for r in got) == sorted((str(i), crc[i, t], size[i, t]) for i, t in rows)


def test_weights_share_records(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text", "1 AS shard")
    n = {r.shard: r["count"] for r in shard_records(df, "doc_id", "text", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_empty_and_bad_weights(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_records(df, "doc_id", "text", [1.0]).count() == 0
    with pytest.raises(ValueError):
        shard_records(df, "doc_id", "text", [1.0, 0.0])
