import base64
import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from seqflip.llm.warc import LoserTree, archive_records, capture_history, merge_runs, parse_record, read_archives, url_key, write_archives


def test_loser_tree_merges_like_sorting():
    random.seed(3)
    for k in (0, 1, 2, 3, 5, 8, 17):
        runs = [sorted(random.choices(range(50), k=random.randrange(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("HTTPS://www.Example.com:443/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert url_key("http://a.b.org:8080") == "org,b,a:8080)/"
    assert url_key(None) == "" and url_key("not a url") == "not a url" and url_key("http://[bad/") == "http://[bad/"


def rows(n=60):
    out = [(i, f"http://h{i % 4}.example.com/p{i % 9}?x={i}", f"<p>body {i % 7 if i % 3 else i} é\r\n\r\n</p>") for i in range(n)]
    return out + [(500, None, None), (501, "http://z.org/\r\nX: y", ""), (None, "http://a.org/", "<p>body 3</p>"), (None, None, None), (7, "u", "same"), (7, "u", "same")]


def frame(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_577_836_800) + F.col("page_id"))).withColumn("record_id", F.lit("clash")).repartition(5)


def expected(data, min_bytes=0):
    newest = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= min_bytes:
            newest[h or ""] = max(newest.get(h or "", i), i)
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        ref = newest.get(h or "") if i is not None and newest.get(h or "", i) > i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip_and_order(spark):
    data = rows()
    for limit in (0, 10):
        got = capture_history(frame(spark, data), "page_id", "url", "ts", "html", min_bytes=limit).collect()
        assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(data, limit)
    got.sort(key=lambda r: (r.range, r.seq))
    keys = [(r.urlkey, r.ts, r.record_id if r.record_id is not None else -1) for r in got]
    assert keys == sorted(keys)


def test_archives_hold_the_payloads(spark):
    data = rows()
    manifest = write_archives(frame(spark, data), "page_id", "url", "ts", "html", archive_bytes=2_000)
    paths = [r.archive for r in manifest.collect()]
    assert len(paths) > 5 and sum(r.records for r in manifest.collect()) == len(data)
    payloads = []
    for p in paths:
        for offset, length, data_ in archive_records(p, chunk=37):
            h, payload, n = parse_record(data_)
            if h["warc-type"] == "response":
                payloads.append(payload.decode())
    assert set(payloads) == {h or "" for _, _, h in data}
    runs = read_archives(manifest).collect()
    assert {r.archive for r in runs} == set(paths)


def test_ranges_are_bounded_and_one_url_spreads(spark):
    data = [(i, "http://one.org/", f"body {i}") for i in range(3000)] + [(None, "http://one.org/", "x" * 300_000)]
    docs = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("ts", F.timestamp_seconds(F.lit(1_577_836_800)))
    manifest = write_archives(docs.repartition(7), "page_id", "url", "ts", "html", archive_bytes=5_000)
    runs = read_archives(manifest)
    got = merge_runs(runs, range_rows=100).collect()
    sizes = Counter(r.range for r in got)
    assert len(got) == 3001 and max(sizes.values()) < 300 and len(sizes) > 20
    got.sort(key=lambda r: (r.range, r.seq))
    assert [r.record_id for r in got] == [None, *range(3000)]


def test_empty_table(spark):
    assert capture_history(frame(spark, rows()).limit(0), "page_id", "url", "ts", "html").count() == 0
