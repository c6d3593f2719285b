import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqflip.llm.token_counts import attribute_tokens, fields_text, rank_encoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text, spans):
    """Each byte of each token looked up by itself."""
    enc, lengths = rank_encoder(PATH, PATTERN)
    data = (text or "").encode()
    spans = [(len(text[:a].encode()), len(text[:z].encode())) for a, z in spans]
    counts, at = {}, 0
    for i in enc.encode_ordinary(text or ""):
        held = [sum(a <= p < z for p in range(at, at + int(lengths[i]))) for a, z in spans]
        k = held.index(max(held)) if held and max(held) else -1
        counts[k] = counts.get(k, 0) + 1
        at += int(lengths[i])
    assert at == len(data)
    return counts


def lines(text):
    out, at = [], 0
    for line in text.splitlines(keepends=True) if "\r" not in text else [x for x in text.replace("\n", "\n\0").split("\0") if x]:
        out.append((at, at + len(line)))
        at += len(line)
    return out or [(0, 0)]


TEXTS = ["", "one", "a b.\n\n\nc é\U0001f600 d\n", "\n\n\n", "x" * 300 + "\n" + "the of and\n" * 50, "été\n  été\n\n   là"]


def test_lines_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (0, "", "x")], "doc_id long, text string, section string")
    got = attribute_tokens(df, PATH, PATTERN).collect()
    for i, t in enumerate(TEXTS[1:], 1):
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        want = lines(t)
        assert [(r.char_start, r.char_end) for r in rows] == want
        assert {r.section: r.n_tokens for r in rows if r.n_tokens} == brute(t, want)
    assert [(r.section, r.n_tokens) for r in got if r.doc_id in (0, None)] == [(0, 0)] * 3
    assert attribute_tokens(df.limit(0), PATH, PATTERN).count() == 0


def test_fields_and_crossing_tokens(spark):
    df = spark.createDataFrame([(1, "ab", "  cd", None), (2, "été", "\n\n", "z")], "k long, a string, b string, c string")
    df = df.withColumn("both", fields_text(F.col("a"), F.col("b"), F.col("c"), between="\n")).select("k", "both.*")
    got = attribute_tokens(df, PATH, PATTERN, "k", "text", "spans").collect()
    for r in df.collect():
        want = brute(r.text, [(s.start, s.end) for s in r.spans])
        assert {x.section: x.n_tokens for x in got if x.k == r.k and x.n_tokens} == want
    one = spark.createDataFrame([(1, "abc", None)], "k long, text string, spans array<struct<start:int,end:int>>")
    assert [(r.section, r.n_tokens) for r in attribute_tokens(one, PATH, PATTERN, "k", "text", "spans").collect()] == [(-1, 1)]
    bad = spark.createDataFrame([(1, "abc", [(2, 1)])], one.schema)
    with pytest.raises(Exception, match="spans must be"):
        attribute_tokens(bad, PATH, PATTERN, "k", "text", "spans").collect()
