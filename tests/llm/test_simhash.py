import random
import re

import pytest
import xxhash

from seqflip.llm.simhash import fetched_links, fingerprint, met_entries, posted_links, simhash_components


def plain_print(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: distinct numbers -> the smallest of each one's component, by all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    return {p: find(p) for p in prints}


def brute(rows):
    prints = [plain_print(t) for _, t in rows]
    root, least = plain_components(sorted(set(prints))), {}
    for (k, _), p in zip(rows, prints):
        if k is not None:
            least[root[p]] = min(least.get(root[p], k), k)
    return [(k, f"{p:016x}", least.get(root[p])) for (k, _), p in zip(rows, prints)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgßéÀ") for _ in range(4))
    rows = []
    for size in (1, 1, 2, 40, 40):
        base = [word() for _ in range(400)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows) * 3, rng.choice([" ", "\n", "\x0b "]).join(words).upper()))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one two"), (905, "ONE  two"), (None, "one two"), (None, rows[5][1]),
             (7, rows[5][1]), (7, rows[5][1]), (906, "a b c " * 70_000), (907, "a b c " * 70_001), (None, "alone " * 5), (908, "x y z q")]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4, 5) for k, t in rows], "doc_id long, text string, key int, fp int, component int, least int, s int")
    for max_entry in (0, 3, 32):
        got = [tuple(r) for r in simhash_components(df, max_entry=max_entry).collect()]
        assert ordered(got) == ordered(brute(rows))


def test_fingerprint_blocks():
    text = " ".join(random.Random(2).choice("abcdefghij") * 3 for _ in range(500))
    assert all(fingerprint(text, block=b) & (1 << 64) - 1 == plain_print(text) for b in (1, 7, 498, 10_000))


def test_fingerprint_equals_spark(spark):
    import pyspark.sql.functions as F

    text = "Täst of three"
    got = spark.createDataFrame([("täst of three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert fingerprint(text) == got


@pytest.mark.parametrize("max_entry", [0, 4, 1000])
def test_balls_of_all_kinds(spark, max_entry):
    """Chains, hot segments and pairs whose bits lie in either or both segments."""
    rng = random.Random(max_entry)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:
        for bits in ((0,), (63,), (31, 32), (1, 2), (40, 50), (5, 60), (1, 2, 3), (40, 50, 60)):
            q = p
            for b in bits:
                q ^= 1 << b
            prints.add(q)
    hot = rng.getrandbits(32) << 32
    prints |= {hot | rng.getrandbits(10) for _ in range(300)} | {hot | 1 << 20 + rng.randrange(12) | rng.getrandbits(4) for _ in range(100)}
    prints |= {0, 1, 3, 7, 1 << 63, (1 << 64) - 1}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
    fetched, crowded = fetched_links(df, 2, max_entry)
    links = [(signed[r["a"]], signed[r["b"]]) for r in fetched.unionByName(posted_links(crowded, 2)).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = plain_components(sorted(prints))
    ours, theirs = {}, {}
    for p in prints:
        ours.setdefault(find(p), set()).add(p)
        theirs.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_hot_entry_is_linear(spark):
    """Fingerprints that share a segment: links grow with them, not with their square."""
    counts = []
    for n in (500, 2000):
        prints = spark.createDataFrame([(i,) for i in range(n)], "fp long")
        fetched, crowded = fetched_links(prints, 2, 32)
        counts.append(fetched.count() + posted_links(crowded, 2).count())
    assert counts[1] < 6 * counts[0]


def test_exploded_tables_are_not_broadcast(spark, tmp_path):
    """A stored table of a few thousand fingerprints is small, its probes and postings are not."""
    path = str(tmp_path / "prints")
    spark.createDataFrame([(i << 20,) for i in range(3000)], "fp long").write.parquet(path)
    prints = spark.read.parquet(path)
    for made in (met_entries(prints, 32), posted_links(prints, 2)):
        assert made.count() > 0
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_given_table(spark):
    import pyarrow.parquet as pq

    from seqflip.llm.queries import queries

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = [tuple(r) for r in queries()["op12_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert ordered(got) == ordered(brute(rows))
