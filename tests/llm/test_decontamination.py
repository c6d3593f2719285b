import random

import numpy as np
import pytest

from seqflip.llm.decontamination import Item, benchmark_leaks, lcs, latent_space, sparse_passages, Vocabulary, words_of


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_brute_force():
    random.seed(2)
    for _ in range(200):
        a, b = ([random.choice(b"abcdef").to_bytes(1, "big") for _ in range(random.randrange(0, 70))] for _ in range(2))
        assert lcs(a, b) == brute_lcs(a, b)


def test_every_word_is_in_a_passage():
    vocabulary = Vocabulary({b"w%d" % i: i for i in range(300)})
    for n in (0, 1, 31, 32, 33, 63, 64, 65, 96, 97, 128, 300):
        text = " ".join(f"w{i}" for i in range(n))
        rows, columns, starts, _ = sparse_passages([text], vocabulary, np.ones(300, bool))
        count = max(1, -(-n // 32) - 1)
        assert starts.tolist() == [0, count] and set(columns) == set(range(n))
        for p in range(count):
            assert set(columns[rows == p]) == set(range(n)[p * 32:p * 32 + 64])
        rows, columns, starts, _ = sparse_passages([text], vocabulary, np.ones(300, bool), 64)
        assert starts[-1] == max(1, -(-n // 64)) and columns.tolist() == list(range(n)) and rows.tolist() == [i // 64 for i in range(n)]


def word():
    return random.choice(["the", "of", "and", "a", "in"]) if random.random() < 0.4 else "".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(3))


def make():
    random.seed(11)
    items = {i: [word() for _ in range(random.randrange(25, 60))] for i in range(30)}
    docs = {i: [word() for _ in range(random.randrange(5, 400))] for i in range(300)}
    want = set()
    for d in range(0, 60):
        i = d % 30
        leak = list(items[i])
        if d >= 30:  # a paraphrase: words replaced and inserted
            for _ in range(len(leak) // 8):
                leak[random.randrange(len(leak))] = word()
            for _ in range(3):
                leak.insert(random.randrange(len(leak)), word())
        at = random.randrange(len(docs[d]) + 1)
        docs[d][at:at] = leak
        want.add((d, i))
    return docs, items, want


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, " ".join(w).upper() if i % 2 else ", ".join(w), 0.5) for i, w in docs.items()], "doc_id long, text string, cosine double")
    b = spark.createDataFrame([(i, " ".join(w) + ".", "x") for i, w in items.items()], "item_id long, text string, doc_id string")
    return d.repartition(4), b


@pytest.mark.parametrize("block", [256, 11])
def test_finds_planted_leaks_and_nothing_else(spark, block):
    docs, items, want = make()
    d, b = frames(spark, docs, items)
    got = benchmark_leaks(d, b, block_items=block).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("n_items", [30, 1000])
def test_corpus_is_scanned_three_times(spark, monkeypatch, n_items):
    from seqflip.llm import decontamination as module
    docs, items, _ = make()
    items |= {i: [word() for _ in range(20)] for i in range(30, n_items)}
    d, b = frames(spark, docs, items)
    scans = []
    for name in ("passage_counts", "sketches_of", "find_leaks"):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **k: scans.append(1) or f(*a, **k))
    got = benchmark_leaks(d, b, block_items=300)
    assert len(scans) == 3 and {(r.doc_id, r.item_id) for r in got.collect()} >= {(i, i) for i in range(30)}


def test_hits_do_not_depend_on_the_blocks(spark):
    """Paraphrases of growing distance, some beyond the limits: equal hits and cosines in blocks of every size."""
    random.seed(21)
    items = {i: [word() for _ in range(random.randrange(25, 60))] for i in range(24)}
    docs = {}
    for d in range(240):
        leak = list(items[d % 24])
        for k in random.sample(range(len(leak)), len(leak) * (d // 24) // 14):
            leak[k] = word()
        docs[d] = [word() for _ in range(random.randrange(0, 90))] + leak + [word() for _ in range(random.randrange(0, 90))]
    d, b = frames(spark, docs, items)
    found = []
    for size in (1, 5, 256):
        found.append({(r.doc_id, r.item_id): r.cosine for r in benchmark_leaks(d, b, block_items=size).collect()})
    assert 100 < len(found[0]) < 240 and found[0].keys() == found[1].keys() == found[2].keys()
    assert max(abs(f[k] - found[2][k]) for f in found for k in f) < 0.06


def test_latent_space_is_the_svd_of_the_passages(spark):
    docs, items, _ = make()
    d, b = frames(spark, docs, items)
    made = [Item(i, w, []) for i, w in ((i, [x.encode() for x in w]) for i, w in items.items())]
    space = latent_space(d.select("text"), made)
    rows, columns, starts, _ = sparse_passages([r.text for r in d.collect()], space.vocabulary, space.weight > 0, 64)
    a = np.zeros((starts[-1], len(space.weight)))
    a[rows, columns] = space.weight[columns]
    q = np.zeros((len(made), len(space.weight)))
    for i, x in enumerate(made):
        q[i, np.unique(space.vocabulary.columns(x.words, len(x.words)))] = 1
    q *= space.weight
    assert np.allclose(space.basis.T @ space.basis, np.eye(space.basis.shape[1]), atol=1e-5)
    assert np.linalg.norm(q - q @ space.basis @ space.basis.T) < 0.15 * np.linalg.norm(q)  # items keep 98 % of their energy
    stress = max(1.0, float((a ** 2).sum())) / float((q ** 2).sum())
    exact = np.linalg.svd(np.vstack([a, np.sqrt(stress) * q]), compute_uv=False)[:20]
    assert np.abs(space.values[:20] / exact - 1).max() < 0.1


def test_answers_short_items_nulls_and_empty(spark):
    d = spark.createDataFrame([(1, "noise words here " * 10 + "what is the capital of france it is paris indeed", None), (2, "short one two", None),
                               (3, None, None), (None, "short two one", None), (2, "short one two", None)], "doc_id long, text string, answer string")
    b = spark.createDataFrame([(7, "short one two", None), (8, "", None), (9, None, None), (10, "what is the big old capital town of sunny france", "paris")],
                              "item_id long, text string, answer string")
    got = sorted((r.doc_id, r.item_id) for r in benchmark_leaks(d, b, answer="answer").collect())
    assert got == [(1, 10), (2, 7), (2, 7)] or got == [(2, 7), (2, 7)]
    assert benchmark_leaks(d.limit(0), b).count() == 0 and benchmark_leaks(d, b.limit(0)).count() == 0
    assert words_of("É,é;x-1") == ["é".encode(), "é".encode(), b"x", b"1"]


def large(n_docs, leaks):
    """More than 2,000 passages; ``leaks``: (item, every how many documents)."""
    random.seed(5)
    items = {i: [word() for _ in range(random.randrange(25, 60))] for i in range(12)}
    docs = {i: [word() for _ in range(random.randrange(60, 300))] for i in range(n_docs)}
    want = set()
    for i, every in leaks:
        for d in range(i, n_docs, every):
            at = random.randrange(len(docs[d]) + 1)
            docs[d][at:at] = items[i]
            want.add((d, i))
    return docs, items, want


def test_item_that_leaked_into_many_passages(spark):
    docs, items, want = large(900, [(0, 2), (1, 300)])
    d, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(d, b).collect()}
    assert sum(max(1, -(-len(w) // 64)) for w in docs.values()) > 2000 and got == want


def test_planted_leaks_and_paraphrases_in_thousands_of_passages(spark):
    docs, items, want = make()
    for d in range(1000, 1900):
        docs[d] = [word() for _ in range(random.randrange(60, 300))]
        if d % 8 == 0:  # one item in several percent of the passages
            leak = list(items[3])
            for k in range(d % 6, len(leak), 6):
                leak[k] = word()
            docs[d][30:30] = leak
            want.add((d, 3))
    assert sum(max(1, -(-len(w) // 64)) for w in docs.values()) > 2000
    d, b = frames(spark, docs, items)
    assert {(r.doc_id, r.item_id) for r in benchmark_leaks(d, b).collect()} == want
    made = [Item(i, [x.encode() for x in w], []) for i, w in items.items()]
    for some in (d, d.filter("doc_id < 100")):
        space = latent_space(some.select("text"), made)
        rows, columns, starts, _ = sparse_passages([r.text for r in some.collect()], space.vocabulary, np.ones(len(space.weight), bool), 64)
        held = np.bincount(columns, minlength=len(space.weight)) + (item_counts := sum(np.isin(sorted(space.vocabulary), x.words) for x in made))
        assert item_counts.min() >= 1 and np.allclose(space.weight, np.log1p((starts[-1] + len(made)) / held))


def test_items_longer_than_a_passage_and_lists_of_short_items(spark):
    random.seed(9)
    word_of = lambda: "".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(4))
    items = {0: [word_of() for _ in range(1500)], 1: [word_of() for _ in range(900)]}
    items |= {i: [word_of() for _ in range(5)] for i in range(2, 42)}
    docs = {i: [word_of() for _ in range(100)] for i in range(20)}
    docs[3][50:50] = items[0]
    docs[4][10:10] = [word_of() if k % 6 == 0 else w for k, w in enumerate(items[1])]  # no run of eight words is left
    docs[5][20:20] = [w for i in range(2, 42) for w in items[i]]
    docs[6][20:20] = items[7][:4]
    d, b = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in benchmark_leaks(d, b).collect()}
    assert got == {(3, 0), (4, 1)} | {(5, i) for i in range(2, 42)}
