import random
import re

import numpy as np
import pytest

from seqflip.llm.components import connected_components
from seqflip.llm.near_dedup import match_threshold, near_duplicates


def sets_of(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    """component_id of each row, by all pairs."""
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(best.get(find(i), k), k)
    return [(k, len(sets[i]), best.get(find(i))) for i, (k, _) in enumerate(rows)]


def corpus(seed=5):
    random.seed(seed)
    word = lambda: random.choice("abcdefgh") + random.choice("klmnop") + str(random.randrange(400))
    rows = []
    for g, size in enumerate([1, 1, 2, 5, 60, 30]):
        base = [word() for _ in range(random.choice([60, 100, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 4, 5, 6, 9, 20])):
                words[random.randrange(len(words))] = word()
            if random.random() < 0.3:
                del words[:random.randrange(4)]
            rows.append(" ".join(words))
    shared = " ".join(word() for _ in range(12))
    rows += [shared + " " + " ".join(word() for _ in range(30)) for _ in range(25)]
    rows += ["", "a", "A", "a b", "A  b\n", "é", "É", None, None, rows[40], rows[40].upper()]
    ids = list(range(len(rows)))
    random.shuffle(ids)
    out = list(zip(ids, rows))
    return out + [(None, rows[50]), (None, "only null keys here"), out[3], out[3]]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_brute_force(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, c int").repartition(6)
    got = near_duplicates(df, width=width, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows, width, percent), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    staying = {}
    for r in got:
        staying.setdefault(r.component_id, []).append(r.stays)
    assert all(sum(v) == 1 for k, v in staying.items() if k is not None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0


def test_threshold_bound():
    for n, p in [(32, 85), (32, 80), (64, 85)]:
        t = match_threshold(n, p)
        draws = np.random.default_rng(1).binomial(n, p / 100, 400_000)
        assert (draws < t).sum() == 0 and t > n * p / 100 / 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(50)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
