import pytest

from seqflip.llm.common import WordHash
from seqflip.llm.quality import measure, quality_rules, without_lines

GOOD = " ".join(f"word{i}" for i in range(40))


def brute_repeat(words, window=8):
    grams = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= set(range(i, i + window))
    return len(covered)


@pytest.mark.parametrize("text", ["", " ", "a", "a b c d e f g h i a b c d e f g h", "x " * 30, "é| ü#\n\né| ü#\n\x0b\ny\x85z  q", GOOD + "\n" + GOOD])
def test_measures_brute_force(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    base, found = measure(text, WordHash())
    assert base == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeat(words)]
    assert [(n, k) for _, n, k in found] == [(n, len(x.encode().split())) for n, x in enumerate(text.split("\n")) if x.encode().split()]


def docs(spark, rows, extra="x string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {extra}")


def test_boilerplate_depletion_and_copies(spark):
    unique = [(i, " ".join(f"u{i}_{j}" for j in range(30)) + "\nSubscribe  To our news", "h", None) for i in range(20)]
    hollow = [(100, "a b\n" + "subscribe to OUR news\n" * 7, "h", None)]
    copies = [(200 + i, "\n".join(f"c{k} " * 3 + str(k) for k in range(9)), "h", None) for i in range(50)]
    other = [(300, "subscribe to our news\n" + GOOD, "g", None), (301, None, None, None), (302, "", "h", None)]
    rows = unique + hollow + copies + other
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].removed_lines == [1] and got[i].n_words_left == 30 and got[i].kept for i in range(20))
    assert got[100].n_words_left == 2 and not got[100].kept
    assert all(got[200 + i].removed_lines == [] and got[200 + i].kept for i in range(50))  # copies are one document
    assert got[300].removed_lines == [] and got[300].kept
    assert got[301].n_words == 0 and got[301].base_failed and not got[301].kept and not got[302].kept
    out = quality_rules(docs(spark, rows, "kept string"), with_row=True).filter("doc_id = 3").select(without_lines("row.text", "removed_lines")).first()[0]
    assert out == rows[3][1].split("\n")[0]


def test_repeats_clashes_and_empty(spark):
    df = docs(spark, [(1, GOOD, "h", "p"), (1, GOOD, "h", "p"), (None, GOOD, None, None)])
    assert [r.row.kept for r in quality_rules(df.withColumnRenamed("x", "kept"), with_row=True).collect()] == ["p", "p", None]
    assert quality_rules(df.limit(0)).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    r = quality_rules(docs(spark, [(1, long, "h", None)])).first()
    assert r.n_words == 200_000 and r.n_repeat_words == 0 and r.kept


def test_documents_that_share_their_smallest_line_are_counted_apart(spark):
    from seqflip.llm.quality import line_hash

    low = min((f"menu {i}" for i in range(5000)), key=lambda x: line_hash(x.encode()))
    rows = [(i, " ".join(f"v{i}_{j}" for j in range(30)) + f"\n{low}", "h", None) for i in range(20)]
    assert all(line_hash(low.encode()) < line_hash(r[1].split("\n")[0].encode()) for r in rows)
    rows += [(100 + i, "\n".join([low, GOOD]), "h", None) for i in range(50)]  # copies are one document still
    rows += [(200 + i, GOOD + f"\nheld by ten {i // 5}", "g", None) for i in range(50)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows).repartition(3)).collect()}
    assert all(got[i].removed_lines == [1] and got[i].n_words_left == 30 and got[i].kept for i in range(20))
    assert all(got[100 + i].removed_lines == [0] for i in range(50))
    assert all(got[200 + i].removed_lines == [] for i in range(50))  # ten different documents
