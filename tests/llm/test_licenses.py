import pytest

from seqflip.llm.licenses import MAX_TEMPLATE_BYTES, TEMPLATES, Scanner, differences, license_scan

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_every_template_wins_its_own_text():
    s = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        assert s.scan(text, 0.8)[0] == name and s.scan(text, 0.8)[2] == "exact"
        found = s.scan("Some words before. " + text.upper() + " And after it.", 0.8)
        assert (found[0], found[2]) == (name, "exact"), name


def test_differences_brute_force():
    assert differences("a b c".split(), "x a b c y".split()) == (1.0, [])
    assert differences("a b c d e".split(), "a b x d e".split()) == (0.8, ["-c +x"])
    assert differences("a b".split(), "q".split())[0] == 0
    assert differences("a b c".split(), "z z z b c".split()) == (2 / 3, ["-a +z"])


def test_scan(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "This work is licensed under the GNU General Public License, version 2."),
            (3, "a permission is qqq zzz"), (4, None), (5, ""), (6, "no cue"), (1, "text\nReleased under the MIT License.\nmore"),
            (7, "Licensed under CC BY-NC 4.0.\na\nb\nc\nd\nAll rights reserved"), (None, "Released under MIT License")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string").repartition(3)
    got = sorted(((r.doc_id, r.block, r.first_line, r.license, r.verdict) for r in license_scan(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, "MIT notice", "exact")] * 2 + [(2, 0, 0, "GPL-2.0 notice", "exact"), (7, 0, 0, "CC-BY-NC-4.0 notice", "exact"),
                         (7, 1, 5, "All rights reserved", "exact"), (None, 0, 0, "MIT notice", "variant")]
                         + [g for g in got if g[0] == 3], key=str)
    assert [g[4] for g in got if g[0] == 3][0] in ("none", "unconfirmed")
    assert license_scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan(df, templates={"x": "y" * (MAX_TEMPLATE_BYTES + 1)})


def test_finds_every_notice_of_the_smallest_tables(spark):
    docs = spark.read.parquet(DOCS)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        for n in (x for x in TEMPLATES if TEMPLATES[x] in r.text):
            want.setdefault(r.doc_id, set()).add(n)
    got = {}
    for r in license_scan(docs).filter("verdict = 'exact'").collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert want and got == want


MIT = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""


def test_notices_in_their_standard_wrapping(spark):
    import textwrap

    before, after = "first line\nsecond\n\n", "\n\nand then code\nmore code\n" + "x = 1\n" * 20
    rows = [(1, before + MIT + after), (2, before + GPL + after), (3, before + MIT + after + GPL), (4, before + MIT.replace("merge, publish", "publish") + after)]
    rows += [(10 + i, before + textwrap.fill(TEMPLATES[n], 40, break_on_hyphens=False, break_long_words=False) + after) for i, n in enumerate(sorted(TEMPLATES))]
    got = {}
    for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.block, r.first_line, r.last_line, r.license, r.verdict))
    assert got[1] == [(0, 3, 15, "MIT text", "exact")] and got[4] == [(0, 3, 15, "MIT text", "variant")]
    assert got[2] == [(0, 3, 11, "GPL-3.0-or-later header", "exact")]
    assert [x[3:] for x in sorted(got[3])] == [("MIT text", "exact"), ("GPL-3.0-or-later header", "exact")]
    for i, n in enumerate(sorted(TEMPLATES)):
        assert [x[3:] for x in got[10 + i]] == [(n, "exact")], (n, got[10 + i])
