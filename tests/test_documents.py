"""Windows of documents against plain Python, with one text that holds a third of all windows."""

import random

from seqflip.sources.documents import document_text_windows, document_windows, short_documents
from seqflip.spec import SequenceSpec


def test_windows_of_texts_of_any_length(spark):
    random.seed(1)
    spec = SequenceSpec(length=6, alphabet=5, start=1, active=2)
    lengths = [0, 1, 5, 6, 7, 11, 12, 13, 35, 36, 37, 60, 61] + [random.randrange(6, 90) for _ in range(30)] + [900]
    texts = {i: "".join(random.choice("abc\u00e9\u4f60 \n.") for _ in range(n)) for i, n in enumerate(lengths)}
    df = spark.createDataFrame([*texts.items(), (1000, None)], "doc_id BIGINT, text STRING")
    want = {}
    for i, t in texts.items():
        for w in range(-(-len(t) // 6) if len(t) >= 6 else 0):
            at = min(6 * w, len(t) - 6)
            want[i, w] = t[at:at + 6]
    for block in (1, 2, 7, 1000):
        got = {(r.doc_id, r.win): r.tokens for r in document_windows(df, spec, block_windows=block).collect()}
        assert got == {k: [ord(c) % 5 for c in t] for k, t in want.items()}
        assert {(r.doc_id, r.win): r.chunk for r in document_text_windows(df, spec, block_windows=block).collect()} == want
    assert {r.doc_id for r in short_documents(df, spec).collect()} == {i for i, n in enumerate(lengths) if n < 6} | {1000}
