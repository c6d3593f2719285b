"""Token counts of fields or sections from one encoding of the whole document.

A document is encoded once; the byte lengths of its tokens give their spans; spans are interval-joined to the sections
in order.  A token belongs to the section that holds most of its bytes, and to the earlier one if two hold as many; a
token that touches no section is counted as outside (section -1).  So the counts of a document always add up to its
tokens, whatever crosses a boundary.

Each document is joined in the task that encodes it: nothing moves, and no key can be hot.

Defined cases: a null or empty text has one empty section without tokens (line mode); a null list of spans counts
everything as outside; null or reversed spans raise ValueError, as do spans that overlap; repeated rows and null keys
each keep rows of their own; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_slices


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the byte length of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def owners(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Section of each token by the rule above; -1 outside.  Sections are in order and do not overlap."""
    if not len(start):
        return np.full(len(token_start), -1)
    first = np.searchsorted(end, token_start, side="right")
    last = np.searchsorted(start, token_end, side="left") - 1
    owner = np.where(first <= last, first, -1)
    for i in np.flatnonzero(first < last).tolist():
        span = slice(first[i], last[i] + 1)
        held = np.minimum(end[span], token_end[i]) - np.maximum(start[span], token_start[i])
        owner[i] = first[i] + int(held.argmax())
    return owner


def line_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with the newline that ends it."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    edges = np.concatenate([[0], breaks, [len(data)]])
    if len(breaks) and breaks[-1] == len(data):
        edges = edges[:-1]
    return edges[:-1], edges[1:]


def char_offsets(data: bytes) -> np.ndarray:
    """Characters before each byte, and in all."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


SECTIONS = T.ArrayType(T.StructType([T.StructField("section", T.IntegerType()), T.StructField("char_start", T.LongType()),
                                     T.StructField("char_end", T.LongType()), T.StructField("n_tokens", T.LongType())]))


def section_counts(text: str, spans: list | None, lines: bool, encoder: tiktoken.Encoding, lengths: np.ndarray) -> list[tuple]:
    """(section, char_start, char_end, n_tokens) of one document; -1 only if it has tokens outside."""
    data = text.encode()
    ids = encoder.encode_to_numpy(text, disallowed_special=())
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    chars = char_offsets(data)
    if lines:
        a, z = line_spans(data)
    else:
        pairs = np.array([(s["start"], s["end"]) for s in spans or []], np.int64).reshape(-1, 2)
        if (pairs[:, 0] > pairs[:, 1]).any() or (pairs[1:, 0] < pairs[:-1, 1]).any() or (pairs < 0).any() or (pairs > chars[-1]).any():
            raise ValueError("spans must be ascending, apart, and inside the text")
        byte_of = np.concatenate([np.flatnonzero(np.diff(chars)), [len(data)]])
        a, z = byte_of[pairs[:, 0]], byte_of[pairs[:, 1]]
    owner = owners(starts, ends, a, z)
    counts = np.bincount(owner + 1, minlength=len(a) + 1)
    out = [(k, int(chars[s]), int(chars[e]), int(c)) for k, (s, e, c) in enumerate(zip(a, z, counts[1:]))]
    return out + ([(-1, 0, int(chars[-1]), int(counts[0]))] if counts[0] else [])


def attribute_tokens(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text",
                     spans: str | None = None) -> DataFrame:
    """(key, section, char_start, char_end, n_tokens): a row for each section.

    ``spans`` names a column of array<struct<start, end>> in characters (ascending, apart); without it the lines are
    the sections."""
    cols = [F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
            *([F.col(spans).alias("_spans")] if spans else [])]
    key_type = df.schema[key].dataType
    section = pa.struct([("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64())])
    schema = T.StructType([T.StructField("_key", key_type), T.StructField("_sections", SECTIONS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = rank_encoder(rank_path, pattern)
        for whole in batches:
            for b in row_slices(whole, "_text"):
                given = b.column(2).to_pylist() if spans else [None] * b.num_rows
                found = [section_counts(t, s, spans is None, encoder, lengths) for t, s in zip(b.column(1).to_pylist(), given)]
                flat = [x for rows in found for x in rows]
                offsets = np.concatenate([[0], np.cumsum([len(rows) for rows in found])])
                columns = list(zip(*flat)) or [(), (), (), ()]
                inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, section)], fields=list(section))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)],
                                                 names=["_key", "_sections"])

    return df.select(*cols).mapInArrow(run, schema).select(F.col("_key").alias(key), F.inline("_sections"))


def fields_text(*fields: Column, between: str = "\n") -> Column:
    """struct<text, spans>: fields laid end to end with ``between``, and where each one lies (null fields are empty)."""
    values = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for v in values:
        spans.append(F.struct(at.alias("start"), (at + F.length(v)).alias("end")))
        at = at + F.length(v) + len(between)
    return F.struct(F.concat_ws(between, *values).alias("text"), F.array(*spans).alias("spans"))
