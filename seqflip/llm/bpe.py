"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens; every distinct pre-token of a block of rows is encoded once, all of them together:
an index maps each adjacent pair of symbols to all its positions in the block, the active ranks are applied in
ascending order, and each application updates the lists of the pairs that appear around the merged positions.  One
rank is one vectorised step over all its positions.  Documents are then gathered from their pre-tokens.

The vocabulary is a public tokenizer file (path parameter); it is read once per worker.  Rows never meet, so no
shuffle, no hot key: a block holds a few MB of text whatever the table holds, and the memo of encoded pre-tokens
is emptied beyond a fixed size without changing any result.

Defined cases: a null text encodes like the empty text (no ids); null ids decode to the empty text; repeated rows
are encoded alike; very long texts are processed whole; an empty table gives an empty result; all other columns
pass through, but a column that has the output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_slices

#: Fixed value: the split pattern of byte-level BPE, with Unicode White_Space as the only space class.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Distinct pre-tokens that a worker remembers before it starts anew.
MEMO_LIMIT = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 on."""
    # The ranges of printable Latin-1 characters.
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and token bytes of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char = byte_symbols()
        ids = spec["model"]["vocab"]
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(of_char[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in of_char.items():
            self.byte_id[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.product = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.split_specials = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
                               if self.specials else None)
        lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where it has none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Pair occurrence index over the symbols of many pre-tokens laid end to end."""

    def __init__(self, vocab: Vocabulary, pieces: list[bytes]):
        self.vocab = vocab
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.piece = np.repeat(np.arange(len(pieces)), lengths)
        n = len(data)
        self.symbol = vocab.byte_id[data]
        self.next = np.arange(1, n + 1)
        self.prev = np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        ends = ends[lengths > 0]
        self.next[ends - 1] = -1
        self.prev[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.flatnonzero(self.next >= 0))

    def add(self, at: np.ndarray) -> None:
        """Enter the pairs that start at ``at`` into the lists of their ranks."""
        rank = self.vocab.ranks(self.symbol[at], self.symbol[self.next[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, positions in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r in self.lists:
                self.lists[r].append(positions)
            else:
                self.lists[r] = [positions]
                heapq.heappush(self.active, r)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Apply all ranks in ascending order; (ids, piece of each id)."""
        sym, nxt, prv, v = self.symbol, self.next, self.prev, self.vocab
        while self.active:
            r = heapq.heappop(self.active)
            lists = self.lists.pop(r)
            a, b = v.left[r], v.right[r]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols the pairs are taken from the left
                at = np.sort(at)
                first = np.concatenate([[True], nxt[at[:-1]] != at[1:]])
                start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = v.product[r]
            sym[gone] = -1
            nxt[at] = after
            linked = after >= 0
            prv[after[linked]] = at[linked]
            before = prv[at]
            self.add(np.unique(np.concatenate([before[before >= 0], at[linked]])))
        alive = sym >= 0
        return sym[alive], self.piece[alive]


class Encoder:
    """Encodes whole texts; remembers the pre-tokens it has met."""

    def __init__(self, path: str, pattern: str = PATTERN, memo_limit: int = MEMO_LIMIT):
        self.vocab = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.memo_limit = memo_limit
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens in it stay whole."""
        v = self.vocab
        if v.split_specials is None or not any(s in text for s in v.specials):
            return self.find(text)
        out: list[str] = []
        for part in v.split_specials.split(text):
            out += [part] if part in v.specials else self.find(part)
        return out

    def learn(self, new: list[str]) -> None:
        special = {i for i, p in enumerate(new) if p in self.vocab.specials}
        index = PairIndex(self.vocab, [b"" if i in special else p.encode() for i, p in enumerate(new)])
        ids, piece = index.run()
        counts = np.bincount(piece, minlength=len(new))
        if special:
            at = sorted(special)
            before = np.concatenate([[0], np.cumsum(counts)])[at]
            ids = np.insert(ids, before, [self.vocab.specials[new[i]] for i in at])
            counts[at] = 1
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): the ids of text k are ``ids[offsets[k]:offsets[k + 1]]``."""
        if len(self.number) > self.memo_limit:
            self.forget()
        number, new, flat, sizes = self.number, [], [], []
        for text in texts:
            found = self.pieces(text)
            sizes.append(len(found))
            for p in found:
                k = number.get(p)
                if k is None:
                    k = number[p] = len(number)
                    new.append(p)
                flat.append(k)
        if new:
            self.learn(new)
        piece = np.array(flat, np.int64)
        lengths = self.starts[piece + 1] - self.starts[piece]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.starts[piece] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[take], ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)]


def decode_ids(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of many id lists laid end to end; invalid UTF-8 becomes U+FFFD."""
    ids = ids.astype(np.int64)
    lengths = vocab.starts[ids + 1] - vocab.starts[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    take = np.repeat(vocab.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
    data, cuts = vocab.all_bytes[take].tobytes(), ends[offsets].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _append(batch: pa.RecordBatch, others: list[str], name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [batch.column(batch.schema.get_field_index(c)) for c in others]
    return pa.RecordBatch.from_arrays([*kept, values], names=[*others, name])


def _others(df: DataFrame, out: str) -> list[str]:
    return [c for c in df.columns if c.lower() != out.lower()]


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "ids", block_bytes: int = 4 << 20) -> DataFrame:
    """Add ``out``, the ids (array of int) of the whole text."""
    others = _others(df, out)
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab_path)
        for whole in batches:
            for b in row_slices(whole, text, block_bytes):
                texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                ids, offsets = encoder.encode(texts)
                yield _append(b, others, out, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", out: str = "decoded", block_bytes: int = 4 << 20) -> DataFrame:
    """Add ``out``, the text that the ids stand for."""
    others = _others(df, out)
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids))
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            texts: list[str] = []
            # Blocks of rows of about block_bytes (a token has 3 or 4 bytes on average).
            for k in _blocks(offsets, block_bytes // 4):
                a, z = offsets[k.start], offsets[k.stop]
                texts += decode_ids(vocab, flat[a:z], offsets[k.start:k.stop + 1] - a)
            yield _append(b, others, out, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


def _blocks(offsets: np.ndarray, most: int) -> Iterator[range]:
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield range(start, min(stop, n))
        start = min(stop, n)


def encoded_digests(df: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and digest both: (key, n_tokens, ids_sha256, decoded_sha256)."""
    both = decode(encode(df.select(key, text), vocab_path, text).drop(text), vocab_path)
    return both.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
