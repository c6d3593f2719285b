"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``WINDOW`` words, end to end for the statistics and overlapping by half for the
search.  Passages and benchmark items are TF-IDF vectors over the
words of the benchmark (other words add nothing to a product with an item; inverse document frequencies come from all
passages, and every word keeps a weight above zero at any size of the corpus).  A randomised SVD gives the latent space in one pass: each task multiplies its
sparse passages with a random matrix and back, and the singular vectors come from the summed sketch (Nystrom's form for
A'A).  The items stand in the matrix too, with as much weight as all passages together and a rank above their number, so
that an item that leaked only once keeps its direction.

Passages whose latent cosine with an item reaches ``MIN_COSINE`` are candidates, for all passages of the corpus against
all items.  An item that leaked into many passages makes its own words common, so its cosines fall: passages that hold
``MIN_ITEM_WORDS`` words of an item in one run, or the whole of a shorter item, are candidates too, whatever their weights.
Items longer than a passage are cut into queries no longer than one.  Candidates are confirmed on the words around them: the longest common subsequence with the item, the share
of the item's TF-IDF weight that is there, and for paraphrases the item's answer.

The benchmark is a query set.  Words, their weights and the lengths of passages are those of the whole benchmark, from one
scan of the corpus; so an item's cosines do not depend on what it is searched together with.  The latent spaces are made for
blocks of about ``BLOCK_ITEMS`` queries, each over its own words and of a rank above its items; ``SCAN_BLOCKS`` of them share
the two scans that remain, one for the sketches and one for the search.  Broadcast are the benchmark's words and the items and
matrices of these blocks.  The corpus never shuffles; what moves are sums of a bounded size for each task.

Defined cases: null or empty texts and items match nothing; an
item of fewer than ``MIN_ITEM_WORDS`` words must occur whole; repeated rows and null keys each get rows of their own;
other columns are dropped; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, row_slices, stored

WINDOW, STRIDE = 64, 32
BLOCK_ITEMS, SCAN_BLOCKS = 256, 4
EXTRA_RANK, OVERSAMPLING = 16, 8
MIN_COSINE = 0.3
#: Confirmation: share of the item's words in order (alone, or together with the answer) and of its weight.
MIN_LCS, MIN_LCS_WITH_ANSWER, MIN_ANSWER, MIN_WEIGHT = 0.7, 0.5, 0.7, 0.6
MIN_ITEM_WORDS = 8

#: ASCII characters that are no letter or digit separate words; all others are part of one.
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SEPARATE).split()


class Vocabulary(dict):
    """word -> column"""

    def columns(self, words: Iterable[bytes], n: int) -> np.ndarray:
        """The column of each of ``n`` words, -1 for a word that has none."""
        return np.fromiter(map(self.get, words, repeat(-1)), np.int64, n)


@dataclass
class Item:
    id: object
    words: list[bytes]
    answer: list[bytes]


def pieces(items: list[Item]) -> tuple[list[Item], np.ndarray]:
    """The items cut evenly into queries of at most a passage's length, and where those of each item start."""
    out, first = [], []
    for x in items:
        n = max(1, ceil(len(x.words) / WINDOW))
        ends = [len(x.words) * k // n for k in range(n + 1)]
        first.append(len(out))
        out += [Item(x.id, x.words[a:z], []) for a, z in zip(ends, ends[1:])]
    return out, np.array(first, np.int64)


def last_sentence(text: str) -> str:
    return next((s for s in reversed(re.split(r"[.!?]+", text)) if words_of(s)), "")


def _passages(texts: list[str], vocabulary: Vocabulary, used: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """``sparse_passages``, and the column of each word of all texts."""
    words = [words_of(t) for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(np.maximum(-(-lengths // stride) - (WINDOW // stride - 1), 1))]).astype(np.int64)
    c = vocabulary.columns(chain.from_iterable(words), int(lengths.sum()))
    at = np.flatnonzero(c >= 0)
    at = at[used[c[at]]]
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, at, side="right")
    p = (at - (ends - lengths)[text]) // stride + starts[text]
    last = starts[text + 1] - 1
    width = max(1, len(used))
    key = p * width + c[at]
    if stride < WINDOW:  # word k lies in passage k // stride and the one before it, as far as the text has them
        key = np.concatenate([key[p <= last], (key - width)[p > starts[text]]])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key // width, key % width, starts, words, c


def sparse_passages(texts: list[str], vocabulary: Vocabulary, used: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """(passage, column) of every distinct word with weight, in order of passages; where the passages of each text start,
    and their number; the words of the texts.  Passages without a word of weight have no entry.  They start every
    ``stride`` words: STRIDE (each word in two) or WINDOW (each word in one)."""
    return _passages(texts, vocabulary, used, stride)[:4]


def _groups(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, np.int64)


def _sums(matrix: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of the matrix in the groups that start at ``first``; adds the k-th rows of all groups at once."""
    counts = np.diff(np.append(first, len(at)))
    order = np.argsort(-counts, kind="stable")
    start, counts = first[order], counts[order]
    total = np.take(matrix, at[start], axis=0)
    longer = np.searchsorted(-counts, -np.arange(1, counts.max(initial=1)))
    for k, m in enumerate(longer.tolist(), 1):
        total[:m] += np.take(matrix, at[start[:m] + k], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out


def sums_by_key(parts: DataFrame, width: int) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of each key; the result has a row for each key of a bounded range and goes to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(v, np.float32)
                total[k] = total[k] + x if k in total else x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["k", "v"])

    rows = parts.repartition("k").mapInArrow(add, "k int, v binary").collect()
    return np.array([r.k for r in rows], np.int64), np.array([np.frombuffer(r.v, np.float64) for r in rows]).reshape(len(rows), width)


def _parts(keys: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in matrix], pa.binary())], names=["k", "v"])


@dataclass
class Statistics:
    """The words of the benchmark, their weights, and the passages of the corpus that hold each."""

    vocabulary: Vocabulary
    weight: np.ndarray
    counts: np.ndarray


@dataclass
class Space:
    """Columns, their weights, the basis (columns x rank) and the singular values."""

    vocabulary: Vocabulary
    weight: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def passage_counts(texts: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Passages in all, and those that hold each column."""
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        n, used = len(vocabulary), np.ones(len(vocabulary), bool)
        total, count = np.zeros(n, np.int64), 0
        for whole in batches:
            for b in row_slices(whole, "text"):
                _, columns, starts, _ = sparse_passages(b.column(b.schema.get_field_index("text")).to_pylist(), vocabulary, used, WINDOW)
                total += np.bincount(columns, minlength=n)
                count += int(starts[-1])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(total[held], count), pa.int64())], names=["k", "n"])

    rows = texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        if r.k >= 0:
            found[r.k] = r.n
    return next((r.n for r in rows if r.k < 0), 0), found


def queried_words(queries: DataFrame) -> dict[bytes, int]:
    """How many queries hold each word of the benchmark; for the empty word, how many there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pieces([Item(None, w, []) for t in b.column(0).to_pylist() if (w := words_of(t))])[0]
            held = Counter(chain.from_iterable(set(x.words) for x in parts))
            held[b""] = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = queries.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def word_statistics(texts: DataFrame, held: dict[bytes, int]) -> Statistics:
    """Weights of the words of ``queried_words`` from all passages of ``texts`` and all queries."""
    words = sorted(w for w in held if w)
    vocabulary = Vocabulary({w: i for i, w in enumerate(words)})
    total, counts = passage_counts(texts, vocabulary)
    mine = np.array([held[w] for w in words], float)
    return Statistics(vocabulary, np.log1p((total + held.get(b"", 0)) / np.maximum(1.0, counts + mine)), counts)


def _local(known: Statistics, vocabulary: Vocabulary) -> np.ndarray:
    """The column of a block's vocabulary for each word of the benchmark, -1 for none."""
    out = np.full(len(known.vocabulary), -1, np.int64)
    out[known.vocabulary.columns(vocabulary, len(vocabulary))] = np.arange(len(vocabulary))
    return out


def sketches_of(texts: DataFrame, known: Statistics, blocks: list[tuple[Vocabulary, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A'(A R) for each block (vocabulary, weight, R): the sum over all passages a of a'(a R).  One scan for all."""
    width = max(r.shape[1] for _, _, r in blocks)
    ends = np.cumsum([0, *(len(v) for v, _, _ in blocks)])
    sent = texts.sparkSession.sparkContext.broadcast((known.vocabulary, [(_local(known, v), w.astype(np.float32), r.astype(np.float32)) for v, w, r in blocks]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, blocks = sent.value
        totals = [np.zeros(r.shape) for _, _, r in blocks]
        used, weighted = np.ones(len(vocabulary), bool), [r * w[:, None] for _, w, r in blocks]
        for whole in batches:
            for b in row_slices(whole, "text"):
                rows, columns, _, _ = sparse_passages(b.column(b.schema.get_field_index("text")).to_pylist(), vocabulary, used, WINDOW)
                for (local, weight, _), total, product in zip(blocks, totals, weighted):
                    mine = local[columns]
                    here = mine >= 0
                    for r, c in _runs(rows[here], mine[here]):
                        first = _groups(r)
                        dense = _sums(product, c, first)
                        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(r))))
                        order = np.argsort(c, kind="stable")
                        heads = _groups(c[order])
                        total[c[order][heads]] += _sums(dense, own[order], heads) * weight[c[order][heads], None]
        for start, total in zip(ends.tolist(), totals):
            held = np.flatnonzero(total.any(axis=1))
            if len(held):
                yield _parts(held + start, np.pad(total[held], ((0, 0), (0, width - total.shape[1]))))

    keys, sums = sums_by_key(texts.select("text").mapInArrow(run, "k int, v binary"), width)
    whole = np.zeros((int(ends[-1]), width))
    whole[keys] = sums
    return [whole[a:z, :r.shape[1]] for a, z, (_, _, r) in zip(ends, ends[1:], blocks)]


def latent_spaces(texts: DataFrame, blocks: list[list[Item]], known: Statistics, seed: int = 20) -> list[Space]:
    """Randomised SVD of the passages of ``texts`` and a block's items, for every block; items have words."""
    ready = []
    for items in blocks:
        vocabulary = Vocabulary({w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))})
        weight = known.weight[known.vocabulary.columns(vocabulary, len(vocabulary))]
        rank = min(len(items) + EXTRA_RANK, len(vocabulary))
        random = np.random.default_rng(seed).standard_normal((len(vocabulary), min(rank + OVERSAMPLING, len(vocabulary))))
        ready.append((vocabulary, weight, np.linalg.qr(random)[0]))
    return [_space(items, known, *block, part) for items, block, part in zip(blocks, ready, sketches_of(texts, known, ready))]


def _space(items: list[Item], known: Statistics, vocabulary: Vocabulary, weight: np.ndarray, random: np.ndarray, part: np.ndarray) -> Space:
    """The space of a block from the corpus's part of its sketch."""
    dense_items = item_vectors(items, vocabulary, weight)
    counts = known.counts[known.vocabulary.columns(vocabulary, len(vocabulary))]
    energy = float((counts * weight ** 2).sum())
    stress = max(1.0, energy) / max(1e-9, float((dense_items ** 2).sum()))
    rank = min(len(items) + EXTRA_RANK, len(vocabulary))
    sketch = stress * dense_items.T @ (dense_items @ random) + part
    # Nystrom: A'A ~ Y (R'Y)^-1 Y'; a small shift keeps the inverse stable.
    shift = 1e-6 * np.linalg.norm(sketch, 2)
    shifted = sketch + shift * random
    inner = random.T @ shifted
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-9 * values.max()))
    basis, singular, _ = np.linalg.svd(shifted @ root, full_matrices=False)
    return Space(vocabulary, weight, basis[:, :rank], np.sqrt(np.maximum(singular[:rank] ** 2 - shift, 0)))


def latent_space(texts: DataFrame, items: list[Item]) -> Space | None:
    """The space of items that are the whole benchmark; None if they have no word."""
    held = Counter(chain.from_iterable(set(x.words) for x in items))
    if not held:
        return None
    held[b""] = len(items)
    return latent_spaces(texts, [items], word_statistics(texts, held))[0]


def item_vectors(items: list[Item], vocabulary: Vocabulary, weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items), len(weight)))
    for i, x in enumerate(items):
        c = np.unique(vocabulary.columns(x.words, len(x.words)))
        out[i, c[c >= 0]] = weight[c[c >= 0]]
    return out


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence of words; one bit for each word of the item."""
    mask: dict[bytes, int] = {}
    for i, w in enumerate(item):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = mask.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def confirm(item: Item, words: list[bytes], weight_of: dict[bytes, float]) -> tuple[bool, float, float]:
    """(confirmed, share of the item's words in order, share of the answer's)."""
    share = lcs(item.words, words) / len(item.words)
    answer = lcs(item.answer, words) / len(item.answer) if item.answer else 0.0
    if len(item.words) < MIN_ITEM_WORDS:
        return _occurs(item.words, words), share, answer
    here, mine = set(words), set(item.words)
    total = sum(weight_of.get(w, 0.0) for w in mine)
    held = sum(weight_of.get(w, 0.0) for w in mine & here) / total if total else 0.0
    enough = share >= MIN_LCS or share >= MIN_LCS_WITH_ANSWER and answer >= MIN_ANSWER
    return held >= MIN_WEIGHT and enough, share, answer


def _occurs(part: list[bytes], words: list[bytes]) -> bool:
    return any(words[i:i + len(part)] == part for i in range(len(words) - len(part) + 1))


def _run_hashes(columns: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, given by their columns (-1: the last code)."""
    code = codes[columns]
    n = max(0, len(code) - width + 1)
    h = code[:n].copy()
    for k in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += code[k:k + n]
    return mix(h)


class Runs:
    """The runs of ``MIN_ITEM_WORDS`` words of the items, and shorter items as they are, to be found in texts."""

    def __init__(self, items: list[Item], vocabulary: Vocabulary):
        self.codes = mix(np.arange(1, len(vocabulary) + 2, dtype=np.uint64))
        self.tables = []
        for width in sorted({self.width(x) for x in items} - {0}):
            found = [(i, h) for i, x in enumerate(items) if self.width(x) == width
                     for h in np.unique(_run_hashes(vocabulary.columns(x.words, len(x.words)), self.codes, width)).tolist()]
            hashes = np.array([h for _, h in found], np.uint64)
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << 20, bool)  # by the upper bits; spares most searches
            seen[hashes >> np.uint64(44)] = True
            self.tables.append((width, hashes[order], np.array([i for i, _ in found], np.int64)[order], seen))

    @staticmethod
    def width(item: Item) -> int:
        return min(MIN_ITEM_WORDS, len(item.words))

    def find(self, columns: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item), in order of passages, of the runs that lie in one text."""
        ends = np.cumsum(lengths)
        passages, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for width, hashes, owners, seen in self.tables:
            h = _run_hashes(columns, self.codes, width)
            at = np.flatnonzero(seen[h >> np.uint64(44)])
            lo, hi = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            text = np.searchsorted(ends, at, "right")
            many = np.where(at + width <= ends[text], hi - lo, 0)
            own = np.repeat(np.arange(len(at)), many)
            place = lo[own] + np.arange(len(own)) - (np.cumsum(many) - many)[own]
            passage = np.minimum((at - (ends - lengths)[text]) // STRIDE + starts[text], starts[text + 1] - 1)
            passages.append(passage[own])
            items.append(owners[place])
        both = np.unique(np.stack([np.concatenate(passages), np.concatenate(items)]), axis=1)
        return both[0], both[1]


HIT = "cosine double, lcs double, answer double, start_word long, end_word long"


def find_leaks(docs: DataFrame, blocks: list[list[Item]], spaces: list[Space], known: Statistics, item_type: T.DataType, min_cosine: float) -> DataFrame:
    """(_key, _item, HIT) of confirmed pairs; ``docs`` has _key and text.  One scan for all blocks."""
    searched = []
    for items, space in zip(blocks, spaces):
        parts, first_part = pieces(items)
        queries = item_vectors(parts, space.vocabulary, space.weight) @ space.basis
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        # A passage times this is its latent vector times each query's.
        products = (space.weight[:, None] * (space.basis @ queries.T)).astype(np.float32)
        searched.append((_local(known, space.vocabulary), products, len(items), first_part))
    every_item = list(chain.from_iterable(blocks))
    sent = docs.sparkSession.sparkContext.broadcast((known.vocabulary, known.weight, every_item, searched, Runs(every_item, known.vocabulary)))
    schema = T.StructType([T.StructField("_key", docs.schema["_key"].dataType), T.StructField("_item", item_type), *T._parse_datatype_string(HIT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, items, searched, runs = sent.value
        used = np.ones(len(vocabulary), bool)
        weight_of = {w: float(weight[vocabulary[w]]) for x in items for w in x.words}
        for whole in batches:
            for b in row_slices(whole, "text"):
                rows, columns, starts, words, every = _passages(b.column(1).to_pylist(), vocabulary, used, STRIDE)
                # A passage is as long as its whole vector over the benchmark's words, so that what lies outside the latent
                # space counts against it.
                norm = np.sqrt(np.bincount(rows, weight[columns] ** 2, int(starts[-1])))
                run_at, run_item = runs.find(every, np.fromiter(map(len, words), np.int64, len(words)), starts)
                best: dict[tuple[int, int], tuple] = {}
                highest: dict[tuple[int, int], float] = {}
                base = 0
                for local, products, n_items, first_part in searched:
                    mine = local[columns]
                    here, own = mine >= 0, (run_item >= base) & (run_item < base + n_items)
                    own_at, own_item = run_at[own], run_item[own] - base
                    for at, cosine in _cosines(rows[here], mine[here], norm, products):
                        cosine = np.maximum.reduceat(cosine, first_part, axis=1) if cosine.shape[1] > n_items else cosine
                        candidate = cosine >= min_cosine
                        met = slice(*np.searchsorted(own_at, [at[0], at[-1] + 1]))
                        candidate[np.searchsorted(at, own_at[met]), own_item[met]] = True
                        for p, q in zip(*(x.tolist() for x in np.nonzero(candidate))):
                            doc, item = int(np.searchsorted(starts, at[p], "right")) - 1, items[base + q]
                            highest[doc, base + q] = max(float(cosine[p, q]), highest.get((doc, base + q), 0.0))
                            reach = len(item.words)
                            first = (int(at[p]) - int(starts[doc])) * STRIDE
                            lo, hi = max(0, first - reach), min(len(words[doc]), first + WINDOW + reach)
                            before = best.get((doc, base + q))
                            if before is not None and before[0] == 1.0:
                                continue
                            ok, share, answer = confirm(item, words[doc][lo:hi], weight_of)
                            if ok and (before is None or share > before[0]):
                                best[doc, base + q] = (share, answer, lo, hi)
                    base += n_items
                if best:
                    where = sorted(best)
                    columns_out = list(zip(*((highest[w], *best[w]) for w in where)))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([d for d, _ in where])), pa.array([items[q].id for _, q in where]),
                         *[pa.array(c, pa.float64()) for c in columns_out[:3]], *[pa.array(c, pa.int64()) for c in columns_out[3:]]], names=schema.fieldNames())

    return docs.select("_key", "text").mapInArrow(run, schema)


def _cosines(rows: np.ndarray, columns: np.ndarray, norm: np.ndarray, products: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, cosines with all queries) in runs of entries; ``norm`` has the length of every passage."""
    for r, c in _runs(rows, columns, 20_000):
        first = _groups(r)
        yield r[first], _sums(products, c, first) / norm[r[first], None]


def _runs(rows: np.ndarray, columns: np.ndarray, step: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of about ``step`` entries that cut no passage."""
    at = 0
    while at < len(rows):
        end = min(len(rows), at + step)
        if end < len(rows):
            end = int(np.searchsorted(rows, rows[end - 1], "right"))
        yield rows[at:end], columns[at:end]
        at = end


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                    answer: str | None = None, min_cosine: float = MIN_COSINE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, item, cosine, lcs, answer, start_word, end_word): a row for each document and each item found in it, with the
    highest cosine of its candidates; words [start_word, end_word) were compared.  Without an ``answer`` column an item's answer is its last sentence."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))
    queries = stored(queries.filter("text IS NOT NULL"), "benchmark")
    held = queried_words(queries)
    blocks = max(1, ceil(held.get(b"", 0) / block_items))
    item_type = benchmark.schema[item].dataType
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("_item", item_type), *T._parse_datatype_string(HIT).fields])
    out = spark.createDataFrame([], schema)
    known = word_statistics(corpus, held) if held.get(b"") else None
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for k in range(0, blocks if known else 0, SCAN_BLOCKS):
        some: dict[int, list[Item]] = {}
        for r in queries.withColumn("block", block).filter((block >= k) & (block < k + SCAN_BLOCKS)).collect():
            if w := words_of(r.text):
                some.setdefault(r.block, []).append(Item(r.id, w, words_of(r.answer if r.answer is not None else last_sentence(r.text))))
        together = [some[x] for x in sorted(some)]
        if together:
            spaces = latent_spaces(corpus, [pieces(items)[0] for items in together], known)
            found = find_leaks(corpus, together, spaces, known, item_type, min_cosine)
            out = out.unionByName(found.withColumnRenamed("_key", key))
    return out.withColumnRenamed("_item", item)
