"""Weak-label quality model.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Documents are counted by their pattern of
votes (at most 3 to the power of the labellers, whatever the table holds), and expectation-maximisation over these counts
estimates each labeller's accuracy and coverage and the share of good documents; that gives every pattern a posterior.
The posteriors of a bounded sample (at most ``max_rows`` distinct texts) then train a linear scorer on hashed words, which
scores all documents.

Votes and features come from a table of the words that a worker has met, row by row; what shuffles is a hash and a pattern
for each distinct text; training is MLlib on the sample; the driver sees the pattern counts, a hash and the model's weights,
all bounded by parameters.

Defined cases: a null or empty text has no words; its labellers vote on nothing but its length; repeated rows and null
keys each keep a row; other columns are dropped; an empty table, or one whose votes name a single class, gives the
posterior itself as score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, row_slices, stored

#: Distinct texts that train the scorer; labelled rows beyond that add nothing to a model of 2 * N_FEATURES weights.
MAX_TRAINING_ROWS = 20_000
N_FEATURES = 1 << 12
ROUNDS = 50
GOOD, BAD, NONE = 1, -1, 0
SYMBOLS = frozenset("#*$%&|<>")
STATS = ["words", "chars", "letters", "capitals", "symbols", "lone", "plain", "ends", "calls"]


class WordTable(dict):
    """word (bytes) -> row of its statistics and feature numbers; starts anew beyond ``limit`` words (results do not change)."""

    def __init__(self, n_features: int, limit: int = 300_000):
        super().__init__()
        self.n, self.limit = n_features, limit
        self.shapes: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.shapes.clear()
        self.stats = np.zeros((1024, len(STATS)), np.int32)
        self.features = np.zeros((1024, 2), np.int32)

    def __missing__(self, key: bytes) -> int:
        row = len(self)
        if row == len(self.stats):
            self.stats = np.concatenate([self.stats, np.zeros_like(self.stats)])
            self.features = np.concatenate([self.features, np.zeros_like(self.features)])
        word = key.decode()
        stats, shape = word_stats(word)
        self.stats[row] = stats
        if shape not in self.shapes:
            self.shapes[shape] = self.n + xxhash.xxh64_intdigest(shape) % self.n
        self.features[row] = (xxhash.xxh64_intdigest(word.lower()) % self.n, self.shapes[shape])
        self[key] = row
        return row

    def rows(self, text: str) -> np.ndarray:
        if len(self) > self.limit:
            self.reset()
        words = text.encode().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_stats(word: str) -> tuple[tuple[int, ...], str]:
    """STATS of a word, and its shape: letters a, capitals A, digits 0, others as they are, runs shortened."""
    body = word.rstrip(".,;:!?")
    if body.isalpha() and len(word) - len(body) <= 1:  # nearly all words
        tail, n = word[len(body):], len(body)
        if body.islower():
            capitals, shape = 0, "a"
        elif body[0].isupper() and (n == 1 or body[1:].islower()):
            capitals, shape = 1, "A" if n == 1 else "Aa"
        else:
            capitals, shape = sum(map(str.isupper, body)), _shape(body)
        return (1, len(word), n, capitals, 0, 0, 1, tail in (".", "!", "?"), tail == "!"), shape + tail
    core = word.strip(".,;:!?()\"'")
    return (1, len(word), sum(map(str.isalpha, word)), sum(map(str.isupper, word)), sum(c in SYMBOLS for c in word),
            not any(map(str.isalnum, word)), bool(core) and all(c.isalpha() or c in "-'" for c in core),
            word[-1] in ".!?", word.count("!")), _shape(word)


def _shape(word: str) -> str:
    shape, last = [], ""
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if c != last:
            shape.append(c)
            last = c
    return "".join(shape)


def votes_of(stats: np.ndarray, lines: np.ndarray, distinct: np.ndarray, doubled: np.ndarray) -> dict[str, np.ndarray]:
    """Votes of the heuristic labellers on documents (rows of word statistics, lines, distinct lines, words equal to the
    one before).  Each one has two limits and abstains between them."""
    s = dict(zip(STATS, np.maximum(stats, 0).T.astype(float)))
    words, chars, letters = (np.maximum(s[c], 1) for c in ("words", "chars", "letters"))

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    return {
        "symbols": vote(s["symbols"] > 0.05 * chars, s["symbols"] < 0.005 * chars),
        "letters": vote(s["letters"] < 0.8 * chars, s["letters"] > 0.9 * chars),
        "plain_words": vote(s["plain"] < 0.7 * words, s["plain"] > 0.9 * words),
        "lone_symbols": vote(s["lone"] > 0.1 * words, s["lone"] < 0.01 * words),
        "capitals": vote(s["capitals"] > 0.4 * letters, s["capitals"] < 0.15 * letters),
        "exclamations": vote(s["calls"] > 0.2 * words, s["calls"] < 0.01 * words),
        "word_length": vote((chars > 12 * words) | (chars < 2 * words), (chars > 3 * words) & (chars < 9 * words)),
        "repeated_lines": vote((lines > 3) & (lines - distinct > 0.3 * lines), np.zeros(len(lines), bool)),
        "doubled_words": vote(doubled > 0.2 * words, (doubled < 0.02 * words) & (s["words"] > 20)),
        "length": vote(s["words"] < 20, s["words"] > 50),
    }


LABELLERS = tuple(votes_of(np.zeros((1, len(STATS))), *[np.zeros(1)] * 3))


def encode_pattern(votes: np.ndarray) -> np.ndarray:
    """The votes of each row as one number in base 3."""
    return (votes + 1) @ (3 ** np.arange(votes.shape[1])[::-1])


def decode_pattern(pattern: int, n: int) -> list[int]:
    votes = []
    for _ in range(n):
        pattern, v = divmod(pattern, 3)
        votes.append(v - 1)
    return votes[::-1]


def document_votes(texts: list[str], table: WordTable, with_features: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pattern of votes, distinct features if asked for) of each text."""
    stats, doubled = np.zeros((len(texts), len(STATS)), np.int64), np.zeros(len(texts), np.int64)
    lines, distinct, features = [], [], []
    for i, t in enumerate(texts):
        rows = table.rows(t)
        stats[i] = table.stats[rows].sum(axis=0)
        doubled[i] = (rows[1:] == rows[:-1]).sum()
        if with_features:
            # Besides words and shapes, the tenth of the words that repeat the one before.
            share = table.n + xxhash.xxh64_intdigest(f"doubled {10 * doubled[i] // max(1, len(rows))}") % table.n
            features.append(np.unique(np.append(table.features[rows], share)))
        full = [x for x in t.split("\n") if x.strip()]
        lines.append(len(full))
        distinct.append(len(set(full)))
    votes = votes_of(stats, np.array(lines), np.array(distinct), doubled)
    return encode_pattern(np.column_stack(list(votes.values()))), features


@dataclass
class LabelModel:
    """Share of good documents; for each labeller P(good vote), P(bad vote) given a good or a bad document."""

    prior: float
    given_good: np.ndarray
    given_bad: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """P(vote is right | it votes), over both classes."""
        right = self.prior * self.given_good[:, 0] + (1 - self.prior) * self.given_bad[:, 1]
        wrong = self.prior * self.given_good[:, 1] + (1 - self.prior) * self.given_bad[:, 0]
        return right / (right + wrong)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for each row of votes."""
        def log_p(table: np.ndarray) -> np.ndarray:
            full = np.column_stack([table, 1 - table.sum(axis=1)])  # good vote, bad vote, none
            index = np.where(votes == GOOD, 0, np.where(votes == BAD, 1, 2))
            return np.log(full[np.arange(votes.shape[1]), index]).sum(axis=1)

        odds = np.log(self.prior) - np.log(1 - self.prior) + log_p(self.given_good) - log_p(self.given_bad)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, smooth: float = 1.0) -> LabelModel:
    """Fit to patterns of votes and how often each occurs.  Starts from the majority; ``smooth`` pseudo-documents keep
    every probability inside (0, 1)."""
    good = np.clip(0.5 + 0.5 * np.sign(votes.sum(axis=1)) * 0.8, 0.1, 0.9)
    model = None
    for _ in range(rounds):
        w, v = counts * good, counts * (1 - good)

        def table(weight: np.ndarray) -> np.ndarray:
            total = weight.sum() + 3 * smooth
            return np.column_stack([((votes == x) * weight[:, None]).sum(axis=0) + smooth for x in (GOOD, BAD)]) / total

        prior = (w.sum() + smooth) / (counts.sum() + 2 * smooth)
        model = LabelModel(prior, table(w), table(v))
        good = model.posterior(votes)
    return model


def train_scorer(sample: DataFrame, n_features: int) -> LogisticRegressionModel:
    """A linear scorer from (features, posterior): every document counts as good and as bad, by its posterior."""
    # Features are numbers already; the transformer only puts them into sparse vectors.
    vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(2 * n_features)], "names", "vector", minTF=0.0)
    hashed = vector.setBinary(True).transform(sample.withColumn("names", F.col("features").cast("array<string>")))
    both = hashed.select("vector", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
                                                     F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")))).alias("x"))
    rows = both.select("vector", "x.label", "x.weight").filter("weight > 0.001")
    return LogisticRegression(featuresCol="vector", maxIter=30, regParam=0.01, weightCol="weight", standardization=False).fit(rows)


def sampled_texts(source: DataFrame, texts: DataFrame, max_rows: int) -> DataFrame:
    """(h, _text) of the rows whose text is in the sample: the ``max_rows`` distinct texts of smallest hash, so the sample is
    never empty, never larger, and the same however the table is dealt.  Every text counts once, whatever its copies:
    weighted by them, one hot text would be all that a small sample learns from."""
    last = texts.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h").alias("h")).first()["h"]
    return source.select(F.xxhash64("_text").alias("h"), "_text").filter(F.col("h") <= F.lit(last))


def quality_scores(df: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAINING_ROWS,
                   n_features: int = N_FEATURES, keep_from: float = 0.5) -> DataFrame:
    """(key, posterior, score, kept) of every row; ``posterior`` comes from the votes, ``score`` from the scorer."""
    return score_with_model(df, key, text, max_rows, n_features, keep_from)[0]


def score_with_model(df: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAINING_ROWS, n_features: int = N_FEATURES,
                     keep_from: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """The scores, and the estimated accuracy of each labeller."""
    source = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key_type = df.schema[key].dataType

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(n_features)
        for whole in batches:
            for b in row_slices(whole, "_text"):
                pattern, _ = document_votes(b.column(1).to_pylist(), table, with_features=False)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pattern, pa.int32())], names=["h", "pattern"])

    # A row for each distinct text: copies are summed before they move.
    voted = source.select(F.xxhash64("_text").alias("h"), "_text").mapInArrow(vote, "h long, pattern int")
    texts = stored(voted.groupBy("h", "pattern").agg(F.count("*").alias("n")), "votes")
    counts = texts.groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** labellers at most
    table = np.array([decode_pattern(r["pattern"], len(LABELLERS)) for r in counts], np.int64).reshape(-1, len(LABELLERS))
    label_model = expectation_maximisation(table, np.array([r["n"] for r in counts], float))
    found = label_model.posterior(table)
    names = dict(zip(LABELLERS, label_model.accuracy.round(4).tolist()))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordTable(n_features), set()  # max_rows hashes at most
        for whole in batches:
            for b in row_slices(whole, "_text"):
                hashes = b.column(0).to_pylist()
                new = [i for i, h in enumerate(hashes) if h not in seen and not seen.add(h)]
                if not new:
                    continue
                b = b.take(pa.array(new, pa.int64()))
                pattern, features = document_votes(b.column(1).to_pylist(), words)
                votes = np.array([decode_pattern(int(p), len(LABELLERS)) for p in pattern], np.int64).reshape(-1, len(LABELLERS))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(features, pa.list_(pa.int32())), pa.array(label_model.posterior(votes))],
                                                 names=["h", "features", "posterior"])

    two_classes = len(found) and not ((found >= 0.5).all() or (found < 0.5).all())
    weights = None
    if two_classes:
        chosen = sampled_texts(source, texts, max_rows).mapInArrow(learn, "h long, features array<int>, posterior double")
        sample = stored(chosen.dropDuplicates(["h"]).orderBy("h"), "weak_labels")
        fitted = train_scorer(sample, n_features)
        weights, bias = fitted.coefficients.toArray(), float(fitted.intercept)
        forget(sample)
    forget(texts)

    schema = T.StructType([T.StructField("_key", key_type), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(n_features)
        for whole in batches:
            for b in row_slices(whole, "_text"):
                pattern, features = document_votes(b.column(1).to_pylist(), words)
                votes = np.array([decode_pattern(int(p), len(LABELLERS)) for p in pattern], np.int64).reshape(-1, len(LABELLERS))
                posterior = label_model.posterior(votes)
                linear = posterior if weights is None else 1 / (1 + np.exp(-np.array([weights[f].sum() + bias for f in features])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(posterior), pa.array(linear.round(6))], names=schema.fieldNames())

    out = source.mapInArrow(score, schema).select(F.col("_key").alias(key), "posterior", "score", (F.col("score") >= keep_from).alias("kept"))
    return out, names
