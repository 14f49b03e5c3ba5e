"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on every document.  Their accuracies are
estimated by expectation-maximisation over the counts of all vote patterns: there are 3**10 patterns
at most, whatever the size of the corpus, and every document is counted.  The posteriors of a bounded
sample of documents then train a hashed linear scorer, which scores every document.

Defined results: a null or empty text has no votes, the posterior of the class share, and a score from the
intercept and the length feature; a very long text votes and is scored whole; rows without an id count and are scored
like any other; repeated rows are scored alike; a score equal to the threshold is kept; columns other than ``doc_id``
and ``text``, of any name, are not looked at; without documents the result is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import table

BAD, GOOD, NONE = 0, 1, 2
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Hash buckets of the scorer.
BUCKETS = 1 << 16
#: At most about so many documents (those with the lowest hashes) train the scorer.
TRAIN_ROWS = 10_000
#: Rounds of expectation-maximisation and of gradient descent.
EM_ROUNDS, DESCENT_ROUNDS = 100, 150
#: Documents that score lower are rejected.
THRESHOLD = 0.5
#: Words remembered by a task.
MEMO_WORDS = 500_000


def bad_if(condition: bool) -> int:
    return BAD if condition else NONE


def votes(text: bytes) -> tuple[int, ...]:
    """Votes of the labellers on a text: the first seven know bad signs, the others good ones."""
    words = text.split()
    n = len(words)
    if not n:
        return (NONE,) * len(LABELLERS)
    chars = len(text)
    symbols = chars - len(text.translate(None, SYMBOLS))
    upper = chars - len(text.translate(None, UPPER))
    marks = sum(w[-1:] in b"#*$%&|!" for w in words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = text.count(b".") + text.count(b"?")
    repeats = sum(map(eq, words, words[1:]))
    often = Counter(words).most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:])))
    length = sum(map(len, words)) / n
    return (
        bad_if(symbols > 0.02 * chars),
        bad_if(marks > 0.15 * n),
        bad_if(upper > 0.3 * chars),
        bad_if(n >= 5 and repeats > 0.15 * n),
        bad_if(len(lines) >= 3 and len(set(lines)) < 0.5 * len(lines)),
        bad_if(n >= 20 and often > 0.25 * n),
        bad_if(n >= 20 and pairs < 0.6 * (n - 1)),
        GOOD if ends and n / ends <= 60 and marks <= 0.03 * n else NONE,
        (GOOD if 2.5 <= length <= 12 else BAD) if n >= 5 else NONE,
        GOOD if pairs >= 0.85 * (n - 1) and symbols <= 0.005 * chars else NONE,
    )


LABELLERS = ("symbols", "marks", "upper", "repeats", "lines", "often", "pairs", "sentences", "length", "variety")


@dataclass
class LabelModel:
    """Share of good documents, and each labeller's chances of a bad, a good and no vote (last axis), given a
    bad and a good document (axis before)."""

    good: float
    chances: np.ndarray

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Chance that documents with these votes (rows of patterns) are good."""
        logs = np.log(self.chances)
        odds = np.log(self.good) - np.log(1 - self.good)
        for k in range(pattern.shape[1]):
            odds = odds + logs[k, GOOD, pattern[:, k]] - logs[k, BAD, pattern[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def patterns_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Maximum-likelihood accuracies from the counts of vote patterns, started at the majority vote."""
    pattern = patterns_of(codes)
    ayes, noes = (pattern == GOOD).sum(1), (pattern == BAD).sum(1)
    q = np.where(ayes + noes > 0, (ayes + 1.0) / (ayes + noes + 2.0), 0.5)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - q) * counts, q * counts], 1)
        cast = np.stack([(pattern == v).astype(float).T @ weight for v in (BAD, GOOD, NONE)], -1) + 0.1
        share = float((weight[:, GOOD].sum() + 1) / (counts.sum() + 2))
        model = LabelModel(share, cast / cast.sum(-1, keepdims=True))
        q = model.posterior(pattern)
    return model


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


def word_features(word: bytes) -> tuple[int, int]:
    """A word and its last two bytes."""
    return bucket(b"w" + word), bucket(b"e" + word[-2:])


def text_features(words: list[bytes]) -> list[int]:
    """Features of the whole text, in steps: its length and the share of words that repeat the one before."""
    n = len(words)
    repeats = sum(map(eq, words, words[1:]))
    return [bucket(b"n%d" % min(12, n.bit_length())), bucket(b"r%d" % (10 * repeats // max(1, n)))]


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def vote_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, code): the votes on each text as digits to base 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = [3**k for k in range(len(LABELLERS))]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                codes = [sum(map(int.__mul__, votes(x.as_py()), power)) for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.int32())], ["doc_id", "code"])

    return identified(docs).mapInArrow(run, "doc_id long, code int")


def train(docs: DataFrame, model: LabelModel, rows: int, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the hashed scorer, the intercept last; fitted to the posteriors of the sampled documents."""
    share = min(1.0, train_rows / max(1, rows))
    drawn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                data = text.as_py()
                words = data.split()
                at = np.array([b for w in words for b in word_features(w)], np.int64)
                place, count = np.unique(at, return_counts=True)
                place = np.concatenate([place, text_features(words)])
                value = np.concatenate([count / max(1, len(words)), [1.0, 1.0]])
                code = sum(v * 3**k for k, v in enumerate(votes(data)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([code], pa.int32()),
                        pa.array([place.tolist()], pa.list_(pa.int32())),
                        pa.array([value.tolist()], pa.list_(pa.float32())),
                    ],
                    ["code", "place", "value"],
                )

    sample = identified(docs).where(drawn).mapInArrow(run, "code int, place array<int>, value array<float>").toPandas()
    weights = np.zeros(BUCKETS + 1)
    if not len(sample):
        return weights
    target = model.posterior(patterns_of(sample["code"].to_numpy(np.int64)))
    size = sample["place"].map(len).to_numpy()
    row = np.repeat(np.arange(len(sample)), size)
    place = np.concatenate(sample["place"].to_numpy()).astype(np.int64)
    value = np.concatenate(sample["value"].to_numpy()).astype(float)
    squares = np.full(BUCKETS + 1, 1e-8)
    for _ in range(DESCENT_ROUNDS):
        z = np.bincount(row, weights=weights[place] * value, minlength=len(sample)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.bincount(place, weights=error[row] * value, minlength=BUCKETS + 1) / len(sample)
        slope[-1] = error.mean()
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


class Weights(dict):
    """The summed weights of a word's features, worked out once."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        a, b = word_features(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = self.weights[a] + self.weights[b]
        return out


def score(docs: DataFrame, model: LabelModel, weights: np.ndarray) -> DataFrame:
    """(doc_id, code, posterior, score) of all whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label_model, w = shared.value
        memo = Weights(w)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                codes, scores = [], []
                for text in part.column(1).cast(pa.binary()):
                    data = text.as_py()
                    words = data.split()
                    z = sum(map(memo.__getitem__, words)) / max(1, len(words)) + memo.weights[-1]
                    z += sum(memo.weights[b] for b in text_features(words))
                    codes.append(sum(v * 3**i for i, v in enumerate(votes(data))))
                    scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                posterior = label_model.posterior(patterns_of(np.array(codes, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(codes, pa.int32()), pa.array(posterior), pa.array(scores, pa.float64())],
                    ["doc_id", "code", "posterior", "score"],
                )

    return identified(docs).mapInArrow(run, "doc_id long, code int, posterior double, score double")


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, LabelModel]:
    """Scores of all documents, and the model of the labellers."""
    counted = vote_codes(docs).groupBy("code").count().collect()  # 3**10 rows at most
    codes = np.array([r["code"] for r in counted], np.int64)
    counts = np.array([r["count"] for r in counted], float)
    model = estimate(codes, counts)
    return score(docs, model, train(docs, model, int(counts.sum()), train_rows)), model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = classify(table(spark, sf_dir, "documents"))
    digit = [F.floor(F.col("code") / 3**k).cast("int") % 3 for k in range(len(LABELLERS))]
    vote = [F.when(d == NONE, None).otherwise(d == GOOD).alias(f"says_{n}") for d, n in zip(digit, LABELLERS)]
    return scored.select("doc_id", *vote, "posterior", "score", (F.col("score") >= THRESHOLD).alias("kept"))
