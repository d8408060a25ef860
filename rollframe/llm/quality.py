"""Quality classifier with supervised subword embeddings.

A document is the average of learned vectors of its words (blank-separated, as written), of
its character n-grams, and of a mark for each word equal to the one before, hashed into one
table; a softmax layer on the average gives
the class. Table and layer are trained together by stochastic gradient descent in numpy, on
a bounded sample of labelled documents, each taken whole.

Because average and layer are linear, a trained model folds into one number per table row:
the log odds of a text are the mean of those numbers over its words and n-grams. Scoring is
one map over slices of whole texts; nothing is shuffled.

Defined cases: null and empty texts have no features and get the score of the layer's offset;
texts shorter than an n-gram have words only; a repeated row is scored per row; without
labels of both classes the model answers the share of good labels (0.5 with none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import map_slices, query, table
from rollframe.llm.labelled import SAMPLE_ROWS, prior_shift, remainder, sample, trained
from rollframe.llm.words import NOT_BLANK, Words

#: Rows for words, and as many for n-grams.
BUCKETS = 1 << 18
NGRAMS = (3, 4)
#: Row of the mark for a repeated word.
AGAIN = 2 * BUCKETS
DIMS = 8
EPOCHS = 8
#: Small samples are gone over more often, up to so many steps.
LEAST_STEPS = 1500
BATCH = 32
RATE = 0.5
CUT = 0.3


def ngram_rows(data: np.ndarray, width: int) -> np.ndarray:
    """Table row of the ``width`` bytes from each byte on."""
    n = len(data) - width + 1
    code = np.zeros(max(n, 0), np.uint32)
    for i in range(width):
        code = (code << np.uint32(8)) | data[i: n + i]
    spread = (code ^ np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    spread ^= spread >> np.uint32(15)
    return ((spread * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 18)) + np.uint32(BUCKETS)


def word_rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table row of each word, and whether it repeats the word before it."""
    hashes = words.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.uint32), again


class Model:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (AGAIN + 1, DIMS)).astype(np.float32)
        self.layer, self.offset = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, rate: float = RATE, seed: int = 9) -> None:
        """``docs``: distinct table rows of each document and the share of each."""
        rng, steps, done = np.random.default_rng(seed), epochs * len(docs), 0
        used = np.zeros(len(self.vectors), bool)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for begin in range(0, len(order), BATCH):
                own = [i for i in order[begin: begin + BATCH] if len(docs[i][0])]
                done += BATCH
                if not own:
                    continue
                speed = rate * max(0.05, 1 - done / steps)
                rows, share = np.concatenate([docs[i][0] for i in own]), np.concatenate([docs[i][1] for i in own])
                used[rows] = True
                first = np.cumsum([0, *(len(docs[i][0]) for i in own[:-1])])
                hidden = np.add.reduceat(self.vectors[rows] * share[:, None], first, axis=0)
                z = hidden @ self.layer + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                back = (p @ self.layer.T).astype(np.float32)
                self.layer -= speed * hidden.T @ p / len(own)
                self.offset -= speed * p.mean(axis=0)
                # Each feature moves by its share of the document; the factor undoes the averaging.
                size = np.repeat(back, [len(docs[i][0]) for i in own], axis=0) * share[:, None]
                np.subtract.at(self.vectors, rows, speed * 20 * size)
        self.vectors[~used] = 0

    def fold(self, shift: float) -> Folded:
        gap = self.layer[:, 1] - self.layer[:, 0]
        return Folded(self.vectors @ gap, float(self.offset[1] - self.offset[0]) + shift)


class Folded:
    """One weight per table row and an offset."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights.astype(np.float32), offset

    def scores(self, words: Words) -> np.ndarray:
        total, count = np.zeros(len(words.count)), words.count.astype(np.float64)
        rows, again = word_rows(words)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[rows] + again * self.weights[AGAIN], dtype=np.float64)])
        total += sums[words.first[1:]] - sums[words.first[:-1]]
        marks = np.concatenate([[0], np.cumsum(again)])
        count += marks[words.first[1:]] - marks[words.first[:-1]]
        for width in NGRAMS:
            sums = np.concatenate([[0.0], np.cumsum(self.weights[ngram_rows(words.data, width)], dtype=np.float64), np.zeros(width)])
            ends = np.maximum(words.offsets[1:] - width + 1, words.offsets[:-1])  # n-grams stay inside their text
            total += sums[ends] - sums[words.offsets[:-1]]
            count += ends - words.offsets[:-1]
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.offset)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, words: Words) -> np.ndarray:
        return np.full(len(words.count), self.share)


def fit(docs: DataFrame, labels: DataFrame, allowed, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS):
    """A folded model from at most ``rows`` labelled documents of each class."""
    drawn, counts = sample(docs, labels, "quality", allowed, rows)

    def hashed(piece):
        words = Words(piece.column("text"), NOT_BLANK, False)
        (own, again), grams, out = word_rows(words), [ngram_rows(words.data, w) for w in NGRAMS], []
        for i in range(len(words.count)):
            a, b = words.offsets[i], words.offsets[i + 1]
            mine = slice(words.first[i], words.first[i + 1])
            every = np.concatenate([own[mine], np.full(again[mine].sum(), AGAIN), *(g[a: max(a, b - w + 1)] for g, w in zip(grams, NGRAMS))])
            ids, n = np.unique(every, return_counts=True)
            out.append((ids.astype(np.int32).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
        return {"doc_id": piece.column("doc_id"), "label": piece.column("label"), "ids": pa.array([o[0] for o in out], pa.binary()),
                "share": pa.array([o[1] for o in out], pa.binary())}
    def train(got: list[dict]):
        y = np.array([r["label"] for r in got], np.int64)
        if len(set(y.tolist())) < 2:
            return Constant(counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5)
        model, rounds = Model(), max(epochs, LEAST_STEPS * BATCH // len(got))
        model.train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got], y, rounds)
        return model.fold(prior_shift(counts, int(y.sum()), int((y == 0).sum())))
    return trained(map_slices(drawn, hashed, "doc_id long, label int, ids binary, share binary"), lambda drawn: train(drawn.sort_by("doc_id").to_pylist()))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row, by its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(piece):
        words = Words(piece.column("text"), NOT_BLANK, False)
        return {"doc_id": piece.column("doc_id"), "score": pa.array(shared.value.scores(words), pa.float64())}
    return map_slices(docs.select("doc_id", "text"), work, "doc_id long, score double")


@query("op10_quality")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"), remainder(5) != 0)
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
