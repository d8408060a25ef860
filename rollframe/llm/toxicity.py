"""Toxicity by a convolutional text classifier trained in numpy.

A word is one row in each of several hashed embedding tables, side by side: two tables by the
word (words that share a row of one hardly ever share that of the other) and one for each
length of prefix, so that inflected forms of a stem share rows. Filters of several widths run
over the whole text, their largest responses feed a logistic output. Training is by stochastic gradient
descent (adaptive steps) on a bounded sample of labelled documents; the first embedding
dimension starts from smoothed log odds of the words, the other dimensions at random. Words
never seen in training have no weight.

The score uses the text alone. Thresholds are calibrated by language on the fifth of the documents
(by hash) kept out of counts and gradient steps, and decide ``rejected``; a language with few toxic examples takes the
threshold of all languages.

Scoring is a map over slices of whole texts, with the model broadcast; nothing is shuffled.

Defined cases: null and empty texts get the score of a text without words; a repeated row is
scored per row; a null language takes the threshold of all languages; without labels of both
classes the model answers the share of toxic labels (0.5 with none).
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rollframe.llm.common import fresh, map_slices, query, small_batches, staged, table
from rollframe.llm.labelled import known_labels, remainder, trained, with_labels
from rollframe.llm.words import LETTER_OR_DIGIT, Words, slices

BUCKETS = 1 << 18
DIMS = 3
#: Lengths in bytes of the prefixes that have a table.
PREFIXES = (4, 5, 6)
TABLES = 2 + len(PREFIXES)
SIZE = TABLES * DIMS
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
CUT = 0.3
#: A language needs so many toxic calibration documents for a threshold of its own.
OWN_THRESHOLD = 25
#: Documents of a training slice, and how many there must be for a fifth to be kept for calibration.
SLICE_ROWS = 4000
LEAST_SPLIT = 50
#: What a difference of parameters is counted in.
UNIT = 2.0 ** -40
#: Cuts that thresholds are chosen from.
CUTS = [float(c) for c in np.linspace(CUT, 0.7, 41)]


def rows_of(words: Words) -> np.ndarray:
    """Row in each table for every word."""
    mask = np.uint64(BUCKETS - 1)
    whole, *heads = words.hashes(PREFIXES)
    return np.stack([whole & mask, (whole >> np.uint64(32)) & mask, *(h & mask for h in heads)], axis=1).astype(np.int32)


def presence(docs: list[np.ndarray]) -> np.ndarray:
    """In how many of the documents each row of each table occurs."""
    seen = np.zeros((TABLES, BUCKETS), np.int64)
    for d in docs:
        for j in range(TABLES):
            seen[j, np.unique(d[:, j])] += 1
    return seen


class Model:
    def __init__(self, positives: list[np.ndarray], negatives: list[np.ndarray], seed: int = 5):
        """Tables from the log odds of each row's presence in documents of either class."""
        self._start(presence(positives), presence(negatives), len(positives), len(negatives), seed)

    @classmethod
    def of_counts(cls, positives: np.ndarray, negatives: np.ndarray, sizes: tuple[int, int], seed: int = 5) -> "Model":
        """The same from the counts of :func:`presence` and the number of documents of either class."""
        model = cls.__new__(cls)
        model._start(positives, negatives, *sizes, seed)
        return model

    def _start(self, positives: np.ndarray, negatives: np.ndarray, n_positive: int, n_negative: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.tables = np.zeros((TABLES, BUCKETS, DIMS), np.float32)
        for j in range(TABLES):
            seen = (positives[j], negatives[j])
            share = [(s + 1.0) / (n + 2.0) for s, n in zip(seen, (n_positive, n_negative))]
            self.tables[j, :, 1:] = rng.normal(0, 0.1, (BUCKETS, DIMS - 1))
            self.tables[j, :, 0] = np.clip(np.log(share[0] / share[1]), -3, 3)
            self.tables[j, seen[0] + seen[1] == 0] = 0
        self.filters = {w: rng.normal(0, 0.2, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:  # the first filter of each width starts on the log odds of its first word
            self.filters[w][:, 0] = 0
            self.filters[w][0: SIZE: DIMS, 0] = 1
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.bias[w][0] = -4
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out[::FILTERS] = 0.7
        self.base = np.float32(-1.5)
        self.shift = 0.0

    def __getstate__(self) -> dict:
        """Most rows of the tables belong to no word seen: the others alone travel."""
        flat = self.tables.reshape(-1, DIMS)
        cells = np.flatnonzero(flat.any(axis=1)).astype(np.int32)
        return self.__dict__ | {"tables": (cells, flat[cells])}

    def __setstate__(self, state: dict) -> None:
        cells, rows = state["tables"]
        tables = np.zeros((TABLES, BUCKETS, DIMS), np.float32)
        tables.reshape(-1, DIMS)[cells] = rows
        self.__dict__ |= state | {"tables": tables}

    def dense(self) -> list[np.ndarray]:
        """The parameters beside the tables, each as one dimension."""
        return [*(f.reshape(-1) for f in self.filters.values()), *self.bias.values(), self.out, np.array([self.base])]

    def moved(self, start: "Model") -> tuple[np.ndarray, np.ndarray]:
        """Number and difference (in units) of every table row that left its start, and of every
        other parameter, whose numbers follow those of the tables."""
        steps = self.tables.reshape(-1, DIMS).astype(np.float64) - start.tables.reshape(-1, DIMS)
        cells = np.flatnonzero(steps.any(axis=1))
        rest = np.concatenate(self.dense()).astype(np.float64) - np.concatenate(start.dense())
        steps = np.concatenate([steps[cells], np.stack([rest, *[np.zeros(len(rest))] * (DIMS - 1)], axis=1)])
        return np.concatenate([cells, TABLES * BUCKETS + np.arange(len(rest))]), np.rint(steps / UNIT).astype(np.int64)

    def move(self, cells: np.ndarray, steps: np.ndarray) -> None:
        """Add differences (as numbers) by the numbers of :meth:`moved`."""
        own = cells < TABLES * BUCKETS
        self.tables.reshape(-1, DIMS)[cells[own]] += steps[own].astype(np.float32)
        flat = np.concatenate(self.dense()).astype(np.float64)
        flat[cells[~own] - TABLES * BUCKETS] += steps[~own, 0]
        at = 0
        for part in self.dense()[:-1]:
            part[:] = flat[at: at + len(part)]
            at += len(part)
        self.base = np.float32(flat[at])

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[j][rows[:, j]] for j in range(TABLES)], axis=1)

    def responses(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """Filter responses from every word on; ``x`` ends with enough empty words."""
        n, size = len(x) - max(WIDTHS) + 1, SIZE
        return {w: sum(x[i: n + i] @ self.filters[w][i * size: (i + 1) * size] for i in range(w)) + self.bias[w] for w in WIDTHS}

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities of the texts whose words are ``rows[first[i]:first[i + 1]]``."""
        gap, texts = max(WIDTHS) - 1, len(first) - 1
        count = np.diff(first)
        starts = first[:-1] + gap * np.arange(texts)  # every text is followed by empty words
        x = np.zeros((len(rows) + gap * texts + gap, SIZE), np.float32)
        place = np.arange(len(rows)) + gap * np.repeat(np.arange(texts), count)
        x[place] = self.embed(rows)
        logits = np.full(texts, self.base, np.float64)
        full = np.flatnonzero(count)
        for k, (w, r) in enumerate(self.responses(x).items()):
            best = np.tile(self.bias[w], (texts, 1))
            if len(full):
                cuts = np.stack([starts[full], starts[full] + count[full]], axis=1).ravel()
                best[full] = np.maximum.reduceat(np.concatenate([r, r[:1]]), cuts, axis=0)[::2]
            logits += np.maximum(best, 0) @ self.out[k * FILTERS: (k + 1) * FILTERS]
        return 1 / (1 + np.exp(-(logits + self.shift)))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float = 0.05, seed: int = 7) -> None:
        rng, gap, size = np.random.default_rng(seed), max(WIDTHS) - 1, SIZE
        sums = {"tables": np.full((TABLES, BUCKETS), 1e-3, np.float32), "out": np.full(len(self.out), 1e-3), "base": 1e-3}
        sums |= {w: np.full(self.filters[w].shape, 1e-3) for w in WIDTHS} | {("b", w): np.full(FILTERS, 1e-3) for w in WIDTHS}

        def step(value, grad, name):
            sums[name] += grad * grad
            value -= (rate * grad / np.sqrt(sums[name])).astype(np.float32)

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for begin in range(0, len(order), BATCH):
                grads = {w: np.zeros_like(self.filters[w]) for w in WIDTHS}
                grads |= {("b", w): np.zeros(FILTERS) for w in WIDTHS} | {"out": np.zeros(len(self.out)), "base": 0.0}
                touched: list[tuple[np.ndarray, np.ndarray]] = []
                own = order[begin: begin + BATCH]
                for i in own:
                    rows = docs[i] if len(docs[i]) else np.zeros((0, TABLES), np.int32)
                    if not len(rows):
                        continue
                    x = np.concatenate([self.embed(rows), np.zeros((gap, size), np.float32)])
                    pooled, at = [], []
                    for w, r in self.responses(x).items():
                        at.append(r.argmax(axis=0))
                        pooled.append(r[at[-1], np.arange(FILTERS)])
                    z = np.maximum(np.concatenate(pooled), 0)
                    error = float(1 / (1 + np.exp(-(z @ self.out + self.base))) - labels[i])
                    grads["base"] += error
                    back = np.where(z > 0, error * self.out, 0)
                    grads["out"] += error * z
                    for k, w in enumerate(WIDTHS):
                        g = back[k * FILTERS: (k + 1) * FILTERS]
                        live = np.flatnonzero(g)
                        if not len(live):
                            continue
                        places = at[k][live][:, None] + np.arange(w)
                        grads["b", w][live] += g[live]
                        grads[w][:, live] += (x[places].reshape(len(live), -1) * g[live][:, None]).T
                        dx = (self.filters[w][:, live] * g[live]).T.reshape(-1, size)
                        flat = places.ravel()
                        real = flat < len(rows)
                        touched.append((rows[flat[real]], dx[real]))
                scale = 1 / len(own)
                for w in WIDTHS:
                    step(self.filters[w], grads[w] * scale, w)
                    step(self.bias[w], grads["b", w] * scale, ("b", w))
                step(self.out, grads["out"] * scale, "out")
                sums["base"] += (grads["base"] * scale) ** 2
                self.base -= np.float32(rate * grads["base"] * scale / np.sqrt(sums["base"]))
                if touched:
                    rows, dx = np.concatenate([t[0] for t in touched]), np.concatenate([t[1] for t in touched]) * scale
                    for j in range(TABLES):
                        unique, where = np.unique(rows[:, j], return_inverse=True)
                        g = np.zeros((len(unique), DIMS))
                        np.add.at(g, where, dx[:, j * DIMS: (j + 1) * DIMS])
                        sums["tables"][j, unique] += (g * g).mean(axis=1)
                        self.tables[j, unique] -= (rate * g / np.sqrt(sums["tables"][j, unique])[:, None]).astype(np.float32)


class Constant:
    """Stands in where there are not labels of both classes."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.share)


def thresholds(counts: list[tuple[str | None, int, int, int]]) -> dict[str | None, float]:
    """The lowest cut of best F1 for all languages (under None) and for each with enough examples.
    Takes (language, label, cuts reached, documents)."""
    def best(rows):
        shape = (2, len(CUTS) + 1)
        n = np.zeros(shape, np.int64)
        for _, label, reached, docs in rows:
            n[label, reached] += docs
        above = n[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # documents that reach each cut
        f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + n[1].sum())
        return float(CUTS[np.flatnonzero(np.isclose(f1, f1.max()))[0]])
    toxic = [r for r in counts if r[1]]
    out = {None: best(counts) if toxic else CUT}
    for lang in sorted({r[0] for r in toxic if r[0]}):
        if sum(r[3] for r in toxic if r[0] == lang) >= OWN_THRESHOLD:
            out[lang] = best([r for r in counts if r[0] == lang])
    return out


def hashed(table: pa.Table) -> list[np.ndarray]:
    """Table rows of the words of every text."""
    out = []
    for piece in slices(iter(table.to_batches())):
        words = Words(piece.column("text"), LETTER_OR_DIGIT, True)
        rows = rows_of(words)
        out += [rows[a:b] for a, b in zip(words.first, words.first[1:])]
    return out


def fit(docs: DataFrame, labels: DataFrame, allowed, rows: int = SLICE_ROWS, epochs: int = EPOCHS):
    """A model and its thresholds from all labelled documents, in slices of about ``rows``."""
    spark = docs.sparkSession
    small_batches(spark)
    known = staged(with_labels(docs, known_labels(labels, "toxic", allowed)).withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5))))
    sizes = {(r.label, r.aside): r.n for r in known.groupBy("label", (F.col("draw") == 0).alias("aside")).agg(F.count("*").alias("n")).collect()}
    of = lambda label, *asides: sum(sizes.get((label, a), 0) for a in asides)
    total = [of(0, True, False), of(1, True, False)]
    if not all(total):
        return Constant(total[1] / sum(total) if sum(total) else 0.5), {None: CUT}
    split = sum(total) >= LEAST_SPLIT
    own, held = (known.filter("draw <> 0"), known.filter("draw = 0")) if split else (known, known)
    n_own = [of(0, False), of(1, False)] if split else total

    def count(batches):
        seen = np.zeros((2, TABLES * BUCKETS), np.int64)
        for batch in batches:
            y = batch.column("label").to_numpy()
            x = hashed(pa.Table.from_batches([batch]))
            for value in (0, 1):
                seen[value] += presence([x[i] for i in np.flatnonzero(y == value)]).reshape(-1)
        cells = np.flatnonzero(seen.any(axis=0))
        for a in range(0, len(cells), 50_000):
            part = cells[a: a + 50_000]
            yield pa.RecordBatch.from_pydict({"cell": part, "n0": seen[0, part], "n1": seen[1, part]})

    def begin(cells: pa.Table):
        seen = np.zeros((2, TABLES * BUCKETS), np.int64)
        at = cells.column("cell").to_numpy()
        seen[0, at], seen[1, at] = cells.column("n0").to_numpy(), cells.column("n1").to_numpy()
        seen = seen.reshape(2, TABLES, BUCKETS)
        return Model.of_counts(seen[1], seen[0], (n_own[1], n_own[0]))
    counted = own.select("label", "text").mapInArrow(count, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    start = spark.sparkContext.broadcast(trained(counted, begin))

    def train(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("doc_id")
        model = copy.deepcopy(start.value)
        model.train(hashed(piece), piece.column("label").to_numpy(), epochs)
        cells, steps = model.moved(start.value)
        return pa.table({"cell": cells, **{f"d{i}": steps[:, i] for i in range(DIMS)}})

    def end(cells: pa.Table):
        model = copy.deepcopy(start.value)
        steps = np.stack([cells.column(f"d{i}").to_numpy() for i in range(DIMS)], axis=1)
        model.move(cells.column("cell").to_numpy(), steps * UNIT / cells.column("n").to_numpy()[:, None])
        return model
    parts = max(1, -(-sum(n_own) // rows))
    dealt = own.select("doc_id", "label", "text", F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(parts)).alias("slice"))
    trained_slices = dealt.groupBy("slice").applyInArrow(train, "cell long, " + ", ".join(f"d{i} long" for i in range(DIMS)))
    model = trained(trained_slices.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMS)]), end)
    start.destroy()
    shared = spark.sparkContext.broadcast(model)

    reached = F.size(F.filter(F.array(*[F.lit(c) for c in CUTS]), lambda c: c <= F.col("score")))
    scored = score(held.select("lang", "label", "text"), shared).groupBy("lang", "label", reached.alias("reached")).agg(F.count("*").alias("n"))
    counts = [tuple(r) for r in scored.collect()]
    shared.destroy()
    return model, thresholds(counts)


def score(docs: DataFrame, model, name: str = "score") -> DataFrame:
    """Add the score to every row, by its whole text; the other columns pass through. The model may be a
    broadcast already."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != name]
    # Numbered names for the way through Python, which takes no dots.
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    text = f"c{rest.index('text')}"

    def work(piece):
        words = Words(piece.column(text), LETTER_OR_DIGIT, True)
        return piece.append_column("score", pa.array(shared.value.scores(rows_of(words), words.first), pa.float64()))
    return map_slices(rows, work, StructType([*rows.schema, StructField("score", DoubleType())]), text).toDF(*rest, name)


def rejected(cuts: dict[str | None, float], name: str = "score"):
    """Whether a row's score reaches the threshold of its language."""
    cut = F.lit(cuts[None])
    for lang, value in sorted((k, v) for k, v in cuts.items() if k):
        cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    return F.col(name) >= cut


def drop_toxic(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """The rows whose score stays below the threshold of their language, with all their columns."""
    model, cuts = fit(docs, labels, allowed)
    name = fresh(docs, "_toxicity")
    return score(docs, model, name).filter(~rejected(cuts, name)).select(*[f"`{c}`" for c in docs.columns])


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model, cuts = fit(docs, table(spark, sf, "labels"), remainder(4) != 2)
    scored = score(docs.select("doc_id", "text", "lang"), model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
                         rejected(cuts).alias("rejected"))
