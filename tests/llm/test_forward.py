"""The classifiers' scores from their stored weights in plain Python, and a gradient step against finite differences."""

import math
import pickle

import numpy as np
import pyarrow as pa
import pytest

from rollframe.llm import labelled, quality, toxicity
from rollframe.llm.words import LETTER_OR_DIGIT, NOT_BLANK, Words

TEXTS = ["you vile person you", "a calm and friendly note on gardens", "x", "", "vile vile vile", "un été calme"]


def words_of(text):
    return Words(pa.array([text]), LETTER_OR_DIGIT, True)


def plain_logit(model, rows):
    """Score before the logistic function: largest response of every filter over all places, word by word."""
    size, total = toxicity.SIZE, float(model.base)
    embedded = [[float(v) for j in range(toxicity.TABLES) for v in model.tables[j][row[j]]] for row in rows]
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = -math.inf if embedded else float(model.bias[width][f])
            for at in range(len(embedded)):
                response = float(model.bias[width][f])
                for i in range(width):
                    if at + i < len(embedded):
                        response += sum(x * float(model.filters[width][i * size + d][f]) for d, x in enumerate(embedded[at + i]))
                best = max(best, response)
            total += max(best, 0.0) * float(model.out[k * toxicity.FILTERS + f])
    return total


@pytest.fixture(scope="module")
def toxic_model():
    rows = [toxicity.rows_of(words_of(t)) for t in TEXTS]
    model = toxicity.Model([rows[0], rows[4]], [rows[1], rows[5]])
    model.train(rows, np.array([1, 0, 0, 0, 1, 0]), 3)
    model.shift = 0.25
    return model


@pytest.mark.parametrize("text", TEXTS)
def test_toxicity_score(toxic_model, text):
    words = words_of(text)
    rows = toxicity.rows_of(words)
    want = 1 / (1 + math.exp(-(plain_logit(toxic_model, rows.tolist()) + toxic_model.shift)))
    assert toxic_model.scores(rows, words.first)[0] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_step_follows_the_gradient(label):
    """One step on one document: its size tells the gradient, as the rate and the running sum are known."""
    rows = toxicity.rows_of(words_of(TEXTS[0]))
    other = toxicity.rows_of(words_of(TEXTS[1]))
    make = lambda: toxicity.Model([rows], [other])
    model, rate = make(), 1e-4
    model.train([rows], np.array([label]), 1, rate=rate)

    def loss(change):
        m = make()
        for name in ("tables", "out"):
            setattr(m, name, getattr(m, name).astype(np.float64))
        m.filters = {w: f.astype(np.float64) for w, f in m.filters.items()}
        m.bias, m.base = {w: b.astype(np.float64) for w, b in m.bias.items()}, float(m.base)
        change(m)
        z = plain_logit(m, rows.tolist())
        return math.log(1 + math.exp(-z)) if label else math.log(1 + math.exp(z))

    def implied(before, after):
        t = (float(before) - float(after)) / rate  # grad / sqrt(0.001 + grad ** 2)
        return math.sqrt(1e-3) * t / math.sqrt(max(1e-9, 1 - t * t))

    def slope(put):
        h = 1e-5
        return (loss(lambda m: put(m, h)) - loss(lambda m: put(m, -h))) / (2 * h)
    old = make()
    checked = 0
    for i in range(0, len(old.out), 3):
        want = slope(lambda m, d, i=i: m.out.__setitem__(i, m.out[i] + d))
        assert implied(old.out[i], model.out[i]) == pytest.approx(want, rel=0.05, abs=2e-3)
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            for d in (0, 4, w * toxicity.SIZE - 1):
                want = slope(lambda m, h, w=w, d=d, f=f: m.filters[w].__setitem__((d, f), m.filters[w][d, f] + h))
                if abs(want) < 0.02:  # beyond this a step is too near its full size to tell the gradient
                    assert implied(old.filters[w][d, f], model.filters[w][d, f]) == pytest.approx(want, rel=0.1, abs=2e-3)
                    checked += 1
    assert checked > 20


def test_training_adds_to_the_start():
    """Words that the start knows nothing of are told apart after training only."""
    rng = np.random.default_rng(1)
    pool = [f"w{i}" for i in range(40)]
    # Both classes have the same words; the toxic ones have them in pairs.
    texts, labels = [], []
    for i in range(120):
        words = list(rng.permutation(pool[:20]))
        if i % 2:
            at = int(rng.integers(0, 19))
            words[at:at] = ["alpha", "beta"]
        else:
            words.insert(int(rng.integers(0, 9)), "alpha")
            words.insert(int(rng.integers(12, 20)), "beta")
        texts.append(toxicity.rows_of(words_of(" ".join(words))))
        labels.append(i % 2)
    y = np.array(labels)
    model = toxicity.Model([t for t, v in zip(texts, y) if v], [t for t, v in zip(texts, y) if not v])
    right = lambda m: np.mean([(m.scores(t, np.array([0, len(t)]))[0] >= 0.5) == v for t, v in zip(texts, y)])
    before = right(model)
    model.train(texts, y, 12)
    assert before <= 0.6 and right(model) >= 0.9


def plain_quality(folded, text):
    """Mean weight of words, repeats and byte n-grams, one by one."""
    words = Words(pa.array([text]), NOT_BLANK, False)
    rows, again = quality.word_rows(words)
    weights = [float(folded.weights[r]) for r in rows] + [float(folded.weights[quality.AGAIN])] * int(again.sum())
    data = text.encode()
    for width in quality.NGRAMS:
        for i in range(len(data) - width + 1):
            code = int.from_bytes(data[i: i + width], "big") & 0xFFFFFFFF
            spread = ((code ^ (width * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            spread ^= spread >> 15
            weights.append(float(folded.weights[(((spread * 0xC2B2AE35) & 0xFFFFFFFF) >> 14) + quality.BUCKETS]))
    return 1 / (1 + math.exp(-(sum(weights) / max(1, len(weights)) + folded.offset)))


@pytest.mark.parametrize("text", [*TEXTS, "same same word", "ab"])
def test_quality_score(text):
    rng = np.random.default_rng(2)
    folded = quality.Folded(rng.normal(0, 3, quality.AGAIN + 1), 0.3)
    assert folded.scores(Words(pa.array([text]), NOT_BLANK, False))[0] == pytest.approx(plain_quality(folded, text), abs=1e-6)


def test_quality_step_follows_the_gradient():
    """One step on one document against the softmax loss; vectors move by the stated factor."""
    rows, share = np.array([5, 9, quality.AGAIN], np.int32), np.array([0.5, 0.3, 0.2], np.float32)
    make = quality.Model
    old, model = make(), make()
    old.layer[:] = model.layer[:] = np.random.default_rng(4).normal(0, 0.5, old.layer.shape)
    start = model.vectors.copy()
    speed = 0.1 * 0.05  # with one document the rate has come down to its least part

    def loss(vectors, layer, offset):
        z = (vectors.astype(np.float64) * share[:, None]).sum(axis=0) @ layer.astype(np.float64) + offset
        return -z[1] + math.log(np.exp(z).sum())
    model.train([(rows, share)], np.array([1]), 1, rate=0.1)
    h = 1e-5
    for d in range(quality.DIMS):
        for c in (0, 1):
            step = np.zeros_like(old.layer, np.float64)
            step[d, c] = h
            want = (loss(start[rows], old.layer + step, old.offset) - loss(start[rows], old.layer - step, old.offset)) / (2 * h)
            assert (old.layer[d, c] - model.layer[d, c]) / speed == pytest.approx(want, abs=1e-4)
        for i in range(len(rows)):
            step = np.zeros((len(rows), quality.DIMS))
            step[i, d] = h
            want = (loss(start[rows] + step, old.layer, old.offset) - loss(start[rows] - step, old.layer, old.offset)) / (2 * h)
            assert (start[rows[i], d] - model.vectors[rows[i], d]) / (20 * speed) == pytest.approx(want, abs=1e-4)


def test_a_model_travels_without_the_rows_of_words_never_seen():
    docs = [toxicity.rows_of(words_of(t)) for t in TEXTS]
    model = toxicity.Model([docs[0], docs[4]], [docs[1], docs[5]])
    sent = pickle.dumps(model, protocol=5)
    back = pickle.loads(sent)
    assert len(sent) < 100_000 < model.tables.nbytes
    assert np.array_equal(back.tables, model.tables) and all(np.array_equal(a, b) for a, b in zip(back.dense(), model.dense()))
    rows = docs[0]
    back.train([rows], np.array([0]), 1)
    model.train([rows], np.array([0]), 1)
    assert np.array_equal(back.tables, model.tables)


def test_a_trained_model_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(labelled, "PIECE_BYTES", 1000)
    made = labelled.trained(spark.range(50), lambda rows: np.arange(rows.num_rows * 100))
    assert np.array_equal(made, np.arange(5000))
    assert labelled.trained(spark.range(0), lambda rows: rows.num_rows) == 0
