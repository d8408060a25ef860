"""Trained operators: held-out accuracy, brute-force scores, defined cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollframe.llm import language, quality, toxicity
from rollframe.llm.labelled import remainder
from rollframe.llm.words import LETTER_OR_DIGIT, NOT_BLANK, Words

SF = "/root/testdata/sf0.01"
ODD = [(900_001, None, "en"), (900_002, "", None), (900_003, "x" * 200_000 + " idiot " + "y " * 200_000, "xx"), (None, "hi", "en"), (900_004, "same", "de"), (900_004, "same", "de")]


def made(spark, n=400):
    """Toxic documents hold one of two stems, bad ones repeat a word."""
    rng, docs, labels = np.random.default_rng(11), [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            words[rng.integers(60)] = f"vile{rng.integers(30)}"
        if not good:
            words[20:40] = [words[20]] * 20
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(good), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_held_out_accuracy(spark, label):
    docs, labels = made(spark)
    allowed = remainder(4) != 2
    if label == "toxic":
        model, cuts = toxicity.fit(docs, labels, allowed)
        scored = toxicity.score(docs, model)
        assert set(cuts) == {None} or all(toxicity.CUT <= c <= 0.7 for c in cuts.values())
    else:
        scored = quality.score(docs, quality.fit(docs, labels, allowed))
    rows = scored.join(labels, "doc_id").withColumn("held", remainder(4) == 2).collect()
    held = [r for r in rows if r.held]
    assert len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(r.score >= 0.3) == bool(r[label]) for r in held]) >= 0.95


def test_scores_do_not_use_held_out_labels(spark):
    docs, labels = made(spark, 120)
    allowed = remainder(4) != 2
    turned = labels.withColumn("toxic", F.when(remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, x, allowed)[0]).collect()} for x in (labels, turned))
    assert one == two


def test_all_labelled_documents_train(spark):
    """A toxic word that one long document alone holds, far beyond any slice, is in the model."""
    docs, labels = made(spark, 300)
    ids = [i for i in range(10_000, 10_200)]
    rare = spark.createDataFrame([(i, f"only{i} " + "w1 " * 12_000, "en") for i in ids[:20]], docs.schema)
    both = docs.unionByName(rare)
    known = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i in ids[:20]], labels.schema))
    model, _ = toxicity.fit(both, known, F.lit(True), rows=40, epochs=1)
    words = Words(pa.array([f"only{i}" for i in ids[:20]]), LETTER_OR_DIGIT, True)
    learned = [any(model.tables[j][row[j], 0] > 0 for j in range(2)) for row in toxicity.rows_of(words)]
    assert sum(learned) >= 10  # the others calibrate
    again = toxicity.fit(both.repartition(7), known.repartition(3), F.lit(True), rows=40, epochs=1)[0]
    assert all((a == b).all() for a, b in zip([model.tables, *model.dense()], [again.tables, *again.dense()]))


def test_scoring_in_slices_equals_one_by_one(spark):
    docs, labels = made(spark, 120)
    model, _ = toxicity.fit(docs, labels, F.lit(True))
    texts = [r.text for r in docs.limit(30).collect()] + ["", "a", "vile3"]
    words = Words(pa.array(texts), LETTER_OR_DIGIT, True)
    together = model.scores(toxicity.rows_of(words), words.first)
    for text, want in zip(texts, together):
        own = Words(pa.array([text]), LETTER_OR_DIGIT, True)
        assert model.scores(toxicity.rows_of(own), own.first)[0] == pytest.approx(want, abs=1e-5)
    folded = quality.fit(docs, labels, F.lit(True))
    together = folded.scores(Words(pa.array(texts), NOT_BLANK, False))
    for text, want in zip(texts, together):
        assert folded.scores(Words(pa.array([text]), NOT_BLANK, False))[0] == pytest.approx(want, abs=1e-9)


def test_defined_cases_of_classifiers(spark):
    docs, labels = made(spark, 120)
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as label", "3 as toxic")
    model, cuts = toxicity.fit(docs, labels, F.lit(True))
    scored = toxicity.score(odd, model)
    rows = scored.withColumn("no", toxicity.rejected(cuts)).collect()
    assert len(rows) == len(ODD) and scored.columns == ["doc_id", "text", "lang", "label", "toxic", "score"]
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.score)
        assert 0 <= r.score <= 1 and r.no is not None
    assert by[900_001] == by[900_002] and all(len(v) == 1 for v in by.values())
    kept = toxicity.drop_toxic(odd, labels, F.lit(True))
    assert kept.columns == odd.columns
    assert quality.score(odd, quality.fit(docs, labels, F.lit(True))).count() == len(ODD)
    messy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (0, 0, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.fit(docs, messy, F.lit(True))[1]
    none = labels.limit(0)
    assert [r.score for r in toxicity.score(docs.limit(2), toxicity.fit(docs, none, F.lit(True))[0]).collect()] == [0.5, 0.5]
    assert [r.score for r in quality.score(docs.limit(2), quality.fit(docs, labels.filter("quality = 1"), F.lit(True))).collect()] == [1.0, 1.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_language(pages, docs):
    """The fusion with dictionaries: language and posterior of each page."""
    letter = lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    fold = lambda s: bytes(b if letter(b) else 0x20 for b in s.encode().lower() if True)

    def grams(text):
        low = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in text.encode())
        data = bytes(b if letter(b) else 0x20 for b in low)
        return [((int.from_bytes(data[i: i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> 18 for i in range(len(data) - 2)]
    counts, prior = defaultdict(Counter), Counter()
    for text, lang in docs:
        if text is not None and lang is not None:
            counts[lang.lower()].update(grams(text))
            prior[lang.lower()] += 1
    langs = sorted(prior)
    total = {x: sum(counts[x].values()) + 0.5 * language.BUCKETS for x in langs}
    rows = []
    for url, page in pages:
        g = grams(language.visible(page or ""))
        logs = [sum(math.log((counts[x][b] + 0.5) / total[x]) for b in g) / max(1, len(g)) * min(len(g), language.EFFECTIVE) for x in langs]
        rows.append((*language.address(url or ""), language.declared(page or ""), logs, int(np.argmax(logs)) if g else None))
    whole = Counter(r[5] for r in rows if r[5] is not None)
    n = sum(whole.values())
    kinds = [len({r[k] for r in rows if r[5] is not None}) for k in (2, 3)]
    base = sum(prior[x] + 1 for x in langs)
    out = []
    for i, r in enumerate(rows):
        others = [x for j, x in enumerate(rows) if j != i and x[5] is not None]
        level = [(whole[k] + (prior[x] + 1) / base) / (n + 1) for k, x in enumerate(langs)]
        for place in (1, 0):
            own = [sum(x[5] == k for x in others if x[place] == r[place] and r[place]) for k in range(len(langs))]
            level = [(o + 5 * p) / (sum(own) + 5) for o, p in zip(own, level)]
        logs = [math.log(p) + t for p, t in zip(level, r[4])]
        for place, kind in zip((2, 3), kinds):
            if r[place]:
                for k in range(len(langs)):
                    same = sum(x[5] == k for x in others if x[place] == r[place])
                    logs[k] += math.log((same + 1) / (max(0, whole[k] - (r[5] == k)) + max(1, kind)))
        p = np.exp(np.array(logs) - max(logs))
        out.append((langs[int(np.argmax(logs))], float((p / p.sum()).max())))
    return out


def test_language_by_brute_force(spark):
    rng = np.random.default_rng(12)
    pool = {"en": ["the", "and", "with", "of"], "fr": ["que", "les", "été", "dans"], "de": ["und", "nicht", "für", "sich"]}
    say = lambda lang, n: " ".join(rng.choice(pool[lang], n))
    docs = [(say(x, 40), x.upper() if i % 5 == 0 else x) for i, x in enumerate(["en", "fr", "de"] * 12)] + [(None, "en"), ("text", None)]
    pages = []
    for i in range(40):
        lang = ["en", "fr", "de"][i % 3]
        body = f"<p>{say(lang, rng.integers(0, 8))}</p><script>var x = 'the and with'</script><!-- les été -->"
        pages.append((i, f"http://www.site{i % 4}.example.{['com', 'fr', 'co.uk'][i % 3]}/{['', lang + '/'][i % 2]}page", f"<html lang='{lang}'>{body}</html>" if i % 4 else body))
    pages += [(100, None, None), (101, "not a url", ""), (102, "http://site1.example.com", "<html lang=de>" + "und " * 50_000), (None, None, "<b>the"), (103, "http://x/", "the"), (103, "http://x/", "the")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'q' as lang", "1 as host", "2 as guess")
    table = spark.createDataFrame(docs, "text string, lang string")
    got = sorted(((str(r.page_id), r.lang, round(r.posterior, 6)) for r in language.identify(frame, table).collect()))
    want = sorted((str(i), lang, round(p, 6)) for (i, _, _), (lang, p) in zip(pages, brute_language([p[1:] for p in pages], docs)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert {r.lang for r in language.identify(frame, table.limit(0)).collect()} == {None}
    assert language.identify(frame.limit(0), table).count() == 0


def test_parts_of_pages():
    assert language.address("https://u:p@Www.Example.co.uk:80/de/x?y") == ("www.example.co.uk", "example.co.uk", "uk/de")
    assert language.address("http://a.example.com/english/") == ("a.example.com", "example.com", "com/")
    assert language.visible("<style>x</style>a<br>b &amp; c<!-- d").split() == ["a", "b", "&", "c"]
    assert language.declared("<!DOCTYPE html><HTML class=x LANG=\"pt-BR\">") == "pt"
    assert re.fullmatch("[a-z]*", language.declared("<html>")) is not None


def test_declared_anywhere_in_the_page():
    """Past a long banner, after long attributes, in a later tag, and in linear time."""
    assert language.declared("<!-- " + "x" * 300_000 + " --><html lang=fr>") == "fr"
    assert language.declared("<html data-x='" + "y" * 5_000 + "' lang='de'>") == "de"
    assert language.declared("<html class=a><p lang=it>" + " " * 30_000 + "<html lang=nl>") == "nl"
    assert language.declared("<html " * 100_000 + "lang " * 100_000 + ">" + "<html>" * 100_000) == ""
