"""Licence notices of which indexed words are missing."""

from rollframe.llm import licenses


def test_notice_without_two_of_its_rarest_words(spark):
    """The mandatory phrase and three of the five rarest words are in place; two are reworded."""
    template, label, _ = licenses.TEMPLATES[7]
    # Every word of the templates occurs. These five of the template are equally rare with the notice, so they rank by the alphabet.
    kept, reworded = ["binary", "provided", "redistribution"], ["modification", "permitted"]
    rows = [" ".join(sorted({w for t, _, _ in licenses.TEMPLATES for w in t.split()} - {*kept, *reworded}))] * 30 + kept * 3 + reworded * 4
    notice = " ".join("x" if w in reworded else w for w in template.split())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, "intro words " + notice])], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: ("", 0.0) for i in range(len(rows))} | {len(rows): (label, 0.6)}


def test_head_of_a_notice_whose_other_words_occur_nowhere(spark):
    """Only words that occur are indexed, so a phrase that is there whole is found."""
    docs = spark.createDataFrame([(1, "Redistribution and use in source and binary forms, maybe"), (2, "nothing here")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()} == {1: "bsd", 2: ""}


def test_every_phrase_has_an_indexed_word():
    words = {w for text, _, _ in licenses.TEMPLATES for w in text.split()}
    rows = licenses.index(1000, {w: 1 + len(w) for w in words})
    for t, (_, _, phrases) in enumerate(licenses.TEMPLATES):
        own = {w for n, w, _, _ in rows if n == t}
        assert all(own & set(p.split()) for p in phrases)
    assert licenses.index(10, {}) == []
