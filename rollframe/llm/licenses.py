"""Licence scan with a positional index of rare words, in DataFrame functions only.

Short licence notices are the templates. Each is indexed by its ``INDEXED`` rarest words that occur
at all, by document frequency over the whole corpus, and by the rarest such word of each of its
mandatory phrases, with their positions. A file's occurrences of these
words are looked up in the index; occurrences that agree on where a template would start are
added up by inverse document frequency. Starts with enough of a template's indexed weight are
candidates; the words of the file must then hold one of the template's mandatory phrases at
the very place it has in the template.

The corpus is scanned twice: for the frequencies of the templates' words, and for the places of
indexed words and of whole mandatory phrases. Every phrase found tells where its template would
start, and only files with such a start keep their places; no file's words are written. The
index is a constant of the library and joins as one small table.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are
scanned per row; an empty table gives no rows; other columns are ignored. Words of equal
frequency are taken in the order of the alphabet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import query, staged, table

#: Phrases of the base labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Wording of public licence notices, label, and phrases of which one must be there.
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("released under the mit license", "mit", ["mit license"]),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit",
     ["permission is hereby granted free of charge"]),
    ("licensed under the apache license version 2 0", "apache", ["apache license version 2 0"]),
    ("you may not use this file except in compliance with the license", "apache", ["except in compliance with the license"]),
    ("this work is licensed under the gnu general public license version 3", "gpl", ["gnu general public license"]),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl",
     ["gnu general public license", "free software foundation"]),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl",
     ["gnu lesser general public license"]),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd",
     ["redistribution and use in source and binary forms"]),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", ["mozilla public license"]),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc",
     ["for any purpose with or without fee is hereby granted"]),
    ("this is free and unencumbered software released into the public domain", "unlicense", ["unencumbered software released into the public domain"]),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", ["creative commons attribution 4 0"]),
    ("all rights reserved", "reserved", ["all rights reserved"]),
]
INDEXED = 5
#: Share of a template's indexed weight that makes a start a candidate.
SHARE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each word of a fixed vocabulary occurs."""
    own = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    counts = _plain(docs).select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return docs.count(), {r.word: r.n for r in counts.collect()}


def index(n: int, frequency: dict[str, int], indexed: int = INDEXED) -> list[tuple[int, str, int, float]]:
    """(template, word, position, share of the template's indexed weight) of the rarest words."""
    import math
    rows = []
    for t, (text, _, phrases) in enumerate(TEMPLATES):
        words = text.split()
        rarest = lambda own, most: sorted({w for w in own if frequency.get(w)}, key=lambda w: (frequency[w], w))[:most]
        rare = {*rarest(words, indexed), *(w for p in phrases for w in rarest(p.split(), 1))}
        weight = {w: math.log((n + 1) / (frequency[w] + 1)) + 1e-3 for w in rare}
        places = [(w, p) for p, w in enumerate(words) if w in weight]
        total = sum(weight[w] for w, _ in places)
        rows += [(t, w, p, weight[w] / total) for w, p in places]
    return rows


def _phrase_keys(frequency: dict[str, int]) -> list[tuple[int, int, list[str], int]]:
    """(template, words before the phrase, the phrase, place of its rarest word in it) of every mandatory phrase."""
    out = []
    for t, (text, _, phrases) in enumerate(TEMPLATES):
        for phrase in phrases:
            own = phrase.split()
            key = min(range(len(own)), key=lambda i: (frequency.get(own[i], 0), own[i]))
            out.append((t, len(re.split(rf"\b{re.escape(phrase)}\b", text)[0].split()), own, key))
    return out


def _starts_of_phrases(keys: list[tuple[int, int, list[str], int]]) -> Column:
    """Where templates would start by their mandatory phrases, from ``places`` of the phrases' rarest words."""
    def found(template: int, before: int, own: list[str], key: int) -> Column:
        def match(x: Column) -> Column:
            out = x["word"] == own[key]
            for i, w in enumerate(own):
                if i != key:
                    out = out & F.coalesce(F.get("words", x["at"] + (i - key)) == w, F.lit(False))
            return out
        return F.transform(F.filter("places", match), lambda x: F.struct(F.lit(template).alias("template"), (x["at"] - (key + before)).alias("start")))
    return F.array_distinct(F.concat(*[found(*k) for k in keys]))


def scan_licenses(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, words, base phrases, labels of both kinds and the best verified share."""
    vocabulary = sorted({w for text, _, _ in TEMPLATES for w in text.split()})
    n, frequency = frequencies(docs, vocabulary)
    rows, keys = index(n, frequency), _phrase_keys(frequency)
    session = docs.sparkSession
    indexed = sorted({r[1] for r in rows})
    wanted = sorted({*indexed, "license", *(own[key] for _, _, own, key in keys)})
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(wanted))
    base = F.filter(F.transform(
        F.filter("places", lambda x: x["word"] == "license"),
        lambda x: F.struct(
            F.when((F.get("words", x["at"] - 1) == "public") & (F.get("words", x["at"] - 2) == "general"), x["at"] - 2).otherwise(x["at"] - 1).alias("at"),
            F.when(F.get("words", x["at"] - 1) == "mit", "mit").when(F.get("words", x["at"] - 1) == "apache", "apache")
            .when((F.get("words", x["at"] - 1) == "public") & (F.get("words", x["at"] - 2) == "general"), "gpl").alias("label"))),
        lambda b: b["label"].isNotNull())
    found = _plain(docs).withColumn("places", places).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), "places", _starts_of_phrases(keys).alias("held"))
    found = found.withColumn("places", F.when(F.size("held") > 0, F.filter("places", lambda x: x["word"].isin(indexed))))
    found = staged(found.withColumn("row", F.monotonically_increasing_id()))

    postings = F.broadcast(session.createDataFrame(rows, "template int, word string, position int, weight double"))
    holding = found.filter(F.size("held") > 0)
    starts = (holding.select("row", F.explode("places").alias("p")).select("row", "p.word", "p.at").join(postings, "word")
              .groupBy("row", "template", (F.col("at") - F.col("position")).alias("start"))
              .agg(F.round(F.sum("weight"), 9).alias("matched")).filter(F.col("matched") >= share))
    verified = starts.join(holding.select("row", F.explode("held").alias("h")).select("row", "h.template", "h.start"), ["row", "template", "start"])
    names = F.array(*[F.lit(label) for _, label, _ in TEMPLATES])
    labelled = verified.groupBy("row").agg(
        F.collect_set(F.element_at(names, F.col("template") + 1)).alias("own"), F.max("matched").alias("best"))
    labels = F.transform("base", lambda b: b["label"])
    everything = F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))
    starts_at = F.transform("base", lambda b: b["at"])
    return found.drop("places", "held").join(labelled, "row", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts_at).cast("long").alias("first_word"),
        F.array_max(starts_at).cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(everything), ",").alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))), 6).alias("score"))


def _sql() -> str:
    """The same scan as SQL, from the same templates."""
    quote = lambda s: "'" + s + "'"
    words = ", ".join(f"({t}, {quote(w)}, {p})" for t, (text, _, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split()))
    phrases = ", ".join(f"({t}, {quote(label)}, {len(re.split(rf'\b{re.escape(p)}\b', text)[0].split())}, {quote(p)}, {len(p.split())})"
                        for t, (text, label, ps) in enumerate(TEMPLATES) for p in ps)
    parts = ", ".join(f"({t}, {quote(p)}, {quote(w)})" for t, (_, _, ps) in enumerate(TEMPLATES) for p in ps for w in sorted(set(p.split())))
    base = ", ".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in BASE)
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
tw(template, word, position) AS (VALUES {words}),
ph(template, label, before, phrase, n) AS (VALUES {phrases}),
pw(template, phrase, word) AS (VALUES {parts}),
bp(phrase, label, n) AS (VALUES {base}),
total AS (SELECT count(*) AS n FROM documents),
pos AS (SELECT doc_id, word, spot FROM (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS spot FROM w)
        WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM pos GROUP BY 1),
rare AS (
  SELECT template, word, ln((total.n + 1) / (df + 1)) + 1e-3 AS weight, row_number() OVER (PARTITION BY template ORDER BY df, word) AS r
  FROM (SELECT DISTINCT template, word FROM tw) JOIN df USING (word), total),
must AS (
  SELECT DISTINCT template, word FROM (SELECT template, word, row_number() OVER (PARTITION BY template, phrase ORDER BY df, word) AS r FROM pw JOIN df USING (word)) WHERE r = 1),
post AS (
  SELECT template, word, position, weight / sum(weight) OVER (PARTITION BY template) AS weight
  FROM tw JOIN rare USING (template, word) LEFT JOIN (SELECT template, word, true AS needed FROM must) USING (template, word) WHERE r <= {INDEXED} OR needed),
cand AS (
  SELECT doc_id, template, spot - position AS start, round(sum(weight), 9) AS matched FROM pos JOIN post USING (word)
  GROUP BY 1, 2, 3 HAVING round(sum(weight), 9) >= {SHARE}),
own AS (
  SELECT doc_id, label, max(matched) AS matched FROM cand JOIN ph USING (template) JOIN w USING (doc_id)
  WHERE start + before >= 0 AND array_to_string(words[start + before + 1:start + before + n], ' ') = phrase GROUP BY 1, 2),
base AS (
  SELECT doc_id, label, spot FROM (SELECT DISTINCT doc_id, spot AS last FROM pos WHERE word = 'license') JOIN w USING (doc_id), bp,
  LATERAL (SELECT last - n + 1 AS spot) WHERE spot >= 0 AND array_to_string(words[spot + 1:spot + n], ' ') = phrase),
bs AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM own) GROUP BY 1),
sc AS (SELECT doc_id, max(matched) AS best FROM own GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CAST(least(1.0, greatest(coalesce(best, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)) AS DOUBLE), 6) AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)"""


SQL = _sql()


@query("op5_license_scan", SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))
