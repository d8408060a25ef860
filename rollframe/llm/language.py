"""Language of web pages by Bayesian fusion of text, markup, address and host.

Text: byte n-gram likelihoods per language, counted over all labelled documents. Markup: the
language a page declares. Address: its last host label and the first path segment, where
that looks like a language. How often each language comes with each declaration and suffix
is counted over all pages, with the text's own decision as the language, and smoothed. Host:
the languages of the other pages of a host are the prior, smoothed by those of its domain,
and these by the whole corpus; counts are grouped aggregates, so a hot host costs one partial
row per task.

A page's posterior is the normalized product; the text's share is tempered, since n-grams
are not independent. Pages are mapped once and not shuffled with their text; what is shuffled
is one small row per page.

Defined cases: a null page or address has no evidence of that kind; with no evidence at all
the posterior is the corpus prior; repeated rows are answered per row; documents without text
or language do not train; without any labelled document there is no language to choose and
``lang`` is null.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import map_slices, query, staged, table
from rollframe.llm.words import FOLD, LETTER_OR_DIGIT, Words

NGRAM = 3
BUCKETS = 1 << 14
#: The model is one row of buckets per language, so their number is bounded.
MAX_LANGUAGES = 1000
#: Text counts as so many independent n-grams at most.
EFFECTIVE = 12.0
#: Pseudo-counts: of a declaration or suffix per language, and of the level above a host.
SMOOTH, UP = 1.0, 5.0

_DROP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")
_HTML = re.compile(r"(?i)<html\b[^>]*+")
_LANG = re.compile(r"(?i)\blang\s*+=\s*+[\"']?([a-z]{2,3})")
_ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*(?:/([a-z]{2})(?=[/?#]|$))?")


def visible(page: str) -> str:
    """The text a reader sees, roughly."""
    return unescape(_DROP.sub(" ", page))


def declared(page: str) -> str:
    """The language of the page's first <html> tag that has one, wherever in the page it is."""
    for tag in _HTML.finditer(page):
        found = _LANG.search(page, tag.start(), tag.end())
        if found:
            return found[1].lower()
    return ""


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (last label, and a language-like path)."""
    found = _ADDRESS.match(url)
    if not found:
        return "", "", ""
    host = found[1].lower()
    labels = host.split(".")
    return host, ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-2:]), f"{labels[-1]}/{(found[2] or '').lower()}"


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram from each byte on; letters, digits and one blank between words."""
    n = len(data) - NGRAM + 1
    code = np.zeros(max(n, 0), np.uint32)
    for i in range(NGRAM):
        code = (code << np.uint32(8)) | data[i: n + i]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all bytes on, and the range of each text's own; other signs count as blanks."""
    data = np.where(LETTER_OR_DIGIT[FOLD[words.data]], FOLD[words.data], np.uint8(0x20))
    start = words.offsets[:-1]
    end = np.maximum(words.offsets[1:] - NGRAM + 1, start)
    return buckets(data), np.where(end > start, start, 0), np.where(end > start, end, 0)


def train(docs: DataFrame, smooth: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log likelihoods (language x bucket), and documents per language."""
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.lower(F.col("lang")).alias("lang")).filter("text is not null and lang is not null")
    per_lang = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(per_lang) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(per_lang)
    if not langs:
        return [], np.zeros((0, BUCKETS)), np.zeros(0)
    place = {x: i for i, x in enumerate(langs)}

    def count(piece):
        words = Words(piece.column("text"), LETTER_OR_DIGIT, True)
        grams, start, end = _grams(words)
        lang, n = np.array([place[x] for x in piece.column("lang").to_pylist()], np.int64), end - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        every = np.bincount(np.repeat(lang, n) * BUCKETS + grams[at], minlength=1)
        some = np.flatnonzero(every)
        return {"cell": some.astype(np.int64), "n": every[some].astype(np.int64)}
    cells = map_slices(labelled, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.full(len(langs) * BUCKETS, smooth)
    for r in cells.toLocalIterator():  # at most languages x buckets numbers
        counts[r.cell] += r.n
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)), np.array([per_lang[x] for x in langs], float)


def evidence(pages: DataFrame, langs: list[str], table_: np.ndarray, effective: float = EFFECTIVE) -> DataFrame:
    """Per page row: id, host, domain, suffix, declaration, tempered text likelihoods and their best language."""
    shared = pages.sparkSession.sparkContext.broadcast(table_)

    def work(piece):
        raw = [x or "" for x in piece.column("text").to_pylist()]
        where = [address(u or "") for u in piece.column("url").to_pylist()]
        words = Words(pa.array([visible(x) for x in raw], pa.large_string()), LETTER_OR_DIGIT, True)
        grams, start, end = _grams(words)
        n, total = (end - start)[:, None], np.zeros((piece.num_rows, len(shared.value)))
        for j, own in enumerate(shared.value):
            sums = np.concatenate([[0.0], np.cumsum(own[grams])])
            total[:, j] = sums[end] - sums[start]
        total = total / np.maximum(n, 1) * np.minimum(n, effective)
        best = [int(r.argmax()) if k else None for r, k in zip(total, n[:, 0])]
        return {"page_id": piece.column("page_id"), "host": [w[0] for w in where], "domain": [w[1] for w in where], "suffix": [w[2] for w in where],
                "declared": [declared(x) for x in raw], "text": pa.array(total.tolist(), pa.list_(pa.float64())), "guess": pa.array(best, pa.int32())}
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    return map_slices(rows, work, "page_id long, host string, domain string, suffix string, declared string, text array<double>, guess int")


def _table_of(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Counts of guesses per value of ``key`` as an array over the languages."""
    counts = rows.filter("guess is not null").groupBy(key, "guess").agg(F.count("*").alias("n"))
    per_key = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"))
    return per_key.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias(f"{key}_n"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, posterior, and the text's own decision, of every page row."""
    langs, table_, prior = train(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"))
    size = len(langs)
    rows = staged(evidence(pages, langs, table_))
    joined = rows
    for key in ("host", "domain", "suffix", "declared"):
        joined = joined.join(_table_of(rows, key, size), key, "left")
    per_lang = {r.guess: r.n for r in rows.filter("guess is not null").groupBy("guess").agg(F.count("*").alias("n")).collect()}
    whole = np.array([per_lang.get(i, 0) for i in range(size)], float)
    kinds = {key: rows.filter("guess is not null").select(key).distinct().count() for key in ("suffix", "declared")}

    def fuse(batches):
        for batch in batches:
            def counts(name):
                return np.array([x or [0.0] * size for x in batch.column(name).to_pylist()]).reshape(-1, size)
            guess = batch.column("guess").to_pylist()
            own = np.zeros((batch.num_rows, size))  # a page says nothing about itself
            for i, g in enumerate(guess):
                if g is not None:
                    own[i, g] = 1
            level = (whole + SMOOTH * (prior + 1) / (prior + 1).sum()) / (whole.sum() + SMOOTH)
            level = np.tile(level, (batch.num_rows, 1))
            for key in ("domain", "host"):
                known = np.array([bool(x) for x in batch.column(key).to_pylist()])[:, None]
                rest = np.maximum(counts(f"{key}_n") - own, 0) * known
                level = (rest + UP * level) / (rest.sum(axis=1, keepdims=True) + UP)
            logs = np.log(level) + np.array(batch.column("text").to_pylist()).reshape(-1, size)
            for key in ("suffix", "declared"):
                known = np.array([bool(x) for x in batch.column(key).to_pylist()])[:, None]
                rest = np.maximum(counts(f"{key}_n") - own, 0)
                logs += np.log((rest + SMOOTH) / (np.maximum(whole - own, 0) + SMOOTH * max(1, kinds[key]))) * known
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "lang": [langs[b] for b in best], "posterior": p[np.arange(len(best)), best],
                "text_lang": pa.array([None if g is None else langs[g] for g in guess], pa.string())})
    return joined.select("page_id", "guess", "text", "host", "domain", "suffix", "declared", "host_n", "domain_n", "suffix_n", "declared_n").mapInArrow(
        fuse, "page_id long, lang string, posterior double, text_lang string")


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "pages"), table(spark, sf, "documents"))
