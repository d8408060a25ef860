"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is a run of ``WINDOW`` consecutive item words (the whole item if it is
shorter). Seen as a set of positioned shingles it must be contained whole in a document, so
its necessary prefix is one shingle; the rarest one in the corpus is taken, which keeps the
candidates few. A document shingle that is a prefix proposes a start by its position in the
window; starts that do not leave room for the whole window are dropped (length and position
bounds), and the rest are verified word by word.

The benchmark is indexed in blocks of at most ``BLOCK_BYTES`` of text, each small enough to
broadcast; a larger benchmark takes one pass over the documents per block. Documents are
never shuffled.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have
no windows; items that share an id count once; an item without an id hits words and counts
under the empty string; repeated document rows are answered row by row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import map_slices, packed, query, staged, table, texts
from rollframe.llm.words import LETTER_OR_DIGIT, Words

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 16 << 20
#: A document is contaminated if hits make up at least one word in so many.
SHARE = 20


class Lookup:
    """Positions of 64-bit keys in a sorted table; a bitmap turns most misses away early."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = max(16, int(len(keys) * 64).bit_length())
        self.mask = np.uint64((1 << min(bits, 26)) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[self.keys & self.mask] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are keys, and the place of each in the table."""
        at = np.flatnonzero(self.seen[values & self.mask])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        place = np.searchsorted(self.keys, values[at])
        hit = self.keys[np.minimum(place, len(self.keys) - 1)] == values[at]
        return at[hit], place[hit]


class Windows:
    """Distinct windows of a block of items: their words, shingles and items."""

    def __init__(self, ids: list[str], item_texts: list[str], window: int):
        words = Words(pa.array(item_texts, pa.string()), LETTER_OR_DIGIT, True)
        hashes, found = words.hashes(), {}
        for i, name in enumerate(ids):
            own = hashes[words.first[i]: words.first[i + 1]]
            for s in range(max(0, len(own) - window) + 1 if len(own) else 0):
                found.setdefault(own[s: s + window].tobytes(), set()).add(name)
        self.words = [np.frombuffer(k, np.uint64) for k in found]
        self.items = [sorted(v) for v in found.values()]

    def shingles(self, i: int, width: int) -> np.ndarray:
        return run_hashes(self.words[i], min(width, len(self.words[i])))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-aware hashes of ``width`` neighbours, tagged by width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i: n + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def _counts(df: DataFrame, lookups: dict[int, Lookup]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(lookups)

    def work(piece):
        words = Words(piece.column("text"), LETTER_OR_DIGIT, True)
        hashes = words.hashes()
        got = [_inside(words, hashes, w, t)[1] for w, t in shared.value.items()]
        keys, n = np.unique(np.concatenate(got), return_counts=True)
        return {"shingle": keys.view(np.int64), "n": n} if len(keys) else None
    return map_slices(df, work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _inside(words: Words, hashes: np.ndarray, width: int, lookup: Lookup):
    """Word places of known shingles, their keys, and their places in the lookup."""
    runs = run_hashes(hashes, width)
    at, place = lookup.find(runs)
    ok = words.text[at] == words.text[at + width - 1] if len(at) else np.zeros(0, bool)
    return at[ok], runs[at[ok]], place[ok]


def prefix_index(df: DataFrame, windows: Windows, shingle: int):
    """The rarest shingle of every window over the whole corpus, with the window's words."""
    by_width: dict[int, set] = {}
    for i in range(len(windows.words)):
        by_width.setdefault(min(shingle, len(windows.words[i])), set()).update(windows.shingles(i, shingle).tolist())
    lookups = {w: Lookup(np.array(list(k), np.uint64)) for w, k in by_width.items()}
    seen = {np.int64(r.shingle).astype(np.uint64).item(): r.n for r in _counts(df, lookups).collect()} if lookups else {}
    postings: dict[int, list] = {}
    for i, own in enumerate(windows.words):
        each = windows.shingles(i, shingle).tolist()
        rare = min(range(len(each)), key=lambda p: (seen.get(each[p], 0), p))
        if all(k in seen for k in each):  # a shingle that never occurs rules the window out
            postings.setdefault(min(shingle, len(own)), []).append((each[rare], rare, i))
    out = {}
    for width, rows in postings.items():
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        lookup = Lookup(np.unique(keys))
        out[width] = (lookup, np.searchsorted(keys, np.append(lookup.keys, np.uint64(2**64 - 1)), "left"),
                      np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        out[width][1][-1] = len(rows)
    longest = max((len(w) for w in windows.words), default=1)
    padded = np.zeros((len(windows.words), longest), np.uint64)
    for i, own in enumerate(windows.words):
        padded[i, : len(own)] = own
    return out, padded, np.array([len(w) for w in windows.words], np.int64)


def matches(words: Words, hashes: np.ndarray, index) -> tuple[np.ndarray, np.ndarray]:
    """Verified (word place, window) occurrences in the texts of a slice."""
    postings, padded, length = index
    starts, which = [], []
    for width, (lookup, first, offset, window) in postings.items():
        at, _, place = _inside(words, hashes, width, lookup)
        n = first[place + 1] - first[place]
        row = np.repeat(np.arange(len(at)), n)
        post = first[place][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, win = at[row] - offset[post], window[post]
        text = words.text[at[row]]
        ok = (start >= words.first[text]) & (start + length[win] <= words.first[text + 1])
        start, win = start[ok], win[ok]
        for i in range(padded.shape[1]):
            ok = (i >= length[win]) | (hashes[np.minimum(start + i, len(hashes) - 1)] == padded[win, i])
            start, win = start[ok], win[ok]
        starts.append(start)
        which.append(win)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(which)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                   block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id") -> DataFrame:
    """Per document row: doc_id, fp (hash of the text), n_words, the hit words as a packed bitmap, and the ids of the items found."""
    docs = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("fp"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"), key=id_column)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, ceil(1.2 * size / block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect() if size else []
        windows = Windows([r.item for r in rows], [r.text for r in rows], window)
        docs = _scan(docs, prefix_index(docs, windows, shingle), windows.items, keep_text=b < blocks - 1)
    return docs


def _scan(docs: DataFrame, index, items: list[list[str]], keep_text: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((index, items))

    def work(piece):
        found, names = shared.value
        words = Words(piece.column("text"), LETTER_OR_DIGIT, True)
        start, win = matches(words, words.hashes(), found)
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + found[2][win], -1)
        hit = np.cumsum(change)[:-1] > 0
        before, got = piece.column("hits").to_pylist(), [set(x) for x in piece.column("items").to_pylist()]
        for t, w in set(zip(words.text[start].tolist(), win.tolist())):
            got[t].update(names[w])
        marks = []
        for i, old in enumerate(before):
            own = hit[words.first[i]: words.first[i + 1]]
            if old is not None:
                own = own | (np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)) > 0)
            marks.append(np.packbits(own).tobytes())
        out = {"doc_id": piece.column("doc_id"), "fp": piece.column("fp"), "n_words": words.count.astype(np.int64), "hits": pa.array(marks, pa.binary()),
               "items": pa.array([sorted(x) for x in got], pa.list_(pa.string()))}
        return out | ({"text": piece.column("text")} if keep_text else {})
    return map_slices(docs, work, "doc_id long, fp long, n_words long, hits binary, items array<string>" + (", text string" if keep_text else ""))


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """Per document row: words, hit words, items and whether the hits reach one word in ``share``."""
    found = find_benchmark(docs, benchmark)

    def count(batches):
        for batch in batches:
            hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in batch.column("hits").to_pylist()]
            ids = batch.column("items").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "fp": batch.column("fp"), "n_words": batch.column("n_words"), "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array([len(x) for x in ids], pa.int64()),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids],
                "items": batch.column("items")})
    out = found.mapInArrow(count, "doc_id long, fp long, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, share).filter("contaminated").select(F.col("doc_id").alias("its_id"), F.col("fp").alias("its_fp")).distinct()
    match = (F.col("fp") == F.col("its_fp")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
    return packed(docs).join(staged(found), match, "left_anti").select("row.*")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, len(words) AS n_item, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s, words FROM b WHERE len(words) > 0),
bk AS (SELECT DISTINCT item, least(13, n_item) AS width, array_to_string(words[s:s + 12], ' ') AS k FROM bw),
widths AS (SELECT DISTINCT width FROM bk),
dw AS (
  SELECT doc_id, width, unnest(range(1, len(words) - width + 2)) AS s, words FROM w, widths WHERE len(words) >= width),
hits AS (
  SELECT doc_id, s, dw.width, item FROM (SELECT doc_id, s, width, array_to_string(words[s:s + width - 1], ' ') AS k FROM dw) dw
  JOIN bk ON dw.k = bk.k AND dw.width = bk.width),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM (SELECT DISTINCT doc_id, s, width FROM hits)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op9_decontamination", SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items", "fp")
