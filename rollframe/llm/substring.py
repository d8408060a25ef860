"""Substring dedup: winnowed anchors are joined, extended both ways, and merged to maximal repeats.

A repeat is a run of ``LENGTH`` or more words that also occurs earlier (in a smaller doc_id,
or in the same document at an earlier start).

1. Seeds. Of every ``LENGTH``-word window the run of ``SEED`` words with the least hash is the
   anchor, so equal windows have equal anchors at equal places. An anchor occurrence owns the
   consecutive windows it is the anchor of. Its row has the anchor's hash, the place, and a
   hash of its whole extent: the anchor extended both ways to all windows it owns (64 bits, and
   32 of a second hash).
2. Join. Rows are dealt by anchor and sorted. Occurrences of an anchor with one extent repeat
   all their windows, except the earliest. An anchor that occurs once has no repeats.
3. Extend. Where an anchor has several extents, a repeat may end inside one. The earliest
   occurrence of each extent goes back to its text and is compared window by window: the
   windows it owns are counted by content, all but the earliest repeat.
4. Maximal repeats are the unions of overlapping repeated windows, per document.

Hot anchors: keys that a sample of documents shows to be frequent are told apart beforehand
(a bounded list). Their extents are reduced by a partial minimum per task instead of being
dealt to one task. The sample only decides the route of a key, never a result.

Defined cases: null and empty texts have no words and the digest of the empty text; texts
under ``LENGTH`` words lose nothing; a null doc_id is one id, before all others; rows that
share a doc_id are told apart by their text and have their own marks, and what stands at one
place in several of them is no repeat of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import key_of, map_slices, query, staged, table
from rollframe.llm.words import NOT_BLANK, Words, mix, sliding, span_hashes

LENGTH = 20
SEED = 6
#: Documents looked at for frequent anchors, and the share of anchors that makes one frequent.
SAMPLE_DOCS = 20_000
FREQUENT = 1 / 5000


def anchors(words: Words, hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, first owned window and number of owned windows, by first window."""
    n, width = len(hashes) - length + 1, length - seed + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    seeds, _ = words.runs(hashes, seed)
    least = sliding(seeds, width, np.minimum)
    owner = np.zeros(n, np.int64)
    for off in range(width - 1, -1, -1):
        owner[seeds[off: off + n] == least] = off
    start = np.flatnonzero(words.text[:n] == words.text[length - 1:])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    owner = owner[start] + start
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
    return owner[new], start[new], np.diff(np.concatenate([new, [len(start)]]))


def _rows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """One row per anchor occurrence; ``at`` packs the first window and the number of windows."""
    def work(piece):
        words = Words(piece.column("text"), NOT_BLANK, False)
        hashes = words.hashes()
        place, start, n = anchors(words, hashes, length, seed)
        if not len(place):
            return None
        seeds, _ = words.runs(hashes, seed)
        extent = span_hashes(hashes, "word", start, start + n - 1 + length)
        docs, rows, text = piece.column("doc").to_numpy(), piece.column("row").to_numpy(), words.text[start]
        second = span_hashes(mix(hashes), "word", start, start + n - 1 + length)
        return {"anchor": seeds[place].view(np.int64), "extent": extent.view(np.int64), "check": (second >> np.uint64(32)).astype(np.uint32).view(np.int32),
                "doc": docs[text], "row": rows[text], "at": (words.place[start] << 8) | n}
    return map_slices(docs, work, "anchor long, extent long, check int, doc long, row long, at long")


def _frequent(docs: DataFrame, length: int, seed: int) -> list[int]:
    """Anchors that a bounded sample of documents shows to be frequent; at most 1 / FREQUENT."""
    n = docs.count()
    some = docs if n <= SAMPLE_DOCS else docs.sample(SAMPLE_DOCS / n, seed=3)
    counts = _rows(some, length, seed).groupBy("anchor").agg(F.count("*").alias("n"))
    counts = staged(counts.filter("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.anchor for r in counts.filter(F.col("n") > max(20, FREQUENT * total)).orderBy(F.desc("n"), "anchor").limit(int(1 / FREQUENT)).collect()]


def _scan(batches):
    """Sorted anchor rows: repeats of an extent, and first extents where an anchor has several."""
    held: list[pa.RecordBatch] = []

    def resolve(t: pa.RecordBatch | pa.Table):
        anchor, extent, check = (t.column(c).to_numpy() for c in ("anchor", "extent", "check"))
        doc, row, at = t.column("doc").to_numpy(), t.column("row").to_numpy(), t.column("at").to_numpy()
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_extent = new_anchor | np.concatenate([[True], (extent[1:] != extent[:-1]) | (check[1:] != check[:-1])])
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group, weights=new_extent)[group] > 1
        leader = np.flatnonzero(new_extent)[np.cumsum(new_extent) - 1]
        first = (doc == doc[leader]) & (at == at[leader])
        keep = ~first | several
        return pa.RecordBatch.from_pydict({"doc": doc[keep], "row": row[keep], "at": at[keep], "first": first[keep]})

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        whole = pa.Table.from_batches(held)
        anchor = whole.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1], "left"))
        if cut:  # the last anchor may go on in the next batch
            yield resolve(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
    if held:
        yield resolve(pa.Table.from_batches(held))


def _windows(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Content hash and place of every window owned by the open anchor occurrences."""
    def work(piece):
        words = Words(piece.column("text"), NOT_BLANK, False)
        hashes = words.hashes()
        runs, _ = words.runs(hashes, length)
        second, _ = words.runs(mix(hashes), length)
        lists = piece.column("ats")
        at = lists.flatten().to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
        n = at & 255
        own = np.repeat(np.arange(len(at)), n)
        place = (at >> 8)[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        docs, rows, where = piece.column("doc").to_numpy(), piece.column("row").to_numpy(), words.first[text[own]] + place
        return {"window": runs[where].view(np.int64), "check": (second[where] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                "doc": docs[text[own]], "row": rows[text[own]], "at": (place << 8) | 1}
    per_row = open_.groupBy("doc", "row").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    return map_slices(docs.join(per_row, ["doc", "row"]).select("doc", "row", "text", "ats"), work, "window long, check int, doc long, row long, at long")


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, row, at) of all windows that occur earlier, as runs packed like in :func:`_rows`."""
    if not 0 < seed <= length < seed + 255:
        raise ValueError(f"no anchors of {seed} words for windows of {length}")
    rows = _rows(docs, length, seed)
    hot = _frequent(docs, length, seed)
    is_hot = F.col("anchor").isin(hot) if hot else F.lit(False)
    dealt = rows.filter(~is_hot).repartition("anchor").sortWithinPartitions("anchor", "extent", "check", "doc", "at")
    found = dealt.mapInArrow(_scan, "doc long, row long, at long, first boolean")
    if hot:
        busy = rows.filter(is_hot)
        # Written first, so that the join's two sides are dealt by its keys alone and a hot key can be split.
        first = staged(busy.groupBy("anchor", "extent", "check").agg(F.min(F.struct("doc", "at")).alias("one")))
        found = found.unionByName(busy.join(first, ["anchor", "extent", "check"]).select(
            "doc", "row", "at", (F.struct("doc", "at") == F.col("one")).alias("first")))
    found = staged(found)
    windows = staged(_windows(docs, found.filter("first"), length))
    earliest = windows.groupBy("window", "check").agg(F.min(F.struct("doc", "at")).alias("one"), F.count("*").alias("n")).filter("n > 1")
    again = windows.join(earliest, ["window", "check"]).filter(F.struct("doc", "at") != F.col("one"))
    return found.filter("not first").select("doc", "row", "at").unionByName(again.select("doc", "row", "at"))


def merged(ats: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal word ranges covered by runs of windows."""
    out: list[list[int]] = []
    for at in sorted(ats):
        start, end = at >> 8, (at >> 8) + (at & 255) - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, the kept text and the repeats as word ranges."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))
    # Rows of one id and one text have the same marks, so the text's hash is a row key that needs no staging.
    base = base.withColumn("row", F.xxhash64("text"))
    marks = repeated_windows(base, length, seed).groupBy("doc", "row").agg(F.collect_set("at").alias("ats"))

    def work(piece):
        words = Words(piece.column("text"), NOT_BLANK, False)
        raw, kept, removed, repeats = words.data.tobytes(), [], [], []
        for i, ats in enumerate(piece.column("ats").to_pylist()):
            ranges = [(a, b) for a, b in merged(ats or [], length) if b <= words.count[i]]
            keep = np.ones(words.count[i], bool)
            for a, b in ranges:
                keep[a:b] = False
            own = np.flatnonzero(keep) + words.first[i]
            kept.append(b" ".join([raw[a:b] for a, b in zip(words.starts[own].tolist(), words.ends[own].tolist())]))
            removed.append(int(len(keep) - len(own)))
            repeats.append([{"start": a, "end": b} for a, b in ranges])
        return {"doc_id": piece.column("doc_id"), "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept": pa.array([k.decode() for k in kept], pa.string()),
                "repeats": pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
    return map_slices(base.join(marks, ["doc", "row"], "left").select("doc_id", "text", "ats"), work,
                      "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start: long, end: long>>")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS txt
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) ALL_WORDS
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = ALL_WORDS.doc_id AND gone.p = ALL_WORDS.p) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op1_substring_dedup", SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_substrings(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
