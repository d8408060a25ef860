"""MinHash near-dedup by probability Jaccard similarity.

A text is the weighted set of its runs of five words; the weight is how often a run occurs.
Each run has its own exponential arrivals, at a rate in proportion to its weight, which
visit the signature's registers in an order drawn from the run; a register keeps the run
that arrives first. A run is dropped as soon as its next arrival is later than all registers
hold (early termination). Two signatures agree in a register with the probability Jaccard
similarity of the texts.

1. Equal word sequences are one node from here on, so exact copies cost one partial row each.
2. ``BANDS`` bands of ``ROWS`` registers put nodes into buckets. Every member of a bucket is
   verified against the bucket's most central node only (the one that meets most others in
   all its buckets): a star, not all pairs.
3. Verified links are joined into components. Members of one bucket that are still apart get
   a long sketch (one bit of each of ``SKETCH_BITS`` registers). Pairs across components are
   verified (in the first bucket they share) where the sketches differ in no more bits than linked texts do, and the distances
   from the common node differ by no more than the threshold allows (one minus this
   similarity is a metric).
4. Verification is exact: shingles are made anew from both texts.

A pair at similarity 0.8 misses all buckets with probability (1 - 0.8**4)**24, 3 in a million;
if it has to be found in step 3, the sketch turns it away with 3 in 100,000 (four deviations).

Defined cases: null and wordless texts are alone; texts of fewer than five words are one run;
rows that share an id, or have none, are told apart by their text; repeated rows are copies;
the class id is the smallest doc_id of the class; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import map_slices, packed, query, staged, table
from rollframe.llm.components import components
from rollframe.llm.words import LETTER_OR_DIGIT, Words, mix, span_hashes

RUN = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Registers: a prime, so that every stride visits all of them; the last is in no band.
REGISTERS = 97
#: Bits of the long sketch, from as many registers of a larger prime number of them.
SKETCH_BITS, SKETCH_REGISTERS = 2048, 2053
DEVIATIONS = 4
SEED = 0x5851F42D4C957F2D
#: A byte of a word, as an expression.
HAS_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def shingles(words: Words, hashes: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of the distinct runs of each text, by text."""
    short = np.flatnonzero((words.count > 0) & (words.count < run))
    runs, ok = words.runs(hashes, run)
    text = np.concatenate([words.text[: len(ok)][ok], short])
    own = np.concatenate([runs[ok], span_hashes(hashes, "word", words.first[short], words.first[short + 1])])
    _, at, weight = np.unique(own ^ mix(text.astype(np.uint64)), return_index=True, return_counts=True)
    order = np.argsort(text[at], kind="stable")
    return text[at][order], own[at][order], weight[order]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(text: np.ndarray, runs: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """First-arriving run per register and text; zero where a text has no runs."""
    first = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, np.uint64)
    start = (mix(runs ^ np.uint64(SEED)) % np.uint64(registers)).astype(np.int64)
    stride = (mix(runs + np.uint64(SEED)) % np.uint64(registers - 1)).astype(np.int64) + 1
    rate, base, time = weight / registers, text * registers, np.zeros(len(runs))
    for i in range(registers):
        # One of the registers not visited so far is next, after an exponential time.
        time = time - np.log(_uniform(runs + np.uint64((i * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))) / (rate * (registers - i))
        place = base + (start + i * stride) % registers
        np.minimum.at(first, place, time)
        won = first[place] == time
        holder[place[won]] = runs[won]
        alive = time < first.reshape(texts, registers).max(axis=1)[base // registers]
        if not alive.any():
            break
        runs, rate, base, time, start, stride = runs[alive], rate[alive], base[alive], time[alive], start[alive], stride[alive]
    return holder.reshape(texts, registers)


def probability_jaccard(a: dict | tuple, b: dict | tuple) -> float:
    """Exact similarity of two weighted sets given as (sorted hashes, weights)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])], y[np.searchsorted(every, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # Against element i, elements of at least its ratio count by x, the others by y.
    upto = np.searchsorted(-ratio, -ratio, "right")
    sums_x, sums_y = np.cumsum(x), np.concatenate([[0.0], np.cumsum(y)])
    both = np.flatnonzero((x > 0) & (y > 0))
    last = upto[both]
    return float((1 / (sums_x[last - 1] / x[both] + (sums_y[-1] - sums_y[last]) / y[both])).sum())


def fingerprint() -> Column:
    return F.xxhash64("text").alias("fp")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, fp, node (16-byte key of the word sequence, null without words) and band keys of every row."""
    def work(piece):
        words = Words(piece.column("text"), LETTER_OR_DIGIT, True)
        hashes, n = words.hashes(), piece.num_rows
        sums = [span_hashes(h, "word", words.first[:-1], words.first[1:]) for h in (hashes, mix(hashes ^ np.uint64(SEED)))]
        nodes = np.stack(sums, axis=1)
        names = pa.array([v.tobytes() if c else None for v, c in zip(nodes, words.count.tolist())], pa.binary())
        held = signatures(*shingles(words, hashes), n)[:, : BANDS * ROWS].reshape(n, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
        for r in range(ROWS):
            keys = mix(keys ^ held[:, :, r]) + np.uint64(r)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.astype(np.uint64).view(np.int64).ravel()))
        return {"doc_id": piece.column("doc_id"), "fp": piece.column("fp"), "node": names, "bands": bands}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("fp", fingerprint())
    return map_slices(rows, work, "doc_id long, fp long, node binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The exact similarity of every pair (a, b); ``texts`` has id and text."""
    def sets(column):
        words = Words(column, LETTER_OR_DIGIT, True)
        text, runs, weight = shingles(words, words.hashes())
        cut = np.searchsorted(text, np.arange(len(column) + 1))
        for i in range(len(column)):
            own = np.argsort(runs[cut[i]: cut[i + 1]])
            yield runs[cut[i]: cut[i + 1]][own], weight[cut[i]: cut[i + 1]][own]

    def work(piece):
        found = [probability_jaccard(x, y) for x, y in zip(sets(piece.column("text")), sets(piece.column("other")))]
        return {"a": piece.column("a"), "b": piece.column("b"), "similarity": pa.array(found, pa.float64())}
    with_texts = (pairs.join(texts.select(F.col("id").alias("a"), "text"), "a")
                  .join(texts.select(F.col("id").alias("b"), F.col("text").alias("other")), "b"))
    return map_slices(with_texts, work, "a long, b long, similarity double")


def sketch_bits(held: np.ndarray) -> np.ndarray:
    """One bit of each register: drawn from the run and the register, so that registers which hold one run have bits of their own."""
    own = mix(np.arange(1, held.shape[1] + 1, dtype=np.uint64) * np.uint64(SEED))
    return (mix(held ^ own) & np.uint64(1)).astype(bool)


def sketch(texts: DataFrame) -> DataFrame:
    """id and the long sketch of its text as columns of 64 bits."""
    longs = SKETCH_BITS // 64

    def work(piece):
        out = []
        for at in range(0, piece.num_rows, 256):
            part = piece.slice(at, 256)
            words = Words(part.column("text"), LETTER_OR_DIGIT, True)
            held = signatures(*shingles(words, words.hashes()), part.num_rows, SKETCH_REGISTERS)[:, :SKETCH_BITS]
            out.append(np.packbits(sketch_bits(held), axis=1).view(np.int64))
        return {"id": piece.column("id")} | {f"s{i}": c for i, c in enumerate(np.concatenate(out).T.copy())}
    return map_slices(texts, work, "id long, " + ", ".join(f"s{i} long" for i in range(longs)))


def most_differing(threshold: float) -> int:
    """Sketch bits in which texts at the threshold differ at most, but for rare chance."""
    agree = (1 + threshold) / 2
    return int(SKETCH_BITS * (1 - agree) + DEVIATIONS * (SKETCH_BITS * agree * (1 - agree)) ** 0.5)


def find_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and the class of every node: node, class_node, both as byte keys."""
    signed = staged(sign(docs))
    nodes = staged(signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "fp", "bands")).alias("one"))
                   .select("node", "one.*").withColumn("id", F.monotonically_increasing_id()))
    exploded = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = staged(exploded.join(exploded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"))
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    weighted = staged(shared.join(weights, "id").select("bucket", "id", "weight"))
    centers = weighted.groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("center"))
    members = staged(weighted.drop("weight").join(centers, "bucket"))
    pairs = staged(members.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    carriers = nodes.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("at"), F.col("fp").alias("at_fp"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("fp", fingerprint())
    texts = staged(source.join(carriers, (F.col("fp") == F.col("at_fp")) & F.col("doc_id").eqNullSafe(F.col("at")))
                   .select("id", "text").dropDuplicates(["id"]))
    checked = staged(verify(pairs, texts))
    links = checked.filter(F.col("similarity") >= threshold).select("a", "b")
    roots = staged(components(links))

    # Members of a bucket that are still in different components, with their distance from its center.
    apart = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = apart.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    near = checked.select(F.col("a").alias("center"), F.col("b").alias("id"), "similarity")
    open_ = staged(apart.join(mixed, "bucket", "left_semi").join(near, ["center", "id"], "left")
                   .select("bucket", "id", "root", "center", F.coalesce("similarity", F.lit(1.0)).alias("similarity")))
    outside = open_.filter("id <> center")
    wanted = outside.select("id").distinct()
    sketches = staged(sketch(texts.join(wanted, "id", "left_semi")))
    left = outside.drop("center").join(sketches, "id").join(nodes.select("id", "bands"), "id")
    right = left.select("bucket", *[F.col(c).alias(f"{c}_2") for c in left.columns if c != "bucket"])
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"s{i}_2"))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    first_shared = F.get(F.filter(F.zip_with("bands", "bands_2", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 0)
    across = left.join(right, "bucket").filter(
        (F.col("root") < F.col("root_2")) & (F.abs(F.col("similarity") - F.col("similarity_2")) <= 1 - threshold + 1e-9)
        & (differ <= most_differing(threshold)) & (first_shared == F.col("bucket"))).select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
    across = staged(across)
    more = verify(across, texts).filter(F.col("similarity") >= threshold).select("a", "b")
    every = links.unionByName(staged(more))
    found = staged(components(every))
    keys = nodes.select("id", "node")
    return signed, (keys.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
                    .select("node", F.col("root").alias("class")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, class_id, class_size), and the one row (doc_id, fp) that stays of each class of texts with words."""
    signed, classes = find_classes(docs, threshold)
    texts_of = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("one"), F.count("*").alias("n"))
    known = staged(texts_of.filter("node is not null").join(classes, "node"))
    per_class = known.groupBy("class").agg(F.min("one").alias("one"), F.sum("n").alias("class_size"))
    of_node = known.select("node", "class").join(per_class, "class").select("node", F.col("one.doc_id").alias("class_id"), "class_size")
    worded = signed.filter("node is not null").join(of_node, "node").select("doc_id", "fp", "class_id", "class_size")
    alone = signed.filter("node is null").select("doc_id", "fp", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return worded.unionByName(alone), per_class.select("one.doc_id", "one.fp")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns; rows without words all stay."""
    _, kept = near_duplicates(docs, threshold)
    kept = staged(kept.distinct().select(F.col("doc_id").alias("stays"), F.col("fp").alias("stays_fp")))
    rows, worded = packed(docs), F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    found = rows.filter(worded).join(kept, (F.col("fp") == F.col("stays_fp")) & F.col("doc_id").eqNullSafe(F.col("stays")))
    return found.dropDuplicates(["doc_id", "fp"]).select("row.*").unionByName(rows.filter(~worded).select("row.*"))


@query("op3_near_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))[0].select("doc_id", "class_id", "class_size")
