"""Labelled documents: all of them, or bounded samples, and training in a task.

Defined cases: labels other than 0 and 1, of null ids or of ids without a document drop out; of
repeated labels of one id the larger one counts; of documents that share an id, the one whose
text has the least hash; null and longer texts are not drawn into a sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents per class that a model is trained on, and the longest text among them.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 1 << 15
#: A trained model comes to the driver in rows of so many bytes.
PIECE_BYTES = 1 << 18


def remainder(mod: int) -> Column:
    """crc32 of the document's id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def known_labels(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """doc_id and label of every allowed label."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").filter(allowed).groupBy("doc_id").agg(F.max("label").alias("label"))


def with_labels(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text, lang and label of every labelled document, whatever its length; a null text is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "lang")
    one = F.min_by(F.struct("text", "lang", "label"), F.struct(F.xxhash64("text"), "text", "lang")).alias("one")
    return texts.join(known, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*")


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int = SAMPLE_ROWS,
           chars: int = SAMPLE_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """At most ``rows`` labelled documents of each class, and the class counts over all labels.

    The ids are drawn by hash, so the choice does not depend on partitions, and are few enough
    to broadcast: the documents are scanned once and not shuffled. Repeated labels of one
    document count once (the larger one); ids without a document drop out.
    """
    known = known_labels(labels, label, allowed)
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for value in (0, 1):
        own = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        drawn = own if drawn is None else drawn.unionByName(own)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").filter(
        F.col("text").isNotNull() & (F.length("text") <= chars))
    one = F.min_by(F.struct("text", "lang", "label"), F.struct(F.xxhash64("text"), "text", "lang")).alias("one")
    return (texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*"),
            {0: counts.get(0, 0), 1: counts.get(1, 0)})


def trained(rows: DataFrame, train: Callable[[pa.Table], object]):
    """What ``train`` makes of rows whose number is bounded (a sample, the parameters of a model). It
    runs in one task: the rows never come to the driver, the model alone does, in pieces that are
    small beside the driver's memory."""
    schema = rows.limit(0).toArrow().schema

    def run(batches):
        held = [b for b in batches if b.num_rows]
        whole = pickle.dumps(train(pa.Table.from_batches(held) if held else schema.empty_table()), protocol=5)
        for place, a in enumerate(range(0, len(whole), PIECE_BYTES)):
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "piece": pa.array([whole[a: a + PIECE_BYTES]], pa.binary())})
    pieces = rows.repartition(1).mapInArrow(run, "place int, piece binary").toArrow().sort_by("place").column("piece")
    return pickle.loads(b"".join(p.as_py() for p in pieces))


def prior_shift(counts: dict[int, int], positives: int, negatives: int) -> float:
    """What to add to the log odds of a model trained on a sample with other class shares."""
    import math
    return math.log((counts[1] + 1) / (counts[0] + 1)) - math.log((positives + 1) / (negatives + 1))
