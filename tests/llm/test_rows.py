"""One table of awkward rows through every operator that hands whole rows on, and through the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollframe.llm import decontaminate, near, packing, secrets, toxicity
from rollframe.llm.common import staged
from rollframe.llm.labelled import remainder

SF = "/root/testdata/sf0.001"
SECRET = "password = Abcdefgh1234567"
ROWS = [(1, None), (1, None), (2, ""), (2, ""), (None, None), (None, ""), (None, "?!"), (None, "alone in the world"), (3, "same words"), (3, "same words"),
        (4, "same words"), (None, SECRET), (5, SECRET + " tail"), (6, "x " * 200_000), (7, "\n\n"), (7, "\n\n"), (8, "\u00e9t\u00e9 \u96ea")]
NAMES = ["_fp", "_own", "_id", "_kept", "_kept_fp", "_parts", "_toxicity", "fp", "row", "stays", "parts", "its_id", "score", "a.b", "node", "length", "sequence_id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return staged(rows.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).repartition(4))


def kept(df, docs):
    """Key and text of the rows; every other column still has what it had."""
    assert df.dtypes == docs.dtypes
    rows = df.collect()
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)
    return sorted(str((r.doc_id, r.text)) for r in rows)


def all_of(rows):
    return sorted(str(r) for r in rows)


def test_near_duplicates(docs):
    """Wordless rows all stay, also repeated ones; of each class one row stays."""
    gone = [(3, "same words"), (4, "same words")]
    want = list(ROWS)
    for r in gone:
        want.remove(r)
    assert kept(near.deduplicate(docs), docs) == all_of(want)


def test_redaction(docs):
    assert kept(secrets.redact(docs), docs) == all_of((d, t and t.replace(SECRET, secrets.REPLACEMENT)) for d, t in ROWS)
    n = {r.text: r.n_chars for r in secrets.redact(docs).filter("text like '%tail'").collect()}
    assert n == {secrets.REPLACEMENT + " tail": len(secrets.REPLACEMENT) + 5}


def test_decontamination(spark, docs):
    benchmark = spark.createDataFrame([("i", "same words"), ("j", None), ("k", "")], "item_id string, text string")
    assert kept(decontaminate.drop_contaminated(docs, benchmark), docs) == all_of(r for r in ROWS if r[1] != "same words")


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, labels, remainder(4) != 2)
    assert set(kept(out, docs)) <= set(all_of(ROWS))
    assert kept(toxicity.drop_toxic(docs, labels.limit(0), remainder(4) != 2), docs) in (all_of(ROWS), [])


def test_packing(docs):
    got = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in ROWS}


@pytest.mark.parametrize("blanks", [" " * 1_000_000, "\n" * 1_000_000, " \t\n" * 400_000, "a" + " " * 3_000_000 + "b"])
def test_very_long_runs_of_blanks(blanks):
    encoder = packing.Encoder.of(packing.tokenizer_path())
    assert encoder.encode(blanks) == b"".join(i.to_bytes(4, "little") for i in encoder.whole.encode(blanks, add_special_tokens=False).ids)


def test_stages_keep_columns(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, out, SF))
        assert out.dtypes == docs.dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() >= out.count() > 0
