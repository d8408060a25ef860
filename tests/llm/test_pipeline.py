"""The pipeline stage by stage against brute force, and the driver's entry point."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_near import brute_classes  # noqa: E402
from test_packing import check  # noqa: E402
from test_scans import brute_contamination  # noqa: E402
from test_secrets import all_spans  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from rollframe.llm import secrets, toxicity  # noqa: E402
from rollframe.llm.common import QUERIES, staged  # noqa: E402
from rollframe.llm.labelled import remainder  # noqa: E402

SF = "/root/testdata/sf0.001"


def masked(text):
    out, upto = [], 0
    for s, _, e in all_spans(text):
        if s >= upto:
            out.append((text or "")[upto:s])
        upto = max(upto, e)
    return secrets.REPLACEMENT.join([*out, (text or "")[upto:]])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # A few rows that a given table may have: missing text, repeated rows, a further column.
    docs = staged(docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("9000001 as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")))
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = staged(stages[0](spark, docs, SF))
    model, cuts = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), remainder(4) != 2)
    no = {r.doc_id for r in toxicity.score(docs, model).withColumn("no", toxicity.rejected(cuts)).filter("no").collect()}
    assert clean.count() == docs.filter(~docs.doc_id.isin(list(no))).count() and no
    unique = staged(stages[1](spark, clean, SF))
    ordered = sorted(rows(clean).items())
    stay = {d for d, c in zip([d for d, _ in ordered], brute_classes(ordered)) if d == c}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(stay) and len(stay) < len(ordered)
    fresh = staged(stages[2](spark, unique, SF))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_, hit in brute_contamination(sorted(rows(unique).items()), bench) if hit}
    assert rows(fresh) == {d: t for d, t in rows(unique).items() if d not in bad} and bad
    hidden = staged(stages[3](spark, fresh, SF))
    assert rows(hidden) == {d: masked(t) if all_spans(t) else t for d, t in rows(fresh).items()}
    assert {r.doc_id: r.n_chars for r in hidden.filter("text is not null").collect()} == {d: len(t) for d, t in rows(hidden).items() if t is not None}
    for df in (clean, unique, fresh, hidden):
        assert df.dtypes == docs.dtypes
    check(stages[4](spark, hidden, SF).collect(), rows(hidden))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert docs.count() == 0


def test_entry_point():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
