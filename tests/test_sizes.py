"""Values that only larger or odd tables show, and steps whose work must stay in bounds."""

import datetime as dt
import functools
import operator
import pathlib
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollframe import distributed, session
from rollframe.distributed import row_numbers
from rollframe.plans import views
from rollframe.plans.source_queries import dump_root
from rollframe.sources import readers as R
from rollframe.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_trims_round_as_single_precision(spark, tmp_path):
    """1.02 times 100 is 102 in single precision and a little less in double."""
    vector = [0.0] * 4 + [1.02, -1.29, 1.13, 1.3] + [0.0] * 56
    pq.write_table(pa.table({"vec_id": pa.array([1], pa.int64()), "embedding": pa.array([vector], pa.list_(pa.float32())), "label": pa.array([0], pa.int32())}), tmp_path / "embeddings.parquet")
    for key, kept in (("PRJ3", 8), ("PRJ4", 60)):
        row = entry.queries()[key](spark, str(tmp_path)).first()
        assert (row.kept, row.total) == (kept, 102 - 129 + 113 + 130)


def test_ranks_of_equal_means_in_any_order(spark, tmp_path):
    """Two users of the same values in another order, whose mean is on the middle of two roundings."""
    rng, below = random.Random(5), None
    while below is None:
        values = [rng.randrange(20_000) for _ in range(64)]
        if sum(values) % 4 == 2:  # the mean ends in half a millionth
            cents = [v / 100 for v in values]
            if sum(values) / 6400 <= functools.reduce(operator.add, cents) / 64 and functools.reduce(operator.add, cents[::-1]) / 64 < sum(values) / 6400:
                below = cents[::-1]
    rows = [(7, v) for v in below] + [(3, v) for v in below[::-1]]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    places = {r.user_id: r.place for r in entry.queries()["SRT5"](spark, str(tmp_path)).collect()}
    assert places == {3: 1, 7: 2}


def test_ranks_with_nulls_and_fine_values(spark, tmp_path):
    """Users without a value or an id stand last among equals, and a value finer than ten digits is not rounded up first."""
    rows = [(1, None), (2, 3.0), (3, -1.5), (None, 3.0), (4, 0.00000049999999999), (5, 0.0), (6, float("nan")), (7, 1e30), (7, None), (8, None), (8, None), (None, None), (9, 3.0), (9, None)]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["SRT5"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in entry.queries()["SRT5"](spark, str(tmp_path)).collect())
    assert dict(want) == {9: 1, None: 2, 7: 3, 8: 4, 3: 5, 4: 6, 5: 7, 2: 8, 6: 9, 1: 10}


def test_assembly_state_is_kept_by_bucket(spark, tmp_path):
    """One bucket and many give the same records, over batches that split the trajectories."""
    schema = "group_idx string, traj_idx int, turn_idx int, last_turn boolean, traj_success boolean, score double, ts timestamp"
    t0 = dt.datetime(2024, 1, 1)
    rows = [(str(g), t, i, i == 4, g % 2 == 0, 0.25 * i, t0) for g in range(40) for t in range(3) for i in range(1, 5) if not (g % 5 == 0 and i == 2)]
    batches = [[r for r in rows if r[2] % 2 == k] for k in (1, 0)] + [[("clock", d, 1, True, True, 0.0, t0 + dt.timedelta(days=d + 1))] for d in range(2)]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for n in (1, 64):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = J.run_once(J.assemble(stream, "ts", buckets=n), str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")).filter("group_idx <> 'clock'")
        got.append(sorted((r.kind, r.group_idx, r.traj_idx, tuple(r.turn_list), r.reward) for r in out.collect()))
    assert got[0] == got[1] and len(got[0]) == 120
    assert [r for r in got[0] if r[0] == "incomplete"] == sorted(("incomplete", str(g), t, (1, 3, 4), 2.0) for g in range(0, 40, 5) for t in range(3))
    many = pd.DataFrame({"a": range(3)})
    assert J._unpacked(J._packed(many)).equals(many)


def test_numbering_without_a_hot_key_writes_nothing(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 3001).alias("o"))
    held = lambda: len(session._staged.get(spark.sparkContext.applicationId, []))
    before = held()
    plain = sorted(row_numbers(df, ["k"], ["o"]).collect())
    assert held() == before
    monkeypatch.setattr(distributed, "WINDOW_ROWS", 100)
    assert sorted(row_numbers(df, ["k"], ["o"]).collect()) == plain and held() > before


def test_turns_of_hot_orders_are_the_same(spark, monkeypatch):
    plain = sorted(map(str, views.turns(spark, SF).collect()))
    monkeypatch.setattr(distributed, "WINDOW_ROWS", 0)
    assert sorted(map(str, views.turns(spark, SF + "/").collect())) == plain


def test_folders_of_small_files_are_packed(spark):
    """SRC9 and its like write some files for each name, not one for each episode."""
    root = dump_root(spark, SF)
    parts = [p for p in pathlib.Path(root).rglob("*") if p.is_file() and p.suffix == ".parquet"]
    assert 0 < len(parts) <= 3 * spark.sparkContext.defaultParallelism
    assert R.packed_files(spark, root, "metrics.json").count() == spark.read.parquet(SF + "/orders.parquet").count()
