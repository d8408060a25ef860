"""Streams over several batches."""

import datetime as dt
import json

import pytest

from rollframe.streaming import jobs as J

TURN = "group_idx string, traj_idx int, turn_idx int, last_turn boolean, traj_success boolean, score double, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_assembly_over_batches(spark, tmp_path):
    first = [("g", 0, 1, False, False, 0.5, at(0)), ("g", 1, 2, True, True, 1.0, at(0)), ("g", 2, 1, False, False, 0.25, at(0)), ("g", 2, 3, True, False, 0.5, at(0))]
    second = [("g", 0, 2, True, True, 0.25, at(1)), ("g", 1, 1, False, False, 0.5, at(1))]
    stray = [("g", 0, 2, True, True, 0.125, at(2)), ("g", 2, 4, False, None, None, at(2))]
    later = [("h", 0, 1, True, False, 0.0, at(500))]
    last = [("h", 1, 1, True, False, 0.0, at(1000)), ("g", 2, 2, False, False, 0.75, at(3)), ("k", 0, 1, True, True, 2.0, at(3))]
    stream = feed(spark, str(tmp_path / "in"), TURN, first, second, stray, later, last)
    out = J.run_once(J.assemble(stream, "ts", "1 minute", patience_ms=600_000), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.kind, r.group_idx, r.traj_idx, tuple(r.turn_list), r.turns, r.reward, r.success, r.complete) for r in out.collect())
    assert got == [
        ("complete", "g", 0, (1, 2), 2, 0.75, True, True), ("complete", "g", 1, (1, 2), 2, 1.5, True, True),
        ("complete", "h", 0, (1,), 1, 0.0, False, True), ("complete", "h", 1, (1,), 1, 0.0, False, True),
        ("incomplete", "g", 2, (1, 3, 4), 3, 0.75, False, False),
        ("late", "g", 2, (2,), 1, 0.75, False, False), ("late", "k", 0, (1,), 1, 2.0, True, False),
        ("stray", "g", 0, (2,), 1, 0.125, True, False)]


def test_dedup_over_batches(spark, tmp_path):
    row = ("g", 0, 1, True, True, 0.5, at(0))
    stream = feed(spark, str(tmp_path / "in"), TURN, [row, row], [row, ("g", 0, 2, True, True, 0.5, at(1))])
    out = J.run_once(J.drop_copies(stream, "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.turn_idx for r in out.collect()) == [1, 2]


SAMPLE = "run string, gpu_index int, sample long, elapsed_seconds double, power_watts double, memory_used_mib double, utilization_percent double, ts timestamp"


def samples():
    rows = [("r", 0, i, i * 60.0, None if i == 3 else 100.0 + i, 10.0 * i, 50.0, at(i)) for i in range(8)]
    return rows[:4], rows[4:]


@pytest.mark.parametrize("mixed", [False, True])
def test_energy_over_batches(spark, tmp_path, mixed):
    """Samples out of order between and inside batches give the same pieces; the last row moves the watermark."""
    every = [r for part in samples() for r in part]
    parts = [[every[i] for i in own] for own in ([5, 0, 2], [7, 1], [6, 3, 4])] if mixed else samples()
    end = [("end", 0, 99, 0.0, 1.0, 1.0, 1.0, at(5000))]
    stream = feed(spark, str(tmp_path / "in"), SAMPLE, *parts, end)
    out = J.run_once(J.energy_pieces(stream), str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    pairs = [(0, 1), (1, 2), (4, 5), (5, 6), (6, 7)]
    want = sum((200.0 + a + b) / 2 * 60 / 3600 / 1000 for a, b in pairs)
    assert len(out) == 5 and abs(sum(r.kwh for r in out) - want) < 1e-12


def test_energy_forgets_silent_devices(spark, tmp_path):
    rows = [("r", 0, i, m * 60.0, 60.0, 1.0, 1.0, at(m)) for i, m in enumerate([0, 1, 200, 201])]
    stream = feed(spark, str(tmp_path / "in"), SAMPLE, rows[:2], rows[2:], [("end", 0, 99, 0.0, 1.0, 1.0, 1.0, at(5000))])
    out = J.run_once(J.energy_pieces(stream, patience_ms=3_600_000), str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    assert [round(r.kwh, 9) for r in out] == [0.001, 0.001]


def test_windows_and_sessions(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), SAMPLE, *samples())
    out = J.run_once(J.device_windows(stream, width="2 minutes"), str(tmp_path / "o1"), str(tmp_path / "c1"), "update", ["run", "gpu_index", "window"])
    assert sorted((r.samples, r.peak_memory_mib) for r in out.collect()) == [(2, 10.0), (2, 30.0), (2, 50.0), (2, 70.0)]
    slide = J.device_windows(spark.readStream.schema(SAMPLE).parquet(str(tmp_path / "in")), width="4 minutes", slide="2 minutes")
    assert J.run_once(slide, str(tmp_path / "o2"), str(tmp_path / "c2"), "update", ["run", "gpu_index", "window"]).count() == 5
    one = J.device_sessions(spark.readStream.schema(SAMPLE).parquet(str(tmp_path / "in")), gap="5 minutes")
    r = J.run_once(one, str(tmp_path / "o3"), str(tmp_path / "c3"), "complete").first()
    assert (r.samples, r.active_seconds) == (8, 420.0)


def test_ingest_splits_bad_lines(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "5.jsonl").write_text(json.dumps({"score": 1.0}) + "\n\nnot json\n[1]\n")
    J.ingest(J.rollout_stream(spark, str(src)), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    good = spark.read.parquet(str(tmp_path / "good")).collect()
    assert [(r.step, r.score) for r in good] == [(5, 1.0)] and good[0].arrived is not None
    assert [r._bad for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not json"]
