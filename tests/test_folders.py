"""The folder source: what it returns, and which files it opens."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

from rollframe.sources import folders, readers, writers


def put(root, path, value):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture
def root(tmp_path):
    for i in range(6):
        put(tmp_path, f"group/run{i}/manifest.json", {"evaluation_role": "final_test" if i % 2 else "validation", "environment": "maze", "seed": i})
        put(tmp_path, f"group/run{i}/parity.json", {"gate_passed": i != 3})
    put(tmp_path, "group/run1/gpu_metrics/gpu_summary.json", {"gpu_hours": 2.5})
    put(tmp_path, "other/broken/manifest.json", "{no json")
    put(tmp_path, "other/list/manifest.json", [1])
    put(tmp_path, "other/deep/er/manifest.json", {"evaluation_role": 7, "environment": None})
    put(tmp_path, "manifest.json", {"evaluation_role": "root"})
    put(tmp_path, "other/side/parity.json", {})
    return tmp_path


def test_rows(spark, root):
    got = folders.read_folders(spark, str(root), "manifest.json", ["parity.json", "gpu_metrics/gpu_summary.json"], ["evaluation_role", "environment"])
    assert got.columns == ["folder", "evaluation_role", "environment", "manifest", "parity", "gpu_summary"]
    rows = {r.folder.removeprefix(str(root)): r for r in got.collect()}
    assert set(rows) == {"", "/other/broken", "/other/list", "/other/deep/er", *(f"/group/run{i}" for i in range(6))}
    assert rows["/other/deep/er"].evaluation_role == "7" and rows["/other/deep/er"].environment is None and rows["/other/broken"].manifest == "{no json"
    assert rows["/group/run1"].gpu_summary and rows["/group/run2"].gpu_summary is None


def test_runs_and_restrictions(spark, root):
    every = readers.read_runs(spark, str(root))
    assert every.count() == 8, "unreadable manifests are no runs"
    got = readers.read_runs(spark, str(root), "final_test", "maze").orderBy("seed").collect()
    assert [(r.seed, r.gate_passed, r.gpu_hours) for r in got] == [(1, True, 2.5), (3, False, None), (5, True, None)]
    assert readers.read_runs(spark, str(root), runs=[f"{root}/group/run2", "nowhere"]).first().seed == 2
    plan = every.filter(F.col("run").startswith(f"{root}/other")).collect()
    assert len(plan) == 1


def test_other_files_of_excluded_folders_stay_closed(root, monkeypatch):
    reader = folders.FolderReader(str(root), "manifest.json", ["parity.json"], ["evaluation_role"])
    left = list(reader.pushFilters([EqualTo(("evaluation_role",), "final_test"), In(("folder",), (f"{root}/group/run1", f"{root}/group/run2")),
                                    StringStartsWith(("folder",), str(root)), IsNotNull(("folder",)), EqualTo(("manifest",), "x")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    opened, plain = [], folders.FolderReader._text
    monkeypatch.setattr(folders.FolderReader, "_text", staticmethod(lambda files, path: opened.append(path.removeprefix(str(root))) or plain(files, path)))
    rows = [f for part in reader.partitions() for b in reader.read(part) for f in b.column("folder").to_pylist()]
    assert [r.removeprefix(str(root)) for r in rows] == ["/group/run1"]
    assert sorted(opened) == ["/group/run1/manifest.json", "/group/run1/parity.json", "/group/run2/manifest.json"]


def test_files_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(f"/a/e{i}/metrics.json", json.dumps({"seed": i, "success": i % 2 == 0})) for i in range(300)] + [("/a/e1/assistant_texts.json", '["x"]')], "path string, value string")
    assert writers.write_files(rows, str(tmp_path)) == 301
    got = readers.read_episodes(spark, str(tmp_path)).orderBy("seed").collect()
    assert [r.seed for r in got] == list(range(300)) and got[1].assistant_texts == ["x"] and got[2].assistant_texts == []
