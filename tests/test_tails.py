"""Lines of growing files, as batch and stream."""

import pytest

from rollframe.sources import readers, tails
from rollframe.streaming.jobs import run_once


@pytest.mark.parametrize("step", [1, 5, 17, 1 << 20])
@pytest.mark.parametrize("text", [b"", b"\n", b"a", b"a\n\nbb\r\nccc\n", b"\n\nlong line here\nx\n\n", "\u00e9t\u00e9\n\u96ea\nlast".encode()])
def test_ranges_give_every_line_once(tmp_path, text, step):
    path = tmp_path / "a.log"
    path.write_bytes(text)
    got = [(o, v) for r in tails.ranges(str(path), 0, len(text), step) for b in tails.lines_of(str(path), r) for o, v in zip(b["offset"].to_pylist(), b["value"].to_pylist())]
    want, at = [], 0
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        if i < len(lines) - 1 or line:
            want.append((at, line.removesuffix(b"\r").decode()))
        at += len(line) + 1
    assert got == want


def test_whole_lines_end(tmp_path, monkeypatch):
    monkeypatch.setattr(tails, "CHUNK_BYTES", 4)
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\nunfinished")
    assert tails.whole_lines_end(str(path), str(path), 0, 18) == 8 and tails.whole_lines_end(str(path), str(path), 8, 18) == 8


def test_a_growing_file(spark, tmp_path):
    """Half a line waits for its end; a file that grows is read on from where it was; other suffixes are left alone."""
    source = tmp_path / "in"
    source.mkdir()
    log, base = source / "gpu.log", str(tmp_path)
    (source / "notes.txt").write_text("0, not, 1, 2, 3, 4\n")

    def run():
        rows = readers.parse_device_lines(tails.stream_lines(spark, str(source), ".log"))
        return sorted((r.gpu_index, r.memory_used_mib) for r in run_once(rows, f"{base}/out", f"{base}/ck").collect())
    log.write_text("0, a, 10, 80, 5, 50\nbad line\n1, a, 11, 8")
    assert run() == [(0, 10.0)]
    with log.open("a") as f:
        f.write("0, 5, 60\n2, a, 12, 80, n/a, 70\n")
    (source / "more.log").write_text("3, b, 13, 80, 1, 1\n")
    assert run() == [(0, 10.0), (1, 11.0), (2, 12.0), (3, 13.0)]
    assert run() == [(0, 10.0), (1, 11.0), (2, 12.0), (3, 13.0)], "nothing new, nothing twice"
    batch = readers.parse_device_lines(tails.read_lines(spark, str(source), ".log", range_bytes=7))
    assert sorted((r.gpu_index, r.memory_used_mib, r.offset) for r in batch.collect()) == [(0, 10.0, 0), (1, 11.0, 29), (2, 12.0, 49), (3, 13.0, 0)]


def test_an_empty_folder(spark, tmp_path):
    assert tails.read_lines(spark, str(tmp_path)).count() == 0
