"""Words and word runs of whole text columns, hashed in numpy on Arrow buffers.

Everything works on the UTF-8 bytes of a slice of a column at once, so there is no Python
loop per word or per document. A slice holds about a quarter of a megabyte of text, or one longer text.
Hashes are 64-bit polynomials, taken as differences of running sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_BYTES = np.arange(256)
#: Bytes outside these ASCII blanks make up a word.
NOT_BLANK = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Digits, lower-case ASCII letters and everything outside ASCII make up a word.
LETTER_OR_DIGIT = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
FOLD = _BYTES.astype(np.uint8)
FOLD[0x41:0x5B] += 0x20

_FACTORS = {"byte": (0x9E3779B97F4A7C15, 1), "word": (0xD1B54A32D192ED03, 2)}
_VALUES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        factor = _FACTORS[kind][0]
        rows = []
        for base in (factor, pow(factor, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            rows.append(np.multiply.accumulate(a))
        have = (rows[0], rows[1])
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, kind: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``; equal runs of equal length have equal hashes."""
    return _from_sums(_sums(values, kind), kind, starts, ends)


def _sums(values: np.ndarray, kind: str) -> np.ndarray:
    up, _ = _power(kind, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def _from_sums(sums: np.ndarray, kind: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _power(kind, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Words:
    """The words of the texts of one slice: text number, byte range and hash of each."""

    def __init__(self, texts: pa.Array, member: np.ndarray, fold: bool):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        buffer = texts.buffers()[2]
        raw = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)[offsets[0]: offsets[-1]]
        self.data = FOLD[raw] if fold else raw
        inside = member[self.data]
        n = len(inside)
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        firsts = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[firsts] = inside[firsts]
        lasts = (self.offsets[1:] - 1)[np.diff(self.offsets) > 0]
        stops[lasts] = inside[lasts]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.text = np.searchsorted(self.offsets, self.starts, "right") - 1 if n else np.zeros(0, np.int64)
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        #: Number of each word within its text.
        self.place = np.arange(len(self.starts)) - self.first[self.text]

    def hashes(self, prefixes: tuple[int, ...] = ()):
        """Hash of each word; with ``prefixes``, also of its first so many bytes (or all)."""
        sums = _sums(_VALUES[self.data], "byte")
        whole = _from_sums(sums, "byte", self.starts, self.ends)
        if not prefixes:
            return whole
        return [whole, *(_from_sums(sums, "byte", self.starts, np.minimum(self.ends, self.starts + k)) for k in prefixes)]

    def runs(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and whether they lie in one text."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(n - width + 1)
        return span_hashes(hashes, "word", at, at + width), self.text[: n - width + 1] == self.text[width - 1:]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out
