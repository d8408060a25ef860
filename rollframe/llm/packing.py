"""Best-fit packing with certified bin counts.

Documents become token ids plus an end mark; only longer ones are cut, the odd piece first.
Full pieces are sequences of their own. The others are dealt evenly over partitions of
about ``PARTITION_ITEMS`` pieces, each packed by best-fit decreasing in one task. Dual-feasible
functions give a lower bound on the bins of a partition; where the packing meets it, the
partition is certified and final. A partition with a gap gives up the documents of its
emptiest bins, and these are dealt anew and packed again, with fewer partitions each round.
The rounds end when all are certified, when one partition is left, or after ``ROUNDS``.

Rows carry their own results, so nothing is joined back. Every round is written to the shared
folder, which fixes its deal against lost executors.

Defined cases: a null or empty text is its end mark alone; a repeated row is packed once per
row; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.llm.common import map_slices, query, staged, table, texts

CAPACITY = 2048
END = 0
PARTITION_ITEMS = 1 << 16
ROUNDS = 6
#: Bins that a partition gives up for each bin of its gap, and at least.
RELEASE = 8
#: Fixed value: the pattern by which the byte-level vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ranks by token bytes, if ids count up in the order of the merges; else None."""
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(vocab.get(c, 256) > 255 for c in letters):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, equal to those of the tokenizer file.

    A byte-level vocabulary is merged by rank, which gives the same ids several times faster;
    texts that hold an added token or a very long run of blanks, and other kinds of tokenizer, go
    to the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole, self.ranked = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.added = [t["content"] for t in rules["added_tokens"]]
        plain = rules["normalizer"] is None and rules["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        ranks = byte_ranks(rules["model"]) if plain else None
        if ranks:
            import tiktoken
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # its pattern gives up on runs of about a million blanks
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: the odd one first, then full ones."""
    if length <= capacity:
        return [(0, length)]
    odd = length % capacity
    return [(0, odd)] * (odd > 0) + [(s, capacity) for s in range(odd, length, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document; ``keep_ids`` adds the ids themselves as bytes."""
    path = path or tokenizer_path()
    mark = np.array([end], "<u4").tobytes()

    def work(batch):
        docs, rows = batch.column("doc_id").to_pylist(), []
        encoder = Encoder.of(path)
        for doc, text in zip(docs, batch.column("text").to_pylist()):
            ids = encoder.encode(text or "") + mark
            for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                own = ids[4 * start: 4 * (start + length)]
                rows.append((doc, i, start, length, zlib.crc32(own), own if keep_ids else None))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        return {n: pa.array(c, k) for n, c, k in zip(names[: 5 + keep_ids], columns, kinds)}
    return map_slices(texts(docs), work, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound over two families of dual-feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    cut = np.arange(0, capacity // 2 + 1)
    # Large items fill a bin, items below the cut vanish, the rest count as they are.
    large = number[capacity] - number[capacity - cut]
    middle = weight[capacity - cut] - np.where(cut > 0, weight[cut - 1], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    size = np.arange(capacity + 1)
    for k in range(1, 33):
        # Sizes rounded down to multiples of 1/k of a bin, but for exact multiples of 1/(k+1).
        scaled = np.where(size * (k + 1) % capacity == 0, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, int(-(-(count * scaled).sum() // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and place of each item, and the free space of each bin."""
    bins, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    occupied = 0  # bit f: a bin with f free tokens exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = occupied >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            b = by_free[room].pop()
            if not by_free[room]:
                occupied ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], place[i] = b, capacity - room
        free[b] = room - n
        if room > n:
            by_free[room - n].append(b)
            occupied |= 1 << (room - n)
    return bins, place, np.array(free, np.int64)


def _pack(rows: DataFrame, capacity: int, turn: int, final: bool) -> DataFrame:
    own = [c for c in rows.columns if c not in ("sequence_id", "offset", "certified", "done")]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", sequence_id long, offset long, certified boolean, done boolean"

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        lengths = got.column("length").to_numpy()
        bins, place, free = best_fit(lengths, capacity)
        gap, keep = len(free) - lower_bound(lengths, capacity), np.ones(len(free), bool)
        if gap and not final:
            keep[np.argsort(-free, kind="stable")[: RELEASE * gap]] = False
        first = (turn << 56) + (TaskContext.get().partitionId() << 28)
        for name, values in (("sequence_id", first + bins), ("offset", place), ("certified", np.full(len(bins), gap == 0)), ("done", keep[bins])):
            got = got.append_column(name, pa.array(values))
        yield from got.to_batches(max_chunksize=10_000)
    return rows.select(own).mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Give every row with a ``length`` a sequence and a place in it, in as few sequences as can be.

    ``certified``: the bin count of the partition that packed it last is proven least.
    """
    items = staged(items)
    whole = items.filter(F.col("length") == capacity).select(
        "*", ((F.lit(rounds + 1).cast("long") * F.lit(1 << 56)) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    pool, finished = items.filter(F.col("length") < capacity), [whole]
    for turn in range(rounds):
        left = pool.count()
        if not left:
            break
        parts = ceil(left / partition_items)
        last = parts == 1 or turn == rounds - 1
        packed = staged(_pack(pool.repartition(parts), capacity, turn, last))
        finished.append(packed.filter("done").drop("done"))
        if last:
            break
        pool = packed.filter("not done")
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(pieces(docs, path, capacity, keep_ids=keep_ids), capacity)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))
