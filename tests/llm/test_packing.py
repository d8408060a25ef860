"""Packing: ids against the tokenizer itself, gapless sequences, bounds against exhaustive search."""

import itertools
import zlib

import numpy as np
import pytest

from rollframe.llm import packing

STRANGE = ["", " ", "a\x1c.b 　c　　d ' 's've x\n\n\ny <|endoftext|> z<|endoftext|>q\t\t", "日本語 テスト\r\n\r\n   é1²Ⅷ \u0085\u0085x \x1f\x1f \U0001F600", "x" * 5000]


def test_ids_equal_the_tokenizer(spark):
    path = packing.tokenizer_path()
    encoder = packing.Encoder(path)
    assert encoder.ranked is not None
    texts = STRANGE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def check(pieces, texts, capacity=2048):
    """Every document is there once, whole, cut as stated; sequences have no gaps or overflow."""
    encoder = packing.Encoder.of(packing.tokenizer_path())
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = encoder.encode(text or "") + b"\0\0\0\0"
        own = sorted(by_doc[doc], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own)))
        at = 0
        for p in own:
            assert p.start == at and 0 < p.length <= capacity
            assert p.ids_crc32 == zlib.crc32(ids[4 * at: 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
        assert all(p.length == capacity for p in own[1:])
        assert len(own) == 1 or len(ids) // 4 > capacity
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack_documents(docs).collect()
    used = check(pieces, {r.doc_id: r.text for r in docs.collect()})
    assert used <= packing.lower_bound(np.array([p.length for p in pieces]), 2048) + 1


def test_exchange_between_partitions(spark):
    """Many small partitions leave gaps; the rounds close nearly all of them."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(300, 1100, 3000).tolist()
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = packing.pack(items, partition_items=40).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(lengths))
    space = {}
    for r in packed:
        space.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in space.values():
        assert [o for o, _ in sorted(own)] == list(itertools.accumulate([0] + [n for _, n in sorted(own)][:-1])) and sum(n for _, n in own) <= 2048
    apart = len({r.sequence_id for r in packing.pack(items, partition_items=40, rounds=1).collect()})
    together = len(packing.best_fit(np.array(lengths), 2048)[2])
    assert len(space) < apart
    assert len(space) - together <= 0.6 * (apart - together)


def best(lengths, capacity):
    """Least number of bins by exhaustive search."""
    least = len(lengths)

    def put(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(lengths):
            least = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                put(i + 1, bins)
                bins[b] -= lengths[i]
        put(i + 1, [*bins, lengths[i]])
    put(0, [])
    return least


def test_bounds_never_exceed_the_least_number():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 21, rng.integers(1, 9))
        least = best(lengths.tolist(), 20)
        assert packing.lower_bound(lengths, 20) <= least <= len(packing.best_fit(lengths, 20)[2])


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "hello " * 9000), (None, "a"), (4, "same"), (4, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as piece", "8 as length", "9 as sequence_id", "'x' as ids")
    got = packing.pack_documents(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in got if r.doc_id != 3) == [("1", 0, 1), ("2", 0, 1), ("4", 0, 2), ("4", 0, 2), ("None", 0, 2)]
    check(packing.pack_documents(docs.filter("doc_id < 4")).collect(), {1: None, 2: "", 3: "hello " * 9000})
    assert packing.pack_documents(docs.limit(0)).count() == 0
    kept = packing.pack_documents(docs.filter("doc_id = 2"), keep_ids=True).collect()[0]
    assert kept.ids == b"\0\0\0\0"
    with pytest.raises(Exception):
        packing.Encoder("/no/such/file.json")
