"""Suffix dedup against brute force over all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tokenfjord.llm import suffix_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("places", T.LongType()), T.StructField("k_id", T.StringType())])


def brute(texts, window=400):
    where = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - window + 1):
            if where[t[i : i + window]] > 1:
                hit[i] += 1
                hit[i + window] -= 1
        gone = np.cumsum(hit)[: len(t)] > 0
        runs = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    want = sorted(((d, *r) for (d, _), r in zip(rows, brute([(t or "").encode() for _, t in rows]), strict=True)), key=str)
    assert sorted(map(tuple, suffix_dedup.report(docs, **options).collect()), key=str) == want
    return want


def planted():
    draw = np.random.default_rng(11)
    word = lambda n: "".join(draw.choice(list("abcdé \n"), n))
    shared = [word(n) for n in (380, 400, 401, 450, 900)]
    rows = [(k, word(int(draw.integers(0, 900))) + shared[k % 5] + word(int(draw.integers(0, 900)))) for k in range(30)]
    rows += [(100, "x" * 401), (101, "y" * 400), (102, "ab" * 700), (103, None), (104, ""), (None, shared[4]), (None, shared[4]), (105, word(300) * 3), (106, shared[1]), (7, word(2000)), (7, word(2000))]
    return rows + [rows[3], rows[3]]


def test_planted_repeats(spark):
    want = check(spark, planted())
    assert sum(r[2] > 0 for r in want) > 25


@pytest.mark.parametrize("most_group", [1, 3])
def test_hot_groups_by_window_hash(spark, most_group):
    check(spark, planted(), most_group=most_group)


def test_small_slabs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 700)
    monkeypatch.setattr(suffix_dedup, "BLOCK_STRINGS", 5)
    monkeypatch.setattr(suffix_dedup.ColumnFile, "ROWS", 3)
    rows = planted()
    texts = [(t or "").encode() for _, t in rows]
    for text in texts:
        joined = {}
        for which, (shift, *sizes), data in suffix_dedup._slabs([text]):
            places, hashes = suffix_dedup.anchors(np.frombuffer(data, np.uint8), np.cumsum(sizes).clip(max=len(data)))
            joined |= dict(zip((places + shift).tolist(), hashes.tolist(), strict=True))
        whole, hashes = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([len(text)]))
        assert joined == dict(zip(whole.tolist(), hashes.tolist(), strict=True))


def test_whole_table(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty_table_and_texts(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])


def test_cleaned_texts(spark):
    text = "p" * 10 + "q" * 5 + "".join(map(chr, range(200, 500)))
    docs = spark.createDataFrame([(1, text + "one"), (2, "two" + text), (3, "three")], "doc_id long, text string")
    assert {r[0]: r[1] for r in suffix_dedup.deduplicate(docs).collect()} == {1: "one", 2: "two", 3: "three"}


def test_hash_zero_is_a_key_like_any_other(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 1200).astype(np.uint8)
    real = suffix_dedup.gram_hashes

    def forced(x):
        h = real(x).copy()
        h[300::150] &= np.uint64(0xFFFFFFFF)
        return h

    monkeypatch.setattr(suffix_dedup, "gram_hashes", forced)
    places, _ = suffix_dedup.anchors(data, np.array([len(data)]))
    reach = suffix_dedup.LEFT + 1
    for start in range(len(data) - suffix_dedup.WINDOW + 1):
        assert ((places >= start) & (places < start + reach)).any()
    assert {300, 450, 600} <= set(places.tolist())
