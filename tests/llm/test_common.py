"""The helpers that the corpus operators share."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadentia.llm import common


def test_join_uneven_is_an_inner_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7").withColumn("v", F.col("k") * 10)
    out = common.join_uneven(rows, keys, ["k"], "n", 6000).select("k", "id", "v").collect()
    assert Counter(map(tuple, out)) == Counter((r.k, r.id, r.k * 10) for r in rows.collect() if r.k != 7)


def test_join_hot_is_a_join(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 2500, 0).when(F.col("id") < 2600, None).otherwise(F.col("id") % 50).alias("k"), "id")
    assert common.hot_keys(rows, "k") == [0]
    keys = spark.range(60).where("id <> 7").select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for given in (keys, keys.where("k > 0")):
        for how in ("inner", "left"):
            got = Counter(map(tuple, common.join_hot(rows, given, "k", how=how).select("k", "id", "v").collect()))
            assert got == Counter(map(tuple, rows.join(given, "k", how).select("k", "id", "v").collect()))


def test_one_for_each(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "k string, v int")
    keys = spark.createDataFrame([("a", 1), ("b", 2)], "k string, _copies int")
    assert sorted(map(tuple, common.one_for_each(rows, keys, "k", "_copies").collect())) == [("a", 1), ("b", 2)]


def test_slices_cut_by_bytes_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["x" * n for n in (3, 30, 0, 4, 4, 4, 25)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert len(parts) > 3 and common.texts(parts[-1])[-1] == "é".encode()


def test_held_out(spark):
    got = {r.i: r.h for r in spark.createDataFrame([(1,), (2,), (None,)], "i long").select("i", common.held_out(F.col("i"), 3, 1).alias("h")).collect()}
    assert got == {1: zlib.crc32(b"1") % 3 == 1, 2: zlib.crc32(b"2") % 3 == 1, None: False}


def test_word_hashes_are_bounded(monkeypatch):
    monkeypatch.setattr(common, "MEMO_WORDS", 10)
    memo = common.WordHashes()
    words = [str(i).encode() for i in range(100)]
    first = memo.of(words)
    assert len(memo) <= 10 and (memo.of(words) == first).all() and len(np.unique(first)) == 100


def test_the_shared_folder_is_the_sessions(spark):
    folder = common.shared_folder(spark)
    assert folder == common.shared_folder(spark)
    df = common.settle(spark.range(3))
    assert df.count() == 3


def test_words_of_slices(monkeypatch):
    """A slice of a batch gives the words that its texts have, also with nulls, and so do what counts and encodes them."""
    from cadentia.llm import entry, lm, packing

    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else f" W{i}  x{i}, É{i % 3}\n" + "y " * (i % 4) for i in range(60)]
    plain = [(t or "").encode().lower().split() for t in texts]
    monkeypatch.setattr(common, "SLICE_BYTES", 50)
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, kind)], names=["id", "text"])
        parts = list(common.slices(iter([batch.slice(1, 58)])))
        assert len(parts) > 5
        number, encoder = lm._Words(), packing._encoder(entry.tokenizer_path())
        for p in parts:
            rows = p.column(0).to_pylist()
            assert [[w.encode() for w in ws if w] for ws in common.split_words(p.column(1), lower=True).to_pylist()] == [plain[i] for i in rows]
            tokens, ends = number.of(p.column(1))
            assert tokens.tolist() == [x for i in rows for x in [*map(number.__getitem__, plain[i]), int(lm._END)]] and ends.tolist() == np.cumsum([len(plain[i]) + 1 for i in rows]).tolist()
            ids, at = encoder.encode(p.column(1))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoder.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids for i in rows]
