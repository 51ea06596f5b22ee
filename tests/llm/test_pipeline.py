"""The pipeline's stages against plain versions of their decisions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cadentia.llm import mixing, neardup
from tests.llm import cases
from tests.llm.test_neardup import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = before.collect(), after.collect()
        if number < 4:
            assert after.columns == COLUMNS
        if name == "language":
            dropped = {r.doc_id for r in old} - {r.doc_id for r in new}
            assert len(dropped) <= 0.02 * len(old)
            assert sum(r.lang == a.lang for r in new for a in old if a.doc_id == r.doc_id) >= 0.98 * len(new)
        elif name == "near_duplicates":
            wanted = {k[0] for k in plain([(r.doc_id, r.text) for r in old], 5, 80) if k[3] or k[1] == 0}
            assert {r.doc_id for r in new} == wanted and len(new) == len(wanted)
        elif name == "pii":
            texts = {r.doc_id: r.text for r in old}
            assert len(new) == len(old)
            assert not any(re.search(r"@[a-z0-9]+\.[a-z]", r.text) for r in new)
            assert all(r.text == texts[r.doc_id] or "[" in r.text for r in new)
            assert all(r.n_chars == len(r.text) for r in new)
        elif name == "mixing":
            count = lambda t: len(re.findall(mixing.WORD, t or ""))
            sizes, got, times = Counter(), Counter(), Counter(r.doc_id for r in new)
            for r in old:
                sizes[r.source] += count(r.text)
            for r in new:
                got[r.source] += count(r.text)
            order = sorted(sizes)
            goal = dict(zip(order, mixing.targets([(s, sizes[s]) for s in order], [3, 1, 2], 1.5, 2), strict=True))
            longest = max(count(r.text) for r in old)
            assert max(times.values()) <= 2 and all(abs(got[s] - goal[s]) <= longest for s in order)
        else:
            total = sum(r.length for r in new)
            assert Counter(r.doc_id for r in new if r.piece == 0) == Counter(r.doc_id for r in old)
            assert len({r.sequence_id for r in new}) <= -(-total // 4096) * 1.03 + 2
        before = after


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 0


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    empty = cases.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0)] * 4 + [(1, "a b c d e f", 1), (None, "x y", 0), (None, "x y", 0), (None, None, 0)], "doc_id long, text string, extra int")
    out = [tuple(r)[:2] for r in neardup.deduplicated(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, "a b c d e f"), (None, "x y"), (None, None)], key=str)


CLASHES = ["_row", "_lot", "_key", "_copies", "_draws", "_shard", "spans", "sanitised", "score", "lang_pred", "doc", "row", "base", "near", "lot", "key", "draw", "copies", "margin", "size", "a.b"]


def test_columns_of_any_name_come_back(spark):
    """Every stage but the last gives back columns with names that the operators use themselves, unchanged."""
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in CLASHES))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in CLASHES)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
