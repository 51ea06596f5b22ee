"""The store on disk: batches, streams, upserts; rows whose columns have any name."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadentia.operators import quality, store
from cadentia.sources import files, storage

D = dt.date(2024, 5, 1)
SCHEMA = "workout_id long, athlete_id long, date date, duration_seconds int, sport string, row int, place int"
ROWS = [(1, 1, D, 60, "Running", 0, 0), (2, 1, D, 60, "Running", 0, 0), (3, None, D, 60, "Running", 0, 0), (4, None, D, 60, "Running", 0, 0), (5, 2, D, 60, "Running", 0, 0), (6, 1, D, 61, "Running", 0, 0), (6, 1, D, 61, "Running", 0, 0)]


def ids(df):
    return sorted(r.workout_id for r in df.collect())


def test_twins_in_a_batch_and_batches_written_again(spark, tmp_path):
    rows, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "store")
    assert storage.stored(spark, path) is None
    storage.append_batch(rows, path, 0)
    assert ids(storage.stored(spark, path)) == [1, 3, 4, 5, 6]
    more = spark.createDataFrame([(7, 2, D, 60, "Running", 1, 1), (8, 9, D, 1, "Cycling", 1, 1), (9, 9, D, 1, "Cycling", 1, 1)], SCHEMA)
    for _ in range(2):
        storage.append_batch(more, path, 1)
        assert ids(storage.stored(spark, path)) == [1, 3, 4, 5, 6, 8]
    storage.append_batch(rows, path, 0)
    assert ids(storage.stored(spark, path)) == [1, 3, 4, 5, 6, 8]
    assert set(storage.stored(spark, path).columns) == {*SCHEMA.replace(",", "").split()[::2], "stored_in"}
    with pytest.raises(ValueError, match="stored_in"):
        storage.append_batch(rows.withColumn("stored_in", F.lit(1)), path, 2)


def test_a_stream_is_stored_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "store")
    for part in (ROWS[:2], ROWS[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        for checkpoint in ("a", "b"):  # a second reader starts from the beginning and finds all there
            storage.append_stream(spark.readStream.schema(SCHEMA).parquet(str(source)), path if checkpoint == "a" else f"{path}-b", str(tmp_path / checkpoint)).awaitTermination()
    assert ids(storage.stored(spark, path)) == ids(storage.stored(spark, f"{path}-b")) == [1, 3, 4, 5, 6]


def test_replaced_rows(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoint"))
    path = str(tmp_path / "nights")
    frame = lambda rows: spark.createDataFrame(rows, "a int, y int, v int, x string")
    storage.replace_rows(frame([(1, 2020, 1, "a"), (1, 2020, 2, "b"), (2, 2021, 5, "c")]), path, ["a", "y"], "v", "y")
    storage.replace_rows(frame([(1, 2020, 2, "d"), (3, 2020, 1, "e"), (4, 2022, 1, "f")]), path, ["a", "y"], "v", "y")
    storage.replace_rows(frame([(1, 2020, 1, "late")]), path, ["a", "y"], "v", "y")
    assert sorted((r.a, r.y, r.v, r.x) for r in storage.stored(spark, path).collect()) == [(1, 2020, 2, "d"), (2, 2021, 5, "c"), (3, 2020, 1, "e"), (4, 2022, 1, "f")]
    with pytest.raises(ValueError, match="part of the key"):
        storage.replace_rows(frame([]), path, ["a"], "v", "y")


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, 5, 7, 0, 1, 2, 3, 4, 5), (1, 6, 7, 1, 1, 2, 3, 4, 5)], "k int, v int, _in int, seq int, workout_id int, ts_s int, row int, newer int, `n.m` int")
    both = store.upsert(df.limit(1), df, ["k"], "v")
    assert both.columns == df.columns and [tuple(r) for r in both.collect()] == [(1, 6, 7, 1, 1, 2, 3, 4, 5)]
    for out in (quality.sorted_distinct(df), quality.reindexed(df), files.downsampled(df)):
        assert out.columns == df.columns and out.count() in (1, 2)
    assert sorted(r.ts_s for r in quality.reindexed(df).collect()) == [0, 1]


def test_quoted_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,"note, free",power,hr\n0.5,x,200,120\n1.5,"y, z",201,121\n')
    got = [(r.seq, r.power, r.heart_rate) for r in files.read_csv(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, 200, 120), (1, 201, 121)]
