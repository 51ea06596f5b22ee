"""Cases that larger tables bring up: equal ids, values without spread, borders, tables past a cache's size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadentia.operators import effect, recovery, store
from cadentia.plans import files as plans_files
from cadentia.plans import imports as plans_imports
from cadentia.plans import load as plans_load
from cadentia.sources import cache, files, workout_files


def test_correlation_without_spread(spark):
    rows = spark.createDataFrame([(1, 80, 50), (1, 80, 60), (2, 70, 50), (2, 80, 60), (2, 90, 70), (2, None, 1), (2, 1, None), (3, 80, 50), (4, None, 50), (4, None, 51)], "k int, x int, y int")
    got = {r.k: (r.n, r.r) for r in recovery.correlation(rows, "k", "x", "y").collect()}
    assert got == {1: (2, 0.0), 2: (3, 1.0)}


def test_rows_of_one_id_are_counted_together(spark):
    key = (1, "2024-01-01", 60, "Running")
    rows = spark.createDataFrame([(1, *key, 1), (5, *key, 2), (5, *key, 3), (5, 2, "2024-01-01", 60, "Running", 9)], "id long, athlete_id long, date string, duration_seconds int, sport string, created_at long")
    assert sorted(map(tuple, store.duplicates_to_remove(rows).collect())) == [(5, 3)]
    twice = rows.where("id = 1").unionByName(rows)
    assert sorted(map(tuple, store.duplicate_counts(twice).collect())) == [(1, 1, 4)]


def test_a_third_of_fall_is_fifty_of_severity(spark):
    rows = spark.createDataFrame([(1, i, i, v) for i, v in enumerate((90.0, 70.0, 60.0, 50.0))], "k int, night_id int, date int, rmssd double")
    assert [(r.consecutive_days, r.severity) for r in recovery.overreaching(rows, "k").collect()] == [(3, 65)]


def test_a_spread_of_exactly_an_hour(spark):
    # both halves an hour from the mean, dealt over many tasks
    rows = spark.createDataFrame([(k, i, i, 300 + k + 120 * (i * 7 % 11 % 2 if i < 10 else i % 2), 70) for k in range(40) for i in range(10 + 2 * k)], "k int, night_id int, date int, total_sleep int, sleep_score int")
    even = rows.groupBy("k").agg({"total_sleep": "avg"}).where("`avg(total_sleep)` = 360 + k").select("k")
    got = recovery.sleep_pattern(rows.join(even, "k").repartition(64), "k").collect()
    assert len(got) > 10 and {(r.sd_minutes, r.consistency) for r in got} == {(60.0, 50.0)}


def test_trend_of_a_single_day(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 40.0), (1, "2024-01-01", 42.0), (2, "2024-01-01", 40.0), (3, "2024-01-01", 40.0), (3, "2024-01-03", 42.0)], "k int, date string, vo2 double").selectExpr("k", "to_date(date) AS date", "vo2")
    got = {r.k: r.slope for r in effect.vo2_trend(rows, "k").collect()}
    assert math.isnan(got[1]) and got[2] == 0.0 and abs(got[3] - 1.0) < 1e-9


def test_a_manifest_without_a_limit_keeps_every_file(spark, tmp_path):
    files = spark.createDataFrame([(f"/in/{i}", bytes([i]) * 100) for i in range(10)], "path string, content binary")
    old, new = files.where("path < '/in/5'"), files.where("path >= '/in/5'")
    for most, left in ((600, 6), (None, 10)):
        keeper = cache.Manifest(spark, f"{tmp_path}/{most}")
        for day, rows in ((1, old), (2, new)):
            assert keeper.incremental(rows, f"2024-01-0{day} 00:00:00", most=most).count() == 5
        assert keeper.read(2).count() == left


def test_counters_leave_nothing_in_the_driver(spark, sf_dir):
    before = {t.name for t in spark.catalog.listTables()}
    out = plans_files.stream_counters(spark, sf_dir)
    assert out.inputFiles() and {t.name for t in spark.catalog.listTables()} == before


def test_dense_days_are_not_sorted(spark, sf_dir):
    plan = plans_load.QUERIES["pmc_by_athlete"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert not any("Window" in line for line in plan[:made])


def test_a_file_for_each_name(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.csv").write_text("old")
    rows = spark.range(3000).selectExpr("if(id < 2999, concat(id % 7, '/a=', id % 30, '.csv'), null) AS file", "-id AS at", "concat('é', id) AS text")
    assert files.write_each(rows, str(tmp_path / "out")) == 210
    there = {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file()}
    assert there.pop("_SUCCESS") == "" and len(there) == 210
    assert there["3/a=10.csv"] == "".join(f"é{i}\n" for i in range(2998, -1, -1) if i % 7 == 3 and i % 30 == 10)


def test_files_are_read_once(spark, sf_dir):
    points, results = plans_imports.imports_of(spark, sf_dir)
    both = results.join(points.groupBy(points.workout_id.alias("path")).count(), "path", "left")
    assert both.count() == results.count()
    both.collect()
    final = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan text") == 1


def test_cells_of_lines_as_csv(spark):
    lines = ["a,b", "", ",", '"a, b",c', 'x,"a, b"', '"",1', '"a \\"b\\", c",2', '"open, to the end', ' "a, b",c', 'a"b,c"d', '"a, b"c,d', "x," * 40 + "y", '"a"b",c', '"a\\\\",b']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    known = {r.i: [v for v in r.c] for r in rows.selectExpr("i", f"from_csv(x, '{', '.join(f'c{k} string' for k in range(41))}') AS c").collect()}
    for r in rows.select("i", F.transform(files.cells(F.col("x")), files.unquoted).alias("c")).collect():
        assert [x or None for x in r.c] == [x or None for x in known[r.i][: len(r.c)]] and not any(known[r.i][len(r.c) :]), lines[r.i]


def test_a_workout_file_is_written_once(spark, tmp_path):
    workouts = spark.range(40).selectExpr("id AS workout_id", "date'2024-05-01' AS date", "60 AS duration_seconds")
    points = spark.range(120).selectExpr("id % 40 AS workout_id", "CAST(id DIV 40 AS INT) AS seq", "CAST(id DIV 40 AS INT) AS ts_s", "CAST(id AS INT) AS power")
    workout_files.write(workouts, points, str(tmp_path / "out"))
    # a file for each workout and nothing beside it, no check sums either
    assert sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.is_file()) == sorted(["_SUCCESS", *(f"workout_id={i}/workout.xml" for i in range(40))])
    got = workout_files.read(spark, str(tmp_path / "out"))
    assert {(r.workout_id, r.seq, r.power) for r in got.collect()} == {(i % 40, i // 40, i) for i in range(120)}


def test_a_training_step_to_the_bit():
    lm = pytest.importorskip("cadentia.llm.lm")
    rng = np.random.default_rng(5)
    weights, bias = rng.normal(size=(64, 8)).astype(np.float32), rng.normal(size=8).astype(np.float32)
    features, wanted, rate = rng.integers(0, 64, (500, 3)).astype(np.int32), rng.integers(0, 8, 500), 0.7
    assert np.array_equal(lm.rows_of(weights, features[:, 1]), weights[features[:, 1]])
    plain = weights.copy()
    slope = np.exp(np.clip(plain[features[:, 0]] + plain[features[:, 1]] + plain[features[:, 2]] + bias, -60, 60))
    slope *= (-1 / (slope @ np.ones(8, np.float32)))[:, None]
    slope[np.arange(500), wanted] += 1
    for k in range(3):
        order = np.argsort(features[:, k], kind="stable")
        rows, starts, n = np.unique(features[order, k], return_index=True, return_counts=True)
        plain[rows] += (rate / (n + 4)).astype(np.float32)[:, None] * lm.sums_of(slope[order], starts, n)
    lm.step(weights, bias, features, wanted, rate)
    assert np.array_equal(weights, plain)
