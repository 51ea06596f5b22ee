"""Findings of round 4, each as a small case."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from cadentia import plans
from cadentia.operators import recovery
from cadentia.sources import workout_files


def test_workout_files_hold_every_sample(spark, tmp_path):
    workouts = spark.range(2).selectExpr("id AS workout_id", "date'2024-05-01' AS date", "60 AS duration_seconds")
    points = spark.range(25_000).selectExpr("0L AS workout_id", "CAST(id AS INT) AS seq", "CAST(id AS INT) AS ts_s", "CAST(id % 400 AS INT) AS power")
    points = points.unionByName(points.where("seq < 3").withColumn("workout_id", F.lit(1).cast("long")))
    workout_files.write(workouts, points, str(tmp_path / "out"))
    got = workout_files.read(spark, str(tmp_path / "out")).select(*points.columns)
    assert got.count() == 25_003 and not got.exceptAll(points).count()


def test_xml_files_of_a_long_workout(spark, tmp_path):
    events = spark.range(20_500).selectExpr("id AS event_id", "timestamp_micros(id * 1000000) AS ts", "7L AS user_id", "CAST(id % 90 AS DOUBLE) AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    (row,) = plans.QUERIES["xml_files"](spark, str(tmp_path)).collect()
    assert (row.workout_id, row.n, row.seq, row.power) == (7, 20_500, 20_500 * 20_499 // 2, sum(i % 90 for i in range(20_500) if i % 11))


#: Athletes whose spread is 60 minutes exactly: running means leave a little more of it in the second, and 60 in the first.
BORDER = {368566: [3609140, 3614570, 3622919, 3628141, 3636042, 3648999, 3656921, 3675443, 3682572, 3683539, 3728963], 815555: [8114202, 8137886, 8138799, 8158592, 8180212, 8195283, 8217896, 8227259, 8230697]}


def test_sleep_advice_on_the_border_is_its_sql(spark, tmp_path):
    rows = [(k, a) for a, keys in BORDER.items() for k in keys] + [(k, k % 5) for k in range(50)]
    spark.createDataFrame(sorted(rows), "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("1995-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    ran = con.execute(plans.ORACLES["sleep_advice"])
    columns = [d[0] for d in ran.description]
    wanted = sorted(ran.fetchall())
    assert [r[columns.index("areas")].count("consistency") for r in wanted if r[0] in BORDER] == [0, 1]
    assert sorted(map(tuple, plans.QUERIES["sleep_advice"](spark, str(tmp_path)).select(*columns).collect())) == wanted


def test_running_spread(spark):
    def plain(xs):
        n, mean, squares = 0.0, 0.0, 0.0
        for x in xs:
            n += 1
            before, mean = mean, mean + (x - mean) / n
            squares += (x - mean) * (x - before)
        return (squares / n) ** 0.5 if n else None

    lists = {k: [None if (i + k) % 7 == 0 else (i * i * 31 + k * 17) % 601 for i in range(k)] for k in range(1, 40)}
    rows = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)], "k int, night_id long, total_sleep int")
    got = {r.k: r.running_sd for r in recovery.running_spread(rows.repartition(16), "k").collect()}
    assert got == {k: plain([x for x in xs if x is not None]) for k, xs in lists.items()}
