"""Training data as views over the given star-schema tables, in Spark and in SQL.

Real deployments read ``points``, ``workouts``, ``athletes`` and ``nights`` from their own
tables; these adaptors give the same columns from whatever keys the commerce tables
have, by integer arithmetic only, so that another engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sport for each order priority.
SPORTS = {"1-URGENT": "Cycling", "2-HIGH": "Running", "3-MEDIUM": "Swimming", "4-NOT SPECIFIED": "Triathlon", "5-LOW": "Rowing"}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: workout_id, seq, ts_s and nullable channels."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("workout_id"),
        seq.alias("seq"),
        i,
        F.when(i % 11 != 0, F.floor("value").cast("int")).alias("power"),
        F.when(i % 13 != 0, (90 + i % 100).cast("int")).alias("heart_rate"),
        (60 + i % 60).cast("int").alias("cadence"),
        F.when(i % 17 != 0, (100 + i % 23).cast("int")).alias("elevation"),
        (F.lit(3.5) + (i % 50) / F.lit(10.0)).alias("pace"),
        (F.lit(2.0) + (i % 40) / F.lit(10.0)).alias("speed"),
        (i % 30).cast("int").alias("stroke_count"),
        (i % 7).cast("int").alias("stroke_type"),
        (180 + i % 120).cast("int").alias("ground_contact_time"),
        (60 + i % 80).cast("int").alias("vertical_oscillation"),
        (F.lit(0.8) + (i % 10) / F.lit(10.0)).alias("stride_length"),
        (40 + i % 21).cast("int").alias("balance"),
    ).select("*", F.col("seq").alias("ts_s"), (F.col("seq") * 3.0).alias("distance"), (F.floor(F.col("seq") / 20) + 1).cast("int").alias("lap_number"))


POINTS = """points AS (
  SELECT *, seq AS ts_s, seq * 3.0::DOUBLE AS distance, CAST(seq // 20 + 1 AS INT) AS lap_number FROM (
    SELECT user_id AS workout_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id,
      CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS INT) END AS power,
      CASE WHEN event_id % 13 <> 0 THEN CAST(90 + event_id % 100 AS INT) END AS heart_rate,
      CAST(60 + event_id % 60 AS INT) AS cadence,
      CASE WHEN event_id % 17 <> 0 THEN CAST(100 + event_id % 23 AS INT) END AS elevation,
      3.5::DOUBLE + (event_id % 50) / 10.0::DOUBLE AS pace,
      2.0::DOUBLE + (event_id % 40) / 10.0::DOUBLE AS speed,
      CAST(event_id % 30 AS INT) AS stroke_count, CAST(event_id % 7 AS INT) AS stroke_type,
      CAST(180 + event_id % 120 AS INT) AS ground_contact_time, CAST(60 + event_id % 80 AS INT) AS vertical_oscillation,
      0.8::DOUBLE + (event_id % 10) / 10.0::DOUBLE AS stride_length, CAST(40 + event_id % 21 AS INT) AS balance
    FROM events))"""


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per workout with its summary columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    sport = F.create_map(*(F.lit(x) for pair in SPORTS.items() for x in pair))
    return o.select(
        k.alias("workout_id"),
        F.col("o_custkey").alias("athlete_id"),
        F.to_date("o_orderdate").alias("date"),
        sport[F.col("o_orderpriority")].alias("sport"),
        F.when(k % 10 != 0, F.col("o_totalprice") / 2500.0).alias("tss"),
        (1800 + k % 7200).cast("int").alias("duration_seconds"),
        F.when(k % 9 != 0, F.lit(5000.0) + k % 20000).alias("total_distance"),
        F.when(k % 7 != 0, F.lit(0.55) + (k % 60) / F.lit(100.0)).alias("intensity_factor"),
        F.when(k % 8 != 0, (110 + k % 70).cast("int")).alias("avg_heart_rate"),
        F.when(k % 6 != 0, (120 + k % 200).cast("int")).alias("avg_power"),
        F.when(k % 5 != 0, F.lit(3.5) + (k % 40) / F.lit(10.0)).alias("avg_pace"),
    )


WORKOUTS = """workouts AS (
  SELECT o_orderkey AS workout_id, o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Cycling' WHEN '2-HIGH' THEN 'Running' WHEN '3-MEDIUM' THEN 'Swimming' WHEN '4-NOT SPECIFIED' THEN 'Triathlon' WHEN '5-LOW' THEN 'Rowing' END AS sport,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 2500.0 END AS tss,
    CAST(1800 + o_orderkey % 7200 AS INT) AS duration_seconds,
    CASE WHEN o_orderkey % 9 <> 0 THEN 5000.0::DOUBLE + o_orderkey % 20000 END AS total_distance,
    CASE WHEN o_orderkey % 7 <> 0 THEN 0.55::DOUBLE + (o_orderkey % 60) / 100.0::DOUBLE END AS intensity_factor,
    CASE WHEN o_orderkey % 8 <> 0 THEN CAST(110 + o_orderkey % 70 AS INT) END AS avg_heart_rate,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(120 + o_orderkey % 200 AS INT) END AS avg_power,
    CASE WHEN o_orderkey % 5 <> 0 THEN 3.5::DOUBLE + (o_orderkey % 40) / 10.0::DOUBLE END AS avg_pace
  FROM orders)"""


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each athlete."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("athlete_id"),
        (150 + k % 200).cast("int").alias("ftp"),
        (150 + k % 30).cast("int").alias("lthr"),
        (170 + k % 30).cast("int").alias("max_hr"),
        (45 + k % 20).cast("int").alias("resting_hr"),
        (F.lit(4.0) + (k % 20) / F.lit(10.0)).alias("threshold_pace"),
        (F.lit(50.0) + k % 50).alias("weight"),
    )


ATHLETES = """athletes AS (
  SELECT c_custkey AS athlete_id, CAST(150 + c_custkey % 200 AS INT) AS ftp, CAST(150 + c_custkey % 30 AS INT) AS lthr, CAST(170 + c_custkey % 30 AS INT) AS max_hr,
    CAST(45 + c_custkey % 20 AS INT) AS resting_hr, 4.0::DOUBLE + (c_custkey % 20) / 10.0::DOUBLE AS threshold_pace, 50.0::DOUBLE + c_custkey % 50 AS weight
  FROM customer)"""


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recovery row per order: sleep stages in minutes, HRV, resting heart rate, battery, stress, TSB."""
    k = F.col("o_orderkey")
    null_if = lambda m, x: F.when(k % m != 0, x)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("night_id"),
        F.col("o_custkey").alias("athlete_id"),
        F.to_date("o_orderdate").alias("date"),
        (30 + k % 80).cast("int").alias("deep"),
        (120 + k % 200).cast("int").alias("light"),
        (40 + k % 90).cast("int").alias("rem"),
        (k % 70).cast("int").alias("awake"),
        (k % 7).cast("int").alias("interruptions"),
        null_if(12, F.lit(30.0) + k % 70).alias("rmssd"),
        null_if(14, F.lit(40.0) + k % 40).alias("baseline"),
        (45 + k % 30).cast("int").alias("rhr"),
        (k % 101).cast("int").alias("battery_start"),
        ((k * 7) % 101).cast("int").alias("battery_end"),
        null_if(9, (k * 3) % 101).cast("int").alias("stress"),
        (k % 81 - 40).cast("int").alias("tsb"),
    )


NIGHTS = """nights AS (
  SELECT o_orderkey AS night_id, o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS date,
    CAST(30 + o_orderkey % 80 AS INT) AS deep, CAST(120 + o_orderkey % 200 AS INT) AS light, CAST(40 + o_orderkey % 90 AS INT) AS rem,
    CAST(o_orderkey % 70 AS INT) AS awake, CAST(o_orderkey % 7 AS INT) AS interruptions,
    CASE WHEN o_orderkey % 12 <> 0 THEN 30.0::DOUBLE + o_orderkey % 70 END AS rmssd,
    CASE WHEN o_orderkey % 14 <> 0 THEN 40.0::DOUBLE + o_orderkey % 40 END AS baseline,
    CAST(45 + o_orderkey % 30 AS INT) AS rhr, CAST(o_orderkey % 101 AS INT) AS battery_start, CAST((o_orderkey * 7) % 101 AS INT) AS battery_end,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST((o_orderkey * 3) % 101 AS INT) END AS stress, CAST(o_orderkey % 81 - 40 AS INT) AS tsb
  FROM orders)"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workouts with many equal natural keys, to find duplicates in."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("athlete_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("int").alias("duration_seconds"),
        F.col("l_returnflag").alias("sport"),
        F.col("l_orderkey").alias("created_at"),
    )


COPIES = """copies AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS athlete_id, CAST(l_shipdate AS DATE) AS date,
    CAST(l_quantity AS INT) AS duration_seconds, l_returnflag AS sport, l_orderkey AS created_at
  FROM lineitem)"""
