"""What the plan modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.sources import views


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles and decimals rounded, integers as long, so that another engine's sums compare equal."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def sql(body: str, *ctes: str) -> str:
    """A query over view texts of views (POINTS, WORKOUTS, ...), recursive or not."""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def r4(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 4) + 0.0 AS {name}"


def i8(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


SESSIONS = f"""sessions AS (
  SELECT p.workout_id, CAST(count(*) * 60 AS INT) AS duration_seconds, CAST(150 + p.workout_id % 200 AS INT) AS ftp, CAST(150 + p.workout_id % 30 AS INT) AS lthr,
    4.0::DOUBLE + (p.workout_id % 20) / 10.0::DOUBLE AS threshold_pace,
    CASE p.workout_id % 5 WHEN 0 THEN 'Cycling' WHEN 1 THEN 'Running' WHEN 2 THEN 'Swimming' WHEN 3 THEN 'Rowing' ELSE 'Triathlon' END AS sport
  FROM points p GROUP BY p.workout_id)"""


def sessions(points: DataFrame) -> DataFrame:
    """The workouts behind points: duration, sport and the athlete's thresholds."""
    k = F.col("workout_id")
    sport = F.when(k % 5 == 0, "Cycling").when(k % 5 == 1, "Running").when(k % 5 == 2, "Swimming").when(k % 5 == 3, "Rowing").otherwise("Triathlon")
    return points.groupBy("workout_id").agg((F.count("*") * 60).cast("int").alias("duration_seconds")).select(
        "workout_id", "duration_seconds", (150 + k % 200).cast("int").alias("ftp"), (150 + k % 30).cast("int").alias("lthr"), (F.lit(4.0) + (k % 20) / F.lit(10.0)).alias("threshold_pace"), sport.alias("sport")
    )


def points_query(f):
    return lambda spark, sf_dir: rounded(f(views.points(spark, sf_dir)))


def workouts_query(f):
    return lambda spark, sf_dir: rounded(f(views.workouts(spark, sf_dir)))


def nights_query(f):
    return lambda spark, sf_dir: rounded(f(views.nights(spark, sf_dir)))
