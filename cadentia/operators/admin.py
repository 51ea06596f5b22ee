"""Threshold history, import logs, goals, advice, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Goals with their sport and typical weeks.
GOALS = {
    "marathon": ("Running", 16), "half-marathon": ("Running", 12), "5k": ("Running", 8), "10k": ("Running", 8), "century": ("Cycling", 12), "metric-century": ("Cycling", 10), "triathlon": ("Triathlon", 12),
    "ironman-full": ("Triathlon", 24), "half-ironman": ("Triathlon", 16), "maintenance": ("CrossTraining", 4), "base-building": ("CrossTraining", 8), "return-from-break": ("CrossTraining", 6),
}
#: Other names of goals, and weeks of a recovery cycle by pattern.
GOAL_NAMES = {"half": "half-marathon", "halfmarathon": "half-marathon", "metric": "metric-century", "tri": "triathlon", "ironman": "ironman-full", "ironman70.3": "half-ironman", "70.3": "half-ironman", "base": "base-building", "return": "return-from-break"}
CYCLES = {"2:1": 3, "3:1": 4, "4:1": 5}


def goal(name: str) -> tuple[str, int]:
    """A goal's sport and typical weeks."""
    key = name.lower()
    key = GOAL_NAMES.get(key, key)
    if key not in GOALS:
        raise ValueError(f"unknown goal {name}")
    return GOALS[key]


def cycle_length(pattern: str) -> int:
    if pattern not in CYCLES:
        raise ValueError(f"unknown recovery pattern {pattern}")
    return CYCLES[pattern]


def threshold_history(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes (keys, date, value) numbered newest first, with what each replaced."""
    w = Window.partitionBy(*keys).orderBy(F.desc("date"))
    return changes.select(*keys, "date", "value", F.row_number().over(w).alias("age"), F.lead("value").over(w).alias("before"))


def thresholds_as_of(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, date, ...) with the value in force that day, null before the first change (an extension).

    Changes and rows go through one window: no row meets more than the last change before it.
    """
    extra = [c for c in rows.columns if c not in (*keys, "date")]
    both = rows.select(*keys, "date", F.lit(1).alias("_row"), F.struct(*extra).alias("_x"), F.lit(None).cast(changes.schema["value"].dataType).alias("_v")).unionByName(
        changes.select(*keys, "date", F.lit(0).alias("_row"), F.lit(None).cast(rows.select(F.struct(*extra).alias("x")).schema["x"].dataType).alias("_x"), F.col("value").alias("_v"))
    )
    w = Window.partitionBy(*keys).orderBy("date", "_row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("_v", ignorenulls=True).over(w)).where("_row = 1").select(*keys, "date", "_x.*", "value")


def log_summary(log: DataFrame) -> DataFrame:
    """Entries and files by severity of (file, severity, message)."""
    return log.groupBy("severity").agg(F.count("*").alias("entries"), F.countDistinct("file").alias("files"))


def at_least(log: DataFrame, severity: str) -> DataFrame:
    """Entries of a severity or above."""
    order = ["Info", "Warning", "Error", "Critical"]
    return log.where(F.col("severity").isin(order[order.index(severity):]))


def latest_metrics(series: DataFrame, key: str, day: str) -> DataFrame:
    """Each key's last row up to a day."""
    return series.where(F.col("date") <= F.lit(day).cast("date")).groupBy(key).agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in ("ctl", "atl", "tsb")])


def sleep_advice(mean_minutes: Column, consistency: Column, mean_score: Column, debt_minutes: Column, tss: Column) -> dict[str, Column]:
    """Areas to improve, days to pay the debt back, target minutes."""
    areas = F.array_compact(F.array(
        F.when(mean_minutes < 420, F.lit("duration")).when(mean_minutes > 600, F.lit("efficiency")), F.when(consistency < 50, F.lit("consistency")), F.when(mean_score < 70, F.lit("quality")),
    ))
    return {
        "areas": F.array_join(areas, ","), "payback_days": F.when(debt_minutes > 0, F.ceil(debt_minutes / 45.0)), "target_minutes": F.when(tss > 150, 570).otherwise(480),
        "bedtime": F.when(tss > 150, "21:30").otherwise("22:00"), "review_days": F.when(F.size(areas) == 0, 0).otherwise(7),
    }


def valid_physiology(resting_hr: Column, respiration: Column, spo2: Column, stress: Column) -> Column:
    """Whether every known value lies in its range."""
    ok = lambda c, a, b: F.coalesce(c.between(a, b), F.lit(True))
    return ok(resting_hr, 30, 120) & ok(respiration, 5.0, 40.0) & ok(spo2, 70, 100) & ok(stress, 0, 100)


def text_report(totals: DataFrame, key: str) -> DataFrame:
    """A line of text for each row of report totals."""
    return totals.select(key, F.format_string("%s: %d workouts in %d days, %d minutes, TSS %d, mostly %s", F.col(key).cast("string"), "n", "span_days", F.round(F.col("total_hours") * 60, 6).cast("long"), F.round("total_tss", 6).cast("long"), "main_sport").alias("line"))
