"""Feature tables for models: calendar, rolling and running sums, chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators.effect import training_effect
from cadentia.operators.zones import distribution, hr_zone_features


def calendar(rows: DataFrame) -> DataFrame:
    """Weekday (Monday 0), ISO week, month, day of year."""
    return rows.withColumns({"weekday": F.weekday("date"), "iso_week": F.weekofyear("date"), "month": F.month("date"), "day_of_year": F.dayofyear("date")})


def rolling(workouts: DataFrame, key: str, days: int) -> DataFrame:
    """Sums over a key's workouts at or before each, dated at most ``days`` days back (so days + 1 calendar days).

    A range frame takes in later workouts of the same day; what follows in that day is taken off again.
    """
    metres = F.coalesce("total_distance", F.lit(0.0)) if "total_distance" in workouts.columns else F.lit(0.0)
    x = workouts.select(key, "workout_id", "date", F.coalesce("tss", F.lit(0.0)).alias("v"), F.col("duration_seconds").cast("long").alias("s"), metres.alias("m"), F.datediff("date", F.lit("1970-01-01").cast("date")).alias("d"))
    span = Window.partitionBy(key).orderBy("d").rangeBetween(-days, 0)
    after = Window.partitionBy(key, "d").orderBy("workout_id").rowsBetween(1, Window.unboundedFollowing)
    less = lambda f, c, z: f(c).over(span) - F.coalesce(f(c).over(after), F.lit(z))
    return x.select(key, "workout_id", "date", less(F.sum, "v", 0.0).alias("tss"), less(F.sum, "s", 0).alias("seconds"), less(F.sum, "m", 0.0).alias("distance"), (F.count("*").over(span) - F.count("*").over(after)).alias("n"))


def running_sums(workouts: DataFrame, key: str) -> DataFrame:
    """Cumulative stress, time and distance in order of date."""
    w = Window.partitionBy(key).orderBy("date", "workout_id").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c, z: F.sum(F.coalesce(c, F.lit(z))).over(w)
    return workouts.select(key, "workout_id", total("tss", 0.0).alias("tss"), F.sum("duration_seconds").over(w).alias("seconds"), total("total_distance", 0.0).alias("distance"))


def chronological_split(rows: DataFrame, train: float = 0.70, validate: float = 0.85, dates: DataFrame | None = None) -> DataFrame:
    """train, validation or test by a row's place in order of date.

    The places are global, but no row meets all others: days are counted (over ``dates``, a cheaper table with the same days, where it is given), their counts
    summed over the short calendar, and rows ranked within their day.
    """
    days = (rows if dates is None else dates).groupBy("date").agg(F.count("*").alias("n"))
    before = days.select("date", F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    x = rows.join(before, "date").withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("workout_id")) - 1 + F.col("before"))
    share = F.col("place") / F.col("total")
    return x.withColumn("split", F.when(share < train, "train").when(share < validate, "validation").otherwise("test")).drop("before", "total")


def with_sums(workouts: DataFrame, key: str = "athlete_id", spans: tuple[int, ...] = (7, 28)) -> DataFrame:
    """Workouts with the sums of ``rolling`` over each span (tss_7d, ...) and of ``running_sums`` (cumulative_tss, ...): one shuffle by key, windows in one order, no join."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    x = workouts.withColumns({"sum_day": day, "sum_tss": F.coalesce("tss", F.lit(0.0)), "sum_seconds": F.col("duration_seconds").cast("long"), "sum_distance": F.coalesce("total_distance", F.lit(0.0))})
    order = Window.partitionBy(key).orderBy("sum_day", "workout_id")
    after = Window.partitionBy(key, "sum_day").orderBy("workout_id").rowsBetween(1, Window.unboundedFollowing)
    # what follows in a day is in every range that ends with it
    later = {c: F.coalesce(F.sum(f"sum_{c}").over(after), F.lit(0)) for c in ("tss", "seconds", "distance")} | {"n": F.count("*").over(after)}
    x = x.withColumns({f"later_{c}": v for c, v in later.items()})
    sums = {f"cumulative_{c}": F.sum(f"sum_{c}").over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("tss", "seconds", "distance")}
    for days in spans:
        span = Window.partitionBy(key).orderBy("sum_day").rangeBetween(-days, 0)
        sums |= {f"{c}_{days}d": (F.count("*") if c == "n" else F.sum(f"sum_{c}")).over(span) - F.col(f"later_{c}") for c in ("tss", "seconds", "distance", "n")}
    return x.withColumns(sums).drop(*(c for c in x.columns if c not in workouts.columns))


def feature_table(workouts: DataFrame, points: DataFrame, lthr: int = 170) -> DataFrame:
    """Summary, calendar, rolling, running and zone features of each workout, one row each."""
    zones = distribution(points, hr_zone_features(F.col("heart_rate"), F.lit(lthr)), 5, ["workout_id"], all_rows=True).drop("total")
    best = F.col("avg_pace").alias("best_pace")
    return calendar(with_sums(workouts)).join(zones, "workout_id", "left").select("*", best, F.lit(None).cast("int").alias("max_power"))


#: Columns of the exported features, in order.
ML_COLUMNS = (
    "workout_id", "date", "sport", "duration_seconds", "distance_meters", "year", "month", "day_of_week", "day_of_year", "week_of_year", "tss", "intensity_factor", "normalized_power", "average_power", "max_power",
    "average_hr", "max_hr", "hr_zone_1_pct", "hr_zone_2_pct", "hr_zone_3_pct", "hr_zone_4_pct", "hr_zone_5_pct", "aerobic_te", "anaerobic_te", "epoc", "recovery_hours", "average_pace_min_per_km",
    "best_pace_min_per_km", "rolling_7d_tss", "rolling_7d_duration", "rolling_7d_distance", "rolling_28d_tss", "rolling_28d_duration", "rolling_28d_distance", "cumulative_tss", "cumulative_duration",
    "cumulative_distance", "split",
)


def ml_table(workouts: DataFrame, points: DataFrame, lthr: int, max_hr: int, resting_hr: int, fitness: int, high: int = 160) -> DataFrame:
    """The exported feature table: ML_COLUMNS, one row a workout, training effect and split joined; the best pace is the mean, the largest power unknown."""
    have = feature_table(workouts, points, lthr).join(training_effect(points, max_hr, resting_hr, fitness, high), "workout_id", "left")
    have = chronological_split(have, dates=workouts)
    from_ = {
        "distance_meters": "total_distance", "day_of_week": "weekday", "week_of_year": "iso_week", "average_power": "avg_power", "average_hr": "avg_heart_rate", "max_hr": "max_heart_rate",
        "aerobic_te": "aerobic", "anaerobic_te": "anaerobic", "average_pace_min_per_km": "avg_pace", "best_pace_min_per_km": "best_pace", "cumulative_duration": "cumulative_seconds",
        **{f"hr_zone_{i}_pct": f"pct{i}" for i in range(1, 6)}, **{f"rolling_{d}d_{x}": f"{c}_{d}d" for d in (7, 28) for x, c in (("tss", "tss"), ("duration", "seconds"), ("distance", "distance"))},
    }
    have = have.withColumn("year", F.year("date"))
    value = lambda c: F.col(c) if c in have.columns else F.lit(None).cast("double")
    return have.select(*(value(from_.get(name, name)).alias(name) for name in ML_COLUMNS))
