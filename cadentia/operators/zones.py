"""Zone tables and distributions. The six heart-rate schemes differ in base, border and rounding and stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the threshold at which zones end.
LTHR_ENDS = (0.81, 0.89, 0.93, 0.99)
MAX_HR_ENDS = (0.68, 0.83, 0.94, 1.05)
POWER_ENDS = (0.55, 0.74, 0.89, 1.04, 1.20, 1.50)
POWER_ENDS_BATCH = (0.55, 0.75, 0.90, 1.05, 1.20, 1.50)
PACE_STARTS = (1.29, 1.14, 1.06, 1.00)
PACE_STARTS_BATCH = (1.29, 1.14, 1.07, 0.97)
ABSOLUTE_PACES = (6.5, 5.5, 5.0, 4.5, 4.0)
#: Running zones, fastest and slowest share of threshold pace, and where heart rate starts and ends.
RUNNING = [(1, 1.35, 1.50, 0.50, 0.60), (2, 1.20, 1.35, 0.60, 0.70), (3, 1.05, 1.20, 0.70, 0.80), (4, 0.97, 1.05, 0.80, 0.90), (5, 0.90, 0.97, 0.90, 0.95), (6, 0.80, 0.90, 0.95, 1.02)]


def rounded_end(threshold: Column, share: float) -> Column:
    """A share of a whole threshold, rounded half to even, in decimals as the tables state it."""
    return F.bround(threshold.cast("decimal(10,0)") * F.lit(share).cast("decimal(4,2)"), 0).cast("int")


def truncated_end(threshold: Column, share: float) -> Column:
    """A share in single precision, cut to a whole number."""
    return (threshold.cast("float") * F.lit(share).cast("float")).cast("float").cast("int")


def by_ends(value: Column, ends: list[Column], closed: bool) -> Column:
    """Zone number of a value, from 1; zones include their end if ``closed``."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, end in enumerate(ends):
        out = out.when(value <= end if closed else value < end, F.lit(i + 1))
    return out.otherwise(F.lit(len(ends) + 1))


def by_starts(value: Column, starts: list[Column], closed: bool) -> Column:
    """Zone number where larger values are slower: zone 1 from the first start up."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, start in enumerate(starts):
        out = out.when(value >= start if closed else value > start, F.lit(i + 1))
    return out.otherwise(F.lit(len(starts) + 1))


def hr_table_lthr(athletes: DataFrame) -> DataFrame:
    t = F.col("lthr")
    return athletes.select("athlete_id", *[rounded_end(t, s).alias(f"z{i + 1}") for i, s in enumerate(LTHR_ENDS)], (t + 20).alias("z5"))


def hr_table_max(athletes: DataFrame) -> DataFrame:
    t = F.col("max_hr")
    return athletes.select("athlete_id", *[rounded_end(t, s).alias(f"z{i + 1}") for i, s in enumerate(MAX_HR_ENDS)], (t + 10).alias("z5"))


def power_table(athletes: DataFrame) -> DataFrame:
    t = F.col("ftp")
    return athletes.select("athlete_id", *[rounded_end(t, s).alias(f"z{i + 1}") for i, s in enumerate(POWER_ENDS)], (t * 3).alias("z7"))


def pace_table(athletes: DataFrame) -> DataFrame:
    return athletes.select("athlete_id", *[(F.col("threshold_pace") * s).alias(f"z{i + 1}_from") for i, s in enumerate(PACE_STARTS)])


def running_table(athletes: DataFrame) -> DataFrame:
    """Six running zones of each athlete, as pace and heart-rate ranges."""
    rows = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(h).alias("h")) for z, a, b, _, h in RUNNING]))
    x = athletes.select("athlete_id", "threshold_pace", "lthr", rows.alias("r"))
    top = F.when(F.col("r.zone") == 6, F.col("lthr") + 20).otherwise((F.col("lthr") * F.col("r.h")).cast("int"))
    return x.select("athlete_id", "r.zone", (F.col("threshold_pace") * F.col("r.a")).alias("fastest"), (F.col("threshold_pace") * F.col("r.b")).alias("slowest"), top.alias("hr_to"))


def hr_zone_lthr(hr: Column, lthr: Column) -> Column:
    return by_ends(hr, [rounded_end(lthr, s) for s in LTHR_ENDS], True)


def hr_zone_max(hr: Column, max_hr: Column) -> Column:
    return by_ends(hr, [rounded_end(max_hr, s) for s in MAX_HR_ENDS], True)


def hr_zone_reserve(hr: Column, resting: Column, max_hr: Column) -> Column:
    pct = F.when(hr > resting, (hr - resting) / (max_hr - resting) * 100).otherwise(F.when(hr.isNotNull(), F.lit(0.0)))
    return by_ends(pct, [F.lit(x) for x in (60.0, 70.0, 80.0, 90.0)], False)


def hr_zone_features(hr: Column, lthr: Column) -> Column:
    return by_ends(hr / lthr * 100, [F.lit(x) for x in (65.0, 75.0, 85.0, 95.0)], False)


def hr_zone_batch(hr: Column, lthr: Column) -> Column:
    return by_ends(hr, [truncated_end(lthr, s) for s in MAX_HR_ENDS], False)


def power_zone(power: Column, ftp: Column) -> Column:
    return by_ends(power, [rounded_end(ftp, s) for s in POWER_ENDS], True)


def power_zone_batch(power: Column, ftp: Column) -> Column:
    return by_ends(power, [truncated_end(ftp, s) for s in POWER_ENDS_BATCH], False)


def pace_zone(pace: Column, threshold: Column) -> Column:
    return by_starts(pace, [threshold * s for s in PACE_STARTS], True)


def pace_zone_batch(pace: Column, threshold: Column) -> Column:
    return by_starts(pace, [threshold * s for s in PACE_STARTS_BATCH], False)


def absolute_pace_zone(pace: Column) -> Column:
    return by_starts(pace, [F.lit(x) for x in ABSOLUTE_PACES], False)


def distribution(rows: DataFrame, zone: Column, n_zones: int, keys: list[str], all_rows: bool = False) -> DataFrame:
    """Counts and percentages of zones as columns; ``all_rows`` counts rows without a zone in the total, and gives null for absent zones."""
    counts = rows.select(*keys, zone.alias("_z")).groupBy(*keys).agg(
        F.count("*" if all_rows else "_z").alias("total"), *[F.count_if(F.col("_z") == z).alias(f"n{z}") for z in range(1, n_zones + 1)]
    )
    share = lambda z: F.try_divide((F.nullif(F.col(f"n{z}"), F.lit(0)) if all_rows else F.col(f"n{z}")) * 100.0, "total")
    absent = None if all_rows else F.lit(0.0)
    return counts.select(*keys, "total", *[(share(z) if absent is None else F.coalesce(share(z), absent)).alias(f"pct{z}") for z in range(1, n_zones + 1)])


def time_in_zones(points: DataFrame, zone: Column, n_zones: int) -> DataFrame:
    """Seconds in each zone; a sample's time is since the row before, whatever that row holds."""
    w = Window.partitionBy("workout_id").orderBy("seq")
    timed = points.select("workout_id", zone.alias("_z"), (F.col("ts_s") - F.lag("ts_s").over(w)).alias("dt"))
    return timed.groupBy("workout_id").agg(*[F.coalesce(F.sum(F.when(F.col("_z") == z, F.col("dt"))), F.lit(0)).alias(f"s{z}") for z in range(1, n_zones + 1)])


def intensity_pattern(workouts: DataFrame, key: str) -> DataFrame:
    """Low, moderate and high shares by intensity factor (0.75, 0.95) and the pattern's name; a null factor counts in the total only."""
    f = F.col("intensity_factor")
    g = workouts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(f < 0.75).alias("a"), F.count_if((f >= 0.75) & (f < 0.95)).alias("b"), F.count_if(f >= 0.95).alias("c"))
    low, mid, high = (F.col(x) * 100.0 / F.col("n") for x in "abc")
    name = F.when((low >= 75) & (high >= 15) & (mid <= 15), "polarized").when(mid >= 40, "threshold").when(high >= 40, "high_intensity").otherwise("mixed")
    return g.select(key, low.alias("low"), mid.alias("moderate"), high.alias("high"), name.alias("pattern"))


def intensity_time(workouts: DataFrame, key: str) -> DataFrame:
    """Shares of time below 0.75, to 0.85 and above, of workouts with a factor."""
    f, s = F.col("intensity_factor"), F.col("duration_seconds")
    g = workouts.where(f.isNotNull()).groupBy(key).agg(F.sum(s).alias("t"), *[F.sum(F.when(c, s).otherwise(0)).alias(x) for x, c in (("a", f < 0.75), ("b", (f >= 0.75) & (f < 0.85)), ("c", f >= 0.85))])
    return g.select(key, *[F.try_divide(F.col(x) * 100.0, "t").alias(n) for x, n in (("a", "easy"), ("b", "moderate"), ("c", "hard"))])


def threshold_estimates(rows: DataFrame) -> DataFrame:
    """FTP from 20 minutes, threshold pace from 5 and 10 km times, max heart rate from age; out-of-range inputs give null."""
    ok = lambda c, a, b: F.when(F.col(c).between(a, b), F.col(c))
    return rows.select(
        "athlete_id", F.bround(ok("power20", 50, 800).cast("decimal(10,0)") * F.lit(0.95).cast("decimal(3,2)"), 0).cast("int").alias("ftp"),
        F.when(F.col("age").between(10, 100), 220 - F.col("age")).alias("max_hr"), (F.col("t5k") / 5).alias("pace_5k"), (F.col("t10k") / 10 * 0.98).alias("pace_10k"),
    )
