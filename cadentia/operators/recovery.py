"""Heart-rate variability, sleep, readiness and overtraining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadentia.operators.rows import of, whole


def hrv_status(rmssd: Column, baseline: Column) -> Column:
    pct = F.try_divide((rmssd - baseline) * 100, baseline)
    return F.when(rmssd.isNull() | baseline.isNull(), F.lit(None)).when(baseline <= 0, "NoReading").when(pct >= -15, "Balanced").when(pct >= -30, "Unbalanced").otherwise("Poor")


def hrv_score(rmssd: Column, baseline: Column) -> Column:
    """Share of the baseline, at most 100; without one a line from 20 at 20 ms to 100 at 100 ms."""
    bound = lambda x, low: F.floor(F.greatest(F.least(x, F.lit(100.0)), F.lit(low))).cast("int")
    alone = bound(rmssd, 20.0)
    return F.when(rmssd.isNull(), F.lit(None).cast("int")).when(baseline.isNull(), alone).when(baseline <= 0, 0).otherwise(bound(F.try_divide(rmssd, baseline) * 100, 0.0))


def ema_baseline(rows: DataFrame, key: str, alpha: float) -> DataFrame:
    """Exponential mean of a key's readings in time order, from the first: each reading's weight follows from its place, so it is a plain sum."""
    order = Window.partitionBy(key).orderBy(F.desc("date"), F.desc("night_id"))
    x = rows.where("rmssd is not null").select(key, "rmssd", (F.row_number().over(order) - 1).alias("later"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("later")) * F.when(F.col("later") == F.col("n") - 1, 1.0).otherwise(alpha)
    return x.groupBy(key).agg(F.sum(F.col("rmssd") * weight).alias("baseline"), F.count("*").alias("n"))


def hrv_baseline(rows: DataFrame, key: str, readings: int = 7, least: int = 3, cutoff: float = 3.5) -> DataFrame:
    """Mean of the last seven readings without outliers by modified z-score (upper medians); three at least must stay."""
    w = Window.partitionBy(key).orderBy(F.desc("date"), F.desc("night_id"))
    last = rows.where("rmssd is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= readings)
    xs = last.groupBy(key).agg(F.array_sort(F.collect_list("rmssd")).alias("xs")).where(F.size("xs") >= least)
    upper = lambda a: F.element_at(a, F.expr("1") + F.floor(F.size(a) / 2).cast("int"))
    xs = xs.withColumn("med", upper(F.col("xs")))
    xs = xs.withColumn("mad", upper(F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("med"))))))
    kept = F.when(F.col("mad") < 0.001, F.col("xs")).otherwise(F.filter("xs", lambda x: F.abs(x - F.col("med")) * 0.6745 <= F.col("mad") * cutoff))
    xs = xs.withColumn("kept", kept)
    return xs.where(F.size("kept") >= least).select(key, (F.aggregate("kept", F.lit(0.0), lambda a, x: a + x) / F.size("kept")).alias("baseline"), F.size("kept").alias("n"))


def overreaching(rows: DataFrame, key: str, value: str = "rmssd") -> DataFrame:
    """Longest strictly falling run of readings (the first on ties) of 3 steps or more whose mean lies 10 % below the value before it."""
    w = Window.partitionBy(key).orderBy("date", "night_id")
    x = rows.where(F.col(value).isNotNull()).select(key, "date", "night_id", F.col(value).alias("v")).withColumn("before", F.lag("v").over(w)).withColumn("i", F.row_number().over(w))
    falls = F.col("v") < F.col("before")
    x = x.withColumn("falls", F.coalesce(falls, F.lit(False))).withColumn("island", F.sum(F.when(falls, 0).otherwise(1)).over(w))
    runs = x.where("falls").groupBy(key, "island").agg(F.count("*").alias("days"), F.avg("v").alias("mean"), F.min_by("before", "i").alias("start"), F.min("i").alias("i"))
    best = runs.groupBy(key).agg(F.max_by(F.struct("days", "mean", "start"), F.struct("days", -F.col("i"))).alias("r")).select(key, "r.*").where("days >= 3")
    # per cent before the division: a third of 100 times 1.5 must not fall below 50
    pct = (F.col("mean") - F.col("start")) * 100 / F.col("start")
    out = best.withColumn("deviation_pct", pct).where("deviation_pct <= -10")
    severity = F.floor(F.least(F.abs("deviation_pct") * 1.5, F.lit(70.0))).cast("int") + F.least(F.col("days") * 5, F.lit(20))
    return out.select(key, F.col("days").alias("consecutive_days"), "deviation_pct", F.least(severity, F.lit(100)).cast("int").alias("severity"))


def sleep_metrics(nights: DataFrame) -> DataFrame:
    """Total, efficiency and score of each night; a night without sleep has nulls."""
    made = ("total_sleep", "efficiency", "sleep_score")
    total = of("deep") + of("light") + of("rem")
    n = whole(nights).withColumn("total", F.when(total > 0, total))
    # shares and hours stand in columns of their own, so that the score's code stays small enough to be compiled
    n = n.withColumns({"efficiency": F.col("total") * 100.0 / (F.col("total") + of("awake")), "hours": F.col("total") / 60, **{f"{x}_share": of(x) / F.col("total") * 100 for x in ("deep", "light", "rem")}})
    score = sleep_score(F.col("deep_share"), F.col("light_share"), F.col("rem_share"), F.col("hours"), F.col("efficiency"), F.coalesce(of("interruptions"), F.lit(0)))
    return n.select(*(of(c).alias(c) for c in nights.columns if c not in made), F.col("total").alias("total_sleep"), "efficiency", score.alias("sleep_score"))


def _in_band(pct: Column, low: float, high: float, points: float, drop: float, most: float) -> Column:
    return F.when(pct.between(low, high), F.lit(points)).when(pct < low, pct / low * points).otherwise(points - F.least((pct - high) / 10.0 * drop, F.lit(most)))


def sleep_score(deep: Column, light: Column, rem: Column, hours: Column, efficiency: Column, interruptions: Column) -> Column:
    """Stages (in per cent of the sleep) 40 points, efficiency 30, duration 20, interruptions 10; truncated."""
    score = (
        _in_band(deep, 13.0, 23.0, 15.0, 5.0, 10.0) + _in_band(light, 45.0, 55.0, 10.0, 3.0, 7.0) + _in_band(rem, 20.0, 25.0, 15.0, 5.0, 10.0)
        + F.when(efficiency >= 85, F.lit(30.0)).otherwise(efficiency / 85.0 * 30.0)
        + F.when(hours.between(7, 9), F.lit(20.0)).when(hours < 7, hours / 7.0 * 20.0).otherwise(20.0 - F.least((hours - 9) * 2.0, F.lit(10.0)))
        + F.when(interruptions <= 2, F.lit(10.0)).otherwise(F.greatest(10.0 - (interruptions - 2) * 2.0, F.lit(0.0)))
    )
    return F.floor(F.greatest(F.least(F.round(score, 9), F.lit(100.0)), F.lit(0.0))).cast("int")


def stage_shares(nights: DataFrame) -> DataFrame:
    """Stage percentages and whether they are plausible."""
    total = F.col("deep") + F.col("light") + F.col("rem")
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, total), F.lit(0.0))
    ok = (pct("deep") <= 40) & pct("light").between(30, 70) & pct("rem").between(10, 35)
    return nights.select("night_id", pct("deep").alias("deep_pct"), pct("light").alias("light_pct"), pct("rem").alias("rem_pct"), ok.alias("plausible"))


def session_from_stages(segments: DataFrame) -> DataFrame:
    """Minutes by stage (summed in seconds, then cut) and interruptions: wakings after sleep; segments(session_id, seq, stage, seconds)."""
    w = Window.partitionBy("session_id").orderBy("seq")
    before = F.lag("stage").over(w)
    s = segments.select("session_id", "stage", "seconds", ((F.col("stage") == "Awake") & (before != "Awake")).alias("woke"))
    minutes = lambda name: F.expr(f"coalesce(sum(case when stage = '{name}' then seconds end), 0) div 60").cast("int").alias(name.lower())
    return s.groupBy("session_id").agg(*[minutes(x) for x in ("Deep", "Light", "REM", "Awake")], F.count_if("woke").alias("interruptions"))


def battery(rows: DataFrame, hours: float) -> DataFrame:
    """Drain or charge an hour, lowest, highest and the energy band; levels outside 0 to 100 are dropped."""
    change = F.col("battery_end") - F.col("battery_start")
    e = F.col("battery_end")
    return rows.where("battery_start between 0 and 100 and battery_end between 0 and 100").select(
        "night_id", F.when(change < 0, -change / hours).alias("drain_rate"), F.when(change > 0, change / hours).alias("charge_rate"), F.least("battery_start", "battery_end").alias("lowest"), F.greatest("battery_start", "battery_end").alias("highest"),
        F.when(e >= 75, "High").when(e >= 50, "Moderate").when(e >= 25, "Low").otherwise("VeryLow").alias("energy"),
    )


def stress_level(stress: Column) -> Column:
    return F.when(stress.isNull(), F.lit(None)).when(stress <= 25, "Low").when(stress <= 50, "Moderate").when(stress <= 75, "High").otherwise("VeryHigh")


def health_concern(resting_hr: Column, spo2: Column, stress: Column) -> Column:
    return F.coalesce(resting_hr > 100, F.lit(False)) | F.coalesce(spo2 < 90, F.lit(False)) | F.coalesce(stress > 75, F.lit(False))


def readiness_simple(deviation: Column, sleep: Column, tsb: Column) -> Column:
    """HRV 40 %, sleep 30 %, TSB 30 %, rounded half away from zero."""
    hrv = F.when(deviation >= 0, F.lit(100.0)).otherwise(F.least(F.greatest((deviation + 50) / 50 * 100, F.lit(0.0)), F.lit(100.0)))
    form = F.when(tsb.isNull(), F.lit(60.0)).otherwise(F.least(F.greatest((tsb + 30) / 60.0 * 80 + 20, F.lit(20.0)), F.lit(100.0)))
    return F.round(F.round(hrv * 0.4 + F.coalesce(sleep, F.lit(70)) * 0.3 + form * 0.3, 9), 0).cast("int")


def readiness(status: Column, score: Column, sleep: Column, battery_end: Column, stress: Column, has_physiology: Column) -> Column:
    """HRV 30, sleep 25, battery 25, stress 20, weighed by what is present, truncated."""
    hrv = F.when(status == "Balanced", 100.0).when(status == "Unbalanced", 65.0).when(status == "Poor", 30.0).otherwise(F.coalesce(score.cast("double"), F.lit(50.0)))
    # the first part is never missing, so the weights never come to nothing
    parts = [(sleep.cast("double"), 0.25), (battery_end.cast("double"), 0.25), (F.when(has_physiology, F.coalesce(100.0 - stress, F.lit(70.0))), 0.20)]
    total = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), hrv * 0.30)
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts), F.lit(0.30))
    return F.floor(F.round(total / weight, 9)).cast("int")


def quality(readiness_: Column) -> Column:
    return F.when(readiness_ >= 90, "Excellent").when(readiness_ >= 70, "Good").when(readiness_ >= 50, "Fair").otherwise("Poor")


def limiting_factor(status: Column, sleep: Column, battery_end: Column, concern: Column) -> Column:
    """The strongest of HRV, sleep, energy, health, in that order on ties."""
    rank = [
        ("HRV", F.when(status == "Poor", 10).when(status == "Unbalanced", 5)), ("Sleep", F.when(sleep < 50, 10).when(sleep < 70, 5)),
        ("Energy", F.when(battery_end < 25, 10).when(battery_end < 50, 5)), ("Health", F.when(concern, 10)),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for level in (10, 5):
        for name, r in rank:
            out = out.when(r == level, name)
    return out


def form(tsb: Column, deviation: Column, sleep: Column, rhr: Column, rhr_baseline: Column) -> Column:
    """TSB 25, HRV 35, sleep 25, resting heart rate 15, rounded half away from zero."""
    t = F.least(F.greatest((tsb + 30) / 60.0 * 80 + 20, F.lit(20.0)), F.lit(100.0))
    h = F.when(deviation >= 0, F.lit(100.0)).otherwise(F.least(F.greatest((deviation + 60) / 60 * 100, F.lit(0.0)), F.lit(100.0)))
    r = F.coalesce(F.least(F.greatest(100 - (rhr - rhr_baseline) / rhr_baseline * 300, F.lit(30.0)), F.lit(100.0)), F.lit(75.0))
    return F.round(F.round(t * 0.25 + h * 0.35 + F.coalesce(sleep, F.lit(70)) * 0.25 + r * 0.15, 9), 0).cast("int")


def form_band(score: Column) -> Column:
    return F.when(score < 20, "Critical").when(score < 40, "High").when(score < 60, "Moderate").when(score < 80, "Low").otherwise("Optimal")


def decision(rows: DataFrame, readiness_: str, planned: str, acwr: str) -> DataFrame:
    """What to train: recommendation, largest and smallest stress, risk."""
    r, p = F.col(readiness_), F.col(planned)
    cut = lambda f: F.floor(F.round(p * f, 9)).cast("int")
    pick = lambda a, b, c, d, e: F.when(r < 30, a).when(r < 50, b).when(r < 70, c).when(r < 85, d).otherwise(e)
    return rows.select(
        "*", pick("RestDay", "LightRecovery", "ModerateTraining", "HardTraining", "PeakPerformance").alias("recommendation"),
        pick(F.lit(0), cut(0.3), cut(0.8), p.cast("int"), cut(1.1)).alias("max_tss"), pick(F.lit(0), F.lit(20), F.lit(40), F.lit(50), F.lit(50)).alias("min_tss"),
        pick(F.lit("Critical"), F.lit("High"), F.when(F.col(acwr) > 1.3, "Moderate").otherwise("Low"), F.lit("Low"), F.lit("Low")).alias("risk"),
    )


def half_split_trend(rows: DataFrame, key: str, value: str, margin: float, relative: bool) -> DataFrame:
    """Second half against first half of a key's readings in order; Stable below three."""
    w = Window.partitionBy(key).orderBy("date", "night_id")
    # known values are counted, not filtered: a filter would be pushed below what makes the value and compute it twice
    x = rows.select(key, F.col(value).alias("v"), F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("i"), F.count(value).over(Window.partitionBy(key)).alias("n"))
    first = F.col("i") <= F.floor(F.col("n") / 2)
    g = x.groupBy(key).agg(F.count("v").alias("n"), F.avg(F.when(first, F.col("v"))).alias("a"), F.avg(F.when(~first, F.col("v"))).alias("b")).where("n > 0")
    d = (F.col("b") - F.col("a")) / F.col("a") * 100 if relative else F.col("b") - F.col("a")
    return g.select(key, F.when(F.col("n") < 3, "Stable").when(d > margin, "Improving").when(d < -margin, "Declining").otherwise("Stable").alias("trend"))


def overtraining(rows: DataFrame, key: str, acwr: Column) -> DataFrame:
    """Risk from load ratio, HRV trend, sleep debt in hours and share of elevated resting heart rates; rows(key, sleep_score, rhr_elevation)."""
    trend = half_split_trend(rows, key, "rmssd", 5.0, True)
    g = rows.groupBy(key).agg(F.avg("sleep_score").alias("s"), F.count("sleep_score").alias("n"), F.count_if(F.col("rhr_elevation") > 5).alias("e"), F.count("rhr_elevation").alias("m"), F.first(acwr).alias("acwr"))
    g = g.join(trend, key, "left").select(
        key, "acwr", F.coalesce("trend", F.lit("Stable")).alias("hrv_trend"), F.greatest((75 - F.col("s")) / 75 * 7.5 * F.col("n"), F.lit(0.0)).alias("sleep_debt"), F.try_divide(F.col("e") * 100.0, "m").alias("elevated_pct")
    )
    points = F.when(F.col("acwr") > 1.5, 2).when(F.col("acwr") > 1.3, 1).otherwise(0) + (F.col("hrv_trend") == "Declining").cast("int") + F.coalesce(F.col("sleep_debt") > 5, F.lit(False)).cast("int") + F.coalesce(F.col("elevated_pct") > 60, F.lit(False)).cast("int")
    return g.withColumn("risk", F.when(points <= 1, "Low").when(points == 2, "Moderate").when(points == 3, "High").otherwise("Critical")).withColumn("days", F.when(points == 2, 2).when(points == 3, 4).when(points > 3, 7))


def forecast(rows: DataFrame, readiness_: str, tss: str, acwr: str, sleep: str, declining: Column, days: int = 7) -> DataFrame:
    """Hours to full recovery and a row for each coming day."""
    rate = F.lit(24.0) * F.when(F.col(acwr) > 1.3, 0.8).otherwise(1.0) * F.when(declining, 0.85).otherwise(1.0) * F.when(F.col(sleep) < 50, 0.75).otherwise(1.0) * F.when(F.col(tss) > 200, 0.8).otherwise(1.0)
    x = rows.withColumn("rate", rate).withColumn("hours", (100.0 - F.col(readiness_)) / (F.col("rate") / 24))
    x = x.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    value = F.least(F.col(readiness_) + (F.col("day") + 1) * F.col("rate") / 24, F.lit(100.0))
    return x.select(*rows.columns, "hours", "day", F.floor(F.round(value, 9)).cast("int").alias("predicted"), F.greatest(100 - F.col("day") * 10, F.lit(30)).alias("confidence"))


def sleep_debt(rows: DataFrame, key: str, optimal: int = 480) -> DataFrame:
    """Minutes missing against the optimum, nights, mean of the deficits, band; rows(key, total_sleep)."""
    lack = F.when(F.col("total_sleep") < optimal, optimal - F.col("total_sleep"))
    g = rows.groupBy(key).agg(F.coalesce(F.sum(lack), F.lit(0)).alias("debt_minutes"), F.count(lack).alias("debt_days"), F.coalesce(F.avg(lack), F.lit(0.0)).alias("mean_deficit"))
    d = F.col("debt_minutes")
    return g.withColumn("recovery_days", d / float(optimal)).withColumn("severity", F.when(d < 120, "low").when(d < 300, "moderate").otherwise("high"))


def sleep_pattern(rows: DataFrame, key: str) -> DataFrame:
    """Mean and spread of duration, consistency, and the trend of the last three scores against rows four to six from the start."""
    w = Window.partitionBy(key).orderBy("date", "night_id")
    x = rows.select(key, "total_sleep", "sleep_score", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    # whole minutes have exact sums, so a spread on a border of the advice (60) is that border, however the rows were dealt
    total = lambda c: F.sum(c.cast("decimal(18,0)")).cast("decimal(19,0)")
    m, known = F.col("total_sleep"), F.count("total_sleep")
    spread = F.stddev_pop(m)
    if isinstance(rows.schema["total_sleep"].dataType, (T.IntegerType, T.LongType)):
        spread = F.try_divide(F.sqrt((known.cast("decimal(19,0)") * total(m * m) - total(m) * total(m)).cast("double")), known)
    g = x.groupBy(key).agg(
        F.avg("total_sleep").alias("mean_minutes"), spread.alias("sd_minutes"), F.avg("sleep_score").alias("mean_score"), F.max("n").alias("n"),
        F.avg(F.when(F.col("i") > F.col("n") - 3, F.col("sleep_score"))).alias("recent"), F.avg(F.when(F.col("i").between(4, 6), F.col("sleep_score"))).alias("older"),
    )
    trend = F.when((F.col("n") < 3) | F.col("older").isNull(), "Stable").when(F.col("recent") > F.col("older") + 2, "Improving").when(F.col("recent") < F.col("older") - 2, "Declining").otherwise("Stable")
    return g.select(key, "mean_minutes", "sd_minutes", "mean_score", F.greatest(100 - F.least(F.col("sd_minutes") / 120 * 100, F.lit(100.0)), F.lit(0.0)).alias("consistency"), trend.alias("trend"))


def running_spread(rows: DataFrame, key: str) -> DataFrame:
    """The spread of duration by running means over a key's nights in the order of their ids, with what rounding leaves of it on that way; all nights of a key are one row."""
    nights = F.transform(F.array_sort(F.collect_list(F.when(F.col("total_sleep").isNotNull(), F.struct("night_id", "total_sleep")))), lambda x: x["total_sleep"].cast("double"))

    def step(s, x):
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    spread = F.aggregate("nights", F.struct(*(F.lit(0.0).alias(x) for x in ("n", "mean", "squares"))), step, lambda s: F.try_divide(s["squares"], s["n"]))
    return rows.groupBy(key).agg(nights.alias("nights")).select(key, F.sqrt(spread).alias("running_sd"))


def best_bedtime(rows: DataFrame, key: str) -> DataFrame:
    """The night of the best score, the last on ties."""
    return rows.groupBy(key).agg(F.max_by("night_id", F.struct(F.coalesce("sleep_score", F.lit(0)), "date", "night_id")).alias("night_id"))


def correlation(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Pearson's r (0 without spread) with a pseudo p of 5 / (|t| + 5) and its reading."""
    # as in half_split_trend, what lacks its partner is nulled, not filtered
    known = rows.select(key, F.when(F.col(y).isNotNull(), F.col(x)).alias("x"), F.when(F.col(x).isNotNull(), F.col(y)).alias("y"))
    pairs = known.groupBy(key).agg(F.count("x").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("n >= 2")
    # not F.corr: in ANSI mode it divides by zero where a key's values are all equal
    c = F.try_divide("c", F.col("sx") * F.col("sy"))
    r = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    p = pairs.select(key, "n", r.alias("r"))
    t = F.abs(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.least(F.col("r") * F.col("r"), F.lit(0.9999)))))
    strength = F.when(F.abs("r") < 0.3, "weak").when(F.abs("r") < 0.6, "moderate").otherwise("strong")
    return p.select(key, "n", "r", (5 / (t + 5)).alias("pseudo_p"), strength.alias("strength"))
