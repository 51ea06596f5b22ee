"""Training stress, fitness and fatigue series, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators.power import np_tss

#: Estimated stress an hour by sport.
HOURLY = {"Cycling": 60, "Running": 70, "Swimming": 80, "Rowing": 75, "Triathlon": 65, "CrossTraining": 50}
#: Days whose weights stay in a double's range: (7 / 6) ** 512 is about 1e34.
BLOCK_DAYS = 512
#: What an hour in one sport is worth in another.
CONVERSION = {
    ("Running", "Cycling"): 0.75, ("Running", "Swimming"): 1.2, ("Running", "Rowing"): 0.9,
    ("Cycling", "Running"): 1.33, ("Cycling", "Swimming"): 1.6, ("Cycling", "Rowing"): 1.2,
    ("Swimming", "Running"): 0.83, ("Swimming", "Cycling"): 0.625, ("Swimming", "Rowing"): 0.75,
    ("Rowing", "Running"): 1.11, ("Rowing", "Cycling"): 0.83, ("Rowing", "Swimming"): 1.33,
}


def lookup(key: Column, table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


# -- stress of one workout ------------------------------------------------------------------------


def _with_duration(values: DataFrame, sessions: DataFrame) -> DataFrame:
    return values.join(sessions.select("workout_id", "duration_seconds", "ftp", "lthr", "threshold_pace"), "workout_id")


def power_tss(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """hours * IF^2 * 100 with IF = normalized power / FTP; sessions hold duration and the athlete's thresholds."""
    factor = F.col("np") / F.col("ftp")
    return _with_duration(np_tss(points).where("np is not null"), sessions).select("workout_id", factor.alias("intensity_factor"), (F.col("duration_seconds") / 3600 * factor * factor * 100).alias("tss"))


def hr_tss(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """IF is the mean share of threshold heart rate over samples that have one."""
    mean = points.groupBy("workout_id").agg(F.avg("heart_rate").alias("hr")).where("hr is not null")
    factor = F.col("hr") / F.col("lthr")
    return _with_duration(mean, sessions).select("workout_id", factor.alias("intensity_factor"), (F.col("duration_seconds") / 3600 * factor * factor * 100).alias("tss"))


def pace_tss(points: DataFrame, sessions: DataFrame, gradient: bool) -> DataFrame:
    """IF is the mean of threshold pace over pace; running adds climbing between consecutive known elevations."""
    w = Window.partitionBy("workout_id").orderBy("seq")
    climbs = points.where("elevation is not null").select("workout_id", (F.col("elevation") - F.lag("elevation").over(w)).alias("up"))
    gain = climbs.groupBy("workout_id").agg(F.coalesce(F.sum(F.when(F.col("up") > 0, F.col("up"))), F.lit(0)).alias("gain"))
    slow = points.where("pace > 0").groupBy("workout_id").agg(F.avg(1 / F.col("pace")).alias("inverse"))
    joined = _with_duration(slow.join(gain, "workout_id", "left"), sessions)
    factor = F.col("threshold_pace") * F.col("inverse")
    tss = F.col("duration_seconds") / 3600 * factor * factor * 100
    if gradient:
        tss = tss * (1 + F.when(F.coalesce("gain", F.lit(0)) > 0, 0.02 * F.col("gain") / F.col("duration_seconds")).otherwise(0.0))
    return joined.select("workout_id", factor.alias("intensity_factor"), tss.alias("tss"))


def estimated_tss(workouts: DataFrame) -> DataFrame:
    """Hours times the sport's estimate."""
    return workouts.select("workout_id", (F.col("duration_seconds") / 3600 * lookup(F.col("sport"), HOURLY)).alias("tss"))


def tss(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """The first method that gives a value: power for cycling, pace for running and swimming, then heart rate, then the estimate.

    All methods come from one window over a workout's samples, one aggregation and one join with the sessions.
    """
    order = Window.partitionBy("workout_id").orderBy("seq")
    climbed = F.col("elevation") - F.last("elevation", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.select("workout_id", "heart_rate", "pace", F.avg("power").over(order.rowsBetween(0, 29)).alias("m"), climbed.alias("up"))
    g = rows.groupBy("workout_id").agg(
        F.floor(F.sqrt(F.sqrt(F.avg(F.pow("m", F.lit(4)))))).cast("int").alias("np"), F.avg("heart_rate").alias("hr"), F.avg(F.when(F.col("pace") > 0, 1 / F.col("pace"))).alias("inverse"), F.coalesce(F.sum(F.when(F.col("up") > 0, F.col("up"))), F.lit(0)).alias("gain"),
    )
    x = sessions.select("workout_id", "sport", "duration_seconds", "ftp", "lthr", "threshold_pace").join(g, "workout_id", "left")
    squared = lambda factor: F.col("duration_seconds") / 3600 * factor * factor * 100
    pace = squared(F.col("threshold_pace") * F.col("inverse"))
    climbing = 1 + F.when(F.coalesce("gain", F.lit(0)) > 0, 0.02 * F.col("gain") / F.col("duration_seconds")).otherwise(0.0)
    first = F.when(F.col("sport") == "Cycling", squared(F.col("np") / F.col("ftp"))).when(F.col("sport") == "Running", pace * climbing).when(F.col("sport") == "Swimming", pace)
    x = x.select("workout_id", "sport", "duration_seconds", first.alias("first"), squared(F.col("hr") / F.col("lthr")).alias("beats"), (F.col("duration_seconds") / 3600 * lookup(F.col("sport"), HOURLY)).alias("estimate"))
    name = F.when(F.col("sport") == "Cycling", "power").otherwise("pace")
    return x.select(
        "workout_id", "sport", "duration_seconds", F.coalesce("first", "beats", "estimate").alias("tss"),
        F.when(F.col("first").isNotNull(), name).when(F.col("beats").isNotNull(), "heart_rate").otherwise("estimated").alias("method"),
    )


def check_tss(rows: DataFrame) -> DataFrame:
    """Status of a stress value: negative, above 300 an hour, below 10 an hour in more than ten minutes, or ok."""
    hourly = F.try_divide(F.col("tss"), F.col("duration_seconds") / 3600)
    return rows.withColumn(
        "status", F.when(F.col("tss") < 0, "negative").when(hourly > 300, "too_high").when((hourly < 10) & (F.col("duration_seconds") > 600), "too_low").otherwise("ok")
    )


def rpe_tss(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tss", F.col("rpe") * F.col("rpe") * F.col("duration_seconds") / 3600 * 10)


# -- fitness, fatigue, form -----------------------------------------------------------------------


def daily_tss(workouts: DataFrame, key: str) -> DataFrame:
    """Sum (nulls as 0), count and list of a day's stress for each series key."""
    return workouts.groupBy(key, "date").agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.count("*").alias("n_workouts"))


def pmc(daily: DataFrame, key: str, ctl_days: int = 42, atl_days: int = 7, ramp_days: int = 7, spike: float = 1.5, start: str | None = None, end: str | None = None) -> DataFrame:
    """CTL, ATL, TSB, ramp rate and spikes over each key's dense calendar.

    The calendar begins ``ctl_days`` before the first emitted day with seeds of 0.
    TSB is yesterday's CTL less today's ATL (the first computed day uses its own CTL);
    the ramp spans ``ramp_days - 1`` steps; a spike is ATL above ``spike`` times the mean of the
    seven emitted days before, from the eighth on.

    Only days with workouts are ordered: an exponential mean is a running sum with weights that grow without
    end, so their calendar is cut into blocks of days, where sums run, and what the blocks before
    leave decays by the day. Between workouts the means decay in closed form, so the dense days
    are made once, from the gap to the next workout, and need no order but for ramps and spikes.
    """
    w = Window.partitionBy(key).orderBy("date")
    known = daily
    if start:
        known = known.where(F.col("date") >= F.date_sub(F.lit(start).cast("date"), ctl_days))
    if end:
        known = known.where(F.col("date") <= F.lit(end).cast("date"))
    # days with workouts are few beside the days they stand for: as many tasks as the dense days need, and the only shuffle of rows
    known = known.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    first = F.lit(start).cast("date") if start else F.min("date").over(Window.partitionBy(key))
    last = F.lit(end).cast("date") if end else F.col("date")
    keep = {"ctl": 1 - 1 / ctl_days, "atl": 1 - 1 / atl_days}
    gaps = known.select(
        key, "tss", F.col("date").alias("on"), first.alias("first"), F.min("date").over(Window.partitionBy(key)).alias("oldest"), F.lag("date").over(w).alias("last_on"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), last).alias("to"),
    ).withColumn("origin", F.least(F.col("oldest"), F.date_sub("first", ctl_days)))
    pos = F.datediff("on", "origin")
    gaps = gaps.withColumns({"block": F.floor(pos / BLOCK_DAYS).cast("int"), "j": (pos % BLOCK_DAYS).cast("double")})
    inside = Window.partitionBy(key, "block").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    gaps = gaps.withColumns({f"{c}_in": F.pow(F.lit(d), "j") * F.sum(F.col("tss") * F.pow(F.lit(d), -F.col("j"))).over(inside) * (1 - d) for c, d in keep.items()})
    # what each block leaves at its end, then what reaches a block from those before
    left = {c: (F.max_by(f"{c}_in", "j") * F.pow(F.lit(d), BLOCK_DAYS - 1 - F.max("j"))).alias(c) for c, d in keep.items()}
    ends = gaps.groupBy(F.col(key).alias("of"), F.col("block").alias("at")).agg(*left.values())
    before = F.collect_list(F.struct("at", "ctl", "atl")).over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))  # a key's blocks
    carry = lambda c, d: F.aggregate(before, F.lit(0.0), lambda a, e: a + e[c] * F.pow(F.lit(d), BLOCK_DAYS * (F.col("at") - 1 - e["at"])))
    carried = ends.select("of", "at", *(carry(c, d).alias(f"{c}_carry") for c, d in keep.items()))
    gaps = gaps.join(carried, F.col(key).eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    gaps = gaps.withColumns({f"{c}_on": F.col(f"{c}_in") + F.pow(F.lit(d), F.col("j") + 1) * F.col(f"{c}_carry") for c, d in keep.items()})
    by_day = Window.partitionBy(key).orderBy("on")
    eve = F.coalesce(F.lag("ctl_on").over(by_day) * F.pow(F.lit(keep["ctl"]), F.datediff("on", "last_on") - 1), F.lit(0.0))
    # in a select of its own: beside the explode the window would sort the dense days
    gaps = gaps.withColumn("eve", eve)
    gaps = gaps.select(key, "first", "on", "tss", "ctl_on", "atl_on", "eve", F.explode(F.sequence(F.when(F.col("last_on").isNull(), F.col("origin")).otherwise(F.col("on")), F.col("to"))).alias("date"))
    gone = F.datediff("date", "on")
    mean = lambda c, after: F.col(f"{c}_on") * F.pow(F.lit(keep[c]), after)
    days = gaps.select(
        key, "first", "date", F.when(gone == 0, F.col("tss")).otherwise(0.0).alias("tss"),
        *[F.when(gone < 0, 0.0).otherwise(mean(c, gone)).alias(c) for c in keep],
        F.when(gone < 0, 0.0).when(gone == 0, F.col("eve")).otherwise(mean("ctl", gone - 1)).alias("yesterday"),
    )
    rows = days.withColumn("tsb", F.col("yesterday") - F.col("atl")).withColumn("ramp", F.col("ctl") - F.lag("ctl", ramp_days - 1).over(w))
    out = rows.where("date >= first")
    recent = F.avg("atl").over(w.rowsBetween(-7, -1))
    return out.select(
        key, "date", "tss", "ctl", "atl", "tsb", (F.col("ramp") / (ramp_days / 7)).alias("ramp_rate"),
        ((F.row_number().over(w) > 7) & (F.col("atl") > spike * recent)).alias("atl_spike"),
    )


def tsb_class(tsb: Column) -> Column:
    return F.when(tsb >= 25, "VeryFresh").when(tsb >= 5, "Fresh").when(tsb >= -10, "Neutral").when(tsb >= -30, "Fatigued").otherwise("VeryFatigued")


def pmc_trends(series: DataFrame, key: str) -> DataFrame:
    """First against last day, mean ramp, spikes and days since the last; 14 days at least."""
    end = lambda f, c: f(c, "date")
    g = series.groupBy(key).agg(
        F.count("*").alias("n_days"),
        *[end(F.min_by, c).alias(f"{c}_first") for c in ("ctl", "atl", "tsb")], *[end(F.max_by, c).alias(f"{c}_last") for c in ("ctl", "atl", "tsb")],
        F.avg("ramp_rate").alias("mean_ramp"), F.count_if("atl_spike").alias("spikes"), F.max(F.when(F.col("atl_spike"), F.col("date"))).alias("last_spike"), F.max("date").alias("last_date"),
    ).where("n_days >= 14")

    def direction(c):
        pct = (F.col(f"{c}_last") - F.col(f"{c}_first")) / F.greatest(F.abs(f"{c}_first"), F.lit(1.0)) * 100
        return F.when(pct > 5, "Increasing").when(pct < -5, "Decreasing").otherwise("Stable").alias(f"{c}_trend")

    return g.select(key, "n_days", *[direction(c) for c in ("ctl", "atl", "tsb")], "mean_ramp", "spikes", F.datediff("last_date", "last_spike").alias("days_since_spike"))


def recommendations(series: DataFrame) -> DataFrame:
    """Advice codes of each day, in order of concern."""
    return series.withColumn(
        "advice",
        F.array_compact(F.array(
            tsb_class(F.col("tsb")),
            F.when(F.col("ramp_rate") > 8, F.lit("ramp_too_fast")).when(F.col("ramp_rate") < -5, F.lit("losing_fitness")),
            F.when(F.col("atl_spike"), F.lit("fatigue_spike")),
        )),
    )


def pmc_weekly(series: DataFrame, key: str) -> DataFrame:
    """Weeks by ISO year and week: stress summed, the rest averaged."""
    return series.groupBy(key, F.expr("extract(yearofweek from date)").alias("iso_year"), F.weekofyear("date").alias("iso_week")).agg(
        F.sum("tss").alias("tss"), F.avg("ctl").alias("ctl"), F.avg("atl").alias("atl"), F.avg("tsb").alias("tsb")
    )


def pmc_monthly(series: DataFrame, key: str) -> DataFrame:
    """Months: stress summed, the rest as on the last day."""
    return series.groupBy(key, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum("tss").alias("tss"), *[F.max_by(c, "date").alias(c) for c in ("ctl", "atl", "tsb")])


def longest_runs(series: DataFrame, key: str, condition: Column) -> DataFrame:
    """Longest stretch of consecutive days that meet the condition, 0 if none (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("date")
    island = F.sum(F.when(condition, 0).otherwise(1)).over(w)
    runs = series.select(key, condition.alias("hit"), island.alias("island")).groupBy(key, "island").agg(F.count_if("hit").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def warnings(series: DataFrame, key: str) -> DataFrame:
    """Long fatigue (TSB below -10), long detraining (above 15), fast ramps (over 8 in 6 steps), spikes."""
    w = Window.partitionBy(key).orderBy("date")
    tired = longest_runs(series, key, F.col("tsb") < -10).withColumnRenamed("longest", "tired_days")
    idle = longest_runs(series, key, F.col("tsb") > 15).withColumnRenamed("longest", "idle_days")
    fast = series.select(key, "atl_spike", (F.col("ctl") - F.lag("ctl", 6).over(w)).alias("d")).groupBy(key).agg(F.count_if(F.col("d") > 8).alias("fast_ramps"), F.count_if("atl_spike").alias("spikes"))
    return tired.join(idle, key).join(fast, key).select(key, "tired_days", "idle_days", "fast_ramps", "spikes", (F.col("tired_days") >= 7).alias("overreached"), (F.col("idle_days") >= 7).alias("detraining"))


def view_trends(series: DataFrame, key: str) -> DataFrame:
    """Change over the whole view by fixed margins, and how many seven-row windows gain more than 5 CTL."""
    w = Window.partitionBy(key).orderBy("date")
    moved = series.withColumn("d", F.col("ctl") - F.lag("ctl", 6).over(w))
    change = lambda c: F.max_by(c, "date") - F.min_by(c, "date")
    verdict = lambda c, m: F.when(change(c) > m, "up").when(change(c) < -m, "down").otherwise("flat")
    return moved.groupBy(key).agg(verdict("ctl", 2).alias("ctl"), verdict("atl", 3).alias("atl"), verdict("tsb", 5).alias("tsb"), F.count_if(F.col("d") > 5).alias("fast_weeks"))


def fill_tss(workouts: DataFrame) -> DataFrame:
    """Missing stress from the estimate."""
    return workouts.withColumn("tss", F.coalesce("tss", F.col("duration_seconds") / 3600 * lookup(F.col("sport"), HOURLY)))


# -- reports --------------------------------------------------------------------------------------


def report_totals(workouts: DataFrame, key: str) -> DataFrame:
    """Totals of each key; the most frequent sport is the last by name on ties."""
    by_sport = workouts.groupBy(key, "sport").count().groupBy(key).agg(F.max_by("sport", F.struct("count", "sport")).alias("main_sport"))
    totals = workouts.groupBy(key).agg(
        F.sum(F.coalesce("tss", F.lit(0.0))).alias("total_tss"), (F.sum("duration_seconds") / 3600).alias("total_hours"), F.count("*").alias("n"),
        (F.datediff(F.max("date"), F.min("date")) + 1).alias("span_days"), F.countDistinct("date").alias("training_days"),
    )
    return totals.join(by_sport, key).withColumn("mean_tss", F.col("total_tss") / F.col("n")).withColumn("training_pct", F.col("training_days") * 100.0 / F.col("span_days"))


def weekly_summary(workouts: DataFrame, iso: bool = False) -> DataFrame:
    """Weeks by (calendar year, ISO week), as the reports key them, or with ``iso`` by the ISO year."""
    year = F.expr("extract(yearofweek from date)") if iso else F.year("date")
    return workouts.groupBy(year.alias("year"), F.weekofyear("date").alias("week")).agg(
        F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), (F.sum(F.coalesce("tss", F.lit(0.0))) / 7).alias("mean_daily_tss"), F.sum("duration_seconds").alias("seconds"),
        (F.sum("total_distance") / 1000).alias("km"), F.count("*").alias("n"),
    )


def weekly_by_sport(workouts: DataFrame) -> DataFrame:
    return workouts.groupBy(F.year("date").alias("year"), F.weekofyear("date").alias("week"), "sport").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"), F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"))


def monthly_summary(workouts: DataFrame) -> DataFrame:
    """Months; the mean is over the days of the month."""
    days = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    g = workouts.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.sum("duration_seconds").alias("seconds"), F.count("*").alias("n"))
    return g.withColumn("mean_daily_tss", F.col("tss") / days)


# -- several sports -------------------------------------------------------------------------------


def combined_load(workouts: DataFrame) -> DataFrame:
    """Stress and duration of a day by sport, and the day's total."""
    sums = workouts.rollup("date", "sport").agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.sum("duration_seconds").alias("seconds"), F.grouping_id().alias("g"))
    return sums.where("g < 3").select("date", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("sport")).alias("sport"), "tss", "seconds")


def sport_distribution(workouts: DataFrame, end: str, days: int) -> DataFrame:
    """Each sport's share of stress, time and workouts in the days up to ``end``."""
    inside = workouts.where(F.col("date").between(F.date_sub(F.lit(end).cast("date"), days), F.lit(end).cast("date")))
    g = inside.groupBy("sport").agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.sum("duration_seconds").alias("seconds"), F.count("*").alias("n"))
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.sum(c).over(Window.partitionBy()))  # noqa: E731  a row a sport
    return g.select("sport", share("tss").alias("tss_pct"), share("seconds").alias("time_pct"), share("n").alias("count_pct"))


def seven_day_bins(workouts: DataFrame, start: str) -> DataFrame:
    """Seven-day bins from ``start`` to the last workout's, empty ones kept."""
    begin = F.lit(start).cast("date")
    bin_of = F.floor(F.datediff("date", begin) / 7).cast("int")
    sums = workouts.where(F.col("date") >= begin).groupBy(bin_of.alias("bin")).agg(F.sum(F.coalesce("tss", F.lit(0.0))).alias("tss"), F.sum("duration_seconds").alias("seconds"), F.count("*").alias("n"))
    bins = sums.agg(F.max("bin").alias("last")).where("last is not null").select(F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    return bins.join(sums, "bin", "left").select("bin", F.date_add(begin, F.col("bin") * 7).alias("week_start"), F.coalesce("tss", F.lit(0.0)).alias("tss"), F.coalesce("seconds", F.lit(0)).alias("seconds"), F.coalesce("n", F.lit(0)).alias("n"))


def equivalent_load(workouts: DataFrame, to: str) -> DataFrame:
    """Stress as it would count in another sport; pairs without a factor count 1."""
    factors = {a: f for (a, b), f in CONVERSION.items() if b == to}
    return workouts.withColumn("equivalent_tss", F.col("tss") * F.coalesce(lookup(F.col("sport"), factors), F.lit(1.0)))


def critical_swim_speed(workouts: DataFrame, key: str) -> DataFrame:
    """Minutes per 100 m: with three swims or more the mean of the three fastest of the best ten, with two the fastest, else null."""
    swims = workouts.where("sport = 'Swimming' and total_distance > 0").select(key, (F.col("duration_seconds") / 60 / (F.col("total_distance") / 100)).alias("pace"), "workout_id")
    ranked = swims.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("pace", "workout_id"))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where("rn <= 3").groupBy(key).agg(F.when(F.max("n") >= 3, F.avg("pace")).when(F.max("n") == 2, F.min("pace")).alias("css"), F.max("n").alias("n_swims"))
