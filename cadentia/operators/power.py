"""Power analytics over points(workout_id, seq, ts_s, power, ...)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Durations in seconds.
CURVE_DURATIONS = (1, 5, 10, 15, 20, 30, 60, 120, 180, 300, 600, 1200, 1800, 3600)
STANDARD_DURATIONS = (1, 5, 15, 30, 60, 300, 1200, 3600)
PEAK_DURATIONS = (5, 15, 30, 60, 300, 1200, 3600)
KEY_DURATIONS = (5, 60, 300, 1200, 3600)


def _by_workout() -> Window:
    return Window.partitionBy("workout_id").orderBy("seq")


def np_tss(points: DataFrame, window: int = 30) -> DataFrame:
    """Normalized power for training stress: forward means over ``window`` rows (nulls keep their place, tail windows count)."""
    mean = F.avg("power").over(_by_workout().rowsBetween(0, window - 1))
    rolled = points.select("workout_id", mean.alias("m"))
    return rolled.groupBy("workout_id").agg(F.floor(F.sqrt(F.sqrt(F.avg(F.pow("m", F.lit(4)))))).cast("int").alias("np"))


def np_power(points: DataFrame, window: int = 30) -> DataFrame:
    """Normalized power for power analysis: nulls dropped, whole windows of integer means only."""
    w = _by_workout()
    known = points.where("power is not null").select(
        "workout_id", "power", "seq", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("workout_id")).alias("n")
    )
    size = F.least(F.col("n"), F.lit(window))
    rolled = known.withColumn("s", F.sum("power").over(w.rowsBetween(0, window - 1))).where(F.col("rn") <= F.col("n") - size + 1)
    mean = F.expr(f"s div least(n, {window})")
    return rolled.groupBy("workout_id").agg(F.floor(F.sqrt(F.sqrt(F.avg(F.pow(mean, F.lit(4)))))).cast("int").alias("np"))


def mean_max(points: DataFrame, durations: tuple[int, ...]) -> DataFrame:
    """(workout_id, duration_s, max_power): best integer mean over whole windows of each duration, one sort for all."""
    w = _by_workout()
    known = points.where("power is not null").select("workout_id", "seq", "power")
    known = known.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("workout_id")))
    sums = known.select("workout_id", "rn", "n", *[F.sum("power").over(w.rowsBetween(0, d - 1)).alias(f"s{d}") for d in durations])
    best = sums.groupBy("workout_id").agg(*[F.max(F.when(F.col("rn") <= F.col("n") - d + 1, F.expr(f"s{d} div {d}"))).alias(f"m{d}") for d in durations])
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("duration_s"), F.col(f"m{d}").cast("int").alias("max_power")) for d in durations]))
    return best.select("workout_id", rows.alias("x")).select("workout_id", "x.*").where("max_power is not null")


#: Samples in a block of a workout's prefix sums.
CURVE_BLOCK = 1024


def mean_max_full(points: DataFrame, longest: int = 7200) -> DataFrame:
    """The whole mean-maximal curve, every duration up to ``longest``, from prefix sums.

    Prefix sums are cut into blocks; a block of window starts meets the blocks of window ends that are near enough, and
    each meeting gives its best by duration. So a long workout is many tasks' work, and no row holds more than a block.
    """
    w = _by_workout()
    known = points.where("power is not null").select("workout_id", F.row_number().over(w).alias("i"), F.sum("power").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), "power")

    def blocks(at: Column, value: Column, name: str) -> DataFrame:
        held = known.groupBy("workout_id", F.floor(at / CURVE_BLOCK).cast("int").alias(name)).agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("i"), value.alias("s")))).alias("x"))
        return held.select("workout_id", name, F.element_at("x", 1)["i"].alias(f"{name}0"), F.element_at("x", -1)["i"].alias(f"{name}1"), F.transform("x", lambda x: x["s"]).alias(f"{name}s"))

    starts = blocks(F.col("i") - 1, F.col("s") - F.col("power"), "a").withColumn("b", F.explode(F.sequence("a", F.col("a") + F.lit(-(-longest // CURVE_BLOCK)))))
    meetings = starts.join(blocks(F.col("i"), F.col("s"), "b"), ["workout_id", "b"])
    meetings = meetings.withColumns({"low": F.greatest(F.lit(1), F.col("b0") - F.col("a1")), "high": F.least(F.lit(longest), F.col("b1") - F.col("a0"))}).where("low <= high")
    # little data, much work: as many tasks as there are partitions
    meetings = meetings.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "workout_id", "a", "b")
    best = F.expr("transform(sequence(low, high), d -> array_max(transform(sequence(greatest(a0, b0 - d), least(a1, b1 - d)), i -> (bs[i + d - b0] - as[i - a0]) div d)))")
    found = meetings.select("workout_id", "low", F.posexplode(best).alias("n", "max_power"))
    return found.groupBy("workout_id", (F.col("low") + F.col("n")).alias("duration_s")).agg(F.max("max_power").cast("int").alias("max_power"))


def aggregate_curves(curves: DataFrame) -> DataFrame:
    """Best of all workouts by duration; zero watts never count."""
    return curves.where("max_power > 0").groupBy("duration_s").agg(F.max("max_power").alias("max_power"), F.count("*").alias("n_workouts"))


def key_powers(curve: DataFrame, targets: tuple[int, ...] = KEY_DURATIONS) -> DataFrame:
    """(target_s, duration_s, max_power): the exact or else nearest duration (the shorter on a tie), if within a tenth of the target."""
    spark = curve.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in targets], "target_s int"))  # a handful of rows
    apart = F.abs(F.col("duration_s") - F.col("target_s"))
    near = curve.join(wanted, apart <= F.expr("target_s div 10"))
    return near.groupBy("target_s").agg(F.min_by(F.struct("duration_s", "max_power"), F.struct(apart, "duration_s")).alias("x")).select("target_s", "x.*")


def critical_power(curve: DataFrame, durations: tuple[int, ...] = (180, 300, 1200)) -> DataFrame:
    """Two-parameter fit of power on 1/t: slope W', intercept CP, r2, and FTP as 95 % of CP; workouts with all durations only."""
    x = 1.0 / F.col("duration_s")
    fits = curve.where(F.col("duration_s").isin(list(durations))).groupBy("workout_id").agg(
        F.count("*").alias("n"), F.regr_slope("max_power", x).alias("w_prime"), F.regr_intercept("max_power", x).alias("cp"), F.regr_r2("max_power", x).alias("r2")
    )
    return fits.where(F.col("n") == len(durations)).select("workout_id", "w_prime", "cp", "r2", F.floor(F.round(F.col("cp") * 0.95, 6)).cast("int").alias("ftp"))


def w_prime_balance(points: DataFrame, cp: int, w_prime: float) -> DataFrame:
    """Lowest balance and seconds below zero: expenditure above CP, recovery below, capped at W'.

    The cap is one-sided, so the recursion has a closed form in running sums:
    balance = W' + S - max(0, running max of S).
    """
    w = _by_workout()
    known = points.where("power is not null").select("workout_id", "seq", "ts_s", "power")
    steps = known.select(
        "workout_id", "seq", (F.col("ts_s") - F.lag("ts_s").over(w)).alias("dt"), (F.lit(cp) - F.lag("power").over(w)).alias("gain")
    ).where("dt is not null")
    total = steps.withColumn("s", F.sum(F.col("dt") * F.col("gain")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.greatest(F.lit(0), F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    balance = total.withColumn("balance", F.lit(w_prime) + F.col("s") - top)
    return balance.groupBy("workout_id").agg(
        F.least(F.lit(w_prime), F.min("balance")).alias("min_balance"), F.coalesce(F.sum(F.when(F.col("balance") < 0, F.col("dt"))), F.lit(0)).alias("seconds_below_zero")
    )


def time_to_exhaustion(rows: DataFrame, power: str, cp: int, available: float) -> DataFrame:
    """Seconds left at a power; at or below CP the largest 32-bit number stands for no limit."""
    seconds = F.when(F.col(power) <= cp, F.lit(4294967295)).otherwise(F.floor(F.greatest(F.lit(0.0), F.lit(available)) / (F.col(power) - cp)).cast("long"))
    return rows.withColumn("tte_s", seconds)


def power_metrics(points: DataFrame, ftp: int) -> DataFrame:
    """Average and normalized power, variability index, efficiency factor, intensity factor."""
    base = points.groupBy("workout_id").agg(F.sum("power").alias("sp"), F.count("power").alias("np_n"), F.sum("heart_rate").alias("sh"), F.count("heart_rate").alias("nh"))
    joined = base.where("np_n > 0").join(np_power(points), "workout_id")
    avg = F.expr("sp div np_n")
    return joined.select(
        "workout_id",
        avg.cast("int").alias("avg_power"),
        "np",
        F.try_divide("np", avg.cast("double")).alias("vi"),
        F.try_divide("np", F.expr("sh div nullif(nh, 0)").cast("double")).alias("ef"),
        (F.col("np") / ftp).alias("intensity_factor"),
    )


def work_distribution(points: DataFrame, ftp: int) -> DataFrame:
    """Kilojoules above FTP (the excess) and at or below it."""
    return points.groupBy("workout_id").agg(
        F.sum(F.when(F.col("power") > ftp, F.col("power") - ftp).otherwise(0)).alias("a"), F.sum(F.when(F.col("power") <= ftp, F.col("power")).otherwise(0)).alias("b")
    ).select("workout_id", F.expr("a div 1000").alias("kj_above"), F.expr("b div 1000").alias("kj_below"))


def quadrants(points: DataFrame, ftp: int, cadence: int) -> DataFrame:
    """Shares of samples by force (power above FTP) and speed (cadence above the threshold)."""
    known = points.where("power is not null and cadence is not null")
    high, fast = F.col("power") > ftp, F.col("cadence") > cadence
    share = lambda c: F.sum(F.when(c, 1).otherwise(0)) * 100.0 / F.count("*")
    return known.groupBy("workout_id").agg(
        share(high & fast).alias("q1"), share(high & ~fast).alias("q2"), share(~high & ~fast).alias("q3"), share(~high & fast).alias("q4")
    )


def power_balance(points: DataFrame) -> DataFrame:
    """Left and right shares and a score of 50 less the left share's distance from 50."""
    left = (F.col("power") * F.col("balance") / 200).cast("int")
    split = points.where("power is not null and balance is not null").select("workout_id", left.alias("l"), (F.col("power") - left).alias("r"))
    sums = split.groupBy("workout_id").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l + r > 0")
    pct = F.col("l") * 100.0 / (F.col("l") + F.col("r"))
    return sums.select("workout_id", pct.alias("left_pct"), (100 - pct).alias("right_pct"), (50 - F.abs(pct - 50)).alias("score"))


# -- smoothing before the fourth-power mean -------------------------------------------------------


#: Longest window of a smoothing, in samples; digits by which a block of exponential weights may shrink.
LONGEST_WINDOW, DIGITS = 3600, 200


def _known(points: DataFrame) -> DataFrame:
    """Known powers of each workout, numbered from 0."""
    return points.where("power is not null").select("workout_id", F.col("power").cast("double").alias("x"), (F.row_number().over(_by_workout()) - 1).alias("i"))


def exponential_means(points: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(workout_id, i, m): the exponential mean of known powers up to each, alpha of the new one; the first is its own mean.

    Running sums of rescaled powers in blocks, so long workouts are many tasks' work: within a block weights shrink by DIGITS digits at most, so no double
    overflows, and of earlier blocks only the last one's end can still be seen.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and at most 1")
    if alpha == 1:
        return _known(points).select("workout_id", "i", F.col("x").alias("m"))
    rest = 1 - alpha
    block = max(1, min(1 << 16, int(DIGITS / -math.log10(rest))))
    place = F.col("i") % block
    term = F.when(F.col("i") == 0, F.col("x")).otherwise(F.col("x") * alpha) * F.pow(F.lit(rest), -place)
    rows = _known(points).withColumn("block", F.floor(F.col("i") / block))
    running = F.sum(term).over(Window.partitionBy("workout_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("workout_id", "block", "i", (running * F.pow(F.lit(rest), place)).alias("own"))
    ends = rows.where(place == block - 1).select("workout_id", (F.col("block") + 1).alias("block"), F.col("own").alias("carried"))
    return rows.join(ends, ["workout_id", "block"], "left").select("workout_id", "i", (F.col("own") + F.coalesce("carried", F.lit(0.0)) * F.pow(F.lit(rest), place + 1)).alias("m"))


def weighted_means(points: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(workout_id, i, m): the mean of the last powers by the user's weights, the last weight for the newest; the first powers take the last weights alone."""
    if not weights or len(weights) > LONGEST_WINDOW or min(weights) < 0 or weights[-1] <= 0:
        raise ValueError(f"1 to {LONGEST_WINDOW} weights, none negative, the last one above 0")
    n = len(weights)
    frame = Window.partitionBy("workout_id").orderBy("i").rowsBetween(-(n - 1), 0)
    xs = F.collect_list("x").over(frame)  # at most a window
    rows = _known(points).select("workout_id", "i", xs.alias("xs"))
    used = F.slice(F.array(*map(F.lit, map(float, weights))), n + 1 - F.size("xs"), F.size("xs"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("ws", used).select("workout_id", "i", (total(F.zip_with("xs", "ws", lambda x, w: x * w)) / total("ws")).alias("m"))


def smoothed_np(points: DataFrame, kind: str = "RollingAverage", window: int = 30, alpha: float = 0.3, weights: tuple[float, ...] = ()) -> DataFrame:
    """(workout_id, np): fourth root of the mean fourth power of smoothed known powers.

    RollingAverage over ``window`` samples (the first ones over what there is), ExponentialMovingAverage by ``alpha``, WeightedMovingAverage by ``weights``
    (without any, equal ones over the window). Other kinds, and windows outside 1 to 3600, are an error.
    """
    if not 1 <= window <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} seconds")
    if kind == "ExponentialMovingAverage":
        means = exponential_means(points, alpha)
    elif kind == "WeightedMovingAverage" and weights:
        means = weighted_means(points, weights)
    elif kind in ("RollingAverage", "WeightedMovingAverage"):
        mean = F.avg("x").over(Window.partitionBy("workout_id").orderBy("i").rowsBetween(-(window - 1), 0))
        means = _known(points).select("workout_id", mean.alias("m"))
    else:
        raise ValueError(f"unknown smoothing {kind}")
    return means.groupBy("workout_id").agg(F.pow(F.avg(F.pow("m", F.lit(4))), F.lit(0.25)).alias("np"))
