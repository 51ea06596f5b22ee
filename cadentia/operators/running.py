"""Running and swimming analytics over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Race distances in km.
RACES = [("1500m", 1.5), ("1_mile", 1.60934), ("3000m", 3.0), ("2_miles", 3.21869), ("5000m", 5.0), ("10000m", 10.0), ("15k", 15.0), ("half_marathon", 21.0975), ("marathon", 42.195)]
#: Paces by name as multiples of threshold pace.
TRAINING_PACES = [("easy", 1.25), ("marathon", 1.07), ("threshold", 1.0), ("interval", 0.94), ("repetition", 0.88)]


def _w() -> Window:
    return Window.partitionBy("workout_id").orderBy("seq")


def average_pace(points: DataFrame) -> DataFrame:
    """Minutes per km from the last sample's time and distance, counted from zero."""
    last = points.groupBy("workout_id").agg(F.max_by("ts_s", "seq").alias("t"), F.max_by("distance", "seq").alias("d"))
    return last.where("d > 0").select("workout_id", ((F.col("t") / 60) / (F.col("d") / 1000)).alias("avg_pace"))


def _segments(points: DataFrame) -> DataFrame:
    """Steps between adjacent rows with known, growing distance and time and both elevations: dt, dd, grade in per cent, pace."""
    lag = lambda c: F.lag(c).over(_w())
    steps = points.select("workout_id", "seq", "pace", (F.col("ts_s") - lag("ts_s")).alias("dt"), (F.col("distance") - lag("distance")).alias("dd"), (F.col("elevation") - lag("elevation")).alias("de"))
    return steps.where("dt > 0 and dd > 0 and de is not null").withColumn("grade", F.col("de") / F.col("dd") * 100)


def grade_factor(g: Column) -> Column:
    """What a gradient costs: 3.3 % a per cent up to 10, 5 % above, 2 % below -10."""
    return F.when(F.abs(g) <= 10, 1 + 0.033 * g).when(g > 10, 1 + 0.05 * g).otherwise(1 + 0.02 * g)


def normalized_graded_pace(points: DataFrame) -> DataFrame:
    """Unweighted mean over segments of their pace times the gradient's factor."""
    pace = (F.col("dt") / 60) / (F.col("dd") / 1000)
    return _segments(points).groupBy("workout_id").agg(F.avg(pace * grade_factor(F.col("grade"))).alias("ngp"))


def grade_adjusted_pace(points: DataFrame) -> DataFrame:
    """Adjusted time over distance; a factor of 0 leaves its segment's time out."""
    return _segments(points).groupBy("workout_id").agg(
        ((F.sum(F.try_divide(F.col("dt").cast("double"), grade_factor(F.col("grade")))) / 60) / (F.sum("dd") / 1000)).alias("gap")
    )


def splits(points: DataFrame, length: float = 1000.0) -> DataFrame:
    """(workout_id, split, distance, seconds, pace): a split ends at the first sample at least ``length`` on from its own start.

    The next starts where that sample stands, so borders drift: a fold over the
    ordered samples of a workout, not a division of the distance. What is left at the end is a split too.
    """
    xs = points.where("distance is not null").groupBy("workout_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts_s", "distance"))).alias("xs"))
    empty = F.array().cast("array<struct<distance:double,seconds:bigint>>")
    first = F.element_at("xs", 1)
    state = F.struct(first["distance"].cast("double").alias("d0"), first["ts_s"].cast("bigint").alias("t0"), empty.alias("out"))

    def step(acc, x):
        d, t = x["distance"].cast("double"), x["ts_s"].cast("bigint")
        done = d - acc["d0"] >= length
        row = F.array(F.struct((d - acc["d0"]).alias("distance"), (t - acc["t0"]).alias("seconds")))
        return F.struct(F.when(done, d).otherwise(acc["d0"]).alias("d0"), F.when(done, t).otherwise(acc["t0"]).alias("t0"), F.when(done, F.concat(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    last = F.element_at("xs", -1)
    rest = lambda a: F.array(F.struct((last["distance"].cast("double") - a["d0"]).alias("distance"), (last["ts_s"].cast("bigint") - a["t0"]).alias("seconds")))
    finish = lambda a: F.when(last["distance"].cast("double") > a["d0"], F.concat(a["out"], rest(a))).otherwise(a["out"])
    rows = xs.select("workout_id", F.posexplode(F.aggregate("xs", state, step, finish)).alias("i", "s"))
    return rows.select("workout_id", (F.col("i") + 1).alias("split"), "s.distance", "s.seconds", ((F.col("s.seconds") / 60) / (F.col("s.distance") / 1000)).alias("pace"))


def efficiency_factor(points: DataFrame) -> DataFrame:
    """Metres a second of graded pace for each beat."""
    hr = points.groupBy("workout_id").agg(F.expr("sum(heart_rate) div nullif(count(heart_rate), 0)").alias("hr"))
    return normalized_graded_pace(points).join(hr, "workout_id").select("workout_id", F.try_divide(F.try_divide(F.lit(1000.0), F.col("ngp") * 60), F.col("hr").cast("double")).alias("ef"))


def elevation(points: DataFrame) -> DataFrame:
    """Gain, loss and climbing speed; only adjacent rows count."""
    up = points.select("workout_id", "ts_s", (F.col("elevation") - F.lag("elevation").over(_w())).alias("d"))
    g = up.groupBy("workout_id").agg(F.sum(F.greatest("d", F.lit(0))).alias("gain"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("loss"), F.max("ts_s").alias("t"))
    return g.select("workout_id", "gain", "loss", F.try_divide(F.col("gain").cast("double"), F.col("t") / 3600).alias("vam"))


def gradients(points: DataFrame) -> DataFrame:
    """Mean and steepest gradient and seconds in five bands."""
    g = F.col("grade")
    band = lambda c: F.coalesce(F.sum(F.when(c, F.col("dt"))), F.lit(0))
    return _segments(points).groupBy("workout_id").agg(
        F.avg("grade").alias("mean_grade"), F.max("grade").alias("max_grade"), band(g < -10).alias("steep_down"), band((g >= -10) & (g < -3)).alias("down"),
        band((g >= -3) & (g < 3)).alias("flat"), band((g >= 3) & (g < 10)).alias("up"), band(g >= 10).alias("steep_up"),
    )


def elevation_stress(points: DataFrame) -> DataFrame:
    hours = F.col("t") / 3600
    last = points.groupBy("workout_id").agg(F.max("ts_s").alias("t"))
    return elevation(points).join(last, "workout_id").select("workout_id", (50 * hours + (F.col("gain") + F.col("loss")) / 100 * 10).alias("stress"))


def vdot(speed_m_min: Column) -> Column:
    return F.least(F.greatest(0.000104 * speed_m_min * speed_m_min + 0.182 * speed_m_min - 4.6, F.lit(20.0)), F.lit(85.0))


def race_times(points: DataFrame) -> DataFrame:
    """VDOT of the average pace and a time in minutes for each race distance."""
    base = average_pace(points).where("avg_pace > 0").select("workout_id", vdot(1000 / F.col("avg_pace")).alias("vdot"))
    race = F.explode(F.array(*[F.struct(F.lit(n).alias("race"), F.lit(d).alias("km")) for n, d in RACES]))
    fade = F.when(F.col("km") <= 5, 1.0).when(F.col("km") <= 10, 1.05).when(F.col("km") <= 21.1, 1.12).otherwise(1.20)
    return base.select("workout_id", "vdot", race.alias("r")).select("workout_id", "vdot", "r.*").withColumn("minutes", F.col("km") * 240 / F.col("vdot") * fade)


def training_paces(points: DataFrame) -> DataFrame:
    """Paces from VDOT: threshold as the tables invert it, the others as its multiples."""
    base = average_pace(points).where("avg_pace > 0").select("workout_id", vdot(1000 / F.col("avg_pace")).alias("vdot"))
    threshold = 1000 / F.sqrt((F.col("vdot") + 4.6 - 0.182) / 0.000104)
    return base.select("workout_id", *[(threshold * m).alias(n) for n, m in TRAINING_PACES])


def dynamics(points: DataFrame) -> DataFrame:
    """Integer means of contact time and oscillation, mean stride, ratings, share of rows with any of them."""
    any_ = F.col("ground_contact_time").isNotNull() | F.col("vertical_oscillation").isNotNull() | F.col("stride_length").isNotNull()
    g = points.groupBy("workout_id").agg(
        F.expr("sum(ground_contact_time) div nullif(count(ground_contact_time), 0)").alias("gct"), F.expr("sum(vertical_oscillation) div nullif(count(vertical_oscillation), 0)").alias("vo"),
        F.avg("stride_length").alias("stride"), F.floor(F.count_if(any_) * 100.0 / F.count("*")).cast("int").alias("coverage"),
    )

    def rating(c, ends):
        out = F.when(F.col(c).isNull(), F.lit(None).cast("string"))
        for end, name in zip(ends, ("Excellent", "Good", "Average", "BelowAverage"), strict=True):
            out = out.when(F.col(c) <= end, name)
        return out.otherwise("Poor")

    s = F.col("stride")
    stride = F.when(s.isNull(), F.lit(None)).when(s.between(1.0, 1.6), "Good").when(s.between(0.8, 1.8), "Average").otherwise("BelowAverage")
    return g.select("*", rating("gct", (200, 250, 300, 350)).alias("gct_rating"), rating("vo", (60, 80, 100, 120)).alias("vo_rating"), stride.alias("stride_rating"))


def cadence_variation(points: DataFrame) -> DataFrame:
    """Truncated mean cadence and its coefficient of variation in per cent: spread about the truncated mean."""
    mean = points.groupBy("workout_id").agg(F.expr("sum(cadence) div nullif(count(cadence), 0)").alias("mean"))
    joined = points.where("cadence is not null").select("workout_id", "cadence").join(mean, "workout_id")
    return joined.groupBy("workout_id").agg(F.first("mean").alias("mean_cadence"), (F.sqrt(F.avg(F.pow(F.col("cadence") - F.col("mean"), 2))) / F.first("mean") * 100).alias("cv_pct"))


# -- swimming -------------------------------------------------------------------------------------


def laps(points: DataFrame) -> DataFrame:
    """(workout_id, lap_number, strokes, seconds, swolf, pace_100, stroke_type); swolf is 0 without strokes or time."""
    g = points.where("lap_number is not null").groupBy("workout_id", "lap_number").agg(
        F.coalesce(F.sum("stroke_count"), F.lit(0)).alias("strokes"), (F.max("ts_s") - F.min("ts_s")).alias("seconds"), F.max("distance").alias("d"),
        F.min_by("stroke_type", F.when(F.col("stroke_type").isNotNull(), F.col("seq"))).alias("stroke_type"),
    )
    swolf = F.when((F.col("strokes") > 0) & (F.col("seconds") > 0), F.col("strokes") + F.col("seconds")).otherwise(0)
    return g.select("workout_id", "lap_number", "strokes", "seconds", swolf.alias("swolf"), F.try_divide(F.col("seconds").cast("double"), F.col("d") / 100).alias("pace_100"), "stroke_type")


def strokes_per_lap(points: DataFrame) -> DataFrame:
    """The mean over laps of the mean over their rows, and all strokes."""
    g = points.where("stroke_count is not null").groupBy("workout_id", "lap_number").agg(F.avg("stroke_count").alias("m"), F.sum("stroke_count").alias("s"))
    return g.groupBy("workout_id").agg(F.avg("m").alias("strokes_per_lap"), F.sum("s").alias("strokes"))


def swolf(points: DataFrame) -> DataFrame:
    """Mean, best and truncated variation (above 255: 0) of laps with strokes and time."""
    g = laps(points).where("swolf > 0").groupBy("workout_id").agg(F.avg("swolf").alias("mean"), F.min("swolf").alias("best"), F.stddev_pop("swolf").alias("sd"))
    cv = F.floor(F.try_divide(F.col("sd") * 100, "mean"))
    return g.select("workout_id", "mean", "best", F.when(cv > 255, 0).otherwise(cv).cast("int").alias("cv_pct"))


def stroke_mix(points: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of each stroke and their share of the workout's seconds; unknown codes are freestyle."""
    names = {0: "Freestyle", 1: "Backstroke", 2: "Breaststroke", 3: "Butterfly", 4: "Drill", 5: "Mixed", 6: "IM"}
    name = F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[F.col("stroke_type")], F.lit("Freestyle"))
    g = points.where("stroke_type is not null").groupBy("workout_id", name.alias("stroke")).agg(F.count("*").alias("n"))
    return g.join(sessions.select("workout_id", "duration_seconds"), "workout_id").select("workout_id", "stroke", "n", (F.col("n") * 100.0 / F.col("duration_seconds")).alias("pct"))


def swim_pace(points: DataFrame) -> DataFrame:
    """Seconds per 100 m from speed: mean, best, variation."""
    g = points.where("speed > 0").select("workout_id", (100 / F.col("speed")).alias("p")).groupBy("workout_id").agg(F.avg("p").alias("mean"), F.min("p").alias("best"), F.stddev_pop("p").alias("sd"))
    return g.select("workout_id", "mean", "best", (F.col("sd") / F.col("mean") * 100).alias("cv_pct"))


def stroke_efficiency(points: DataFrame) -> DataFrame:
    """Distance a stroke, strokes a minute and a rating."""
    g = laps(points).where("strokes > 0 and seconds > 0").groupBy("workout_id").agg(F.sum("strokes").alias("s"), F.sum("seconds").alias("t"))
    far = points.groupBy("workout_id").agg(F.max("distance").alias("d"))
    dps = F.col("d") / F.col("s")
    rating = F.when(dps >= 2.5, "Excellent").when(dps >= 2.0, "Good").when(dps >= 1.5, "Average").when(dps >= 1.0, "BelowAverage").otherwise("Poor")
    return g.join(far, "workout_id").select("workout_id", dps.alias("distance_per_stroke"), (F.col("s") * 60 / F.col("t")).alias("stroke_rate"), rating.alias("rating"))
