"""Sessions, laps and sport changes of multi-sport files, from their messages in order.

The input is a table of messages (file, n, number, at, values), as fit.read_messages gives it. Each sample takes the value of the last
event message before it: an as-of assignment by windows over a file's messages, without joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators import power

#: Message numbers, seconds between the epochs of FIT and Unix.
SESSION, LAP, RECORD, EPOCH = 18, 19, 20, 631_065_600
#: Sports by number, and what other numbers and files without a session count as.
SPORTS, OTHER_SPORT = {1: "Running", 2: "Cycling", 5: "Swimming", 6: "Rowing", 15: "Triathlon", 26: "CrossTraining"}, "Cycling"
#: The sub-sport whose sessions are intervals.
INTERVALS = 1
#: Record fields: name, number, scale, offset.
CHANNELS = [("elevation", 2, 5, 500), ("heart_rate", 3, 1, 0), ("cadence", 4, 1, 0), ("distance", 5, 100, 0), ("speed", 6, 1000, 0), ("power", 7, 1, 0)]


def _field(number: int) -> Column:
    return F.col("values")[F.lit(number)]


def sport_named(code: Column) -> Column:
    """A sport by its number; null stays null."""
    return F.when(code.isNotNull(), F.coalesce(F.create_map(*(F.lit(x) for pair in SPORTS.items() for x in pair))[code.cast("int")], F.lit(OTHER_SPORT)))


def _session() -> Column:
    """A session message as a struct; without a start it begins before everything, without a sport it is the default."""
    return F.struct(
        (_field(2).cast("long") + EPOCH).alias("started"), F.coalesce(sport_named(_field(5)), F.lit(OTHER_SPORT)).alias("sport"),
        F.when(_field(6) == INTERVALS, "Interval").otherwise("Endurance").alias("workout_type"), F.coalesce(F.floor(_field(8) / 1000).cast("int"), F.lit(0)).alias("duration_seconds"),
    )


def sessions(found: DataFrame) -> DataFrame:
    """(file, session, started, sport, workout_type, duration_seconds): session messages numbered by their start, then their place.

    Sessions of a file are one after the other; started (Unix seconds) is null where the message has none. A file without a
    session message has no row here.
    """
    order = Window.partitionBy("file").orderBy(F.col("s.started").asc_nulls_first(), "n")
    rows = found.where(F.col("number") == SESSION).select("file", "n", _session().alias("s"))
    return rows.select("file", F.row_number().over(order).alias("session"), "s.*")


def samples(found: DataFrame) -> DataFrame:
    """Samples of each file in message order: workout_id (the file), seq, ts_s, session, sport, lap_number, sport_transition and channels.

    lap_number is one more than the index of the last lap message before the sample, 1 before any. A lap whose sport differs from the last
    lap's with a sport marks the sample before it (sport_transition). Session and sport are those of the last session that had started; samples
    before every start belong to the first, those of a file without sessions to session 1 of the default sport. ts_s counts from the start of
    the file's first session message (else its first timed sample), 0 at least; a sample without a time has the last one's, 0 before any.
    """
    by = Window.partitionBy("file")
    order = by.orderBy("n")
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_lap, is_record, is_session = (F.col("number") == x for x in (LAP, RECORD, SESSION))
    rows = found.where(F.col("number").isin(SESSION, LAP, RECORD))
    rows = rows.select("file", "n", "number", "at", "values", F.when(is_session, _session()).alias("own"), F.when(is_lap, sport_named(_field(25))).alias("lap_sport"), F.when(is_lap, _field(254) + 1).alias("lap_at"))
    earlier = F.last("lap_sport", ignorenulls=True).over(before)
    rows = rows.select(
        "*", F.coalesce(F.last("lap_at", ignorenulls=True).over(until), F.lit(1)).cast("int").alias("lap_number"), (F.col("lap_sport") != earlier).alias("changed"), F.count_if(is_record).over(until).alias("reached"),
        F.last(F.when(is_record, F.col("at")), ignorenulls=True).over(until).alias("clock"), F.first(F.when(is_record, F.col("at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_at"),
        F.first("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("main"),
    )
    rows = rows.withColumn("sport_transition", F.coalesce(F.bool_or("changed").over(Window.partitionBy("file", "reached")), F.lit(False)))
    # by time: sessions at their start, ahead of samples of that second; a sample's time is the last known one
    time = F.when(is_session, F.col("own.started")).otherwise(F.coalesce("clock", "first_at"))
    by_time = by.orderBy(F.asc_nulls_first("time"), ~is_session, "n")
    timed = rows.where(~is_lap).withColumn("time", time)
    told = F.last("own", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("own", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    timed = timed.select("*", F.greatest(F.count("own").over(by_time.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)).cast("int").alias("session"), F.coalesce(told, first).alias("is_in"))
    channels = [(_field(number) / scale - offset).alias(name) for name, number, scale, offset in CHANNELS]
    since = F.greatest(F.coalesce(F.col("clock") - F.coalesce("main.started", "first_at"), F.lit(0)), F.lit(0)).cast("int")
    out = timed.where(is_record).select(
        F.col("file").alias("workout_id"), (F.col("reached") - 1).cast("int").alias("seq"), since.alias("ts_s"), "session", F.coalesce("is_in.sport", F.lit(OTHER_SPORT)).alias("sport"), "lap_number", "sport_transition", *channels
    )
    return out.withColumns({name: F.col(name).cast("int") for name in ("elevation", "heart_rate", "cadence", "power")})


def summaries(points: DataFrame) -> DataFrame:
    """Each session of samples in one row (workout_id, session): whole-number means, largest heart rate, normalised power of cycling, pace of running from the mean speed,
    last known distance, climbing between known elevations (null with fewer than two), cadence. What a session has no value for is null."""
    key = ["workout_id", "session"]
    w = Window.partitionBy(*key).orderBy("seq")
    climb = F.col("elevation") - F.last("elevation", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mean = lambda c: F.expr(f"sum({c}) div nullif(count({c}), 0)").cast("int").alias(f"avg_{c}")
    speed = F.avg("speed")
    told = points.withColumn("up", climb).groupBy(*key, "sport").agg(
        mean("heart_rate"), F.max("heart_rate").alias("max_heart_rate"), mean("power"), mean("cadence"), F.when((F.first("sport") == "Running") & (speed > 0), 1000 / (speed * 60)).alias("avg_pace"),
        F.max_by(F.col("distance"), F.when(F.col("distance").isNotNull(), F.col("seq"))).alias("total_distance"), F.when(F.count("elevation") > 1, F.sum(F.when(F.col("up") > 0, F.col("up")).otherwise(0))).cast("int").alias("elevation_gain"),
        F.count("*").alias("samples"), (F.max("ts_s") - F.min("ts_s")).alias("seconds"),
    )
    rides = points.where("sport = 'Cycling'").select(F.struct(*key).alias("workout_id"), "seq", "power")
    watts = power.np_power(rides).select("workout_id.*", F.col("np").alias("normalized_power"))
    return told.join(watts, key, "left")
