"""Queries over file messages, made from the events table: sessions, laps, transitions, physiology, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators import physiology, quality
from cadentia.plans.common import i8, r4, rounded, sql
from cadentia.sources import sessions

c = F.col
CODES = (1, 2, 5, 6, 15, 26, 11)  # 11 is no sport that is known


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of messages for each user: now and then a session, a lap with or without a sport, else a record; some records have no time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    i = c("event_id")
    rows = e.select(c("user_id").alias("file"), n.alias("n"), i, c("value"), F.when(i % 23 == 5, 18).when(i % 7 == 3, 19).otherwise(20).alias("number"))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))
    code = F.element_at(F.array(*map(F.lit, CODES)), (i % 7 + 1).cast("int"))
    time = 1000 + c("n") * 3
    session = [pair(5, F.when(i % 5 > 0, F.element_at(F.array(*map(F.lit, CODES)), (i % 6 + 1).cast("int")))), pair(2, F.when(i % 11 > 0, time - i % 60)), pair(8, (i % 7200) * 1000), pair(6, i % 3)]
    lap = [pair(254, F.when(i % 4 > 0, F.floor(i / 7) % 12)), pair(25, F.when(i % 3 > 0, F.element_at(F.array(*map(F.lit, CODES)), (i % 4 + 1).cast("int"))))]
    record = [pair(253, F.when(i % 13 > 0, time)), pair(3, F.when(i % 6 > 0, 90 + i % 100)), pair(7, F.when(i % 5 > 0, F.floor("value"))), pair(4, F.when(i % 9 > 0, 60 + i % 60)), pair(5, F.when(i % 10 > 0, c("n") * 300)), pair(6, F.when(i % 8 > 0, i % 5000)), pair(2, F.when(i % 12 > 0, 3000 + i % 115))]
    kept = lambda pairs: F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    values = F.when(c("number") == 18, kept(session)).when(c("number") == 19, kept(lap)).otherwise(kept(record))
    return rows.select("file", "n", "number", F.when((c("number") == 20) & (i % 13 > 0), time + sessions.EPOCH).alias("at"), values.alias("values"))


def sample_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.samples(messages(spark, sf_dir))
    return rounded(s.select("workout_id", "seq", "ts_s", "session", "sport", "lap_number", "sport_transition", "elevation", "distance", "speed"))


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Resting heart rates, respiration and stress of each user, in an order that isn't that of time."""
    i = c("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(c("user_id").alias("athlete"), (i * 7919 % 9000).alias("t"), i.alias("n"))
    return e.where("n % 10 = 0").withColumn("resting_hr", 40 + c("n") % 30), e.where("n % 3 = 1").withColumn("respiration", c("n") % 20), e.where("n % 4 = 2").withColumn("stress", c("n") % 101)


def merged_physiology(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, breaths, stress = readings(spark, sf_dir)
    return rounded(physiology.claim_in_order(base, [(breaths, "respiration", 60), (stress, "stress", 300)], "athlete", "t", "n"))


LISTED = "[" + ", ".join(map(str, CODES)) + "]"
NAMED = lambda x: "CASE " + f"{x} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in sessions.SPORTS.items()) + " ELSE 'Cycling' END"
MESSAGES = f"""messages AS (SELECT *, 1000 + n * 3 AS time, CASE WHEN event_id % 23 = 5 THEN 18 WHEN event_id % 7 = 3 THEN 19 ELSE 20 END AS number FROM (
  SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, event_id, value FROM events))"""
SAID = f"""said AS (SELECT file, n, CASE WHEN event_id % 11 > 0 THEN time - event_id % 60 ELSE -1e9 END AS started, CASE WHEN event_id % 5 > 0 THEN {NAMED(f'{LISTED}[event_id % 6 + 1]')} ELSE 'Cycling' END AS sport, event_id % 11 > 0 AS has_start FROM messages WHERE number = 18)"""
LAPS = f"""laps AS (SELECT file, n, CASE WHEN event_id % 4 > 0 THEN event_id // 7 % 12 + 1 END AS lap, CASE WHEN event_id % 3 > 0 THEN {NAMED(f'{LISTED}[event_id % 4 + 1]')} END AS sport FROM messages WHERE number = 19),
changes AS (SELECT file, n FROM (SELECT file, n, sport, lag(sport) OVER (PARTITION BY file ORDER BY n) AS p FROM laps WHERE sport IS NOT NULL) WHERE sport <> p)"""
RECORDS = """records AS (SELECT m.*, row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS seq, coalesce(lead(n) OVER (PARTITION BY file ORDER BY n), 1000000000) AS next_n,
  max(CASE WHEN event_id % 13 > 0 THEN time END) OVER (PARTITION BY file ORDER BY n) AS clock, min(CASE WHEN event_id % 13 > 0 THEN time END) OVER (PARTITION BY file) AS first_time FROM messages m WHERE number = 20)"""
# a sample's session by counting those that had started; the first where none had
SAMPLES = """samples AS (SELECT r.file AS workout_id, seq, event_id, value, r.n,
  greatest(coalesce(clock - coalesce((SELECT CASE WHEN has_start THEN started END FROM said WHERE said.file = r.file ORDER BY said.n LIMIT 1), first_time), 0), 0) AS ts_s,
  greatest((SELECT count(*) FROM said WHERE said.file = r.file AND started <= coalesce(clock, first_time)), 1) AS session,
  coalesce((SELECT max_by(sport, (started, said.n)) FROM said WHERE said.file = r.file AND started <= coalesce(clock, first_time)), (SELECT min_by(sport, (started, said.n)) FROM said WHERE said.file = r.file), 'Cycling') AS sport,
  coalesce((SELECT max_by(lap, laps.n) FROM laps WHERE laps.file = r.file AND laps.n < r.n AND lap IS NOT NULL), 1) AS lap_number,
  EXISTS (SELECT 1 FROM changes WHERE changes.file = r.file AND changes.n > r.n AND changes.n < r.next_n) AS sport_transition,
  CASE WHEN event_id % 12 > 0 THEN trunc((3000 + event_id % 115) / 5.0::DOUBLE - 500) END AS elevation, CASE WHEN event_id % 10 > 0 THEN r.n * 3.0::DOUBLE END AS distance, CASE WHEN event_id % 8 > 0 THEN event_id % 5000 / 1000.0::DOUBLE END AS speed,
  CASE WHEN event_id % 6 > 0 THEN 90 + event_id % 100 END AS heart_rate, CASE WHEN event_id % 5 > 0 THEN CAST(floor(value) AS BIGINT) END AS power, CASE WHEN event_id % 9 > 0 THEN 60 + event_id % 60 END AS cadence FROM records r)"""
FILES = (MESSAGES, SAID, LAPS, RECORDS, SAMPLES)
# whole windows of known watts only
RIDES = """known AS (SELECT workout_id, session, power, row_number() OVER w AS rn, count(*) OVER (PARTITION BY workout_id, session) AS n, sum(power) OVER (w ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS s
  FROM samples WHERE sport = 'Cycling' AND power IS NOT NULL WINDOW w AS (PARTITION BY workout_id, session ORDER BY seq)),
np AS (SELECT workout_id, session, CAST(floor(avg(CAST(s // least(n, 30) AS DOUBLE) ** 4) ** 0.25) AS BIGINT) AS np FROM known WHERE rn <= n - least(n, 30) + 1 GROUP BY 1, 2)"""
CLIMBS = "climbs AS (SELECT workout_id, session, sum(greatest(e - p, 0)) AS gain FROM (SELECT workout_id, session, elevation AS e, lag(elevation) OVER (PARTITION BY workout_id, session ORDER BY seq) AS p FROM samples WHERE elevation IS NOT NULL) WHERE p IS NOT NULL GROUP BY 1, 2)"
# one reading after the other, over a list of a user's rows
CLAIMS = """e AS (SELECT user_id AS athlete, event_id * 7919 % 9000 AS t, event_id AS n FROM events),
todo AS (SELECT athlete, t, n, kind, tolerance, v, row_number() OVER (PARTITION BY athlete ORDER BY kind, n) AS k FROM (SELECT *, 1 AS kind, 60 AS tolerance, n % 20 AS v FROM e WHERE n % 3 = 1 UNION ALL SELECT *, 2, 300, n % 101 FROM e WHERE n % 4 = 2)),
state(athlete, k, rows) AS (
  SELECT athlete, 0, coalesce(list({'t': t, 'n': n, 'hr': 40 + n % 30, 'r': NULL::BIGINT, 's': NULL::BIGINT} ORDER BY n) FILTER (n % 10 = 0), []) FROM e GROUP BY 1
  UNION ALL SELECT athlete, k, CASE WHEN found > 0 THEN list_transform(rows, lambda x, i: CASE WHEN i = found THEN {'t': x.t, 'n': x.n, 'hr': x.hr, 'r': CASE WHEN kind = 1 THEN v ELSE x.r END, 's': CASE WHEN kind = 2 THEN v ELSE x.s END} ELSE x END)
      ELSE list_append(rows, {'t': t, 'n': n, 'hr': NULL::BIGINT, 'r': CASE WHEN kind = 1 THEN v END, 's': CASE WHEN kind = 2 THEN v END}) END
    FROM (SELECT state.athlete, todo.k, rows, t, n, kind, v, coalesce(list_position(list_transform(rows, lambda x: abs(x.t - todo.t) < tolerance), true), 0) AS found FROM state JOIN todo ON todo.athlete = state.athlete AND todo.k = state.k + 1))"""

QUERIES = {
    "physiology_merge": merged_physiology,
    "fit_samples": sample_sums,
    "fit_summaries": lambda spark, d: rounded(sessions.summaries(sessions.samples(messages(spark, d)))),
    "fit_sessions": lambda spark, d: rounded(sessions.sessions(messages(spark, d))),
    "sequence_checks": lambda spark, d: rounded(quality.sequence_checks(sessions.samples(messages(spark, d)).withColumn("ts_s", c("ts_s") - F.when(c("seq") % 37 == 36, 700).otherwise(0)).withColumn("sport", F.when(c("workout_id") % 2 == 0, "Triathlon").otherwise(c("sport"))), transitions=2)),
}

ORACLES = {
    "physiology_merge": sql("SELECT athlete, x.t AS t, x.n AS n, x.hr AS resting_hr, CAST(x.r AS DOUBLE) AS respiration, CAST(x.s AS DOUBLE) AS stress FROM (SELECT athlete, unnest(arg_max(rows, k)) AS x FROM state GROUP BY 1)", CLAIMS),
    "fit_samples": sql(f"SELECT {i8('workout_id', 'workout_id')}, {i8('seq', 'seq')}, {i8('ts_s', 'ts_s')}, {i8('session', 'session')}, sport, {i8('lap_number', 'lap_number')}, sport_transition, {i8('elevation', 'elevation')}, {r4('distance', 'distance')}, {r4('speed', 'speed')} FROM samples", *FILES),
    "fit_summaries": sql(f"""SELECT {i8('workout_id', 'workout_id')}, {i8('session', 'session')}, sport, {i8('sum(heart_rate) // count(heart_rate)', 'avg_heart_rate')}, {i8('max(heart_rate)', 'max_heart_rate')}, {i8('sum(power) // count(power)', 'avg_power')}, {i8('sum(cadence) // count(cadence)', 'avg_cadence')},
        CASE WHEN sport = 'Running' AND avg(speed) > 0 THEN round(1000 / (avg(speed) * 60), 4) END AS avg_pace, {r4('max_by(distance, seq) FILTER (distance IS NOT NULL)', 'total_distance')}, CASE WHEN count(elevation) > 1 THEN CAST(any_value(gain) AS BIGINT) END AS elevation_gain, count(*) AS samples, {i8('max(ts_s) - min(ts_s)', 'seconds')}, {i8('any_value(np)', 'normalized_power')}
        FROM samples LEFT JOIN climbs USING (workout_id, session) LEFT JOIN np USING (workout_id, session) GROUP BY workout_id, session, sport""", *FILES, RIDES, CLIMBS),
    "fit_sessions": sql(f"SELECT {i8('file', 'file')}, {i8('row_number() OVER (PARTITION BY file ORDER BY started, n)', 'session')}, {i8('CASE WHEN has_start THEN started + 631065600 END', 'started')}, sport, CASE WHEN event_id % 3 = 1 THEN 'Interval' ELSE 'Endurance' END AS workout_type, {i8('event_id % 7200', 'duration_seconds')} FROM said JOIN messages USING (file, n)", *FILES),
    "sequence_checks": sql(f"""SELECT {i8('workout_id', 'workout_id')}, transitions, {i8('span', 'lap_span')}, {i8('back', 'largest_back')}, (NOT triathlon OR transitions <= 2) AND low > 0 AND span <= 500 AND back <= 300 AS ok FROM (
        SELECT workout_id, count(*) FILTER (sport_transition) AS transitions, max(lap_number) - min(lap_number) AS span, min(lap_number) AS low, greatest(coalesce(max(b), 0), 0) AS back, bool_or(workout_id % 2 = 0 OR sport = 'Triathlon') AS triathlon
        FROM (SELECT *, lag(t) OVER (PARTITION BY workout_id ORDER BY seq) - t AS b FROM (SELECT *, ts_s - CASE WHEN seq % 37 = 36 THEN 700 ELSE 0 END AS t FROM samples)) GROUP BY 1)""", *FILES),
}
