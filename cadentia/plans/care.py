"""Recovery, quality, store, feature, plan and formula queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.functions import formula
from cadentia.operators import features, plan, quality, recovery, store
from cadentia.plans.common import i8, nights_query, points_query, r4, rounded, sql, workouts_query
from cadentia.sources import views
from cadentia.sources.views import COPIES, NIGHTS, POINTS, WORKOUTS

c = F.col


def scored(n):
    """Nights with sleep metrics, HRV status and deviation."""
    return recovery.sleep_metrics(n).withColumns({
        "status": recovery.hrv_status(c("rmssd"), c("baseline")), "score": recovery.hrv_score(c("rmssd"), c("baseline")),
        "deviation": (c("rmssd") - c("baseline")) / c("baseline") * 100, "rhr_elevation": (c("rhr") - 55) * 100.0 / 55, "concern": recovery.health_concern(c("rhr"), F.lit(None), c("stress")),
    })


def ready(n):
    return scored(n).withColumn("readiness", recovery.readiness(c("status"), c("score"), c("sleep_score"), c("battery_end"), c("stress"), F.lit(True)))


def sporty(p):
    """Points with their workout's sport, in one pass over its key."""
    k = c("workout_id")
    return p.withColumn("sport", F.when(k % 5 == 0, "Cycling").when(k % 5 == 1, "Running").when(k % 5 == 2, "Swimming").when(k % 5 == 3, "Rowing").otherwise("Triathlon"))


def jagged(p):
    """Points whose times repeat and fall back, to clean."""
    return p.withColumn("ts_s", c("seq") - F.when(c("seq") % 10 == 9, 3).otherwise(0))


FIELDS = ["power", "heart_rate", "cadence", "speed", "power_balance", "stride_length", "vertical_oscillation", "ground_contact_time", "stroke_count"]
def goals(spark, sf_dir, model=None):
    """A goal for each athlete with workouts, two months around the last of them."""
    k = c("athlete_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 3 + 1).cast("int"))
    g = views.workouts(spark, sf_dir).groupBy("athlete_id").agg(F.max("date").alias("last"), F.count("*").alias("n"))
    return g.select(
        k.alias("plan"), F.lit(model).alias("model") if model else pick(["traditional", "Block", "reverse"]).alias("model"), pick(["3:1", "2:1", "4:1"]).alias("pattern"), (k % 20).cast("int").alias("weeks"),
        F.date_add("last", (k % 60).cast("int")).alias("target"), F.when(k % 9 > 0, 20.0 + c("n") * 5 + k % 40).alias("ctl"),
    )


def planned(spark, sf_dir, model=None):
    return plan.plan_weeks(goals(spark, sf_dir, model))


def compared(spark, sf_dir):
    return plan.plan_vs_actual(plan.planned_workouts(planned(spark, sf_dir)), views.workouts(spark, sf_dir))


TODAY = "1997-03-01"


def copies_query(f):
    return lambda spark, d: rounded(f(views.copies(spark, d)))


QUERIES = {
    "hrv_status": nights_query(lambda n: scored(n).groupBy("status").agg(F.count("*").alias("n"), F.sum("score").alias("score"))),
    "hrv_ema": nights_query(lambda n: recovery.ema_baseline(n, "athlete_id", 0.2)),
    "hrv_baseline_mad": nights_query(lambda n: recovery.hrv_baseline(n, "athlete_id")),
    "overreaching_runs": nights_query(lambda n: recovery.overreaching(n, "athlete_id")),
    "sleep_score": nights_query(lambda n: recovery.sleep_metrics(n).select("night_id", "total_sleep", "efficiency", "sleep_score")),
    "sleep_stage_shares": nights_query(recovery.stage_shares),
    "sleep_sessions": lambda spark, d: rounded(recovery.session_from_stages(views.points(spark, d).select(c("workout_id").alias("session_id"), "seq", F.element_at(F.array(*map(F.lit, ("Awake", "Light", "Deep", "REM"))), (c("event_id") % 4 + 1).cast("int")).alias("stage"), F.lit(30).alias("seconds")))),
    "sleep_debt": nights_query(lambda n: recovery.sleep_debt(recovery.sleep_metrics(n), "athlete_id")),
    "sleep_pattern": nights_query(lambda n: recovery.sleep_pattern(recovery.sleep_metrics(n), "athlete_id")),
    "sleep_best_night": nights_query(lambda n: recovery.best_bedtime(recovery.sleep_metrics(n), "athlete_id")),
    "sleep_perf_corr": nights_query(lambda n: recovery.correlation(recovery.sleep_metrics(n), "athlete_id", "sleep_score", "rhr")),
    "body_battery": nights_query(lambda n: recovery.battery(n, 8.0)),
    "stress_levels": nights_query(lambda n: scored(n).groupBy(recovery.stress_level(c("stress")).alias("level"), "concern").agg(F.count("*").alias("n"))),
    "readiness_simple": nights_query(lambda n: scored(n).where("deviation is not null").select("night_id", recovery.readiness_simple(c("deviation"), c("sleep_score"), c("tsb")).alias("readiness"))),
    "readiness_composite": nights_query(lambda n: ready(n).select("night_id", "readiness", recovery.quality(c("readiness")).alias("quality"), recovery.limiting_factor(c("status"), c("sleep_score"), c("battery_end"), c("concern")).alias("limit"), (c("readiness") >= 75).alias("ready"))),
    "readiness_trend": nights_query(lambda n: recovery.half_split_trend(ready(n), "athlete_id", "readiness", 5.0, False)),
    "enhanced_form": nights_query(lambda n: scored(n).where("deviation is not null").select("night_id", recovery.form(c("tsb"), c("deviation"), c("sleep_score"), c("rhr"), F.lit(55)).alias("score")).withColumn("priority", recovery.form_band(c("score")))),
    "training_decision": nights_query(lambda n: recovery.decision(ready(n).select("night_id", "readiness", (c("night_id") % 250).cast("int").alias("planned"), (F.lit(0.8) + c("night_id") % 10 / F.lit(10.0)).alias("acwr")), "readiness", "planned", "acwr")),
    "overtraining_risk": nights_query(lambda n: recovery.overtraining(scored(n), "athlete_id", F.lit(0.8) + c("athlete_id") % 10 / F.lit(10.0))),
    "recovery_forecast": nights_query(lambda n: recovery.forecast(ready(n).select("night_id", "readiness", (c("night_id") % 250).alias("tss"), (F.lit(0.8) + c("night_id") % 10 / F.lit(10.0)).alias("acwr"), "sleep_score"), "readiness", "tss", "acwr", "sleep_score", c("night_id") % 3 == 0)),
    "rules_check": points_query(lambda p: quality.check_rules(sporty(p), quality.rules_table(p.sparkSession), FIELDS)),
    "rules_report": points_query(lambda p: quality.rule_report(sporty(p), quality.rules_table(p.sparkSession), FIELDS)),
    "rules_apply": points_query(lambda p: quality.apply_rules(sporty(p)).groupBy("sport").agg(F.sum("speed").alias("speed"), F.sum("power").alias("power"), F.sum("heart_rate").alias("heart_rate"))),
    "clean_points": points_query(lambda p: quality.clean_points(p.withColumns({"cadence": c("cadence") * 3, "vertical_oscillation": c("vertical_oscillation") + 80, "heart_rate": c("heart_rate") + 50})).groupBy("workout_id").agg(F.count("cadence").alias("cadence"), F.count("vertical_oscillation").alias("vo"), F.count("heart_rate").alias("hr"), F.count("power").alias("power"), F.count("pace").alias("pace"))),
    "clean_for_sport": points_query(lambda p: quality.clean_for_sport(sporty(p)).groupBy("sport").agg(F.count("speed").alias("speed"), F.count("stroke_count").alias("strokes"), F.count("stride_length").alias("stride"))),
    "sorted_distinct": points_query(lambda p: quality.sorted_distinct(jagged(p)).groupBy("workout_id").agg(F.count("*").alias("n"), F.sum(c("seq") * c("event_id")).alias("check"))),
    "reindexed": points_query(lambda p: quality.reindexed(jagged(p)).groupBy("workout_id").agg(F.sum("ts_s").alias("t"), F.max("ts_s").alias("last"))),
    "elevation_outliers": points_query(lambda p: quality.elevation_outliers(p.withColumn("elevation", F.when(c("event_id") % 29 == 0, 5000).otherwise(c("elevation")))).groupBy("workout_id").agg(F.count("elevation").alias("n"), F.max("elevation").alias("top"))),
    "store_issues": workouts_query(lambda w: quality.store_issues(w.withColumn("tss", c("tss") * 10 - 100), "2000-01-01")),
    "series_ok": points_query(lambda p: quality.series_ok(jagged(p))),
    "device_quirks": points_query(lambda p: quality.drop_start_spikes(quality.scale_dynamics(quality.scale_cadence(p, 1.5), 0.5, 1.5), 60, 20).groupBy("workout_id").agg(F.sum("cadence").alias("cadence"), F.sum("ground_contact_time").alias("gct"), F.sum("vertical_oscillation").alias("vo"), F.sum("power").alias("power"))),
    "dup_view": copies_query(store.duplicate_counts),
    "dup_remove": copies_query(store.duplicates_to_remove),
    "dup_kept": copies_query(lambda x: store.without_duplicates(x).groupBy("sport").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))),
    "dup_by_sport": copies_query(store.duplicates_by_sport),
    "new_rows": copies_query(lambda x: store.new_rows(x.where("id % 2 = 0"), x.where("id % 2 = 1"), "id").select("id")),
    "upsert_latest": copies_query(lambda x: store.upsert(x.where("id % 2 = 0"), x.where("id % 2 = 1"), ["athlete_id", "date"], "id").select("id", "athlete_id", "date")),
    "limit_before_filter": workouts_query(lambda w: store.query_workouts(w, 500, sport="Running", first="2001-01-01").select("workout_id", "date")),
    "trailing_week": workouts_query(lambda w: store.trailing_days(w, "1998-06-30", 7).select("workout_id", "date")),
    "sport_like": workouts_query(lambda w: store.sport_like(w, "ING", 60).groupBy("sport").agg(F.count("*").alias("n"))),
    "store_statistics": workouts_query(store.statistics),
    "merge_nearest": lambda spark, d: rounded(store.merge_nearest(views.points(spark, d).where("event_id % 2 = 0").select("workout_id", "ts_s"), views.points(spark, d).where("event_id % 2 = 1").select("workout_id", "ts_s", "heart_rate"), "workout_id", "ts_s", 2, "heart_rate")),
    "ml_calendar": workouts_query(lambda w: features.calendar(w.select("workout_id", "date"))),
    "ml_rolling": workouts_query(lambda w: features.rolling(w, "athlete_id", 28)),
    "ml_running_sums": workouts_query(lambda w: features.running_sums(w, "athlete_id")),
    "chrono_split": workouts_query(lambda w: features.chronological_split(w).groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("place").alias("places"))),
    "ml_features": lambda spark, d: rounded(features.feature_table(views.workouts(spark, d), views.points(spark, d)).select("workout_id", "weekday", "tss_7d", "seconds_28d", "cumulative_tss", "pct1", "pct5", "best_pace", "max_power")),
    "plan_traditional": lambda spark, d: rounded(planned(spark, d, "traditional"), 8),
    "plan_block": lambda spark, d: rounded(planned(spark, d, "block"), 8),
    "plan_reverse": lambda spark, d: rounded(planned(spark, d, "reverse"), 8),
    "plan_workouts": lambda spark, d: rounded(plan.planned_workouts(planned(spark, d)), 8),
    "plan_totals": lambda spark, d: rounded(plan.totals(planned(spark, d)), 8),
    "plan_vs_actual": lambda spark, d: rounded(compared(spark, d), 8),
    "plan_monitor": lambda spark, d: rounded(plan.monitor(compared(spark, d), goals(spark, d).select("plan", F.date_sub("target", c("weeks") * 7).alias("start")), TODAY), 8),
    "plan_adjust": lambda spark, d: rounded(plan.adjust(planned(spark, d), TODAY, plan.adjustment("recovery")), 8),
    "plan_increase": lambda spark, d: rounded(plan.adjust(plan.planned_workouts(planned(spark, d)), TODAY, plan.adjustment("increase", 15)).select("plan", "date", "planned_tss", "minutes"), 8),
    "formula_bikescore": workouts_query(lambda w: w.select("workout_id", formula.column(formula.BUILT_IN["bikescore"], {"duration": c("duration_seconds") / 3600, "IF": c("intensity_factor")}).alias("score"))),
    "formula_classic": lambda spark, d: rounded(views.workouts(spark, d).select("workout_id", formula.column(formula.BUILT_IN["classic"], {"duration": c("duration_seconds") / 3600, "IF": c("intensity_factor")}).alias("score")), 8),
    "formula_custom": workouts_query(lambda w: w.select("workout_id", formula.column("-(a + 2.5) * b / (a - 110) ^ 2 + 3", {"a": c("avg_heart_rate"), "b": c("avg_power")}).alias("score"))),
}

TOTAL = "(deep + light + rem)"


def band(x, low, high, points, drop, most):
    return f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {points} WHEN {x} < {low} THEN {x} / {low} * {points} ELSE {points} - least(({x} - {high}) / 10 * {drop}, {most}) END"


share = lambda s: f"(100.0::DOUBLE * {s} / {TOTAL})"
EFF, HRS = f"(100.0::DOUBLE * {TOTAL} / ({TOTAL} + awake))", f"({TOTAL} / 60.0::DOUBLE)"
SCORE = f"""CAST(floor(greatest(least(round({band(share('deep'), 13, 23, 15, 5, 10)} + {band(share('light'), 45, 55, 10, 3, 7)} + {band(share('rem'), 20, 25, 15, 5, 10)}
  + CASE WHEN {EFF} >= 85 THEN 30 ELSE {EFF} / 85 * 30 END + CASE WHEN {HRS} BETWEEN 7 AND 9 THEN 20 WHEN {HRS} < 7 THEN {HRS} / 7 * 20 ELSE 20 - least(({HRS} - 9) * 2, 10) END
  + CASE WHEN interruptions <= 2 THEN 10 ELSE greatest(10 - (interruptions - 2) * 2, 0) END, 9), 100), 0)) AS BIGINT)"""
STATUS = "CASE WHEN rmssd IS NULL OR baseline IS NULL THEN NULL WHEN 100 * (rmssd - baseline) / baseline >= -15 THEN 'Balanced' WHEN 100 * (rmssd - baseline) / baseline >= -30 THEN 'Unbalanced' ELSE 'Poor' END"
HSCORE = "CAST(CASE WHEN rmssd IS NULL THEN NULL WHEN baseline IS NULL THEN floor(greatest(least(rmssd, 100), 20)) ELSE floor(greatest(least(rmssd / baseline * 100, 100), 0)) END AS BIGINT)"
SCORED = f"scored AS (SELECT *, {TOTAL} AS total_sleep, {EFF} AS efficiency, {SCORE} AS sleep_score, {STATUS} AS status, {HSCORE} AS score, (rmssd - baseline) / baseline * 100 AS deviation, (rhr - 55) * 100.0::DOUBLE / 55 AS rhr_elevation, coalesce(rhr > 100, false) OR coalesce(stress > 75, false) AS concern FROM nights)"
READY = "ready AS (SELECT *, CAST(floor(round((CASE status WHEN 'Balanced' THEN 100 WHEN 'Unbalanced' THEN 65 WHEN 'Poor' THEN 30 ELSE coalesce(score, 50) END * 0.3::DOUBLE + sleep_score * 0.25::DOUBLE + battery_end * 0.25::DOUBLE + coalesce(100 - stress, 70) * 0.2::DOUBLE) / (0.3::DOUBLE + 0.25 + 0.25 + 0.2), 9)) AS BIGINT) AS readiness FROM scored)"
N = (NIGHTS, SCORED)
R = (NIGHTS, SCORED, READY)
SPORTY = "sp AS (SELECT *, CASE workout_id % 5 WHEN 0 THEN 'Cycling' WHEN 1 THEN 'Running' WHEN 2 THEN 'Swimming' WHEN 3 THEN 'Rowing' ELSE 'Triathlon' END AS sport FROM points)"
RULES = "rules(sport, field, low, high, severity, action) AS (VALUES " + ", ".join(f"('{s}', '{f}', {a}::DOUBLE, {b}::DOUBLE, '{v}', '{x}')" for s, f, a, b, v, x in quality.RULES) + ")"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT workout_id, seq, sport, '{f}' AS field, CAST({ {'power_balance': 'balance', 'vertical_oscillation': 'vertical_oscillation / 10.0::DOUBLE'}.get(f, f)} AS DOUBLE) AS value FROM sp" for f in FIELDS) + ")"
JAG = "jag AS (SELECT * EXCLUDE ts_s, seq - CASE WHEN seq % 10 = 9 THEN 3 ELSE 0 END AS ts_s FROM points)"
KEYS = "a.athlete_id = b.athlete_id AND a.date = b.date AND a.duration_seconds = b.duration_seconds AND a.sport = b.sport"
TREND = lambda v, t, d, m: f"(SELECT athlete_id, CASE WHEN n < 3 THEN 'Stable' WHEN {d} > {m} THEN 'Improving' WHEN {d} < -{m} THEN 'Declining' ELSE 'Stable' END AS trend FROM (SELECT athlete_id, count(*) AS n, avg(v) FILTER (i <= n0 // 2) AS a, avg(v) FILTER (i > n0 // 2) AS b FROM (SELECT athlete_id, {v} AS v, row_number() OVER (PARTITION BY athlete_id ORDER BY date, night_id) AS i, count(*) OVER (PARTITION BY athlete_id) AS n0 FROM {t} WHERE {v} IS NOT NULL) GROUP BY 1))"
PICK = lambda a, b, cc, d, e: f"CASE WHEN readiness < 30 THEN {a} WHEN readiness < 50 THEN {b} WHEN readiness < 70 THEN {cc} WHEN readiness < 85 THEN {d} ELSE {e} END"
RATE = "24 * CASE WHEN acwr > 1.3 THEN 0.8 ELSE 1 END * CASE WHEN night_id % 3 = 0 THEN 0.85 ELSE 1 END * CASE WHEN sleep_score < 50 THEN 0.75 ELSE 1 END * CASE WHEN tss > 200 THEN 0.8 ELSE 1 END::DOUBLE"
GOALS = """goals AS (SELECT o_custkey AS plan, ['traditional', 'block', 'reverse'][o_custkey % 3 + 1] AS own, [4, 3, 5][o_custkey % 3 + 1] AS cycle, o_custkey % 20 AS n, CAST(max(date) + CAST(o_custkey % 60 AS INT) AS DATE) AS target,
  7 * CASE WHEN o_custkey % 9 > 0 THEN 20.0::DOUBLE + count(*) * 5 + o_custkey % 40 ELSE 200 / 7.0::DOUBLE END AS tss FROM (SELECT athlete_id AS o_custkey, date FROM workouts) GROUP BY 1)"""
r8 = lambda expression, name: f"round(CAST({expression} AS DOUBLE), 8) + 0.0 AS {name}"
# phases by how many weeks come before them; whole weeks of a share in single precision
PHASES = """spans AS (SELECT plan, n, target, cycle, tss, w, model, CAST(floor(CAST(n AS FLOAT) * CAST(0.4 AS FLOAT)) AS INT) AS b, CAST(floor(CAST(n AS FLOAT) * CAST(0.3 AS FLOAT)) AS INT) AS u, CAST(floor(CAST(n AS FLOAT) * CAST(0.2 AS FLOAT)) AS INT) AS p, CAST(floor(CAST(n AS FLOAT) * CAST(0.5 AS FLOAT)) AS INT) AS v, CAST((w - 1) // 4 AS INT) AS block
  FROM (SELECT *, {model} AS model, unnest(range(1, n + 1)) AS w FROM goals)),
phases AS (SELECT *, CASE model WHEN 'traditional' THEN CASE WHEN w <= b THEN 'Base' WHEN w <= b + u THEN 'Build' WHEN w <= b + u + p THEN 'Peak' ELSE 'Taper' END
    WHEN 'block' THEN CASE WHEN block >= n // 4 THEN 'Taper' ELSE ['Accumulation', 'Intensification', 'Realization'][block % 3 + 1] END
    ELSE CASE WHEN w <= u THEN 'Intensity' WHEN w <= u + v THEN 'Volume' ELSE 'Race Prep' END END AS phase FROM spans),
multiplied AS (SELECT *, CASE WHEN phase = 'Base' THEN 1 + 0.3::DOUBLE * (w - 1) / b WHEN phase = 'Build' THEN 1.3 + 0.2::DOUBLE * (w - 1 - b) / u WHEN phase = 'Peak' THEN 1.5 - 0.1::DOUBLE * (w - 1 - b - u) / p
    WHEN phase = 'Taper' AND model = 'block' THEN 0.7 WHEN phase = 'Taper' THEN 1 - 0.5::DOUBLE * (w - 1 - b - u - p) / (n - b - u - p) WHEN phase = 'Accumulation' THEN 1.2 + 0.1::DOUBLE * block WHEN phase = 'Intensification' THEN 1 + 0.05::DOUBLE * block
    WHEN phase = 'Realization' THEN 0.9 + 0.02::DOUBLE * block WHEN phase = 'Intensity' THEN 0.8 WHEN phase = 'Volume' THEN 1.3 * (1 + 0.1::DOUBLE * (w - 1 - u) / v) ELSE 1 - 0.2::DOUBLE * (w - 1 - u - v) / (n - u - v) END AS m,
    w % (CASE WHEN model = 'block' THEN 4 ELSE cycle END) = 0 AND phase NOT IN ('Taper', 'Race Prep') AS recovery FROM phases),
weeks AS (SELECT plan, w AS week, target + CAST((w - 1 - n) * 7 AS INT) AS week_start, phase, recovery, tss * m * CASE WHEN recovery THEN 0.6 ELSE 1 END AS planned_tss FROM multiplied)"""
PLANS = lambda model="own": (WORKOUTS, GOALS, PHASES.replace("{model}", model))
WEEK_ROWS = f"SELECT plan, {i8('week', 'week')}, week_start, phase, recovery, {r8('planned_tss', 'planned_tss')}, {r8('planned_tss / 100 * 1.5', 'planned_hours')} FROM weeks"
SHARES = "shares(family, d, share) AS (VALUES " + ", ".join(f"('{p}', {d}, {s}::DOUBLE)" for p, f in [("Recovery", "Recovery"), ("Base", "Base"), ("Build", "Build"), ("Peak", "Peak"), ("Taper", "Taper"), ("Accumulation", "Base"), ("Intensification", "Build"), ("Realization", "Peak"), ("Intensity", "Build"), ("Volume", "Base"), ("Race Prep", "Peak")] for d, s in enumerate(plan.SHARES[f]) if s) + ")"
DAYS = """days AS (SELECT plan, week, week_start + d AS date, CASE WHEN recovery THEN 'Recovery' WHEN d IN (1, 3) THEN CASE WHEN phase IN ('Base', 'Accumulation') THEN 'Tempo' WHEN phase IN ('Build', 'Intensification') THEN 'Threshold' WHEN phase IN ('Peak', 'Realization') THEN 'Race' ELSE 'Endurance' END WHEN d = 6 THEN 'Recovery' ELSE 'Endurance' END AS workout_type,
  CASE WHEN recovery THEN 0.65 WHEN d IN (1, 3) THEN CASE WHEN phase IN ('Base', 'Accumulation') THEN 0.85 WHEN phase IN ('Build', 'Intensification') THEN 0.90 WHEN phase IN ('Peak', 'Realization') THEN 0.95 ELSE 0.75 END WHEN d = 5 THEN 0.70 WHEN d = 6 THEN 0.65 ELSE 0.75 END::DOUBLE AS intensity, planned_tss * share AS planned_tss
  FROM weeks JOIN shares ON family = CASE WHEN recovery THEN 'Recovery' ELSE phase END)"""
DONE = "cmp AS (SELECT plan, date, p AS planned_tss, coalesce(a, 0) AS actual_tss FROM (SELECT plan, date, max_by(planned_tss, week) AS p FROM days GROUP BY 1, 2) LEFT JOIN (SELECT athlete_id AS plan, date, sum(tss) AS a FROM workouts GROUP BY 1, 2) USING (plan, date))"
DAY_ROWS = f"SELECT plan, {i8('week', 'week')}, date, workout_type, {r8('intensity', 'intensity')}, {r8('planned_tss', 'planned_tss')}, {i8('floor(round(planned_tss / intensity / 100 * 60, 9))', 'minutes')} FROM days"
ORACLES = {
    "hrv_status": sql(f"SELECT status, count(*) AS n, {i8('sum(score)', 'score')} FROM scored GROUP BY 1", *N),
    "hrv_ema": sql(f"SELECT athlete_id, {r4('arg_max(b, i)', 'baseline')}, max(i) AS n FROM f GROUP BY 1", NIGHTS, "o AS (SELECT athlete_id, rmssd, row_number() OVER (PARTITION BY athlete_id ORDER BY date, night_id) AS i FROM nights WHERE rmssd IS NOT NULL)", "f AS (SELECT athlete_id, i, rmssd AS b FROM o WHERE i = 1 UNION ALL SELECT o.athlete_id, o.i, 0.2 * o.rmssd + 0.8 * f.b FROM f JOIN o ON o.athlete_id = f.athlete_id AND o.i = f.i + 1)"),
    "hrv_baseline_mad": sql(f"""SELECT athlete_id, {r4('avg(rmssd)', 'baseline')}, count(*) AS n FROM d WHERE mad < 0.001 OR 0.6745 * abs(rmssd - med) / mad <= 3.5 GROUP BY 1 HAVING count(*) >= 3""", NIGHTS,
        "l AS (SELECT athlete_id, rmssd FROM (SELECT athlete_id, rmssd, row_number() OVER (PARTITION BY athlete_id ORDER BY date DESC, night_id DESC) AS i FROM nights WHERE rmssd IS NOT NULL) WHERE i <= 7)",
        "m AS (SELECT athlete_id, list_sort(list(rmssd))[count(*) // 2 + 1] AS med, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 3)",
        "d AS (SELECT athlete_id, rmssd, med, mad FROM l JOIN m USING (athlete_id) JOIN (SELECT athlete_id, list_sort(list(abs(rmssd - med)))[count(*) // 2 + 1] AS mad FROM l JOIN m USING (athlete_id) GROUP BY 1) USING (athlete_id))"),
    "overreaching_runs": sql(f"""SELECT athlete_id, days AS consecutive_days, {r4('100 * (mean - start) / start', 'deviation_pct')}, {i8('least(floor(least(abs(100 * (mean - start) / start) * 1.5, 70)) + least(days * 5, 20), 100)', 'severity')} FROM (
        SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY days DESC, i) AS k FROM (SELECT athlete_id, g, count(*) AS days, avg(v) AS mean, arg_min(b, i) AS start, min(i) AS i FROM (
        SELECT *, sum(CASE WHEN v < b THEN 0 ELSE 1 END) OVER (PARTITION BY athlete_id ORDER BY i) AS g FROM (SELECT athlete_id, rmssd AS v, lag(rmssd) OVER w AS b, row_number() OVER w AS i FROM nights WHERE rmssd IS NOT NULL WINDOW w AS (PARTITION BY athlete_id ORDER BY date, night_id))) WHERE v < b GROUP BY 1, 2)) WHERE k = 1 AND days >= 3 AND 100 * (mean - start) / start <= -10""", NIGHTS),
    "sleep_score": sql(f"SELECT night_id, {i8('total_sleep', 'total_sleep')}, {r4('efficiency', 'efficiency')}, sleep_score FROM scored", *N),
    "sleep_stage_shares": sql(f"SELECT night_id, {r4(share('deep'), 'deep_pct')}, {r4(share('light'), 'light_pct')}, {r4(share('rem'), 'rem_pct')}, {share('deep')} <= 40 AND {share('light')} BETWEEN 30 AND 70 AND {share('rem')} BETWEEN 10 AND 35 AS plausible FROM nights", NIGHTS),
    "sleep_sessions": sql("SELECT workout_id AS session_id, " + ", ".join(i8(f"coalesce(sum(30) FILTER (s = {k}), 0) // 60", n) for n, k in (("awake", 0), ("light", 1), ("deep", 2), ("rem", 3))) + ", count(*) FILTER (s = 0 AND p <> 0) AS interruptions FROM (SELECT workout_id, event_id % 4 AS s, lag(event_id % 4) OVER (PARTITION BY workout_id ORDER BY seq) AS p FROM points) GROUP BY 1", POINTS),
    "sleep_debt": sql(f"SELECT athlete_id, {i8('d', 'debt_minutes')}, debt_days, {r4('m', 'mean_deficit')}, {r4('d / 480.0::DOUBLE', 'recovery_days')}, CASE WHEN d < 120 THEN 'low' WHEN d < 300 THEN 'moderate' ELSE 'high' END AS severity FROM (SELECT athlete_id, coalesce(sum(480 - total_sleep) FILTER (total_sleep < 480), 0) AS d, count(*) FILTER (total_sleep < 480) AS debt_days, coalesce(avg(480 - total_sleep) FILTER (total_sleep < 480), 0) AS m FROM scored GROUP BY 1)", *N),
    "sleep_pattern": sql(f"""SELECT athlete_id, {r4('m', 'mean_minutes')}, {r4('s', 'sd_minutes')}, {r4('ms', 'mean_score')}, {r4('greatest(100 - least(s / 120 * 100, 100), 0)', 'consistency')}, CASE WHEN n < 3 OR o IS NULL THEN 'Stable' WHEN r > o + 2 THEN 'Improving' WHEN r < o - 2 THEN 'Declining' ELSE 'Stable' END AS trend FROM (
        SELECT athlete_id, avg(total_sleep) AS m, stddev_pop(total_sleep) AS s, avg(sleep_score) AS ms, max(n) AS n, avg(sleep_score) FILTER (i > n - 3) AS r, avg(sleep_score) FILTER (i BETWEEN 4 AND 6) AS o FROM (SELECT athlete_id, total_sleep, sleep_score, row_number() OVER (PARTITION BY athlete_id ORDER BY date, night_id) AS i, count(*) OVER (PARTITION BY athlete_id) AS n FROM scored) GROUP BY 1)""", *N),
    "sleep_best_night": sql("SELECT athlete_id, night_id FROM (SELECT athlete_id, night_id, row_number() OVER (PARTITION BY athlete_id ORDER BY sleep_score DESC, date DESC, night_id DESC) AS k FROM scored) WHERE k = 1", *N),
    "sleep_perf_corr": sql(f"SELECT athlete_id, n, {r4('r', 'r')}, {r4('5 / (abs(r * sqrt((n - 2) / (1 - least(r * r, 0.9999::DOUBLE)))) + 5)', 'pseudo_p')}, CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END AS strength FROM (SELECT athlete_id, count(*) AS n, CASE WHEN stddev_pop(sleep_score) > 0 AND stddev_pop(rhr) > 0 THEN least(greatest(corr(sleep_score, rhr), -1), 1) ELSE 0 END AS r FROM scored GROUP BY 1 HAVING count(*) >= 2)", *N),
    "body_battery": sql(f"SELECT night_id, {r4('CASE WHEN battery_end < battery_start THEN (battery_start - battery_end) / 8.0::DOUBLE END', 'drain_rate')}, {r4('CASE WHEN battery_end > battery_start THEN (battery_end - battery_start) / 8.0::DOUBLE END', 'charge_rate')}, {i8('least(battery_start, battery_end)', 'lowest')}, {i8('greatest(battery_start, battery_end)', 'highest')}, CASE WHEN battery_end >= 75 THEN 'High' WHEN battery_end >= 50 THEN 'Moderate' WHEN battery_end >= 25 THEN 'Low' ELSE 'VeryLow' END AS energy FROM nights", NIGHTS),
    "stress_levels": sql("SELECT CASE WHEN stress IS NULL THEN NULL WHEN stress <= 25 THEN 'Low' WHEN stress <= 50 THEN 'Moderate' WHEN stress <= 75 THEN 'High' ELSE 'VeryHigh' END AS level, concern, count(*) AS n FROM scored GROUP BY 1, 2", *N),
    "readiness_simple": sql(f"SELECT night_id, {i8('round(round(CASE WHEN deviation >= 0 THEN 100 ELSE least(greatest((deviation + 50) / 50 * 100, 0), 100) END * 0.4 + sleep_score * 0.3::DOUBLE + least(greatest((tsb + 30) / 60.0::DOUBLE * 80 + 20, 20), 100) * 0.3, 9), 0)', 'readiness')} FROM scored WHERE deviation IS NOT NULL", *N),
    "readiness_composite": sql("SELECT night_id, readiness, CASE WHEN readiness >= 90 THEN 'Excellent' WHEN readiness >= 70 THEN 'Good' WHEN readiness >= 50 THEN 'Fair' ELSE 'Poor' END AS quality, CASE WHEN status = 'Poor' THEN 'HRV' WHEN sleep_score < 50 THEN 'Sleep' WHEN battery_end < 25 THEN 'Energy' WHEN concern THEN 'Health' WHEN status = 'Unbalanced' THEN 'HRV' WHEN sleep_score < 70 THEN 'Sleep' WHEN battery_end < 50 THEN 'Energy' END AS limit, readiness >= 75 AS ready FROM ready", *R).replace(" AS limit,", ' AS "limit",'),
    "readiness_trend": sql("SELECT * FROM " + TREND("readiness", "ready", "b - a", 5), *R),
    "enhanced_form": sql(f"SELECT night_id, score, CASE WHEN score < 20 THEN 'Critical' WHEN score < 40 THEN 'High' WHEN score < 60 THEN 'Moderate' WHEN score < 80 THEN 'Low' ELSE 'Optimal' END AS priority FROM (SELECT night_id, {i8('round(round(least(greatest((tsb + 30) / 60.0::DOUBLE * 80 + 20, 20), 100) * 0.25 + CASE WHEN deviation >= 0 THEN 100 ELSE least(greatest((deviation + 60) / 60 * 100, 0), 100) END * 0.35 + sleep_score * 0.25::DOUBLE + least(greatest(100 - (rhr - 55) / 55.0::DOUBLE * 300, 30), 100) * 0.15, 9), 0)', 'score')} FROM scored WHERE deviation IS NOT NULL)", *N),
    "training_decision": sql(f"SELECT night_id, readiness, planned, {r4('acwr', 'acwr')}, {PICK(*[repr(x) for x in ('RestDay', 'LightRecovery', 'ModerateTraining', 'HardTraining', 'PeakPerformance')])} AS recommendation, {i8(PICK(0, 'floor(round(planned * 0.3, 9))', 'floor(round(planned * 0.8, 9))', 'planned', 'floor(round(planned * 1.1, 9))'), 'max_tss')}, {i8(PICK(0, 20, 40, 50, 50), 'min_tss')}, {PICK(repr('Critical'), repr('High'), 'CASE WHEN acwr > 1.3 THEN ' + repr('Moderate') + ' ELSE ' + repr('Low') + ' END', repr('Low'), repr('Low'))} AS risk FROM (SELECT night_id, readiness, night_id % 250 AS planned, 0.8::DOUBLE + night_id % 10 / 10.0::DOUBLE AS acwr FROM ready)", *R),
    "overtraining_risk": sql(f"""SELECT athlete_id, {r4('acwr', 'acwr')}, hrv_trend, {r4('debt', 'sleep_debt')}, {r4('el', 'elevated_pct')}, CASE WHEN p <= 1 THEN 'Low' WHEN p = 2 THEN 'Moderate' WHEN p = 3 THEN 'High' ELSE 'Critical' END AS risk, {i8('CASE WHEN p = 2 THEN 2 WHEN p = 3 THEN 4 WHEN p > 3 THEN 7 END', 'days')} FROM (
        SELECT *, CASE WHEN acwr > 1.5 THEN 2 WHEN acwr > 1.3 THEN 1 ELSE 0 END + CASE WHEN hrv_trend = 'Declining' THEN 1 ELSE 0 END + CASE WHEN debt > 5 THEN 1 ELSE 0 END + CASE WHEN el > 60 THEN 1 ELSE 0 END AS p FROM (
        SELECT athlete_id, 0.8::DOUBLE + athlete_id % 10 / 10.0::DOUBLE AS acwr, coalesce(trend, 'Stable') AS hrv_trend, greatest((75 - avg(sleep_score)) / 75 * 7.5 * count(sleep_score), 0) AS debt, 100.0::DOUBLE * count(*) FILTER (rhr_elevation > 5) / count(rhr_elevation) AS el
        FROM scored LEFT JOIN {TREND('rmssd', 'nights', '100 * (b - a) / a', 5)} t USING (athlete_id) GROUP BY athlete_id, trend))""", *N),
    "recovery_forecast": sql(f"SELECT night_id, readiness, tss, {r4('acwr', 'acwr')}, sleep_score, {r4('(100 - readiness) / (rate / 24)', 'hours')}, {i8('d', 'day')}, {i8('floor(round(least(readiness + (d + 1) * rate / 24, 100), 9))', 'predicted')}, {i8('greatest(100 - d * 10, 30)', 'confidence')} FROM (SELECT *, {RATE} AS rate FROM (SELECT night_id, readiness, night_id % 250 AS tss, 0.8::DOUBLE + night_id % 10 / 10.0::DOUBLE AS acwr, sleep_score FROM ready)), range(7) r(d)", *R),
    "rules_check": sql("SELECT workout_id, field, severity, count(*) AS violations FROM long JOIN rules USING (sport, field) WHERE value < low OR value > high GROUP BY 1, 2, 3", POINTS, SPORTY, RULES, LONG),
    "rules_report": sql(f"SELECT workout_id, count(*) AS n_points, count(*) FILTER (bad) AS failed_points, {i8('sum(e)', 'errors')}, sum(e) = 0 AS passed FROM (SELECT s.workout_id, s.seq, count(r.sport) > 0 AS bad, count(*) FILTER (r.severity = 'Error') AS e FROM sp s LEFT JOIN (SELECT l.workout_id, l.seq, l.sport, severity FROM long l JOIN rules USING (sport, field) WHERE value < low OR value > high) r USING (workout_id, seq) GROUP BY 1, 2) GROUP BY 1", POINTS, SPORTY, RULES, LONG),
    "rules_apply": sql(f"SELECT sport, {r4('sum(CASE sport WHEN {} ELSE speed END)'.format(repr('Cycling') + ' THEN least(greatest(speed, 0), 33.3) WHEN ' + repr('Running') + ' THEN least(greatest(speed, 0), 6.94) WHEN ' + repr('Swimming') + ' THEN least(greatest(speed, 0), 3)'), 'speed')}, {r4('sum(CASE WHEN sport = {} THEN least(greatest(power, 0), 2000) ELSE power END)'.format(repr('Cycling')), 'power')}, {i8('sum(heart_rate)', 'heart_rate')} FROM sp GROUP BY 1", POINTS, SPORTY),
    "clean_points": sql("SELECT workout_id, count(*) FILTER (cadence * 3 BETWEEN 0 AND 300) AS cadence, count(*) FILTER (vertical_oscillation + 80 BETWEEN 40 AND 200) AS vo, count(*) FILTER (heart_rate + 50 BETWEEN 30 AND 220) AS hr, count(*) FILTER (power BETWEEN 0 AND 2000) AS power, count(*) FILTER (pace > 0 AND pace <= 1000) AS pace FROM points GROUP BY 1", POINTS),
    "clean_for_sport": sql("SELECT sport, count(*) FILTER (CASE sport WHEN 'Running' THEN speed BETWEEN 1 AND 15 WHEN 'Swimming' THEN speed BETWEEN 0.5 AND 3 WHEN 'Cycling' THEN speed BETWEEN 2 AND 30 WHEN 'Triathlon' THEN speed BETWEEN 2 AND 3 ELSE speed BETWEEN 0 AND 20 END) AS speed, count(*) FILTER (sport = 'Swimming') AS strokes, count(*) FILTER (sport = 'Running') AS stride FROM sp GROUP BY 1", POINTS, SPORTY),
    "sorted_distinct": sql(f"SELECT workout_id, count(*) AS n, {i8('sum(s * event_id)', 'check')} FROM (SELECT workout_id, event_id, row_number() OVER (PARTITION BY workout_id ORDER BY ts_s) - 1 AS s FROM (SELECT *, row_number() OVER (PARTITION BY workout_id, ts_s ORDER BY seq) AS k FROM jag) WHERE k = 1) GROUP BY 1", POINTS, JAG).replace('AS check', 'AS "check"'),
    "reindexed": sql(f"SELECT workout_id, {i8('sum(t)', 't')}, {i8('max(t)', 'last')} FROM (SELECT workout_id, CASE WHEN bool_or(b) OVER (PARTITION BY workout_id) THEN seq ELSE ts_s END AS t FROM (SELECT workout_id, seq, ts_s, coalesce(ts_s <= lag(ts_s) OVER (PARTITION BY workout_id ORDER BY seq), false) AS b FROM jag)) GROUP BY 1", POINTS, JAG),
    "elevation_outliers": sql(f"SELECT workout_id, count(*) FILTER (abs(e - med) <= 5 * mad) AS n, {i8('max(e) FILTER (abs(e - med) <= 5 * mad)', 'top')} FROM ep JOIN md USING (workout_id) LEFT JOIN (SELECT workout_id, avg(abs(e - med)) AS mad FROM ep JOIN md USING (workout_id) GROUP BY 1) USING (workout_id) GROUP BY 1", POINTS, "ep AS (SELECT workout_id, CASE WHEN event_id % 29 = 0 THEN 5000 ELSE elevation END AS e FROM points)", "md AS (SELECT workout_id, list_sort(list(e) FILTER (e IS NOT NULL))[count(e) // 2 + 1] AS med FROM ep GROUP BY 1)"),
    "store_issues": sql("SELECT count(*) FILTER (duration_seconds = 0) AS zero_duration, count(*) FILTER (tss * 10 - 100 < 0 OR total_distance < 0) AS negative, count(*) FILTER (date > '2000-01-01') AS future, count(*) FILTER (tss * 10 - 100 > 1000) AS extreme_tss, count(*) AS n FROM workouts", WORKOUTS),
    "series_ok": sql("SELECT workout_id, coalesce(bool_and(t), true) AS time_ok, coalesce(bool_and(heart_rate BETWEEN 30 AND 220), true) AS hr_ok, coalesce(bool_and(power <= 2000), true) AS power_ok, coalesce(bool_and(elevation BETWEEN -500 AND 9000), true) AS elevation_ok FROM (SELECT *, ts_s >= lag(ts_s) OVER (PARTITION BY workout_id ORDER BY seq) AS t FROM jag) GROUP BY 1", POINTS, JAG),
    "device_quirks": sql(f"SELECT workout_id, {i8('sum(round(cadence * 1.5::DOUBLE))', 'cadence')}, {i8('sum(round(ground_contact_time * 0.5::DOUBLE))', 'gct')}, {i8('sum(round(vertical_oscillation * 1.5::DOUBLE))', 'vo')}, {i8('sum(CASE WHEN ts_s <= 20 AND power > 60 THEN NULL ELSE power END)', 'power')} FROM points GROUP BY 1", POINTS),
    "dup_view": sql(f"SELECT a.id, a.athlete_id, count(*) AS n_later FROM copies a JOIN copies b ON {KEYS} AND a.id < b.id GROUP BY 1, 2", COPIES),
    "dup_remove": sql(f"SELECT b.id, count(*) AS n_earlier FROM copies a JOIN copies b ON {KEYS} AND a.created_at < b.created_at GROUP BY 1", COPIES),
    "dup_kept": sql(f"SELECT sport, count(*) AS n, {i8('sum(id)', 'ids')} FROM copies WHERE id NOT IN (SELECT b.id FROM copies a JOIN copies b ON {KEYS} AND a.created_at < b.created_at) GROUP BY 1", COPIES),
    "dup_by_sport": sql(f"SELECT a.sport, count(*) AS n FROM copies a JOIN copies b ON {KEYS} AND a.id < b.id GROUP BY 1", COPIES),
    "new_rows": sql(f"SELECT a.id FROM copies a WHERE a.id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM copies b WHERE (b.id % 2 = 1 OR b.id < a.id) AND {KEYS})", COPIES),
    "upsert_latest": sql("SELECT id, athlete_id, date FROM (SELECT *, row_number() OVER (PARTITION BY athlete_id, date ORDER BY id DESC) AS k FROM copies) WHERE k = 1", COPIES),
    "limit_before_filter": sql("SELECT workout_id, date FROM (SELECT * FROM workouts ORDER BY date DESC, workout_id DESC LIMIT 500) WHERE sport = 'Running' AND date >= '2001-01-01'", WORKOUTS),
    "trailing_week": sql("SELECT workout_id, date FROM workouts WHERE date BETWEEN '1998-06-24' AND '1998-06-30'", WORKOUTS),
    "sport_like": sql("SELECT sport, count(*) AS n FROM workouts WHERE contains(lower(sport), 'ing') AND duration_seconds >= 3600 GROUP BY 1", WORKOUTS),
    "store_statistics": sql(f"SELECT count(*) AS workouts, count(DISTINCT athlete_id) AS athletes, count(DISTINCT sport) AS sports, min(date) AS first, max(date) AS last, {i8('sum(duration_seconds)', 'seconds')} FROM workouts", WORKOUTS),
    "merge_nearest": sql(f"SELECT workout_id, ts_s, {i8('heart_rate', 'heart_rate')} FROM (SELECT l.workout_id, l.ts_s, r.heart_rate, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.ts_s - r.ts_s), r.ts_s, r.heart_rate NULLS FIRST) AS k FROM (SELECT event_id, workout_id, ts_s FROM points WHERE event_id % 2 = 0) l LEFT JOIN (SELECT workout_id, ts_s, heart_rate FROM points WHERE event_id % 2 = 1) r ON l.workout_id = r.workout_id AND abs(l.ts_s - r.ts_s) < 2) WHERE k = 1", POINTS),
    "ml_calendar": sql(f"SELECT workout_id, date, {i8('isodow(date) - 1', 'weekday')}, {i8('weekofyear(date)', 'iso_week')}, {i8('month(date)', 'month')}, {i8('dayofyear(date)', 'day_of_year')} FROM workouts", WORKOUTS),
    "ml_rolling": sql(f"SELECT a.athlete_id, a.workout_id, a.date, {r4('sum(coalesce(b.tss, 0))', 'tss')}, {i8('sum(b.duration_seconds)', 'seconds')}, {r4('sum(coalesce(b.total_distance, 0))', 'distance')}, count(*) AS n FROM workouts a JOIN workouts b ON a.athlete_id = b.athlete_id AND b.date >= a.date - 28 AND (b.date < a.date OR b.date = a.date AND b.workout_id <= a.workout_id) GROUP BY 1, 2, 3", WORKOUTS),
    "ml_running_sums": sql(f"SELECT athlete_id, workout_id, {r4('sum(coalesce(tss, 0)) OVER w', 'tss')}, {i8('sum(duration_seconds) OVER w', 'seconds')}, {r4('sum(coalesce(total_distance, 0)) OVER w', 'distance')} FROM workouts WINDOW w AS (PARTITION BY athlete_id ORDER BY date, workout_id)", WORKOUTS),
    "chrono_split": sql(f"SELECT CASE WHEN p / n < 0.70 THEN 'train' WHEN p / n < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last, {i8('sum(p)', 'places')} FROM (SELECT date, CAST(row_number() OVER (ORDER BY date, workout_id) - 1 AS DOUBLE) AS p, count(*) OVER () AS n FROM workouts) GROUP BY 1", WORKOUTS),
    "ml_features": sql(f"""SELECT w.workout_id, {i8('isodow(w.date) - 1', 'weekday')}, {r4('s7', 'tss_7d')}, {i8('d28', 'seconds_28d')}, {r4('cum', 'cumulative_tss')}, {r4('p1', 'pct1')}, {r4('p5', 'pct5')}, {r4('avg_pace', 'best_pace')}, CAST(NULL AS BIGINT) AS max_power FROM workouts w
        JOIN (SELECT a.workout_id, sum(coalesce(b.tss, 0)) FILTER (b.date >= a.date - 7) AS s7, sum(b.duration_seconds) FILTER (b.date >= a.date - 28) AS d28, sum(coalesce(b.tss, 0)) AS cum FROM workouts a JOIN workouts b ON a.athlete_id = b.athlete_id AND (b.date < a.date OR b.date = a.date AND b.workout_id <= a.workout_id) GROUP BY 1) USING (workout_id)
        LEFT JOIN (SELECT workout_id, 100.0::DOUBLE * nullif(count(*) FILTER (heart_rate / 170.0::DOUBLE * 100 < 65), 0) / count(*) AS p1, 100.0::DOUBLE * nullif(count(*) FILTER (heart_rate / 170.0::DOUBLE * 100 >= 95), 0) / count(*) AS p5 FROM points GROUP BY 1) USING (workout_id)""", WORKOUTS, POINTS),
    "plan_traditional": sql(WEEK_ROWS, *PLANS("'traditional'")),
    "plan_block": sql(WEEK_ROWS, *PLANS("'block'")),
    "plan_reverse": sql(WEEK_ROWS, *PLANS("'reverse'")),
    "plan_workouts": sql(DAY_ROWS, *PLANS(), SHARES, DAYS),
    "plan_totals": sql("SELECT plan, count(*) AS weeks, round(sum(planned_tss), 8) AS planned_tss, round(sum(planned_tss / 100 * 1.5), 8) AS planned_hours FROM weeks GROUP BY 1", *PLANS()),
    "plan_vs_actual": sql(f"SELECT plan, date, {r8('planned_tss', 'planned_tss')}, {r8('actual_tss', 'actual_tss')} FROM cmp", *PLANS(), SHARES, DAYS, DONE),
    "plan_monitor": sql(f"""SELECT plan, {r8('planned', 'planned')}, {r8('actual', 'actual')}, {i8('pct', 'completion_pct')}, {r8('lp', 'last_week_planned')}, {r8('la', 'last_week_actual')}, {i8('week', 'week')},
        array_to_string(list_filter([CASE WHEN pct < 80 THEN '{plan.SAYS_LOW}' END, CASE WHEN pct > 110 THEN '{plan.SAYS_HIGH.replace("'", "''")}' END, CASE WHEN under = 0 THEN '{plan.SAYS_UNDER}' END, CASE WHEN over = 0 THEN '{plan.SAYS_OVER}' END], lambda x: x IS NOT NULL), '; ') AS adjustments,
        array_to_string(list_filter([CASE WHEN la > 600 THEN '{plan.SAYS_HEAVY}' END, CASE WHEN week % 4 = 0 THEN '{plan.SAYS_REST}' END], lambda x: x IS NOT NULL), '; ') AS recommendations
        FROM (SELECT plan, sum(planned_tss) AS planned, sum(actual_tss) AS actual, round(100 * sum(actual_tss) / sum(planned_tss)) AS pct, sum(planned_tss) FILTER (k <= 7) AS lp, sum(actual_tss) FILTER (k <= 7) AS la, count(*) FILTER (k <= 7 AND actual_tss >= planned_tss * 0.9::DOUBLE) AS under, count(*) FILTER (k <= 7 AND actual_tss <= planned_tss * 1.1::DOUBLE) AS over,
          greatest((DATE '{TODAY}' - (target - CAST(n * 7 AS INT))) // 7 + 1, 1) AS week FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY date DESC) AS k FROM cmp) JOIN goals USING (plan) GROUP BY plan, target, n)""", *PLANS(), SHARES, DAYS, DONE),
    "plan_adjust": sql(f"SELECT plan, {i8('week', 'week')}, week_start, phase, recovery, {r8('planned_tss * f', 'planned_tss')}, {r8('planned_tss / 100 * 1.5 * f', 'planned_hours')} FROM (SELECT *, CASE WHEN week_start >= DATE '{TODAY}' THEN 0.6 ELSE 1 END AS f FROM weeks)", *PLANS()),
    "plan_increase": sql(f"SELECT plan, date, {r8('planned_tss * f', 'planned_tss')}, {i8('CASE WHEN f > 1 THEN floor(round(minutes * f, 9)) ELSE minutes END', 'minutes')} FROM (SELECT *, floor(round(planned_tss / intensity / 100 * 60, 9)) AS minutes, CASE WHEN date >= DATE '{TODAY}' THEN 1.15::DOUBLE ELSE 1 END AS f FROM days)", *PLANS(), SHARES, DAYS),
    "formula_bikescore": sql(f"SELECT workout_id, {r4('duration_seconds / 3600.0::DOUBLE * intensity_factor ** 1.5 * 100', 'score')} FROM workouts", WORKOUTS),
    "formula_classic": sql(f"SELECT workout_id, round(duration_seconds / 3600.0::DOUBLE * intensity_factor ** 2 * 100, 8) AS score FROM workouts", WORKOUTS),
    "formula_custom": sql(f"SELECT workout_id, {r4('-(avg_heart_rate + 2.5::DOUBLE) * avg_power / nullif((avg_heart_rate - 110.0::DOUBLE) ** 2, 0) + 3', 'score')} FROM workouts", WORKOUTS),
}
