"""Training-load queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.operators import load
from cadentia.plans.common import SESSIONS, i8, points_query, r4, rounded, sessions, sql, workouts_query
from cadentia.sources import views
from cadentia.sources.views import POINTS, WORKOUTS


def by_sport(w):
    """Daily stress and the series of each sport over its whole history."""
    return load.pmc(load.daily_tss(w, "sport"), "sport")


def series(f):
    return workouts_query(lambda w: f(by_sport(w)))


def by_athlete(w):
    """The sparse case: a series for each athlete."""
    return load.pmc(load.daily_tss(w, "athlete_id"), "athlete_id")


QUERIES = {
    "pmc_by_sport": series(lambda s: s),
    "pmc_weekly_iso": series(lambda s: load.pmc_weekly(s, "sport")),
    "pmc_monthly_close": series(lambda s: load.pmc_monthly(s, "sport")),
    "pmc_spikes": series(lambda s: s.where("atl_spike").select("sport", "date", "atl")),
    "pmc_classes": series(lambda s: s.groupBy("sport", load.tsb_class(F.col("tsb")).alias("form")).agg(F.count("*").alias("n"))),
    "pmc_trends": series(lambda s: load.pmc_trends(s, "sport")),
    "pmc_advice": series(lambda s: load.recommendations(s).select("sport", "date", F.array_join("advice", ",").alias("advice"))),
    "pmc_view_trends": series(lambda s: load.view_trends(s, "sport")),
    "tsb_streaks": series(lambda s: load.warnings(s, "sport")),
    "pmc_range_drops_warmup": workouts_query(lambda w: load.pmc(load.daily_tss(w.where("date between '1996-03-01' and '1996-06-30'"), "sport"), "sport")),
    "pmc_by_athlete": workouts_query(lambda w: by_athlete(w).groupBy("athlete_id").agg(F.count("*").alias("days"), F.max("ctl").alias("peak_ctl"), F.max_by("tsb", "date").alias("last_tsb"))),
    "daily_tss": workouts_query(lambda w: load.daily_tss(w, "sport")),
    "tss_power": points_query(lambda p: load.power_tss(p, sessions(p))),
    "tss_hr": points_query(lambda p: load.hr_tss(p, sessions(p))),
    "tss_run": points_query(lambda p: load.pace_tss(p, sessions(p), True)),
    "tss_swim": points_query(lambda p: load.pace_tss(p, sessions(p), False)),
    "tss_estimate": workouts_query(load.estimated_tss),
    "tss_dispatch": points_query(lambda p: load.check_tss(load.tss(p, sessions(p))).drop("duration_seconds")),
    "tss_rpe": workouts_query(lambda w: load.rpe_tss(w.select("workout_id", "duration_seconds", (F.col("workout_id") % 10 + 1).alias("rpe"))).select("workout_id", "tss")),
    "tss_fill": workouts_query(lambda w: load.fill_tss(w).groupBy("sport").agg(F.sum("tss").alias("tss"), F.count("tss").alias("n"))),
    "report_totals": lambda spark, sf_dir: rounded(load.report_totals(views.workouts(spark, sf_dir), "athlete_id").withColumn("mean_tss", F.round("mean_tss", 8)), 8),
    "weekly_calendar_iso_mixed": workouts_query(lambda w: load.weekly_summary(w)),
    "weekly_iso": workouts_query(lambda w: load.weekly_summary(w, iso=True)),
    "weekly_by_sport": workouts_query(load.weekly_by_sport),
    "monthly_summary": workouts_query(load.monthly_summary),
    "combined_load": workouts_query(load.combined_load),
    "sport_distribution": workouts_query(lambda w: load.sport_distribution(w, "1998-12-31", 365)),
    "seven_day_bins": workouts_query(lambda w: load.seven_day_bins(w, "1994-12-20")),
    "sport_equivalence": workouts_query(lambda w: load.equivalent_load(w, "Running").groupBy("sport").agg(F.sum("equivalent_tss").alias("tss"))),
    "css_top3": workouts_query(lambda w: load.critical_swim_speed(w, "athlete_id")),
}


def pmc_sql(key: str, where: str = "true") -> tuple[str, ...]:
    """The series step by step: a dense calendar from 42 days before, then the recursion."""
    return (
        WORKOUTS,
        f"daily AS (SELECT {key} AS k, date, sum(coalesce(tss, 0)) AS tss FROM workouts WHERE {where} GROUP BY 1, 2)",
        "spans AS (SELECT k, min(date) AS first, max(date) AS last FROM daily GROUP BY 1)",
        "days AS (SELECT k, first, CAST(unnest(generate_series(first - INTERVAL 42 DAY, CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM spans)",
        "dense AS (SELECT d.k, d.first, d.date, coalesce(t.tss, 0) AS tss, row_number() OVER (PARTITION BY d.k ORDER BY d.date) AS i FROM days d LEFT JOIN daily t ON t.k = d.k AND t.date = d.date)",
        """fold AS (SELECT k, i, first, date, tss, tss / 42.0::DOUBLE AS ctl, tss / 7.0::DOUBLE AS atl FROM dense WHERE i = 1
            UNION ALL SELECT d.k, d.i, d.first, d.date, d.tss, f.ctl + (d.tss - f.ctl) / 42, f.atl + (d.tss - f.atl) / 7 FROM fold f JOIN dense d ON d.k = f.k AND d.i = f.i + 1)""",
        f"""pmc AS (SELECT k AS {key}, date, tss, ctl, atl, tsb, ramp_rate, coalesce(row_number() OVER w > 7 AND atl > 1.5 * avg(atl) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), false) AS atl_spike FROM (
            SELECT k, first, date, tss, ctl, atl, coalesce(lag(ctl) OVER w, ctl) - atl AS tsb, ctl - lag(ctl, 6) OVER w AS ramp_rate FROM fold WINDOW w AS (PARTITION BY k ORDER BY date)) WHERE date >= first WINDOW w AS (PARTITION BY k ORDER BY date))""",
    )


S = pmc_sql("sport")
ROW = f"date, {r4('tss', 'tss')}, {r4('ctl', 'ctl')}, {r4('atl', 'atl')}, {r4('tsb', 'tsb')}, {r4('ramp_rate', 'ramp_rate')}, atl_spike"
FORM = "CASE WHEN tsb >= 25 THEN 'VeryFresh' WHEN tsb >= 5 THEN 'Fresh' WHEN tsb >= -10 THEN 'Neutral' WHEN tsb >= -30 THEN 'Fatigued' ELSE 'VeryFatigued' END"
HOURLY = "CASE sport WHEN 'Cycling' THEN 60 WHEN 'Running' THEN 70 WHEN 'Swimming' THEN 80 WHEN 'Rowing' THEN 75 WHEN 'Triathlon' THEN 65 ELSE 50 END"
NP1 = "np1 AS (SELECT workout_id, floor(sqrt(sqrt(avg(m ** 4)))) AS np FROM (SELECT workout_id, avg(power) OVER (PARTITION BY workout_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS m FROM points) GROUP BY 1)"
UPS = "ups AS (SELECT workout_id, sum(up) FILTER (up > 0) AS gain FROM (SELECT workout_id, elevation - lag(elevation) OVER (PARTITION BY workout_id ORDER BY seq) AS up FROM points WHERE elevation IS NOT NULL) GROUP BY 1)"
TP = "tp AS (SELECT workout_id, np / s.ftp AS f, duration_seconds / 3600.0::DOUBLE * (np / s.ftp) ** 2 * 100 AS tss FROM np1 JOIN sessions s USING (workout_id))"
TH = "th AS (SELECT workout_id, h / s.lthr AS f, duration_seconds / 3600.0::DOUBLE * (h / s.lthr) ** 2 * 100 AS tss FROM (SELECT workout_id, avg(heart_rate) AS h FROM points GROUP BY 1 HAVING count(heart_rate) > 0) JOIN sessions s USING (workout_id))"
TR = "ts AS (SELECT workout_id, s.threshold_pace * q AS f, duration_seconds / 3600.0::DOUBLE * (s.threshold_pace * q) ** 2 * 100 AS tss, duration_seconds AS d FROM (SELECT workout_id, avg(1 / pace) AS q FROM points WHERE pace > 0 GROUP BY 1) JOIN sessions s USING (workout_id)), tr AS (SELECT workout_id, f, tss * (1 + CASE WHEN coalesce(gain, 0) > 0 THEN 0.02::DOUBLE * gain / d ELSE 0 END) AS tss FROM ts LEFT JOIN ups USING (workout_id))"
ALL = (POINTS, SESSIONS, NP1, UPS, TP, TH, TR)
TSS = lambda t: sql(f"SELECT workout_id, {r4('f', 'intensity_factor')}, {r4('tss', 'tss')} FROM {t}", *ALL)
Z = "coalesce(tss, 0)"

ORACLES = {
    "pmc_by_sport": sql(f"SELECT sport, {ROW} FROM pmc", *S),
    "pmc_weekly_iso": sql(f"SELECT sport, {i8('isoyear(date)', 'iso_year')}, {i8('weekofyear(date)', 'iso_week')}, {r4('sum(tss)', 'tss')}, {r4('avg(ctl)', 'ctl')}, {r4('avg(atl)', 'atl')}, {r4('avg(tsb)', 'tsb')} FROM pmc GROUP BY sport, isoyear(date), weekofyear(date)", *S),
    "pmc_monthly_close": sql(f"SELECT sport, {i8('year(date)', 'year')}, {i8('month(date)', 'month')}, {r4('sum(tss)', 'tss')}, {r4('max_by(ctl, date)', 'ctl')}, {r4('max_by(atl, date)', 'atl')}, {r4('max_by(tsb, date)', 'tsb')} FROM pmc GROUP BY sport, year(date), month(date)", *S),
    "pmc_spikes": sql(f"SELECT sport, date, {r4('atl', 'atl')} FROM pmc WHERE atl_spike", *S),
    "pmc_classes": sql(f"SELECT sport, {FORM} AS form, count(*) AS n FROM pmc GROUP BY 1, 2", *S),
    "pmc_trends": sql("SELECT sport, n_days, " + ", ".join(f"CASE WHEN (l{c} - f{c}) / greatest(abs(f{c}), 1) * 100 > 5 THEN 'Increasing' WHEN (l{c} - f{c}) / greatest(abs(f{c}), 1) * 100 < -5 THEN 'Decreasing' ELSE 'Stable' END AS {c}_trend" for c in ("ctl", "atl", "tsb")) + f", {r4('mean_ramp', 'mean_ramp')}, spikes, {i8('last_date - last_spike', 'days_since_spike')} FROM (SELECT sport, count(*) AS n_days, " + ", ".join(f"min_by({c}, date) AS f{c}, max_by({c}, date) AS l{c}" for c in ("ctl", "atl", "tsb")) + ", avg(ramp_rate) AS mean_ramp, count(*) FILTER (atl_spike) AS spikes, max(date) FILTER (atl_spike) AS last_spike, max(date) AS last_date FROM pmc GROUP BY 1) WHERE n_days >= 14", *S),
    "pmc_advice": sql(f"SELECT sport, date, {FORM} || CASE WHEN ramp_rate > 8 THEN ',ramp_too_fast' WHEN ramp_rate < -5 THEN ',losing_fitness' ELSE '' END || CASE WHEN atl_spike THEN ',fatigue_spike' ELSE '' END AS advice FROM pmc", *S),
    "pmc_view_trends": sql("SELECT sport, " + ", ".join(f"CASE WHEN max_by({c}, date) - min_by({c}, date) > {m} THEN 'up' WHEN max_by({c}, date) - min_by({c}, date) < -{m} THEN 'down' ELSE 'flat' END AS {c}" for c, m in (("ctl", 2), ("atl", 3), ("tsb", 5))) + ", count(*) FILTER (d > 5) AS fast_weeks FROM (SELECT *, ctl - lag(ctl, 6) OVER (PARTITION BY sport ORDER BY date) AS d FROM pmc) GROUP BY 1", *S),
    "tsb_streaks": sql("""SELECT sport, tired AS tired_days, idle AS idle_days, fast_ramps, spikes, tired >= 7 AS overreached, idle >= 7 AS detraining FROM
        (SELECT sport, max(n) AS tired FROM (SELECT sport, g, count(*) FILTER (tsb < -10) AS n FROM (SELECT sport, tsb, sum(CASE WHEN tsb < -10 THEN 0 ELSE 1 END) OVER (PARTITION BY sport ORDER BY date) AS g FROM pmc) GROUP BY 1, 2) GROUP BY 1)
        JOIN (SELECT sport, max(n) AS idle FROM (SELECT sport, g, count(*) FILTER (tsb > 15) AS n FROM (SELECT sport, tsb, sum(CASE WHEN tsb > 15 THEN 0 ELSE 1 END) OVER (PARTITION BY sport ORDER BY date) AS g FROM pmc) GROUP BY 1, 2) GROUP BY 1) USING (sport)
        JOIN (SELECT sport, count(*) FILTER (d > 8) AS fast_ramps, count(*) FILTER (atl_spike) AS spikes FROM (SELECT sport, atl_spike, ctl - lag(ctl, 6) OVER (PARTITION BY sport ORDER BY date) AS d FROM pmc) GROUP BY 1) USING (sport)""", *S),
    "pmc_range_drops_warmup": sql(f"SELECT sport, {ROW} FROM pmc", *pmc_sql("sport", "date BETWEEN '1996-03-01' AND '1996-06-30'")),
    "pmc_by_athlete": sql(f"SELECT athlete_id, count(*) AS days, {r4('max(ctl)', 'peak_ctl')}, {r4('max_by(tsb, date)', 'last_tsb')} FROM pmc GROUP BY 1", *pmc_sql("athlete_id")),
    "daily_tss": sql(f"SELECT sport, date, {r4(f'sum({Z})', 'tss')}, count(*) AS n_workouts FROM workouts GROUP BY sport, date", WORKOUTS),
    "tss_power": TSS("tp"),
    "tss_hr": TSS("th"),
    "tss_run": TSS("tr"),
    "tss_swim": TSS("ts"),
    "tss_estimate": sql(f"SELECT workout_id, {r4(f'duration_seconds / 3600.0::DOUBLE * {HOURLY}', 'tss')} FROM workouts", WORKOUTS),
    "tss_dispatch": sql(f"""SELECT workout_id, sport, {r4('tss', 'tss')}, method, CASE WHEN tss < 0 THEN 'negative' WHEN tss / (d / 3600.0::DOUBLE) > 300 THEN 'too_high' WHEN tss / (d / 3600.0::DOUBLE) < 10 AND d > 600 THEN 'too_low' ELSE 'ok' END AS status FROM (
        SELECT s.workout_id, sport, s.duration_seconds AS d, coalesce(x, th.tss, duration_seconds / 3600.0::DOUBLE * {HOURLY}) AS tss, CASE WHEN x IS NOT NULL AND sport = 'Cycling' THEN 'power' WHEN x IS NOT NULL THEN 'pace' WHEN th.tss IS NOT NULL THEN 'heart_rate' ELSE 'estimated' END AS method
        FROM (SELECT s.*, CASE sport WHEN 'Cycling' THEN tp.tss WHEN 'Running' THEN tr.tss WHEN 'Swimming' THEN ts.tss END AS x FROM sessions s LEFT JOIN tp USING (workout_id) LEFT JOIN tr USING (workout_id) LEFT JOIN ts USING (workout_id)) s LEFT JOIN th USING (workout_id))""", *ALL),
    "tss_rpe": sql(f"SELECT workout_id, {r4('(workout_id % 10 + 1) ** 2 * duration_seconds / 3600.0::DOUBLE * 10', 'tss')} FROM workouts", WORKOUTS),
    "tss_fill": sql(f"SELECT sport, {r4(f'sum(coalesce(tss, duration_seconds / 3600.0::DOUBLE * {HOURLY}))', 'tss')}, count(*) AS n FROM workouts GROUP BY 1", WORKOUTS),
    "report_totals": sql(f"""SELECT athlete_id, round(total_tss, 8) AS total_tss, round(total_hours, 8) AS total_hours, n, span_days, training_days, main_sport, round(total_tss / n, 8) AS mean_tss, round(100.0::DOUBLE * training_days / span_days, 8) AS training_pct FROM (
        SELECT athlete_id, sum({Z}) AS total_tss, sum(duration_seconds) / 3600.0::DOUBLE AS total_hours, count(*) AS n, max(date) - min(date) + 1 AS span_days, count(DISTINCT date) AS training_days FROM workouts GROUP BY 1)
        JOIN (SELECT athlete_id, sport AS main_sport FROM (SELECT athlete_id, sport, row_number() OVER (PARTITION BY athlete_id ORDER BY count(*) DESC, sport DESC) AS k FROM workouts GROUP BY 1, 2) WHERE k = 1) USING (athlete_id)""", WORKOUTS),
    "weekly_calendar_iso_mixed": sql(f"SELECT {i8('year(date)', 'year')}, {i8('weekofyear(date)', 'week')}, {r4(f'sum({Z})', 'tss')}, {r4(f'sum({Z}) / 7', 'mean_daily_tss')}, {i8('sum(duration_seconds)', 'seconds')}, {r4('sum(total_distance) / 1000', 'km')}, count(*) AS n FROM workouts GROUP BY year(date), weekofyear(date)", WORKOUTS),
    "weekly_iso": sql(f"SELECT {i8('isoyear(date)', 'year')}, {i8('weekofyear(date)', 'week')}, {r4(f'sum({Z})', 'tss')}, {r4(f'sum({Z}) / 7', 'mean_daily_tss')}, {i8('sum(duration_seconds)', 'seconds')}, {r4('sum(total_distance) / 1000', 'km')}, count(*) AS n FROM workouts GROUP BY isoyear(date), weekofyear(date)", WORKOUTS),
    "weekly_by_sport": sql(f"SELECT {i8('year(date)', 'year')}, {i8('weekofyear(date)', 'week')}, sport, count(*) AS n, {i8('sum(duration_seconds)', 'seconds')}, {r4(f'sum({Z})', 'tss')} FROM workouts GROUP BY year(date), weekofyear(date), sport", WORKOUTS),
    "monthly_summary": sql(f"SELECT {i8('year(date)', 'year')}, {i8('month(date)', 'month')}, {r4(f'sum({Z})', 'tss')}, {i8('sum(duration_seconds)', 'seconds')}, count(*) AS n, {r4(f'sum({Z}) / day(last_day(min(date)))', 'mean_daily_tss')} FROM workouts GROUP BY year(date), month(date)", WORKOUTS),
    "combined_load": sql(f"SELECT date, coalesce(sport, 'all') AS sport, {r4(f'sum({Z})', 'tss')}, {i8('sum(duration_seconds)', 'seconds')} FROM workouts GROUP BY GROUPING SETS ((date, sport), (date))", WORKOUTS),
    "sport_distribution": sql(f"SELECT sport, {r4(f'100 * sum({Z}) / sum(sum({Z})) OVER ()', 'tss_pct')}, {r4('100.0 * sum(duration_seconds) / sum(sum(duration_seconds)) OVER ()', 'time_pct')}, {r4('100.0 * count(*) / sum(count(*)) OVER ()', 'count_pct')} FROM workouts WHERE date BETWEEN DATE '1998-12-31' - 365 AND DATE '1998-12-31' GROUP BY 1", WORKOUTS),
    "seven_day_bins": sql(f"SELECT {i8('b', 'bin')}, DATE '1994-12-20' + CAST(b AS INT) * 7 AS week_start, {r4(f'coalesce(sum({Z}), 0)', 'tss')}, {i8('coalesce(sum(duration_seconds), 0)', 'seconds')}, count(workout_id) AS n FROM (SELECT unnest(range(0, (SELECT (max(date) - DATE '1994-12-20') // 7 + 1 FROM workouts))) AS b) LEFT JOIN workouts ON (date - DATE '1994-12-20') // 7 = b AND date >= DATE '1994-12-20' GROUP BY b", WORKOUTS),
    "sport_equivalence": sql(f"SELECT sport, {r4('sum(tss) * CASE sport WHEN {0} END'.format("'Cycling' THEN 1.33 WHEN 'Swimming' THEN 0.83 WHEN 'Rowing' THEN 1.11 ELSE 1"), 'tss')} FROM workouts GROUP BY 1", WORKOUTS),
    "css_top3": sql(f"""SELECT athlete_id, {r4('CASE WHEN max(n) >= 3 THEN avg(p) WHEN max(n) = 2 THEN min(p) END', 'css')}, {i8('max(n)', 'n_swims')} FROM (
        SELECT athlete_id, p, row_number() OVER (PARTITION BY athlete_id ORDER BY p, workout_id) AS k, count(*) OVER (PARTITION BY athlete_id) AS n FROM (SELECT athlete_id, workout_id, duration_seconds / 60.0::DOUBLE / (total_distance / 100) AS p FROM workouts WHERE sport = 'Swimming' AND total_distance > 0)) WHERE k <= 3 GROUP BY 1""", WORKOUTS),
}
