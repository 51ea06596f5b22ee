"""Power queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.operators import power
from cadentia.plans.common import i8, points_query, r4, sql
from cadentia.sources.views import POINTS

SHORT = (1, 5, 10, 15, 20, 30, 60)
FIT = (10, 20, 40)

QUERIES = {
    "np_tss_flavour": points_query(power.np_tss),
    "np_power_flavour": points_query(power.np_power),
    "mmp_standard": points_query(lambda p: power.mean_max(p, SHORT)),
    "mmp_full_max": points_query(lambda p: power.aggregate_curves(power.mean_max_full(p))),
    "peak_powers": points_query(lambda p: power.mean_max(p, power.PEAK_DURATIONS).groupBy("workout_id").pivot("duration_s", list(power.PEAK_DURATIONS)).agg(F.first("max_power")).select("workout_id", F.col("5").alias("p5"), F.col("15").alias("p15"), F.col("30").alias("p30"), F.col("60").alias("p60"))),
    "key_powers": points_query(lambda p: power.key_powers(power.aggregate_curves(power.mean_max_full(p)), (5, 30, 58, 61))),
    "cp_fit": points_query(lambda p: power.critical_power(power.mean_max(p, FIT), FIT)),
    "wprime_balance": points_query(lambda p: power.w_prime_balance(p, 40, 1500.0)),
    "time_to_exhaustion": points_query(lambda p: power.time_to_exhaustion(p.where("power is not null").select("workout_id", "seq", "power"), "power", 50, 15000.0)),
    "power_metrics": points_query(lambda p: power.power_metrics(p, 60)),
    "work_distribution": points_query(lambda p: power.work_distribution(p, 40)),
    "quadrants": points_query(lambda p: power.quadrants(p, 40, 90)),
    "power_balance": points_query(power.power_balance),
}

KNOWN = "known AS (SELECT workout_id, seq, ts_s, power, row_number() OVER (PARTITION BY workout_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY workout_id) AS n FROM points WHERE power IS NOT NULL)"
PREFIX = "prefix AS (SELECT workout_id, rn, n, sum(power) OVER (PARTITION BY workout_id ORDER BY rn) AS s FROM known), ends AS (SELECT workout_id, rn, n, s FROM prefix UNION ALL SELECT DISTINCT workout_id, 0, n, 0 FROM prefix)"
CURVE = f"curve AS (SELECT a.workout_id, b.rn - a.rn AS duration_s, max((b.s - a.s) // (b.rn - a.rn)) AS max_power FROM ends a JOIN ends b ON a.workout_id = b.workout_id AND b.rn > a.rn GROUP BY 1, 2)"
BEST = "best AS (SELECT duration_s, max(max_power) AS max_power, count(*) AS n_workouts FROM curve WHERE max_power > 0 GROUP BY 1)"
NP2 = """np2 AS (SELECT workout_id, CAST(floor(sqrt(sqrt(avg(CAST(m AS DOUBLE) ** 4)))) AS BIGINT) AS np FROM (
  SELECT workout_id, rn, n, sum(power) OVER (PARTITION BY workout_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) // least(n, 30) AS m FROM known) WHERE rn <= n - least(n, 30) + 1 GROUP BY 1)"""
FULL = (POINTS, KNOWN, PREFIX, CURVE)

ORACLES = {
    "np_tss_flavour": sql(
        """SELECT workout_id, CAST(floor(sqrt(sqrt(avg(m ** 4)))) AS BIGINT) AS np FROM (
           SELECT workout_id, avg(power) OVER (PARTITION BY workout_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS m FROM points) GROUP BY 1""", POINTS),
    "np_power_flavour": sql("SELECT * FROM np2", POINTS, KNOWN, NP2),
    "mmp_standard": sql(f"SELECT workout_id, {i8('duration_s', 'duration_s')}, {i8('max_power', 'max_power')} FROM curve WHERE duration_s IN {SHORT}", *FULL),
    "mmp_full_max": sql(f"SELECT {i8('duration_s', 'duration_s')}, {i8('max_power', 'max_power')}, n_workouts FROM best", *FULL, BEST),
    "peak_powers": sql("SELECT workout_id, " + ", ".join(i8(f"max(max_power) FILTER (duration_s = {d})", f"p{d}") for d in (5, 15, 30, 60)) + " FROM curve WHERE duration_s IN (5, 15, 30, 60, 300, 1200, 3600) GROUP BY 1", *FULL),
    "key_powers": sql(f"""SELECT {i8('t', 'target_s')}, {i8('duration_s', 'duration_s')}, {i8('max_power', 'max_power')} FROM (
        SELECT t, b.*, row_number() OVER (PARTITION BY t ORDER BY abs(duration_s - t), duration_s) AS k FROM best b, (VALUES (5), (30), (58), (61)) v(t) WHERE abs(duration_s - t) <= t // 10) WHERE k = 1""", *FULL, BEST),
    "cp_fit": sql(f"""SELECT workout_id, {r4('w', 'w_prime')}, {r4('c', 'cp')}, {r4('r', 'r2')}, CAST(floor(round(c * 0.95, 6)) AS BIGINT) AS ftp FROM (
        SELECT workout_id, count(*) AS n, regr_slope(max_power, 1.0::DOUBLE / duration_s) AS w, regr_intercept(max_power, 1.0::DOUBLE / duration_s) AS c, regr_r2(max_power, 1.0::DOUBLE / duration_s) AS r FROM curve WHERE duration_s IN {FIT} GROUP BY 1) WHERE n = 3""", *FULL),
    # the recursion itself: balance step by step with its cap
    "wprime_balance": sql(f"""SELECT workout_id, {r4('min(b)', 'min_balance')}, {i8('coalesce(sum(dt) FILTER (b < 0), 0)', 'seconds_below_zero')} FROM walk GROUP BY 1""", POINTS, KNOWN,
        "steps AS (SELECT k.workout_id, k.rn, k.ts_s - p.ts_s AS dt, 40 - p.power AS gain FROM known k JOIN known p ON k.workout_id = p.workout_id AND k.rn = p.rn + 1)",
        "walk AS (SELECT workout_id, CAST(1 AS BIGINT) AS rn, 1500.0::DOUBLE AS b, CAST(0 AS BIGINT) AS dt FROM known WHERE rn = 1 AND n > 1 UNION ALL SELECT s.workout_id, s.rn, least(1500.0::DOUBLE, w.b + s.dt * s.gain), s.dt FROM walk w JOIN steps s ON s.workout_id = w.workout_id AND s.rn = w.rn + 1)"),
    "time_to_exhaustion": sql("SELECT workout_id, seq, CAST(power AS BIGINT) AS power, CASE WHEN power <= 50 THEN 4294967295 ELSE CAST(floor(15000.0 / (power - 50)) AS BIGINT) END AS tte_s FROM points WHERE power IS NOT NULL", POINTS),
    "power_metrics": sql(f"""SELECT workout_id, {i8('a', 'avg_power')}, np, {r4('np / nullif(a, 0)::DOUBLE', 'vi')}, {r4('np / nullif(h, 0)::DOUBLE', 'ef')}, {r4('np / 60.0::DOUBLE', 'intensity_factor')} FROM (
        SELECT workout_id, sum(power) // count(power) AS a, sum(heart_rate) // nullif(count(heart_rate), 0) AS h FROM points GROUP BY 1 HAVING count(power) > 0) JOIN np2 USING (workout_id)""", POINTS, KNOWN, NP2),
    "work_distribution": sql(f"SELECT workout_id, {i8('sum(CASE WHEN power > 40 THEN power - 40 ELSE 0 END) // 1000', 'kj_above')}, {i8('sum(CASE WHEN power <= 40 THEN power ELSE 0 END) // 1000', 'kj_below')} FROM points GROUP BY 1", POINTS),
    "quadrants": sql("SELECT workout_id, " + ", ".join(r4(f"100.0 * count(*) FILTER ({c}) / count(*)", n) for n, c in (("q1", "power > 40 AND cadence > 90"), ("q2", "power > 40 AND cadence <= 90"), ("q3", "power <= 40 AND cadence <= 90"), ("q4", "power <= 40 AND cadence > 90"))) + " FROM points WHERE power IS NOT NULL AND cadence IS NOT NULL GROUP BY 1", POINTS),
    "power_balance": sql(f"SELECT workout_id, {r4('100.0 * l / (l + r)', 'left_pct')}, {r4('100 - 100.0 * l / (l + r)', 'right_pct')}, {r4('50 - abs(100.0 * l / (l + r) - 50)', 'score')} FROM (SELECT workout_id, sum(power * balance // 200) AS l, sum(power - power * balance // 200) AS r FROM points WHERE power IS NOT NULL GROUP BY 1) WHERE l + r > 0", POINTS),
}
