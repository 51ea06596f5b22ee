"""Zone, running, swimming, training-effect and VO2max queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadentia.operators import effect, running, zones
from cadentia.plans.common import SESSIONS, i8, points_query, r4, rounded, sessions, sql, workouts_query
from cadentia.sources import views
from cadentia.sources.views import ATHLETES, POINTS, WORKOUTS


def with_thresholds(p):
    """Points with their workout's thresholds; sessions are aggregated from the same points by the same key."""
    k = F.col("workout_id")
    return p.withColumns({"lthr": (150 + k % 30).cast("int"), "max_hr": (170 + k % 30).cast("int"), "resting_hr": (45 + k % 20).cast("int"), "ftp": (150 + k % 200).cast("int"), "threshold_pace": F.lit(4.0) + (k % 20) / F.lit(10.0)})


def zone_query(zone, n, all_rows=False):
    return points_query(lambda p: zones.distribution(with_thresholds(p), zone(), n, ["workout_id"], all_rows))


c = F.col
QUERIES = {
    "zone_hr_lthr": zone_query(lambda: zones.hr_zone_lthr(c("heart_rate"), c("lthr")), 5),
    "zone_hr_maxhr": zone_query(lambda: zones.hr_zone_max(c("heart_rate"), c("max_hr")), 5),
    "zone_hr_hrr": points_query(lambda p: zones.time_in_zones(with_thresholds(p), zones.hr_zone_reserve(c("heart_rate"), c("resting_hr"), c("max_hr")), 5)),
    "zone_hr_ml": zone_query(lambda: zones.hr_zone_features(c("heart_rate"), c("lthr")), 5, True),
    "zone_hr_batch": zone_query(lambda: zones.hr_zone_batch(c("heart_rate"), c("lthr")), 5),
    "zone_power_coggan": zone_query(lambda: zones.power_zone(c("power"), c("ftp") / 5), 7),
    "zone_power_batch": zone_query(lambda: zones.power_zone_batch(c("power"), (c("ftp") / 5).cast("int")), 7),
    "zone_pace": zone_query(lambda: zones.pace_zone(c("pace"), c("threshold_pace")), 5),
    "zone_pace_batch": zone_query(lambda: zones.pace_zone_batch(c("pace"), c("threshold_pace")), 5),
    "zone_pace_absolute": zone_query(lambda: zones.absolute_pace_zone(c("pace")), 6),
    "zone_tables_hr": lambda spark, d: rounded(zones.hr_table_lthr(views.athletes(spark, d))),
    "zone_tables_max": lambda spark, d: rounded(zones.hr_table_max(views.athletes(spark, d))),
    "zone_tables_power": lambda spark, d: rounded(zones.power_table(views.athletes(spark, d))),
    "zone_tables_pace": lambda spark, d: rounded(zones.pace_table(views.athletes(spark, d))),
    "zone_tables_running": lambda spark, d: rounded(zones.running_table(views.athletes(spark, d))),
    "intensity_pattern": workouts_query(lambda w: zones.intensity_pattern(w, "athlete_id")),
    "intensity_time": workouts_query(lambda w: zones.intensity_time(w, "athlete_id")),
    "threshold_estimates": lambda spark, d: rounded(zones.threshold_estimates(views.athletes(spark, d).select("athlete_id", c("ftp").alias("power20"), (c("athlete_id") % 110).cast("int").alias("age"), (F.lit(15.0) + c("athlete_id") % 20).alias("t5k"), (F.lit(32.0) + c("athlete_id") % 30).alias("t10k")))),
    "average_pace": points_query(running.average_pace),
    "graded_pace": points_query(running.normalized_graded_pace),
    "gap_pace": points_query(running.grade_adjusted_pace),
    "splits_1km": points_query(lambda p: running.splits(p.withColumn("distance", c("distance") * 15 + c("seq") % 7 * 11), 1000.0)),
    "efficiency_factor": points_query(running.efficiency_factor),
    "elevation_gain": points_query(running.elevation),
    "gradient_hist": points_query(running.gradients),
    "elevation_stress": points_query(running.elevation_stress),
    "race_times": points_query(running.race_times),
    "training_paces": points_query(running.training_paces),
    "running_dynamics": points_query(running.dynamics),
    "cadence_variation": points_query(running.cadence_variation),
    "swim_laps": points_query(running.laps),
    "strokes_per_lap": points_query(running.strokes_per_lap),
    "swolf": points_query(running.swolf),
    "stroke_mix": points_query(lambda p: running.stroke_mix(p, sessions(p))),
    "swim_pace": points_query(running.swim_pace),
    "stroke_efficiency": points_query(running.stroke_efficiency),
    "epoc_te": points_query(lambda p: effect.training_effect(p, 190, 50, 165, 150)),
    "hr_bouts": points_query(lambda p: effect.bouts(p, 100, 3)),
    "vo2_trend": workouts_query(lambda w: effect.vo2_trend(w.select("athlete_id", "date", effect.vo2_running(c("avg_pace"), c("avg_heart_rate"), F.lit(190))[0].alias("vo2")), "athlete_id")),
    "vo2_estimates": workouts_query(lambda w: w.select(
        "workout_id", *[x.alias(n) for n, x in zip(("power", "power_c"), effect.vo2_power(c("avg_power"), F.lit(70.0)), strict=True)], *[x.alias(n) for n, x in zip(("run", "run_c"), effect.vo2_running(c("avg_pace"), c("avg_heart_rate"), F.lit(190)), strict=True)],
        *[x.alias(n) for n, x in zip(("ride", "ride_c"), effect.vo2_cycling(c("avg_power"), F.lit(70.0), c("avg_heart_rate"), F.lit(190)), strict=True)], *[x.alias(n) for n, x in zip(("reserve", "reserve_c"), effect.vo2_reserve(c("avg_heart_rate"), F.lit(120), F.lit(190), F.lit(35.0)), strict=True)])),
}

TH = "t AS (SELECT *, 150 + workout_id % 30 AS lthr, 170 + workout_id % 30 AS max_hr, 45 + workout_id % 20 AS resting_hr, 150 + workout_id % 200 AS ftp, 4.0::DOUBLE + (workout_id % 20) / 10.0::DOUBLE AS threshold_pace FROM points)"


def case(value, tests):
    return f"CASE WHEN {value} IS NULL THEN NULL " + " ".join(f"WHEN {t} THEN {i + 1}" for i, t in enumerate(tests)) + f" ELSE {len(tests) + 1} END"


def zone_sql(zone, n, all_rows=False):
    total = "count(*)" if all_rows else "count(z)"
    pct = (lambda i: r4(f"100.0::DOUBLE * nullif(count(*) FILTER (z = {i}), 0) / {total}", f"pct{i}")) if all_rows else (lambda i: r4(f"coalesce(100.0::DOUBLE * count(*) FILTER (z = {i}) / nullif({total}, 0), 0)", f"pct{i}"))
    return sql(f"SELECT workout_id, {total} AS total, " + ", ".join(pct(i) for i in range(1, n + 1)) + f" FROM (SELECT workout_id, {zone} AS z FROM t) GROUP BY 1", POINTS, TH)


even = lambda x, s: f"round_even(CAST({x} AS DECIMAL(12,2)) * {s:.2f}::DECIMAL(4,2), 0)"
f32 = lambda x, s: f"trunc(CAST({x} AS FLOAT) * CAST({s} AS FLOAT))"
HRR = "CASE WHEN heart_rate > resting_hr THEN 100.0::DOUBLE * (heart_rate - resting_hr) / (max_hr - resting_hr) WHEN heart_rate IS NOT NULL THEN 0 END"
SEG = """seg AS (SELECT * FROM (SELECT workout_id, ts_s - lag(ts_s) OVER w AS dt, distance - lag(distance) OVER w AS dd, 100 * (elevation - lag(elevation) OVER w) / (distance - lag(distance) OVER w) AS g FROM points WINDOW w AS (PARTITION BY workout_id ORDER BY seq)) WHERE dt > 0 AND dd > 0 AND g IS NOT NULL),
  segf AS (SELECT *, CASE WHEN abs(g) <= 10 THEN 1 + 0.033::DOUBLE * g WHEN g > 10 THEN 1 + 0.05::DOUBLE * g ELSE 1 + 0.02::DOUBLE * g END AS f FROM seg)"""
NGP = "ngp AS (SELECT workout_id, avg(dt / 60.0::DOUBLE / (dd / 1000) * f) AS ngp FROM segf GROUP BY 1)"
AP = "ap AS (SELECT workout_id, max_by(ts_s, seq) / 60.0::DOUBLE / (max_by(distance, seq) / 1000) AS p FROM points GROUP BY 1 HAVING max_by(distance, seq) > 0)"
VD = "vd AS (SELECT workout_id, least(greatest(0.000104::DOUBLE * (1000 / p) ** 2 + 0.182::DOUBLE * (1000 / p) - 4.6::DOUBLE, 20), 85) AS vdot FROM ap WHERE p > 0)"
EL = "el AS (SELECT workout_id, sum(greatest(d, 0)) AS gain, sum(greatest(-d, 0)) AS loss, max(ts_s) AS t FROM (SELECT workout_id, ts_s, elevation - lag(elevation) OVER (PARTITION BY workout_id ORDER BY seq) AS d FROM points) GROUP BY 1)"
LAPS = "laps AS (SELECT workout_id, lap_number, coalesce(sum(stroke_count), 0) AS strokes, max(ts_s) - min(ts_s) AS seconds, max(distance) AS d, arg_min(stroke_type, seq) AS stroke_type FROM points GROUP BY 1, 2), lap2 AS (SELECT *, CASE WHEN strokes > 0 AND seconds > 0 THEN strokes + seconds ELSE 0 END AS swolf FROM laps)"
XHR = "100.0::DOUBLE * (heart_rate - 50) / 140"
TE = f"""e AS (SELECT workout_id, heart_rate, ts_s - lag(ts_s) OVER (PARTITION BY workout_id ORDER BY seq) AS dt, {XHR} AS x FROM points),
  s AS (SELECT workout_id, coalesce(sum(dt / 60.0::DOUBLE * CASE WHEN x < 30 THEN 0.05 WHEN x < 50 THEN 0.2 + (x - 30) * 0.02 WHEN x < 70 THEN 0.6 + (x - 50) * 0.03 WHEN x < 85 THEN 1.2 + (x - 70) * 0.05 ELSE 2 + (x - 85) * 0.08 END), 0) AS epoc,
    100.0::DOUBLE * coalesce(sum(dt) FILTER (x >= 80), 0) / nullif(sum(dt) FILTER (heart_rate IS NOT NULL), 0) AS hi FROM e GROUP BY 1),
  b AS (SELECT workout_id, count(*) FILTER (n >= 11) AS nb FROM (SELECT workout_id, g, count(*) FILTER (h) AS n FROM (SELECT workout_id, heart_rate > 150 AS h, sum(CASE WHEN heart_rate > 150 THEN 0 ELSE 1 END) OVER (PARTITION BY workout_id ORDER BY seq) AS g FROM points WHERE heart_rate IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
  te AS (SELECT workout_id, epoc, least(CASE WHEN q < 20 THEN 0.5 + q / 40 WHEN q < 40 THEN 1 + (q - 20) / 20 WHEN q < 60 THEN 2 + (q - 40) / 20 WHEN q < 100 THEN 3 + (q - 60) / 40 ELSE 4 + least((q - 100) / 50, 1.5) END, 5.5) AS a,
    least(CASE WHEN h < 5 THEN h * 0.1 WHEN h < 15 THEN 0.5 + (h - 5) * 0.1 WHEN h < 25 THEN 1.5 + (h - 15) * 0.08 ELSE 2.3 + (h - 25) * 0.06 END + least(coalesce(nb, 0) * 0.15, 1.5), 5.5) AS an
    FROM (SELECT s.workout_id, epoc, coalesce(hi, 0) AS h, nb, epoc / greatest(sec / 3600.0::DOUBLE, 0.5) AS q FROM s LEFT JOIN b USING (workout_id) JOIN (SELECT workout_id, max(ts_s) AS sec FROM points GROUP BY 1) USING (workout_id)))"""
SPLIT = """pd AS (SELECT workout_id, seq, ts_s, distance * 15 + seq % 7 * 11 AS d FROM points),
  sp AS (SELECT workout_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS split, d AS d0, ts_s AS t0, CAST(NULL AS DOUBLE) AS done, CAST(NULL AS BIGINT) AS sec FROM pd WHERE seq = 0
    UNION ALL SELECT p.workout_id, p.seq, CASE WHEN p.d - s.d0 >= 1000 THEN s.split + 1 ELSE s.split END, CASE WHEN p.d - s.d0 >= 1000 THEN p.d ELSE s.d0 END, CASE WHEN p.d - s.d0 >= 1000 THEN p.ts_s ELSE s.t0 END,
      CASE WHEN p.d - s.d0 >= 1000 THEN p.d - s.d0 END, CASE WHEN p.d - s.d0 >= 1000 THEN p.ts_s - s.t0 END FROM sp s JOIN pd p ON p.workout_id = s.workout_id AND p.seq = s.seq + 1),
  parts AS (SELECT workout_id, split, done AS d, sec FROM sp WHERE done IS NOT NULL UNION ALL
    SELECT l.workout_id, l.split + 1, p.d - l.d0, p.ts_s - l.t0 FROM (SELECT workout_id, arg_max(split, seq) AS split, arg_max(d0, seq) AS d0, arg_max(t0, seq) AS t0, max(seq) AS seq FROM sp GROUP BY 1) l JOIN pd p USING (workout_id, seq) WHERE p.d > l.d0)"""
conf = lambda s, a, b, x, y, z: f"CASE WHEN {s} > {a} THEN {x} WHEN {s} > {b} THEN {y} WHEN {s} IS NOT NULL THEN {z} END"
rate = lambda x, ends: f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} <= {e} THEN '{n}'" for e, n in zip(ends, ("Excellent", "Good", "Average", "BelowAverage"), strict=True)) + " ELSE 'Poor' END"

ORACLES = {
    "zone_hr_lthr": zone_sql(case("heart_rate", [f"heart_rate <= {even('lthr', s)}" for s in zones.LTHR_ENDS]), 5),
    "zone_hr_maxhr": zone_sql(case("heart_rate", [f"heart_rate <= {even('max_hr', s)}" for s in zones.MAX_HR_ENDS]), 5),
    "zone_hr_hrr": sql("SELECT workout_id, " + ", ".join(i8(f"coalesce(sum(dt) FILTER (z = {i}), 0)", f"s{i}") for i in range(1, 6)) + f" FROM (SELECT workout_id, ts_s - lag(ts_s) OVER (PARTITION BY workout_id ORDER BY seq) AS dt, {case('p', [f'p < {x}' for x in (60, 70, 80, 90)])} AS z FROM (SELECT *, {HRR} AS p FROM t)) GROUP BY 1", POINTS, TH),
    "zone_hr_ml": zone_sql(case("heart_rate", [f"100.0::DOUBLE * (heart_rate / lthr::DOUBLE) < {x}" for x in (65, 75, 85, 95)]), 5, True),
    "zone_hr_batch": zone_sql(case("heart_rate", [f"heart_rate < {f32('lthr', s)}" for s in zones.MAX_HR_ENDS]), 5),
    "zone_power_coggan": zone_sql(case("power", [f"power <= round_even(round_even(CAST(ftp AS DECIMAL(12,2)) / 5, 0) * {s:.2f}::DECIMAL(4,2), 0)" for s in zones.POWER_ENDS]), 7),
    "zone_power_batch": zone_sql(case("power", [f"power < {f32('ftp // 5', s)}" for s in zones.POWER_ENDS_BATCH]), 7),
    "zone_pace": zone_sql(case("pace", [f"pace >= threshold_pace * {s}::DOUBLE" for s in zones.PACE_STARTS]), 5),
    "zone_pace_batch": zone_sql(case("pace", [f"pace > threshold_pace * {s}::DOUBLE" for s in zones.PACE_STARTS_BATCH]), 5),
    "zone_pace_absolute": zone_sql(case("pace", [f"pace > {x}" for x in zones.ABSOLUTE_PACES]), 6),
    "zone_tables_hr": sql("SELECT athlete_id, " + ", ".join(i8(even("lthr", s), f"z{i + 1}") for i, s in enumerate(zones.LTHR_ENDS)) + f", {i8('lthr + 20', 'z5')} FROM athletes", ATHLETES),
    "zone_tables_max": sql("SELECT athlete_id, " + ", ".join(i8(even("max_hr", s), f"z{i + 1}") for i, s in enumerate(zones.MAX_HR_ENDS)) + f", {i8('max_hr + 10', 'z5')} FROM athletes", ATHLETES),
    "zone_tables_power": sql("SELECT athlete_id, " + ", ".join(i8(even("ftp", s), f"z{i + 1}") for i, s in enumerate(zones.POWER_ENDS)) + f", {i8('ftp * 3', 'z7')} FROM athletes", ATHLETES),
    "zone_tables_pace": sql("SELECT athlete_id, " + ", ".join(r4(f"threshold_pace * {s}", f"z{i + 1}_from") for i, s in enumerate(zones.PACE_STARTS)) + " FROM athletes", ATHLETES),
    "zone_tables_running": sql(f"SELECT athlete_id, {i8('z', 'zone')}, {r4('threshold_pace * a', 'fastest')}, {r4('threshold_pace * b', 'slowest')}, {i8('CASE WHEN z = 6 THEN lthr + 20 ELSE floor(lthr * h::DOUBLE) END', 'hr_to')} FROM athletes, (VALUES " + ", ".join(f"({z}, {a}, {b}, {h})" for z, a, b, _, h in zones.RUNNING) + ") v(z, a, b, h)", ATHLETES),
    "intensity_pattern": sql(f"SELECT athlete_id, {r4('l', 'low')}, {r4('m', 'moderate')}, {r4('h', 'high')}, CASE WHEN l >= 75 AND h >= 15 AND m <= 15 THEN 'polarized' WHEN m >= 40 THEN 'threshold' WHEN h >= 40 THEN 'high_intensity' ELSE 'mixed' END AS pattern FROM (SELECT athlete_id, 100.0::DOUBLE * count(*) FILTER (intensity_factor < 0.75) / count(*) AS l, 100.0::DOUBLE * count(*) FILTER (intensity_factor >= 0.75 AND intensity_factor < 0.95) / count(*) AS m, 100.0::DOUBLE * count(*) FILTER (intensity_factor >= 0.95) / count(*) AS h FROM workouts GROUP BY 1)", WORKOUTS),
    "intensity_time": sql("SELECT athlete_id, " + ", ".join(r4(f"100.0::DOUBLE * coalesce(sum(duration_seconds) FILTER ({t}), 0) / sum(duration_seconds)", n) for n, t in (("easy", "intensity_factor < 0.75"), ("moderate", "intensity_factor >= 0.75 AND intensity_factor < 0.85"), ("hard", "intensity_factor >= 0.85"))) + " FROM workouts WHERE intensity_factor IS NOT NULL GROUP BY 1", WORKOUTS),
    "threshold_estimates": sql(f"SELECT athlete_id, {i8(even('ftp', 0.95), 'ftp')}, {i8('CASE WHEN athlete_id % 110 BETWEEN 10 AND 100 THEN 220 - athlete_id % 110 END', 'max_hr')}, {r4('(15 + athlete_id % 20) / 5.0::DOUBLE', 'pace_5k')}, {r4('(32 + athlete_id % 30) / 10.0::DOUBLE * 0.98', 'pace_10k')} FROM athletes", ATHLETES),
    "average_pace": sql(f"SELECT workout_id, {r4('p', 'avg_pace')} FROM ap", POINTS, AP),
    "graded_pace": sql(f"SELECT workout_id, {r4('ngp', 'ngp')} FROM ngp", POINTS, SEG, NGP),
    "gap_pace": sql(f"SELECT workout_id, {r4('sum(dt / nullif(f, 0)) / 60 / (sum(dd) / 1000)', 'gap')} FROM segf GROUP BY 1", POINTS, SEG),
    "splits_1km": sql(f"SELECT workout_id, split, {r4('d', 'distance')}, {i8('sec', 'seconds')}, {r4('sec / 60.0::DOUBLE / (d / 1000)', 'pace')} FROM parts", POINTS, SPLIT),
    "efficiency_factor": sql(f"SELECT workout_id, {r4('1000 / nullif(ngp * 60, 0) / nullif(h, 0)', 'ef')} FROM ngp JOIN (SELECT workout_id, sum(heart_rate) // nullif(count(heart_rate), 0) AS h FROM points GROUP BY 1) USING (workout_id)", POINTS, SEG, NGP),
    "elevation_gain": sql(f"SELECT workout_id, {i8('gain', 'gain')}, {i8('loss', 'loss')}, {r4('gain / nullif(t / 3600.0::DOUBLE, 0)', 'vam')} FROM el", POINTS, EL),
    "gradient_hist": sql(f"SELECT workout_id, {r4('avg(g)', 'mean_grade')}, {r4('max(g)', 'max_grade')}, " + ", ".join(i8(f"coalesce(sum(dt) FILTER ({t}), 0)", n) for n, t in (("steep_down", "g < -10"), ("down", "g >= -10 AND g < -3"), ("flat", "g >= -3 AND g < 3"), ("up", "g >= 3 AND g < 10"), ("steep_up", "g >= 10"))) + " FROM seg GROUP BY 1", POINTS, SEG),
    "elevation_stress": sql(f"SELECT workout_id, {r4('50 * t / 3600.0::DOUBLE + (gain + loss) / 100.0::DOUBLE * 10', 'stress')} FROM el", POINTS, EL),
    "race_times": sql(f"SELECT workout_id, {r4('vdot', 'vdot')}, race, {r4('km', 'km')}, {r4('km::DOUBLE * 240 / vdot * CASE WHEN km <= 5 THEN 1 WHEN km <= 10 THEN 1.05 WHEN km <= 21.1 THEN 1.12 ELSE 1.2 END', 'minutes')} FROM vd, (VALUES " + ", ".join(f"('{n}', {d})" for n, d in running.RACES) + ") v(race, km)", POINTS, AP, VD),
    "training_paces": sql("SELECT workout_id, " + ", ".join(r4(f"{m} * 1000 / sqrt((vdot + 4.6::DOUBLE - 0.182::DOUBLE) / 0.000104::DOUBLE)", n) for n, m in running.TRAINING_PACES) + " FROM vd", POINTS, AP, VD),
    "running_dynamics": sql(f"SELECT workout_id, {i8('gct', 'gct')}, {i8('vo', 'vo')}, {r4('stride', 'stride')}, {i8('100', 'coverage')}, {rate('gct', (200, 250, 300, 350))} AS gct_rating, {rate('vo', (60, 80, 100, 120))} AS vo_rating, CASE WHEN stride BETWEEN 1.0 AND 1.6 THEN 'Good' WHEN stride BETWEEN 0.8 AND 1.8 THEN 'Average' ELSE 'BelowAverage' END AS stride_rating FROM (SELECT workout_id, sum(ground_contact_time) // count(*) AS gct, sum(vertical_oscillation) // count(*) AS vo, avg(stride_length) AS stride FROM points GROUP BY 1)", POINTS),
    "cadence_variation": sql(f"SELECT workout_id, {i8('m', 'mean_cadence')}, {r4('100 * sqrt(avg((cadence - m) ** 2)) / m', 'cv_pct')} FROM points JOIN (SELECT workout_id, sum(cadence) // count(cadence) AS m FROM points GROUP BY 1) USING (workout_id) GROUP BY workout_id, m", POINTS),
    "swim_laps": sql(f"SELECT workout_id, {i8('lap_number', 'lap_number')}, {i8('strokes', 'strokes')}, {i8('seconds', 'seconds')}, {i8('swolf', 'swolf')}, {r4('seconds / nullif(d / 100, 0)', 'pace_100')}, {i8('stroke_type', 'stroke_type')} FROM lap2", POINTS, LAPS),
    "strokes_per_lap": sql(f"SELECT workout_id, {r4('avg(m)', 'strokes_per_lap')}, {i8('sum(s)', 'strokes')} FROM (SELECT workout_id, lap_number, avg(stroke_count) AS m, sum(stroke_count) AS s FROM points GROUP BY 1, 2) GROUP BY 1", POINTS),
    "swolf": sql(f"SELECT workout_id, {r4('avg(swolf)', 'mean')}, {i8('min(swolf)', 'best')}, {i8('CASE WHEN floor(100 * stddev_pop(swolf) / avg(swolf)) > 255 THEN 0 ELSE floor(100 * stddev_pop(swolf) / avg(swolf)) END', 'cv_pct')} FROM lap2 WHERE swolf > 0 GROUP BY 1", POINTS, LAPS),
    "stroke_mix": sql(f"SELECT workout_id, CASE stroke_type WHEN 1 THEN 'Backstroke' WHEN 2 THEN 'Breaststroke' WHEN 3 THEN 'Butterfly' WHEN 4 THEN 'Drill' WHEN 5 THEN 'Mixed' WHEN 6 THEN 'IM' ELSE 'Freestyle' END AS stroke, count(*) AS n, {r4('100.0::DOUBLE * count(*) / max(duration_seconds)', 'pct')} FROM points JOIN sessions USING (workout_id) GROUP BY 1, 2", POINTS, SESSIONS),
    "swim_pace": sql(f"SELECT workout_id, {r4('avg(100 / speed)', 'mean')}, {r4('min(100 / speed)', 'best')}, {r4('100 * stddev_pop(100 / speed) / avg(100 / speed)', 'cv_pct')} FROM points WHERE speed > 0 GROUP BY 1", POINTS),
    "stroke_efficiency": sql(f"SELECT workout_id, {r4('d / s', 'distance_per_stroke')}, {r4('s * 60.0::DOUBLE / t', 'stroke_rate')}, CASE WHEN d / s >= 2.5 THEN 'Excellent' WHEN d / s >= 2 THEN 'Good' WHEN d / s >= 1.5 THEN 'Average' WHEN d / s >= 1 THEN 'BelowAverage' ELSE 'Poor' END AS rating FROM (SELECT workout_id, CAST(sum(strokes) AS DOUBLE) AS s, sum(seconds) AS t FROM laps WHERE strokes > 0 AND seconds > 0 GROUP BY 1) JOIN (SELECT workout_id, max(distance) AS d FROM points GROUP BY 1) USING (workout_id)", POINTS, LAPS),
    "epoc_te": sql(f"SELECT workout_id, {r4('epoc', 'epoc')}, {r4('a', 'aerobic')}, {r4('an', 'anaerobic')}, CASE WHEN a < 1 THEN 'None' WHEN a < 2 THEN 'Minor' WHEN a < 3 THEN 'Maintaining' WHEN a < 4 THEN 'Improving' WHEN a < 5 THEN 'HighlyImproving' ELSE 'Overreaching' END AS level, {i8('floor(0.9 * CASE WHEN a * 0.7 + an * 0.3 < 1 THEN 12 WHEN a * 0.7 + an * 0.3 < 2 THEN 24 WHEN a * 0.7 + an * 0.3 < 3 THEN 36 WHEN a * 0.7 + an * 0.3 < 4 THEN 48 ELSE 72 END) + CASE WHEN an > 3 THEN 12 WHEN an > 2 THEN 6 ELSE 0 END', 'recovery_hours')} FROM te", POINTS, TE),
    "hr_bouts": sql("SELECT workout_id, count(*) FILTER (n >= 3) AS bouts FROM (SELECT workout_id, g, count(*) FILTER (h) AS n FROM (SELECT workout_id, heart_rate > 100 AS h, sum(CASE WHEN heart_rate > 100 THEN 0 ELSE 1 END) OVER (PARTITION BY workout_id ORDER BY seq) AS g FROM points WHERE heart_rate IS NOT NULL) GROUP BY 1, 2) GROUP BY 1", POINTS),
    "vo2_trend": sql(f"SELECT athlete_id, {r4('CASE WHEN count(*) = 1 THEN 0 ELSE coalesce(regr_slope(v, d), 0) END', 'slope')}, {r4('avg(v)', 'mean')}, {r4('min(v)', 'low')}, {r4('max(v)', 'high')}, count(*) AS n, min(date) AS first, max(date) AS last FROM (SELECT athlete_id, date, date - DATE '2000-01-01' AS d, (0.2::DOUBLE * 1000 / avg_pace + 3.5) / (avg_heart_rate / 190.0::DOUBLE) AS v FROM workouts WHERE avg_pace > 0 AND avg_heart_rate > 0) GROUP BY 1", WORKOUTS),
    "vo2_estimates": sql(f"""SELECT workout_id, {r4('avg_power * 10.8::DOUBLE / 70 + 7', 'power')}, {r4(conf('avg_power / 70.0::DOUBLE', 3, 2, 0.85, 0.75, 0.65), 'power_c')},
        {r4('(0.2::DOUBLE * 1000 / avg_pace + 3.5) / s', 'run')}, {r4('CASE WHEN avg_pace IS NOT NULL THEN ' + conf('s', 0.85, 0.75, 0.85, 0.7, 0.55) + ' END', 'run_c')}, {r4('(12.0::DOUBLE * avg_power / 70 + 3.5) / s', 'ride')}, {r4('CASE WHEN avg_power IS NOT NULL THEN ' + conf('s', 0.85, 0.75, 0.8, 0.65, 0.5) + ' END', 'ride_c')},
        {r4('31.5::DOUBLE / r + 3.5', 'reserve')}, {r4(conf('r', 0.8, 0.6, 0.75, 0.65, 0.5), 'reserve_c')} FROM (SELECT *, avg_heart_rate / 190.0::DOUBLE AS s, CASE WHEN avg_heart_rate > 120 THEN (avg_heart_rate - 120) / 70.0::DOUBLE END AS r FROM workouts)""", WORKOUTS),
}
