"""Hand-computed cases for what depends on order, borders and gaps."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadentia.functions import formula
from cadentia.operators import effect, features, load, plan, power, quality, recovery, running, store, zones
from cadentia.sources import files, workout_files
from cadentia.streaming import daily

POINT = "workout_id int, seq int, ts_s int, power int, heart_rate int, cadence int, elevation int, pace double, speed double, distance double, lap_number int, stroke_count int, stroke_type int"


def points(spark, **channels):
    n = max(map(len, channels.values()))
    cols = [x.split()[0] for x in POINT.split(", ")]
    row = lambda i: tuple(1 if c == "workout_id" else i if c in ("seq", "ts_s") and c not in channels else channels.get(c, [None] * n)[i] for c in cols)
    return spark.createDataFrame([row(i) for i in range(n)], POINT)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_np_flavours_differ_on_nulls_and_tails(spark):
    p = points(spark, power=[100, None, 300])
    # forward windows keep null slots: means 200, 300, 300
    assert one(power.np_tss(p)).np == math.floor(((200**4 + 300**4 + 300**4) / 3) ** 0.25)
    # nulls dropped, one window of both
    assert one(power.np_power(p)).np == 200


def test_mmp_golden(spark):
    p = points(spark, power=[100, 500, 400, 400, 300])
    got = {r.duration_s: r.max_power for r in power.mean_max(p, (1, 3, 6)).collect()}
    assert got == {1: 500, 3: 433}
    full = {r.duration_s: r.max_power for r in power.mean_max_full(p).collect()}
    assert full == {1: 500, 2: 450, 3: 433, 4: 400, 5: 340}


def test_key_powers_take_the_shorter_on_a_tie(spark):
    curve = spark.createDataFrame([(55, 300), (65, 200), (301, 250), (4000, 100)], "duration_s int, max_power int")
    got = {r.target_s: (r.duration_s, r.max_power) for r in power.key_powers(curve).collect()}
    assert got == {60: (55, 300), 300: (301, 250)}


def test_cp_fit_of_the_published_table(spark):
    curve = spark.createDataFrame([(1, 180, 350), (1, 300, 320), (1, 1200, 280), (2, 180, 300)], "workout_id int, duration_s int, max_power int")
    r = one(power.critical_power(curve))
    x, y = 1 / np.array([180, 300, 1200]), np.array([350, 320, 280])
    slope, intercept = np.polyfit(x, y, 1)
    assert r.w_prime == pytest.approx(slope) and r.cp == pytest.approx(intercept) and r.ftp == int(0.95 * intercept) and r.workout_id == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=2, max_size=40), st.integers(100, 400))
def test_w_prime_closed_form(spark, watts, cp):
    low, balance, below = 5000.0, 5000.0, 0
    for p in watts[:-1]:
        balance = min(5000.0, balance + cp - p)
        low, below = min(low, balance), below + (balance < 0)
    r = one(power.w_prime_balance(points(spark, power=watts), cp, 5000.0))
    assert r.min_balance == pytest.approx(low) and r.seconds_below_zero == below


def daily_rows(spark, values, start="2024-01-01"):
    day = dt.date.fromisoformat(start)
    return spark.createDataFrame([("a", day + dt.timedelta(days=i), float(v)) for i, v in values], "k string, date date, tss double")


def plain_pmc(values, start, days):
    by, ctl, atl, out, history = dict(values), 0.0, 0.0, [], []
    for i in range(-42, days):
        before = ctl
        t = by.get(i, 0.0)
        ctl, atl = ctl + (t - ctl) / 42, atl + (t - atl) / 7
        history.append(ctl)
        if i >= 0:
            out.append((ctl, atl, before - atl, ctl - history[-7]))
    return out


@pytest.mark.parametrize("values", [[(0, 100)], [(0, 100), (1, 50), (9, 300)], [(i, (i * 37) % 200) for i in range(0, 1500, 3)]])
def test_pmc_against_the_recursion(spark, values):
    days = values[-1][0] + 1
    got = load.pmc(daily_rows(spark, values), "k").orderBy("date").collect()
    wanted = plain_pmc(values, 0, days)
    assert len(got) == days
    for r, (ctl, atl, tsb, ramp) in zip(got, wanted, strict=True):
        assert (r.ctl, r.atl, r.tsb, r.ramp_rate) == pytest.approx((ctl, atl, tsb, ramp), abs=1e-9)


def test_pmc_range_before_and_inside_the_data(spark):
    rows = daily_rows(spark, [(0, 100), (5, 80)])
    early = load.pmc(rows, "k", start="2023-12-25", end="2024-01-03").orderBy("date").collect()
    assert len(early) == 10 and early[0].ctl == 0 and early[7].ctl == pytest.approx(100 / 42) and early[0].tsb == 0
    late = load.pmc(rows, "k", start="2024-01-04", end="2024-01-10").orderBy("date").collect()
    assert [r.date.day for r in late] == list(range(4, 11)) and late[0].ctl == pytest.approx(100 / 42 * (41 / 42) ** 3)
    assert load.pmc(rows.limit(0), "k").count() == 0


def test_streaks_and_iso_weeks(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), -20.0 if 2 <= i < 10 or i > 12 else 0.0) for i in range(16)]
    s = spark.createDataFrame(rows, "k string, date date, tsb double")
    assert one(load.longest_runs(s, "k", F.col("tsb") < -10)).longest == 8
    w = spark.createDataFrame([(1, dt.date(2024, 12, 30), "Running", 50.0, 3600, 1000.0), (2, dt.date(2021, 1, 1), "Running", 60.0, 3600, None)], "workout_id int, date date, sport string, tss double, duration_seconds int, total_distance double")
    assert {(r.year, r.week) for r in load.weekly_summary(w).collect()} == {(2024, 1), (2021, 53)}
    assert {(r.year, r.week) for r in load.weekly_summary(w, iso=True).collect()} == {(2025, 1), (2020, 53)}


def test_single_precision_zone_ends(spark):
    df = spark.range(50, 801).select(F.col("id").cast("int").alias("t"))
    got = df.select("t", *[zones.truncated_end(F.col("t"), s).alias(f"z{i}") for i, s in enumerate(zones.POWER_ENDS_BATCH)]).collect()
    assert all(r[f"z{i}"] == int(np.float32(r.t) * np.float32(s)) for r in got for i, s in enumerate(zones.POWER_ENDS_BATCH))
    assert next(r.z3 for r in got if r.t == 200) == 209


def test_zone_borders(spark):
    df = spark.createDataFrame([(134,), (135,), (None,)], "hr int")
    z = [r[0] for r in df.select(zones.hr_zone_lthr(F.col("hr"), F.lit(165))).collect()]
    assert z == [1, 2, None]  # 0.81 * 165 = 133.65 rounds to 134, its own zone included


def test_splits_drift(spark):
    d = [0.0, 600.0, 1300.0, 2100.0, 2299.0, 2350.0]
    got = [(r.split, r.distance, r.seconds) for r in running.splits(points(spark, distance=d), 1000.0).orderBy("split").collect()]
    assert got == [(1, 1300.0, 2), (2, 1050.0, 3)]


def test_elevation_null_gap(spark):
    p = points(spark, elevation=[100, None, 110, 105, 120])
    assert one(running.elevation(p)).gain == 15  # adjacent rows only
    s = spark.createDataFrame([(1, 3600, 250, 160, 6.0)], "workout_id int, duration_seconds int, ftp int, lthr int, threshold_pace double")
    paced = points(spark, elevation=[100, None, 110, 105, 120], pace=[6.0] * 5)
    assert one(load.pace_tss(paced, s, True)).tss == pytest.approx(100 * (1 + 0.02 * 25 / 3600))


def test_steep_descent_has_no_adjusted_time(spark):
    p = points(spark, distance=[0.0, 10.0, 20.0], elevation=[100, 95, 95])
    assert one(running.grade_adjusted_pace(p)).gap == pytest.approx((1 / 60) / 0.02)


def test_bouts(spark):
    assert one(effect.bouts(points(spark, heart_rate=[170] * 11 + [100] + [170] * 10 + [None] + [170]))).bouts == 2
    assert one(effect.bouts(points(spark, heart_rate=[170] * 10))).bouts == 0


def test_hrv_baseline_uses_upper_medians(spark):
    rows = [("a", dt.date(2024, 1, i + 1), i, v) for i, v in enumerate([50.0, 52.0, 51.0, 49.0, 500.0, 48.0])]
    n = spark.createDataFrame(rows, "k string, date date, night_id int, rmssd double")
    r = one(recovery.hrv_baseline(n, "k"))
    assert r.n == 5 and r.baseline == pytest.approx(50.0)


def test_overreaching(spark):
    values = [60.0, 59.0, 58.0, 57.0, 80.0, 60.0, 50.0, 40.0, 90.0]
    n = spark.createDataFrame([("a", dt.date(2024, 1, i + 1), i, v) for i, v in enumerate(values)], "k string, date date, night_id int, rmssd double")
    assert recovery.overreaching(n, "k").count() == 0  # the first of equal runs falls by less than a tenth
    n = n.where("night_id >= 3")
    r = one(recovery.overreaching(n, "k"))
    assert r.consecutive_days == 3 and r.deviation_pct == pytest.approx(-37.5) and r.severity == 71


def test_limit_comes_before_the_filter(spark):
    rows = [(i, i % 2, dt.date(2024, 1, i + 1), "Running" if i < 5 else "Cycling") for i in range(10)]
    w = spark.createDataFrame(rows, "workout_id int, athlete_id int, date date, sport string")
    assert store.query_workouts(w, 4, sport="Running").count() == 0
    assert store.query_workouts(w, 6, sport="Running").count() == 1


def test_duplicates(spark):
    rows = [(1, 7, "d", 10, "R", 1), (2, 7, "d", 10, "R", 2), (3, 7, "d", 10, "R", 2), (4, None, "d", 10, "R", 1), (5, None, "d", 10, "R", 2)]
    x = spark.createDataFrame(rows, "id int, athlete_id int, date string, duration_seconds int, sport string, created_at int")
    assert {(r.id, r.n_later) for r in store.duplicate_counts(x).collect()} == {(1, 2), (2, 1)}
    assert {(r.id, r.n_earlier) for r in store.duplicates_to_remove(x).collect()} == {(2, 1), (3, 1)}
    assert {r.id for r in store.without_duplicates(x).collect()} == {1, 4, 5}
    assert one(store.duplicates_by_sport(x)).n == 3


def test_rolling_leaves_out_later_rows_of_the_day(spark):
    rows = [(1, "a", dt.date(2024, 1, 1), 10.0, 60), (2, "a", dt.date(2024, 1, 8), 20.0, 60), (3, "a", dt.date(2024, 1, 8), 40.0, 60), (4, "a", dt.date(2024, 1, 9), 80.0, 60)]
    w = spark.createDataFrame(rows, "workout_id int, k string, date date, tss double, duration_seconds int")
    got = {r.workout_id: (r.tss, r.n) for r in features.rolling(w, "k", 7).collect()}
    assert got == {1: (10.0, 1), 2: (30.0, 2), 3: (70.0, 3), 4: (140.0, 3)}


def test_rule_actions_leave_rejects(spark):
    p = points(spark, power=[2500, 100], heart_rate=[250, 150], speed=[40.0, 5.0]).withColumn("sport", F.lit("Cycling"))
    rows = quality.apply_rules(p, [("Cycling", "power", 0.0, 2000.0, "Warning", "Clip"), ("Cycling", "heart_rate", 30.0, 220.0, "Error", "Reject"), ("Cycling", "speed", 0.0, 33.3, "Warning", "Interpolate")]).orderBy("seq").collect()
    assert [(r.power, r.heart_rate, r.speed) for r in rows] == [(2000.0, 250, None), (100.0, 150, 5.0)]


def test_quirks_by_firmware(spark):
    d = spark.createDataFrame([(1, 2697, 5), (1, 2697, None), (2, 1, 5)], "manufacturer int, product int, firmware int")
    q = spark.createDataFrame([(1, 2697, 4, 6, "ranged"), (1, 2697, None, None, "any"), (2, 0, None, None, "product 0")], "manufacturer int, product int, firmware_from int, firmware_to int, quirk string")
    assert sorted((r.firmware or 0, r.quirk) for r in quality.matching_quirks(d, q).collect()) == [(0, "any"), (5, "any"), (5, "ranged")]


def test_formulas(spark):
    df = spark.createDataFrame([(1.0, 0.8, 0.0)], "duration double, f double, z double")
    at = lambda text: df.select(formula.column(text, {"duration": F.col("duration"), "IF": F.col("f"), "z": F.col("z")})).first()[0]
    assert at(formula.BUILT_IN["classic"]) == pytest.approx(64) and at(formula.BUILT_IN["bikescore"]) == pytest.approx(0.8**1.5 * 100)
    assert at("2^3^2") == 512 and at("-2^2") == -4 and at("10/4") == 2.5 and at("1/z") is None and at("sqrt(IF*5)-(1 - duration)") == 2
    for bad in ("", "(1", "1)", "a$", "1 +", "x", "1 2"):
        with pytest.raises(formula.FormulaError):
            at(bad)
    assert formula.variables("sqrt(IF*2)+duration") == ["sqrt", "IF", "duration"] and formula.variables("1.5") == []
    r = formula.Registry()
    r.load('[formulas]\nmine = "IF*2"\n')
    assert r.get("mine") == "IF*2" and "classic" in r.names() and "mine" in r.dump() and r.remove("mine") and not r.remove("mine")


@settings(max_examples=5, deadline=None)
@given(st.integers(150, 350), st.integers(120, 400), st.integers(1800, 7200))
def test_tss_properties(spark, ftp, watts, seconds):
    s = lambda d: spark.createDataFrame([(1, d, ftp, 160, 6.0)], "workout_id int, duration_seconds int, ftp int, lthr int, threshold_pace double")
    p = points(spark, power=[watts] * 40)
    a, b = one(load.power_tss(p, s(seconds))), one(load.power_tss(p, s(2 * seconds)))
    assert a.tss > 0 and b.tss / a.tss == pytest.approx(2) and 0.5 <= one(power.np_tss(p)).np / watts <= 1.5


GOALS = "plan long, model string, pattern string, weeks int, target date, ctl double"


def test_plan_rows(spark):
    goal = spark.sql("SELECT 1L AS plan, 'Traditional' AS model, '3:1' AS pattern, 10 AS weeks, DATE '2024-03-11' AS target, CAST(NULL AS DOUBLE) AS ctl")
    weeks = plan.plan_weeks(goal).orderBy("week").collect()
    assert [r.phase for r in weeks] == ["Base"] * 4 + ["Build"] * 3 + ["Peak"] * 2 + ["Taper"]
    assert [r.recovery for r in weeks] == [False, False, False, True, False, False, False, True, False, False]
    assert [str(r.week_start) for r in weeks][::9] == ["2024-01-01", "2024-03-04"]
    days = plan.planned_workouts(plan.plan_weeks(goal))
    assert days.where("week = 4").agg(F.sum("planned_tss")).first()[0] == pytest.approx(0.6 * 0.6 * 200 * (1 + 0.3 * 3 / 4))


def test_plans_of_other_patterns_models_and_none(spark):
    import datetime as dt

    day = dt.date(2024, 6, 1)
    goals = spark.createDataFrame([(1, "block", "2:1", 10, day, 50.0), (2, "reverse", "2:1", 10, day, 50.0), (3, "block", "4:1", 0, day, 1.0), (4, "traditional", "4:1", 1, day, 10.0), (5, "traditional", "4:1", None, day, 10.0)], GOALS)
    rows = plan.plan_weeks(goals).orderBy("plan", "week").collect()
    assert [(r.week, r.recovery) for r in rows if r.plan == 1 and r.recovery] == [(4, True), (8, True)] and [r.phase for r in rows if r.plan == 1][8:] == ["Taper", "Taper"]
    assert [r.week for r in rows if r.plan == 2 and r.recovery] == [3, 6] and [r.phase for r in rows if r.plan == 2] == ["Intensity"] * 3 + ["Volume"] * 5 + ["Race Prep"] * 2
    assert [(r.plan, r.phase, r.planned_tss) for r in rows if r.plan > 2] == [(4, "Taper", 70.0)]
    for model, pattern in (("linear", "3:1"), ("block", "9:1"), (None, "3:1")):
        with pytest.raises(Exception, match="unknown"):
            plan.plan_weeks(spark.createDataFrame([(1, model, pattern, 3, day, 1.0)], GOALS)).collect()
    assert plan.plan_weeks(goals.limit(0)).count() == 0
    assert [plan.adjustment(*a) for a in (("increase", 15), ("decrease", 10), ("recovery",))] == [1.15, 0.9, 0.6]
    with pytest.raises(ValueError, match="unknown adjustment"):
        plan.adjustment("more")


def test_monitoring_of_a_plan(spark):
    compared = spark.createDataFrame([(1, f"2024-01-0{d}", 100.0, 50.0 if d > 1 else 300.0) for d in range(1, 9)] + [(2, "2024-01-01", 100.0, 700.0), (3, "2024-01-01", 0.0, 5.0)], "plan long, date string, planned_tss double, actual_tss double")
    compared = compared.withColumn("date", F.to_date("date"))
    starts = spark.sql("SELECT * FROM VALUES (1L, DATE '2024-01-01'), (2L, DATE '2024-02-01'), (3L, DATE '2023-12-11') AS t(plan, start)")
    got = {r.plan: (r.completion_pct, r.last_week_actual, r.week, r.adjustments, r.recommendations) for r in plan.monitor(compared, starts, "2024-01-05").collect()}
    assert got[1] == (81, 350.0, 1, plan.SAYS_UNDER, "") and got[2] == (700, 700.0, 1, f"{plan.SAYS_HIGH}; {plan.SAYS_OVER}", plan.SAYS_HEAVY)
    assert got[3] == (0, 5.0, 4, f"{plan.SAYS_LOW}; {plan.SAYS_OVER}", plan.SAYS_REST)


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Elapsed Time,HR,Watts,Altitude,Foo\n2024-01-01 10:00:00,120,200,10,x\n2024-01-01 10:00:05,oops,210,12,y\n")
    (tmp_path / "notes.txt").write_text("no samples")
    good, left = files.read_directory(spark, str(tmp_path))
    rows = good.orderBy("seq").collect()
    assert [(r.ts_s, r.heart_rate, r.power, r.elevation, r.pace) for r in rows] == [(0, 120, 200, 10, None), (5, None, 210, 12, None)]
    assert [r.path.rsplit("/", 1)[1] for r in left.collect()] == ["notes.txt"]
    s = one(files.summarise(good))
    assert (s.avg_power, s.avg_heart_rate, s.duration_seconds, s.elevation_gain) == (205, 120, 5, 2)


def test_csv_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,power,hr\n1,250,130\n2,260,\n")
    (tmp_path / "b.csv").write_text('\ufeff"Heart Rate",time,Watts,Lat,lng,note\r\n130,1,250,47.5,8.25,"x, y"\r\n\r\n131,2,oops,47.6,8.26,z\r\n')
    (tmp_path / "empty.csv").write_text("")
    got = {}
    for r in files.read_csv(spark, str(tmp_path)).orderBy("seq").collect():
        got.setdefault(r.workout_id.rsplit("/", 1)[1], []).append((r.seq, r.power, r.heart_rate, r.latitude, r.longitude))
    assert got == {"a.csv": [(0, 250, 130, None, None), (1, 260, None, None, None)], "b.csv": [(0, 250, 130, 47.5, 8.25), (1, None, 131, 47.6, 8.26)]}
    (tmp_path / "t.csv").write_text("time,power\n01/02/2024 10:00:05,1\n01/02/2024 10:00:00,2\n01/02/2024 10:00:09,3\n")
    assert [r.ts_s for r in files.read_csv(spark, str(tmp_path / "t.csv")).orderBy("seq").collect()] == [0, 0, 4]


def test_export_pairs(spark, tmp_path):
    w = spark.createDataFrame([(1, 7, dt.date(2024, 1, 3), "Cycling", 50.0, 3600, 30_000.0), (2, 7, dt.date(2024, 2, 29), "Running", None, 1800, None)], "workout_id int, athlete_id int, date date, sport string, tss double, duration_seconds int, total_distance double")
    assert files.summary_rows(w).columns == list(files.SUMMARY_COLUMNS) and [r.Distance_KM for r in files.summary_rows(w).orderBy("Date").collect()] == [30.0, None]
    assert [(str(r.Week_Start), str(r.Week_End), r.Week_Number, r.Total_TSS) for r in files.weekly_rows(w).orderBy("Week_Start").collect()] == [("2024-01-01", "2024-01-07", 1, 50.0), ("2024-02-26", "2024-03-03", 9, 0.0)]
    assert [(r.Month_Name, r.Avg_Daily_TSS) for r in files.monthly_rows(w).orderBy("Month").collect()] == [("January", 50 / 31), ("February", 0.0)]
    curve = spark.createDataFrame([(90, 300)], "duration_s int, max_power int")
    assert [tuple(r) for r in files.curve_rows(curve).collect()] == [(90, "1.50", 300)]
    keys = spark.createDataFrame([(60, 58, 410)], "target_s int, duration_s int, max_power int")
    assert {(r.Duration, r.Power_Watts, r.System) for r in files.key_power_rows(keys).collect()} >= {("1_minute", 410, "Anaerobic"), ("5_seconds", 0, "Sprint")}
    for kind, what in (("csv", "summaries"), ("csv", "pmc"), ("json", "report"), ("text", "report")):
        files.export_as(kind, what, w, str(tmp_path / f"{kind}-{what}"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv-pmc")).count() == 58
    p = points(spark, power=[1, 2, 3])
    one_workout = p.select("workout_id").distinct().selectExpr("workout_id", "DATE '2024-05-01' AS date", "3 AS duration_seconds", "'a & b' AS notes")
    files.export_as("pwx", "workout", one_workout, str(tmp_path / "pwx"), p, power.mean_max_full(p))
    assert spark.read.text(f"{tmp_path}/pwx/*", wholetext=True).first()[0].count("<peak>") == 3
    with pytest.raises(ValueError):
        files.export_as("pwx", "workout", w, str(tmp_path / "two"), p)
    with pytest.raises(ValueError):
        files.export_as("json", "pmc", w, str(tmp_path / "none"))
    long = spark.range(1, 1001).select(F.lit(1).alias("workout_id"), F.col("id").cast("int").alias("duration_s"), F.lit(5).alias("max_power"))
    assert len(one(workout_files.documents(one_workout, p, long)).metrics.powerCurve.peak) == 334


def test_import_bookkeeping(spark):
    f = spark.createDataFrame([("/x/a.CSV",), ("/x/b.fit",), ("/x/c.gpx",), ("/x/csv",)], "path string")
    assert [r.importable for r in files.importable(f).orderBy("path").collect()] == [True, True, False, False]
    read = spark.createDataFrame([("/x/a.CSV", 0), ("/x/a.CSV", 1)], "workout_id string, seq int")
    assert {tuple(r) for r in files.validate_only(f.where("path < '/x/c'"), read).collect()} == {("/x/a.CSV", True, 2), ("/x/b.fit", False, 0)}
    m = one(files.cache_metrics(spark.createDataFrame([(True,), (False,), (True,)], "hit boolean"), spark.createDataFrame([(10,), (30,)], "size long")))
    assert tuple(m) == (2, 1, 2 / 3, 2, 40, 20.0)


def test_csv_seconds(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time,power\n0.5,1\n1.5,2\n")
    assert [r.ts_s for r in files.read_csv(spark, str(tmp_path / "b.csv")).orderBy("seq").collect()] == [0, 1]
    (tmp_path / "c.csv").write_text("power\n5\n6\n")
    assert [r.ts_s for r in files.read_csv(spark, str(tmp_path / "c.csv")).orderBy("seq").collect()] == [0, 1]


def test_fit_heads(spark, tmp_path):
    (tmp_path / "ok.fit").write_bytes(bytes([14, 16]) + b"\0" * 6 + b".FIT" + b"\0" * 10)
    (tmp_path / "short.fit").write_bytes(bytes([14, 16]) + b"\0" * 6)
    (tmp_path / "bad.fit").write_bytes(bytes([99, 16]) + b"\0" * 6 + b".FIT" + b"\0" * 10)
    got = {r.path.rsplit("/", 1)[1]: r.state for r in files.fit_heads(spark, str(tmp_path)).collect()}
    assert got == {"ok.fit": "ok", "short.fit": "truncated", "bad.fit": "bad_header"}


def test_exports(spark, tmp_path):
    p = points(spark, power=[1, 2, 3])
    for kind in ("csv", "json", "parquet"):
        files.export(p, kind, str(tmp_path / kind))
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        assert getattr(reader, kind)(str(tmp_path / kind)).count() == 3
    with pytest.raises(ValueError):
        files.export(p, "pdf", str(tmp_path / "x"))
    workouts = p.select("workout_id").distinct().selectExpr("workout_id", "DATE '2024-05-01' AS date", "3 AS duration_seconds", "CAST(NULL AS STRING) AS sport")
    assert len(one(workout_files.documents(workouts, p)).sample) == 3
    assert [r.seq for r in files.downsampled(p, 2).orderBy("seq").collect()] == [0, 1, 2]


def test_stream_counts_daily_load(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 8), 50.0), (1, dt.datetime(2024, 1, 1, 20), None), (1, dt.datetime(2024, 1, 9, 8), 70.0)]
    spark.createDataFrame(rows, "athlete_id int, ts timestamp, tss double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("athlete_id int, ts timestamp, tss double").parquet(str(tmp_path / "in"))
    q = daily.daily_load(s).writeStream.outputMode("complete").format("memory").queryName("loads").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.date), r.tss, r.n) for r in spark.table("loads").collect()} == {("2024-01-01", 50.0, 2), ("2024-01-09", 70.0, 1)}


def test_empty_inputs(spark):
    p = spark.createDataFrame([], POINT)
    for f in (power.np_tss, power.np_power, power.mean_max_full, running.splits, running.elevation, running.laps, running.swolf, effect.bouts, files.summarise):
        assert f(p).count() == 0
