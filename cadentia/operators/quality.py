"""Validation rules, cleaning, device quirks, store integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators.rows import of, whole

#: Default rules (sport, field, min, max, severity, action).
RULES = [
    ("Cycling", "power", 0.0, 2000.0, "Warning", "Clip"),
    ("Cycling", "heart_rate", 30.0, 220.0, "Error", "Flag"),
    ("Cycling", "cadence", 0.0, 220.0, "Warning", "Flag"),
    ("Cycling", "speed", 0.0, 33.3, "Warning", "Clip"),
    ("Cycling", "power_balance", 30.0, 70.0, "Info", "Flag"),
    ("Running", "heart_rate", 30.0, 220.0, "Error", "Flag"),
    ("Running", "cadence", 120.0, 220.0, "Warning", "Flag"),
    ("Running", "speed", 0.0, 6.94, "Warning", "Clip"),
    ("Running", "stride_length", 0.5, 2.5, "Warning", "Flag"),
    ("Running", "vertical_oscillation", 5.0, 15.0, "Info", "Flag"),
    ("Running", "ground_contact_time", 150.0, 350.0, "Info", "Flag"),
    ("Swimming", "heart_rate", 30.0, 190.0, "Error", "Flag"),
    ("Swimming", "speed", 0.0, 3.0, "Warning", "Clip"),
    ("Swimming", "stroke_count", 5.0, 50.0, "Info", "Flag"),
]
#: Hard ranges; what lies outside becomes null.
HARD = {
    "heart_rate": (30, 220), "power": (0, 2000), "cadence": (0, 300), "speed": (0, 100), "ground_contact_time": (100, 500),
    "vertical_oscillation": (40, 200), "stride_length": (0.5, 3.0), "stroke_count": (0, 100), "stroke_type": (0, 6), "lap_number": (1, 1000),
}
DYNAMICS, STROKES = ("ground_contact_time", "vertical_oscillation", "stride_length"), ("stroke_count", "stroke_type")


def field(name: str) -> Column:
    """A rule's field of a point: balance in per cent, oscillation in cm."""
    if name == "power_balance":
        return F.col("balance").cast("double")
    if name == "vertical_oscillation":
        return F.col("vertical_oscillation") / 10.0
    return F.col(name).cast("double")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "sport string, field string, low double, high double, severity string, action string")


#: Rules at most: they become one expression.
MOST_RULES = 1000


def _broken(rules: DataFrame, fields: list[str]) -> list[tuple[str, str, Column]]:
    """(field, severity, whether a point breaks it) of each rule on one of the fields."""
    known = rules.limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = []
    for r in known:
        if r.field in fields:
            value = field(r.field)
            outside = F.coalesce(value < r.low if r.low is not None else F.lit(None), F.lit(False)) | F.coalesce(value > r.high if r.high is not None else F.lit(None), F.lit(False))
            out.append((r.field, r.severity, F.coalesce(F.col("sport") == r.sport, F.lit(False)) & outside))
    return out


def check_rules(points: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Violations by workout, field and severity, in one aggregation: each point lists the rules that it breaks."""
    broken = [F.when(hit, F.struct(F.lit(name).alias("field"), F.lit(severity).alias("severity"))) for name, severity, hit in _broken(rules, fields)]
    listed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<struct<field:string,severity:string>>")
    return points.select("workout_id", F.explode(listed).alias("x")).groupBy("workout_id", "x.field", "x.severity").agg(F.count("*").alias("violations"))


def rule_report(points: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Points of each workout that break any rule, and whether it passes (no errors)."""
    bad, errors = F.lit(False), F.lit(0)
    for _, severity, hit in _broken(rules, fields):
        bad = bad | hit
        if severity == "Error":
            errors = errors + hit.cast("int")
    told = points.select("workout_id", bad.alias("bad"), errors.cast("long").alias("errors"))
    return told.groupBy("workout_id").agg(F.count("*").alias("n_points"), F.count_if("bad").alias("failed_points"), F.sum("errors").alias("errors"), (F.sum("errors") == 0).alias("passed"))


def apply_rules(points: DataFrame, rules=RULES) -> DataFrame:
    """Points with rules applied in order: Clip to the bound, Interpolate to null; Flag and Reject leave the value."""
    edits = {}
    for sport, name, low, high, _, action in rules:
        if action not in ("Clip", "Interpolate") or name in ("power_balance", "vertical_oscillation"):
            continue
        c = edits.get(name, F.col(name).cast("double"))
        fixed = F.least(F.greatest(c, F.lit(low)), F.lit(high)) if action == "Clip" else F.when(c.between(low, high), c)
        edits[name] = F.when((F.col("sport") == sport) & c.isNotNull(), fixed).otherwise(c)
    return points.withColumns(edits)


def clean_points(points: DataFrame) -> DataFrame:
    """Hard ranges: what lies outside becomes null; pace must be above 0 and at most 1000, distance not negative."""
    out = {c: F.when(F.col(c).between(*r), F.col(c)) for c, r in HARD.items() if c in points.columns}
    if "pace" in points.columns:
        out["pace"] = F.when((F.col("pace") > 0) & (F.col("pace") <= 1000), F.col("pace"))
    if "distance" in points.columns:
        out["distance"] = F.when(F.col("distance") >= 0, F.col("distance"))
    return points.withColumns(out)


def clean_for_sport(points: DataFrame) -> DataFrame:
    """Speed ranges by sport and foreign channels to null; triathlon goes through running, swimming and cycling."""
    s, v = F.col("sport"), F.col("speed")
    speed = (
        F.when(s == "Running", F.when(v.between(1, 15), v)).when(s == "Swimming", F.when(v.between(0.5, 3), v)).when(s == "Cycling", F.when(v.between(2, 30), v))
        .when(s == "Triathlon", F.when(v.between(2, 3), v)).otherwise(F.when(v.between(0, 20), v))
    )
    out = {"speed": speed}
    out |= {c: F.when(s == "Running", F.col(c)) for c in DYNAMICS}
    out |= {c: F.when(s == "Swimming", F.col(c)) for c in STROKES}
    return points.withColumns(out)


def valid_workouts(workouts: DataFrame, today: str) -> DataFrame:
    """Positive duration, a date from 2000 to today."""
    return workouts.where((F.col("duration_seconds") > 0) & F.col("date").between("2000-01-01", today))


def _numbered(carried: DataFrame, columns: list[str], name: str, value: Column) -> DataFrame:
    """Carried rows with one of their columns replaced."""
    return carried.select(*(value.alias(c) if c == name else of(c).alias(c) for c in columns))


def sorted_distinct(points: DataFrame) -> DataFrame:
    """Points of each workout by time, the first of equal times, numbered anew."""
    twins = Window.partitionBy(of("workout_id"), of("ts_s")).orderBy(of("seq"))
    first = whole(points).withColumn("place", F.row_number().over(twins)).where("place = 1")
    return _numbered(first, points.columns, "seq", F.row_number().over(Window.partitionBy(of("workout_id")).orderBy(of("ts_s"))) - 1)


def reindexed(points: DataFrame) -> DataFrame:
    """Times 0 to n-1 for workouts whose times don't grow strictly."""
    by = Window.partitionBy(of("workout_id"))
    w = by.orderBy(of("seq"))
    x = whole(points).withColumn("back", of("ts_s") <= F.lag(of("ts_s")).over(w)).withColumn("any_back", F.coalesce(F.bool_or("back").over(by), F.lit(False)))
    return _numbered(x, points.columns, "ts_s", F.when(F.col("any_back"), F.row_number().over(w) - 1).otherwise(of("ts_s")))


def sequence_checks(points: DataFrame, transitions: int = 5, laps: int = 500, back: int = 300) -> DataFrame:
    """Sport transitions, laps and steps back in time of each workout (workout_id, sport, sport_transition, lap_number, ts_s), and whether they are acceptable.

    Transitions are bounded in triathlons alone; lap 0 is refused, as is too wide a span of laps; a step back may be ``back`` seconds long.
    A workout without lap numbers passes their check (lap_span null).
    """
    w = Window.partitionBy("workout_id").orderBy("seq")
    x = points.select("workout_id", "sport", "lap_number", "sport_transition", (F.lag("ts_s").over(w) - F.col("ts_s")).alias("back"))
    g = x.groupBy("workout_id").agg(
        F.count_if("sport_transition").alias("transitions"), F.min("lap_number").alias("first_lap"), (F.max("lap_number") - F.min("lap_number")).alias("lap_span"),
        F.greatest(F.max("back"), F.lit(0)).alias("largest_back"), F.coalesce(F.bool_or(F.col("sport") == "Triathlon"), F.lit(False)).alias("triathlon"),
    )
    laps_ok = F.coalesce((F.col("first_lap") != 0) & (F.col("lap_span") <= laps), F.lit(True))
    ok = (~F.col("triathlon") | (F.col("transitions") <= transitions)) & laps_ok & (F.col("largest_back") <= back)
    return g.select("workout_id", "transitions", "lap_span", "largest_back", ok.alias("ok"))


#: Just above a half: the upper median of an even number of values.
UPPER_HALF = 0.5 + 1e-9


def elevation_outliers(points: DataFrame) -> DataFrame:
    """Elevations further from the upper median than five mean absolute deviations become null."""
    e = of("elevation")
    by = Window.partitionBy(of("workout_id"))
    upper = F.expr(f"percentile_disc({UPPER_HALF}) WITHIN GROUP (ORDER BY elevation)")  # keeps a count for each height, not each sample
    median = points.groupBy(F.col("workout_id").alias("of_workout")).agg(upper.alias("median"))
    x = whole(points).join(median, of("workout_id") == F.col("of_workout"), "left").withColumn("away", F.abs(e - F.col("median")))
    x = x.withColumn("spread", F.avg("away").over(by))
    return _numbered(x, points.columns, "elevation", F.when(F.col("away") <= 5 * F.col("spread"), e))


def store_issues(workouts: DataFrame, today: str) -> DataFrame:
    """One row of counts: zero durations, negative values, future dates, stress above 1000."""
    return workouts.agg(
        F.count_if(F.col("duration_seconds") == 0).alias("zero_duration"), F.count_if((F.col("tss") < 0) | (F.col("total_distance") < 0)).alias("negative"),
        F.count_if(F.col("date") > F.lit(today).cast("date")).alias("future"), F.count_if(F.col("tss") > 1000).alias("extreme_tss"), F.count("*").alias("n"),
    )


def series_ok(points: DataFrame) -> DataFrame:
    """Whether times never fall and channels lie in range, for each workout."""
    w = Window.partitionBy("workout_id").orderBy("seq")
    x = points.select("workout_id", (F.col("ts_s") >= F.lag("ts_s").over(w)).alias("t"), F.col("heart_rate").between(30, 220).alias("h"), (F.col("power") <= 2000).alias("p"), F.col("elevation").between(-500, 9000).alias("e"))
    ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True)).alias(c)
    return x.groupBy("workout_id").agg(ok("t"), ok("h"), ok("p"), ok("e")).select("workout_id", F.col("t").alias("time_ok"), F.col("h").alias("hr_ok"), F.col("p").alias("power_ok"), F.col("e").alias("elevation_ok"))


# -- devices --------------------------------------------------------------------------------------


def scale_cadence(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumn("cadence", F.round(F.col("cadence") * F.lit(factor), 0).cast("int"))


def drop_start_spikes(points: DataFrame, threshold: int, seconds: int) -> DataFrame:
    """Power above the threshold in the first seconds becomes null."""
    return points.withColumn("power", F.when((F.col("ts_s") <= seconds) & (F.col("power") > threshold), F.lit(None).cast("int")).otherwise(F.col("power")))


def left_only_power(points: DataFrame) -> DataFrame:
    """Where a left but no right reading stands, power is the left reading."""
    return points.withColumn("power", F.when(F.col("left_power").isNotNull() & F.col("right_power").isNull(), F.col("left_power")).otherwise(F.col("power")))


def scale_dynamics(points: DataFrame, gct: float | None, vo: float | None) -> DataFrame:
    out = {c: F.round(F.col(c) * F.lit(f), 0).cast("int") for c, f in (("ground_contact_time", gct), ("vertical_oscillation", vo)) if f is not None}
    return points.withColumns(out) if out else points


def matching_quirks(devices: DataFrame, quirks: DataFrame) -> DataFrame:
    """Quirks of each device: maker and product equal, firmware inside the range; unknown firmware never meets a range."""
    d, q = devices.alias("d"), quirks.alias("q")  # an equi-join; Spark broadcasts a registry that is small enough
    free = F.col("q.firmware_from").isNull() & F.col("q.firmware_to").isNull()
    inside = F.col("d.firmware").isNotNull() & (F.coalesce(F.col("d.firmware") >= F.col("q.firmware_from"), F.lit(True))) & (F.coalesce(F.col("d.firmware") <= F.col("q.firmware_to"), F.lit(True)))
    on = (F.col("d.manufacturer") == F.col("q.manufacturer")) & (F.col("d.product") == F.col("q.product")) & (free | inside)
    return d.join(q, on).select("d.*", "q.quirk")
