"""Training plans for a table of goals: weeks, workouts, monitoring and adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators.admin import CYCLES

#: Daily shares of a week's stress, Monday first.
SHARES = {
    "Recovery": (0.0, 0.15, 0.0, 0.20, 0.0, 0.25, 0.0),
    "Base": (0.0, 0.15, 0.10, 0.20, 0.10, 0.30, 0.15),
    "Build": (0.0, 0.20, 0.15, 0.25, 0.0, 0.25, 0.15),
    "Peak": (0.0, 0.25, 0.10, 0.30, 0.0, 0.20, 0.15),
    "Taper": (0.0, 0.15, 0.10, 0.15, 0.0, 0.10, 0.0),
    "Default": (0.0, 0.15, 0.15, 0.20, 0.10, 0.25, 0.15),
}
#: Which phases share a table, and the quality days' type and intensity.
FAMILY = {"Accumulation": "Base", "Volume": "Base", "Intensification": "Build", "Intensity": "Build", "Realization": "Peak", "Race Prep": "Peak"}
QUALITY = {"Base": ("Tempo", 0.85), "Accumulation": ("Tempo", 0.85), "Build": ("Threshold", 0.90), "Intensification": ("Threshold", 0.90), "Peak": ("Race", 0.95), "Realization": ("Race", 0.95)}
#: Phases of each model with their share of the weeks (the last takes the rest) and stress multipliers from, to (not reached).
MODELS = {
    "traditional": [("Base", 0.4, 1.0, 1.3), ("Build", 0.3, 1.3, 1.5), ("Peak", 0.2, 1.5, 1.4), ("Taper", None, 1.0, 0.5)],
    "reverse": [("Intensity", 0.3, 0.8, 0.8), ("Volume", 0.5, 1.3, 1.43), ("Race Prep", None, 1.0, 0.8)],
}
#: Blocks of four weeks in turn, their multiplier and what it gains with each block.
BLOCKS = [("Accumulation", 1.2, 0.1), ("Intensification", 1.0, 0.05), ("Realization", 0.9, 0.02)]
BLOCK_WEEKS, REST, LIGHT = 4, "Taper", 0.7
#: Weekly stress without a known fitness, a recovery week's share, hours for 100 points of stress.
FIRST_STRESS, RECOVERY, HOURS = 200.0, 0.6, 1.5
#: What monitoring says, and when: completion in per cent, shares of the plan on each of the last seven days, stress of those days.
LOW, HIGH, UNDER, OVER, HEAVY = 80, 110, 0.9, 1.1, 600
SAYS_LOW = "Consider reducing planned TSS by 10-15% for upcoming weeks"
SAYS_HIGH = "You're exceeding planned load - monitor fatigue carefully"
SAYS_UNDER = "Consistently under target - consider recovery or reduced volume"
SAYS_OVER = "Consistently over target - great progress but watch for overtraining"
SAYS_HEAVY = "High recent load - ensure adequate rest and nutrition"
SAYS_REST = "Recovery week scheduled - reduce intensity and volume"


def _phases(model: str) -> tuple[Column, Column, Column]:
    """Phase, multiplier and whether no recovery week falls in it, for week number ``i`` (from 0) of ``weeks``; shares of weeks are cut in single precision."""
    i, weeks = F.col("i"), F.col("weeks")
    if model == "block":
        block = F.floor(i / BLOCK_WEEKS)
        whole = block < F.floor(weeks / BLOCK_WEEKS)
        phase = multiplier = F.when(~whole, F.lit(None))
        for k, (name, base, gain) in enumerate(BLOCKS):
            phase, multiplier = phase.when(block % len(BLOCKS) == k, F.lit(name)), multiplier.when(block % len(BLOCKS) == k, base + gain * block)
        return F.coalesce(phase, F.lit(REST)), F.coalesce(multiplier, F.lit(LIGHT)), ~whole
    phase = multiplier = None
    begin = F.lit(0)
    for name, share, low, high in MODELS[model]:
        n = weeks - begin if share is None else F.floor(weeks.cast("float") * F.lit(share).cast("float")).cast("int")
        here, there = i < begin + n, low + (high - low) * (i - begin) / F.greatest(n, F.lit(1))
        phase = F.when(here, name) if phase is None else phase.when(here, name)
        multiplier = F.when(here, there) if multiplier is None else multiplier.when(here, there)
        begin = begin + n
    return phase, multiplier, phase.isin("Taper", "Race Prep")


def plan_weeks(goals: DataFrame) -> DataFrame:
    """(plan, week, week_start, phase, recovery, planned_tss, planned_hours) for each goal (plan, model, pattern, weeks, target, ctl).

    The last week ends before the target date. Weekly stress starts at seven times the fitness (200 where it is null); every last week of the pattern
    (2:1, 3:1, 4:1; of four weeks in blocks) is at 60 %, except in a taper or race preparation. A goal of no weeks has none; unknown models and patterns are an error.
    """
    known = goals.select("plan", F.lower("model").alias("model"), "pattern", "weeks", "target", (F.col("ctl") * 7).alias("stress"))
    cycle = F.lit(None).cast("int")
    for pattern, length in CYCLES.items():
        cycle = F.when(F.col("pattern") == pattern, length).otherwise(cycle)
    cycle = F.coalesce(cycle, F.raise_error(F.concat(F.lit("unknown recovery pattern "), F.coalesce("pattern", F.lit("null")))).cast("int"))
    rows = known.where("weeks > 0").withColumn("cycle", cycle).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)))
    phase = multiplier = calm = None
    for model in (*MODELS, "block"):
        this, parts = F.col("model") == model, _phases(model)
        phase, multiplier, calm = (F.when(this, p) if x is None else x.when(this, p) for x, p in zip((phase, multiplier, calm), parts, strict=True))
    unknown = F.raise_error(F.concat(F.lit("unknown periodization model "), F.coalesce("model", F.lit("null"))))
    rows = rows.select("*", phase.otherwise(unknown.cast("string")).alias("phase"), multiplier.alias("multiplier"), calm.alias("calm"))
    length = F.when(F.col("model") == "block", BLOCK_WEEKS).otherwise(F.col("cycle"))
    rows = rows.withColumn("recovery", ((F.col("i") + 1) % length == 0) & ~F.col("calm"))
    tss = F.col("multiplier") * F.coalesce("stress", F.lit(FIRST_STRESS)) * F.when(F.col("recovery"), RECOVERY).otherwise(1.0)
    start = F.date_add(F.date_sub("target", F.col("weeks") * 7), (F.col("i") * 7).cast("int"))
    return rows.select("plan", (F.col("i") + 1).cast("int").alias("week"), start.alias("week_start"), "phase", "recovery", tss.alias("planned_tss"), (tss / 100 * HOURS).alias("planned_hours"))


def planned_workouts(weeks: DataFrame) -> DataFrame:
    """A row for each training day of each plan: date, type, intensity, stress, minutes (stress over intensity, cut)."""
    spark = weeks.sparkSession
    phases = ("Base", "Build", "Peak", "Taper", *FAMILY)
    table = [("Recovery", d, s) for d, s in enumerate(SHARES["Recovery"])] + [(p, d, s) for p in phases for d, s in enumerate(SHARES[FAMILY.get(p, p)])]
    shares = F.broadcast(spark.createDataFrame(table, "family string, day int, share double").where("share > 0"))  # a few dozen rows
    x = weeks.withColumn("family", F.when(F.col("recovery"), F.lit("Recovery")).otherwise(F.col("phase"))).join(shares, "family")
    quality_day = F.col("day").isin(1, 3)
    pick = lambda i: F.create_map(*(F.lit(v) for p, q in QUALITY.items() for v in (p, q[i])))[F.col("phase")]
    kind = F.when(F.col("recovery"), "Recovery").when(quality_day, F.coalesce(pick(0), F.lit("Endurance"))).when(F.col("day") == 5, "Endurance").when(F.col("day") == 6, "Recovery").otherwise("Endurance")
    factor = F.when(F.col("recovery"), 0.65).when(quality_day, F.coalesce(pick(1), F.lit(0.75))).when(F.col("day") == 5, 0.70).when(F.col("day") == 6, 0.65).otherwise(0.75)
    tss = F.col("planned_tss") * F.col("share")
    return x.select("plan", "week", F.date_add("week_start", F.col("day")).alias("date"), kind.alias("workout_type"), factor.alias("intensity"), tss.alias("planned_tss"), F.floor(F.round(tss / factor / 100 * 60, 9)).cast("int").alias("minutes"))


def plan_vs_actual(planned: DataFrame, workouts: DataFrame, athlete: str = "athlete_id") -> DataFrame:
    """Planned and done stress of each planned day of each plan, 0 where nothing was done; the later week wins a date. A plan's number is its athlete's."""
    one = planned.groupBy("plan", "date").agg(F.max_by("planned_tss", "week").alias("planned_tss"))
    done = workouts.groupBy(F.col(athlete).alias("plan"), "date").agg(F.sum("tss").alias("actual_tss"))
    return one.join(done, ["plan", "date"], "left").select("plan", "date", "planned_tss", F.coalesce("actual_tss", F.lit(0.0)).alias("actual_tss"))


def monitor(compared: DataFrame, starts: DataFrame, today: str) -> DataFrame:
    """One row a plan: completion in per cent (half away from zero), sums, the last seven dates' sums, the current week, and what to adjust and to mind.

    starts: (plan, start). Completion is 0 where nothing is planned; weeks count from 1.
    """
    place = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("date")))
    last = F.col("place") <= 7
    share = lambda test: F.coalesce(F.bool_and(F.when(last, test)), F.lit(True))
    g = compared.withColumn("place", place).groupBy("plan").agg(
        F.sum("planned_tss").alias("planned"), F.sum("actual_tss").alias("actual"), F.sum(F.when(last, F.col("planned_tss"))).alias("last_week_planned"), F.sum(F.when(last, F.col("actual_tss"))).alias("last_week_actual"),
        share(F.col("actual_tss") < F.col("planned_tss") * UNDER).alias("under"), share(F.col("actual_tss") > F.col("planned_tss") * OVER).alias("over"),
    )
    g = g.join(starts, "plan").withColumn("completion_pct", F.when(F.col("planned") > 0, F.round(F.col("actual") / F.col("planned") * 100, 0)).otherwise(0).cast("int"))
    g = g.withColumn("week", F.greatest(F.expr(f"datediff(DATE '{today}', start) div 7") + 1, F.lit(1)))
    says = lambda *pairs: F.array_join(F.array_compact(F.array(*(F.when(test, text) for test, text in pairs))), "; ")
    adjust_ = says((F.col("completion_pct") < LOW, SAYS_LOW), (F.col("completion_pct") > HIGH, SAYS_HIGH), (F.col("under"), SAYS_UNDER), (F.col("over"), SAYS_OVER))
    mind = says((F.col("last_week_actual") > HEAVY, SAYS_HEAVY), (F.col("week") % 4 == 0, SAYS_REST))
    return g.select("plan", "planned", "actual", "completion_pct", "last_week_planned", "last_week_actual", "week", adjust_.alias("adjustments"), mind.alias("recommendations"))


def adjustment(kind: str, percentage: int = 10) -> float:
    """The factor of an adjustment: increase, decrease (by per cent) or recovery."""
    factors = {"increase": 1 + percentage / 100, "decrease": 1 - percentage / 100, "recovery": RECOVERY}
    if kind not in factors:
        raise ValueError(f"unknown adjustment {kind}")
    return factors[kind]


def adjust(rows: DataFrame, today: str, factor: float) -> DataFrame:
    """Weeks (week_start) or workouts (date) of plans: from today on stress and hours times the factor, minutes cut to whole ones.

    Workouts follow their own date here; where a week has begun before today its workouts stay only until today.
    """
    coming = F.col("week_start" if "week_start" in rows.columns else "date") >= F.lit(today).cast("date")
    changed = {c: F.when(coming, F.col(c) * factor).otherwise(F.col(c)) for c in ("planned_tss", "planned_hours") if c in rows.columns}
    if "minutes" in rows.columns:
        changed["minutes"] = F.when(coming, F.floor(F.round(F.col("minutes") * factor, 9)).cast("int")).otherwise(F.col("minutes"))
    return rows.withColumns(changed)


def totals(weeks: DataFrame) -> DataFrame:
    """(plan, weeks, planned_tss, planned_hours): sums of each plan."""
    return weeks.groupBy("plan").agg(F.count("*").alias("weeks"), F.sum("planned_tss").alias("planned_tss"), F.sum("planned_hours").alias("planned_hours"))
