"""Workout files in XML, one a workout, as Spark's ``to_xml`` forms them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadentia.sources.files import CURVE_ENTRIES, write_each

#: The format's root, sports, and a sample's tags with the column that each is from.
DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
ROOT = 'pwx version="1.0" xmlns="http://www.peaksware.com/PWX/1/0"'
SPORTS, OTHER_SPORT = {"Running": "Run", "Cycling": "Bike", "Swimming": "Swim", "Triathlon": "Tri", "Rowing": "Row"}, "Cross"
SAMPLE = {"timeoffset": "ts_s", "hr": "heart_rate", "pwr": "power", "cad": "cadence", "spd": "speed", "dist": "distance", "alt": "elevation", "leftBalance": "left_power", "rightBalance": "right_power"}
SUMMARY = {"duration": "duration_seconds", "distance": "total_distance", "tss": "tss", "intensityFactor": "intensity_factor", "normalizedPower": "normalized_power", "avgPower": "avg_power", "avgHeartRate": "avg_heart_rate", "calories": "calories"}


def _ordered(column: str) -> Column:
    """A collected list in its order, of a single workout."""
    return F.transform(F.array_sort(F.collect_list(column)), lambda x: x["x"])


def _samples(points: DataFrame) -> DataFrame:
    there = {tag: c for tag, c in SAMPLE.items() if c in points.columns}
    item = F.struct(*(F.col(c).alias(tag) for tag, c in there.items()))
    return points.select("workout_id", F.struct("seq", item.alias("x")).alias("s")).groupBy("workout_id").agg(_ordered("s").alias("sample"))


def _laps(points: DataFrame) -> DataFrame:
    laps = points.where("lap_number IS NOT NULL").select("workout_id", "lap_number").distinct()
    segment = F.struct(F.format_string("Lap %d", "lap_number").alias("name"), F.lit("Lap").alias("type"))
    return laps.select("workout_id", F.struct("lap_number", segment.alias("x")).alias("s")).groupBy("workout_id").agg(F.struct(_ordered("s").alias("segment")).alias("segments"))


def _curves(curves: DataFrame) -> DataFrame:
    by = Window.partitionBy("workout_id")
    step = F.greatest(F.floor(F.col("n") / CURVE_ENTRIES), F.lit(1))
    placed = curves.select("workout_id", "duration_s", "max_power", F.count("*").over(by).alias("n"), (F.row_number().over(by.orderBy("duration_s")) - 1).alias("i"))
    kept = placed.where((F.col("i") % step == 0) | (F.col("i") == F.col("n") - 1))
    peak = F.struct(F.col("duration_s").alias("seconds"), F.col("max_power").alias("watts"))
    return kept.select("workout_id", F.struct("i", peak.alias("x")).alias("s")).groupBy("workout_id").agg(F.struct(F.struct(_ordered("s").alias("peak")).alias("powerCurve")).alias("metrics"))


def documents(workouts: DataFrame, points: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """A row for each workout (workout_id, date, duration_seconds and what else its table has), nested as the file is; workout_id stays beside it.

    All samples; every n-th entry of the power curve (workout_id, duration_s, max_power) and the last, about 300.
    What is null has no tag; a workout without samples has none. The title is the notes, else the source, else the id.
    """
    has = lambda c: F.col(c) if c in workouts.columns else F.lit(None)
    notes = F.when(F.trim(has("notes").cast("string")) != "", has("notes").cast("string"))
    sport = F.coalesce(F.create_map(*(F.lit(x) for pair in SPORTS.items() for x in pair))[has("sport").cast("string")], F.lit(OTHER_SPORT))
    head = workouts.select(
        "workout_id", F.struct(F.coalesce(has("athlete_id").cast("string"), F.lit("Unknown Athlete")).alias("name")).alias("athlete"), F.coalesce(notes, has("source").cast("string"), F.col("workout_id").cast("string")).alias("title"), sport.alias("sportType"),
        F.date_format("date", "yyyy-MM-dd'T00:00:00+00:00'").alias("time"), F.col("duration_seconds").alias("duration"), F.lit("time").alias("durationType"), has("source").cast("string").alias("device"), F.coalesce(has("data_source").cast("string"), F.lit("HeartRate")).alias("dataSource"),
        F.struct(*(F.col(c).alias(tag) for tag, c in SUMMARY.items() if c in workouts.columns)).alias("summary_data"), notes.alias("notes"),
    )
    for part in ([_laps(points)] if "lap_number" in points.columns else []) + [_samples(points)] + ([] if curves is None else [_curves(curves)]):
        head = head.join(part, "workout_id", "left")
    last = [c for c in head.columns if c != "notes"]
    return head.select(*last, "notes")


def write(workouts: DataFrame, points: DataFrame, path: str, curves: DataFrame | None = None) -> None:
    """A file for each workout, in a folder named ``workout_id=...``."""
    rows = documents(workouts, points, curves)
    document = F.to_xml(F.struct(*(c for c in rows.columns if c != "workout_id")), {"rowTag": "workout"})
    text = F.concat(F.lit(f"{DECLARATION}\n<{ROOT}>\n"), document, F.lit(f"\n</{ROOT.split()[0]}>"))
    write_each(rows.select(F.concat(F.lit("workout_id="), "workout_id", F.lit("/workout.xml")).alias("file"), F.lit(0).alias("at"), text.alias("text")), path)


def read(spark, path: str) -> DataFrame:
    """The samples of such files: workout_id (by the folder), seq and the columns that samples are written from; a file without samples gives none."""
    kinds = {"speed": T.DoubleType(), "distance": T.DoubleType()}
    sample = T.StructType([T.StructField(tag, kinds.get(c, T.IntegerType())) for tag, c in SAMPLE.items()])
    # folders are no partitions of a table, so the driver parses and keeps no value for each
    rows = spark.read.schema(T.StructType([T.StructField("sample", T.ArrayType(sample))])).format("xml").option("rowTag", "workout").option("recursiveFileLookup", True).load(path)
    of = F.regexp_extract(F.col("_metadata.file_path"), ".*/workout_id=([^/]+)/", 1).try_cast("long")
    return rows.select(of.alias("workout_id"), F.posexplode("sample").alias("seq", "s")).select("workout_id", "seq", *(F.col(f"s.{tag}").alias(c) for tag, c in SAMPLE.items()))
