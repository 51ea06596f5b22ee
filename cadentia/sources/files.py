"""Reading and writing training files: CSV samples, directories, FIT heads, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators import admin, load
from cadentia.operators.rows import of, whole

#: Header aliases of each channel.
ALIASES = {
    "timestamp": ("timestamp", "time", "elapsed_time", "elapsed", "duration"),
    "heart_rate": ("heart_rate", "hr", "heartrate", "bpm"),
    "power": ("power", "watts", "power_watts"),
    "pace": ("pace", "min_per_km", "pace_min_km"),
    "speed": ("speed", "velocity", "speed_ms", "speed_kmh"),
    "elevation": ("elevation", "altitude", "alt", "elev", "height"),
    "cadence": ("cadence", "rpm", "steps_per_minute", "spm"),
    "distance": ("distance", "dist", "total_distance", "cumulative_distance"),
    "latitude": ("latitude", "lat", "position_lat"),
    "longitude": ("longitude", "lon", "lng", "position_long"),
}
#: Date and time formats, in the order they are tried; fractions of a second are optional.
FORMATS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'", "yyyy-MM-dd'T'HH:mm:ss[.SSS]'Z'", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
WHOLE = ("heart_rate", "power", "elevation", "cadence")
#: Developer metrics by what a lower-cased field name contains (one of each group), first match wins.
METRICS = [
    ((("power",), ("balance",)), "PowerBalance"),
    ((("pedal",), ("smooth",)), "PedalSmoothness"),
    ((("leg",), ("spring",)), "LegSpringStiffness"),
    ((("form",), ("power",)), "FormPower"),
    ((("running",), ("power",)), "RunningPower"),
    ((("ground", "gct"), ("balance",)), "GroundContactBalance"),
    ((("cda", "drag"),), "AerodynamicCdA"),
    ((("core",), ("temp",)), "CoreTemperature"),
    ((("smo2",),), "MuscleOxygen"),
    ((("muscle",), ("oxygen",)), "MuscleOxygen"),
    ((("temperature",),), "Environmental"),
    ((("humidity",),), "Environmental"),
    ((("air",), ("quality",)), "Environmental"),
]
#: Sensor channels by what a lower-cased field name contains (one of each group); all that fit count, "side" stands for left or right.
CHANNELS = [
    ("smo2", ("smo2",)), ("smo2", ("muscle",), ("oxygen",)), ("smo2", ("saturation",)), ("thb", ("thb",)), ("thb", ("hemoglobin",), ("total",)), ("core_temp", ("core",), ("temp",)), ("skin_temp", ("skin",), ("temp",)),
    ("torque_effectiveness", ("torque",), ("effect",), "side"), ("pedal_smoothness", ("pedal",), ("smooth",), "side"), ("platform_center_offset", ("platform",), ("offset",), "side"),
    ("power_phase_start", ("power",), ("phase",), ("start",), "side"), ("power_phase_end", ("power",), ("phase",), ("end",), "side"), ("peak_phase_start", ("peak",), ("phase",), ("start",), "side"),
    ("peak_phase_end", ("peak",), ("phase",), ("end",), "side"), ("cda", ("cda",)), ("cda", ("drag",), ("coeff",)), ("wind_speed", ("wind",), ("speed",)), ("wind_direction", ("wind",), ("direction",)),
    ("gradient", ("gradient", "slope")), ("gradient_adjusted_power", ("gradient",), ("power",)),
]
#: Places of a sensor, and kinds of temperature sensors, by what a name contains.
LOCATIONS = [(side, part, f"{side}_{name}") for part, name in (("quad", "quadriceps"), ("calf", "calf"), ("glute", "glute")) for side in ("left", "right")]
SENSORS = [(("core", "sensor"), "core_sensor"), (("ingestible",), "ingestible_pill"), (("pill",), "ingestible_pill"), (("rectal",), "rectal")]
#: Sports as another platform's CSV names them.
EXPORT_SPORTS = {"Cycling": "Bike", "Running": "Run", "Swimming": "Swim", "Triathlon": "Brick", "Rowing": "Row"}


def normalised(header: Column) -> Column:
    return F.translate(F.lower(F.trim(F.regexp_replace(header, '^\\ufeff|"', ""))), " -", "__")


def parse_time(text: Column) -> Column:
    """A timestamp by the first format that fits, else epoch seconds of a whole number."""
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    return F.coalesce(*tried, F.timestamp_seconds(text.try_cast("bigint")))


#: A cell with the comma before it: quoted (a backslash takes the next character as it is) and what follows up to the next comma, or plain.
CELL = r',("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"[^,]*+|$)|[^,]*+)'


def cells(line: Column) -> Column:
    """The cells of a CSV line, however many, quotes as they stand."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))


def unquoted(cell: Column) -> Column:
    """What a quoted cell holds, also one that the line's end closes; other cells as they stand."""
    inner = r'^"([^"\\]*+(?:\\.[^"\\]*+)*+)"?$'
    quoted = F.startswith(cell, F.lit('"')) & cell.rlike(inner)
    return F.when(quoted, F.regexp_replace(F.regexp_extract(cell, inner, 1), r'\\(["\\])', "$1")).otherwise(cell)


def read_csv(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Samples of every CSV at a path, one workout a file: workout_id (the file), seq, ts_s, started and channels.

    Each file goes by its own header: names by their aliases, in any order; unknown columns are ignored, the first of two equal
    ones counts, cells that don't parse or are missing are null. Times are seconds since the file's first time, 0 at least;
    decimal numbers are elapsed seconds as they stand; without a time the row's place counts.
    Quoted cells, of the header too, may hold commas, not line breaks. A file without rows gives none.
    Files are read in one pass: a file's lines meet in one shuffle, where its first one tells the places of the channels.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("workout_id"), at.alias("line"), "value").where(F.trim("value") != "")
    w = Window.partitionBy("workout_id").orderBy("line")
    numbered = lines.withColumn("number", F.row_number().over(w) - 1).withColumn("cells", cells(F.col("value")))
    head = F.col("number") == 0
    numbered = numbered.withColumn("names", F.when(head, F.transform("cells", normalised)))
    place = lambda aliases: F.array_position(F.transform("names", lambda x: x.isin(*aliases)), True).cast("int")
    numbered = numbered.withColumn("places", F.when(head, F.struct(*(place(aliases).alias(c) for c, aliases in ALIASES.items()))))
    numbered = numbered.withColumn("places", F.first("places").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cell = lambda c: F.when(F.col("places")[c] > 0, unquoted(F.get("cells", F.col("places")[c] - 1)))
    number = lambda c: F.trim(cell(c)).try_cast("double").try_cast("int" if c in WHOLE else "double").alias(c)
    channels = [c for c in ALIASES if c != "timestamp"]
    rows = numbered.where(~head).select("workout_id", "line", (F.col("number") - 1).alias("seq"), F.trim(cell("timestamp")).alias("text"), *map(number, channels))
    rows = rows.withColumn("at", parse_time(F.col("text"))).withColumn("plain", F.col("text").try_cast("double"))
    started = F.first("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("started", started)
    since = F.unix_timestamp("at") - F.unix_timestamp("started")
    return rows.select("workout_id", "seq", F.coalesce(F.when(since < 0, 0).otherwise(since), F.floor("plain"), F.col("seq")).cast("int").alias("ts_s"), "started", *channels)


def read_directory(spark: SparkSession, path: str, suffix: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Samples of a directory's files of a kind (not of those below), and a table of its other files with the reason they were left."""
    good = read_csv(spark, f"{path}/*.{suffix}")
    files = spark.read.format("binaryFile").load(f"{path}/*").select("path", "length")
    left = files.where(~F.lower("path").endswith(f".{suffix}")).withColumn("reason", F.lit("unsupported format"))
    return good, left


def summarise(points: DataFrame) -> DataFrame:
    """Whole-number means of known values, largest heart rate, last distance (null if the last row's is), duration, climbing."""
    w = Window.partitionBy("workout_id").orderBy("seq")
    up = points.withColumn("_up", F.col("elevation") - F.lag("elevation").over(w))
    mean = lambda c: F.expr(f"sum({c}) div nullif(count({c}), 0)").cast("int").alias(f"avg_{c}")
    return up.groupBy("workout_id").agg(
        mean("heart_rate"), mean("power"), mean("cadence"), F.max("heart_rate").alias("max_heart_rate"), F.max_by("distance", "seq").alias("total_distance"),
        (F.max("ts_s") - F.min("ts_s")).alias("duration_seconds"), F.avg("pace").alias("avg_pace"), F.coalesce(F.sum(F.when(F.col("_up") > 0, F.col("_up"))), F.lit(0)).cast("int").alias("elevation_gain"),
    )


def data_source(points: DataFrame) -> DataFrame:
    """What a workout's stress rests on, by sport and channels present; heart rate where nothing better is."""
    has = lambda c: F.bool_or(F.col(c).isNotNull())
    dynamics = has("ground_contact_time") | has("vertical_oscillation") | has("stride_length")
    g = points.groupBy("workout_id", "sport").agg(has("power").alias("p"), has("speed").alias("v"), dynamics.alias("d"), has("stroke_count").alias("s"))
    s = F.col("sport")
    power = s.isin("Cycling", "Rowing", "Triathlon") & F.col("p")
    pace = ((s == "Running") & (F.col("d") | F.col("v"))) | ((s == "Swimming") & F.col("s")) | ((s == "Triathlon") & (F.col("d") | F.col("s")))
    return g.select("workout_id", F.when(power, "Power").when(pace, "Pace").otherwise("HeartRate").alias("source"))


def power_split(points: DataFrame) -> DataFrame:
    """Left and right power from the balance in per cent, cut to whole watts."""
    left = (F.col("power") * F.col("balance") / 200).cast("int")
    return points.withColumns({"left_power": left, "right_power": F.col("power") - left})


def metric_kind(name: Column) -> Column:
    """The developer metric that a field name stands for; a core temperature is never environmental."""
    lower = F.lower(name)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for groups, kind in METRICS:
        fits = F.lit(True)
        for group in groups:
            one = F.lit(False)
            for part in group:
                one = one | F.contains(lower, F.lit(part))
            fits = fits & one
        if groups == (("temperature",),):
            fits = fits & ~F.contains(lower, F.lit("core"))
        out = out.when(fits, kind)
    return out.otherwise("Custom")


def sensor_channels(name: Column) -> Column:
    """The channels that a developer field's name stands for, in order of name: those of one side carry it in front; empty for null and for none."""
    lower = F.coalesce(F.lower(name), F.lit(""))
    found = []
    for channel, *groups in CHANNELS:
        sided = groups[-1] == "side"
        fits = F.lit(True)
        for group in groups[:-1] if sided else groups:
            one = F.lit(False)
            for part in group:
                one = one | F.contains(lower, F.lit(part))
            fits = fits & one
        if sided:  # left before right; without a side no channel
            side = F.when(F.contains(lower, F.lit("left")), "left").when(F.contains(lower, F.lit("right")), "right")
            found.append(F.when(fits, F.concat(side, F.lit(f"_{channel}"))))
        else:
            found.append(F.when(fits, F.lit(channel)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def sensor_location(name: Column) -> Column:
    lower, out = F.lower(name), F.lit(None).cast("string")
    for side, part, place in reversed(LOCATIONS):
        out = F.when(F.contains(lower, F.lit(side)) & F.contains(lower, F.lit(part)), place).otherwise(out)
    return out


def sensor_type(name: Column) -> Column:
    """The kind of a temperature sensor; a skin temperature's is the skin sensor."""
    lower, out = F.lower(name), F.lit(None).cast("string")
    for parts, kind in reversed(SENSORS):
        fits = F.lit(True)
        for part in parts:
            fits = fits & F.contains(lower, F.lit(part))
        out = F.when(fits, kind).otherwise(out)
    skin = F.contains(lower, F.lit("skin")) & F.contains(lower, F.lit("temp")) & ~F.contains(lower, F.lit("core"))
    return F.when(skin, "skin_sensor").otherwise(out)


def converted(raw: Column, scale: Column, offset: Column) -> Column:
    return raw / F.coalesce(scale, F.lit(1.0)) - F.coalesce(offset, F.lit(0.0))


def fit_heads(spark: SparkSession, path: str) -> DataFrame:
    """Files with what their first bytes say: header size 12 or 14, protocol 1 to 32, the format's mark, at least 18 bytes."""
    files = spark.read.format("binaryFile").load(path)
    byte = lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("int")
    state = (
        F.when(F.col("length") < 18, "truncated").when(~byte(1).isin(12, 14), "bad_header").when(~byte(2).between(1, 32), "bad_protocol")
        .when(F.substring("content", 9, 4) != F.lit(b".FIT"), "bad_mark").otherwise("ok")
    )
    return files.select("path", "length", F.sha2("content", 256).alias("fingerprint"), state.alias("state"))


# -- exports --------------------------------------------------------------------------------------


#: Columns of exported workout summaries: name and where the value is from.
SUMMARY_COLUMNS = {
    "Date": "date", "Sport": "sport", "Duration_Hours": "duration_seconds", "Workout_Type": "workout_type", "Data_Source": "data_source", "TSS": "tss", "Avg_HR": "avg_heart_rate", "Max_HR": "max_heart_rate",
    "Avg_Power": "avg_power", "Normalized_Power": "normalized_power", "Avg_Pace": "avg_pace", "Intensity_Factor": "intensity_factor", "Distance_KM": "total_distance", "Elevation_Gain_M": "elevation_gain",
    "Avg_Cadence": "avg_cadence", "Calories": "calories", "Notes": "notes", "Athlete_ID": "athlete_id", "Source": "source",
}
#: Names and systems of the key powers by their seconds.
KEY_POWERS = {5: ("5_seconds", "Sprint"), 60: ("1_minute", "Anaerobic"), 300: ("5_minutes", "VO2max"), 1200: ("20_minutes", "FTP"), 3600: ("60_minutes", "Threshold")}


def summary_rows(workouts: DataFrame) -> DataFrame:
    """Workouts under SUMMARY_COLUMNS, hours and kilometres as decimals; what the table doesn't have is null."""
    value = lambda c: F.col(c) if c in workouts.columns else F.lit(None).cast("string")
    made = {"Date": F.date_format("date", "yyyy-MM-dd"), "Duration_Hours": value("duration_seconds") / 3600, "Distance_KM": value("total_distance") / 1000}
    return workouts.select(*(made.get(name, value(c)).alias(name) for name, c in SUMMARY_COLUMNS.items()))


def weekly_rows(workouts: DataFrame) -> DataFrame:
    """Weeks by calendar year and ISO week, Monday to Sunday; the mean is over seven days."""
    tss, monday = F.sum(F.coalesce("tss", F.lit(0.0))), F.min(F.date_trunc("week", F.col("date"))).cast("date")
    weeks = workouts.groupBy(F.year("date").alias("Year"), F.weekofyear("date").alias("Week_Number")).agg(
        monday.alias("Week_Start"), tss.alias("Total_TSS"), F.count("*").alias("Workout_Count"), (F.sum("duration_seconds") / 3600).alias("Duration_Hours"), (F.sum("total_distance") / 1000).alias("Distance_KM")
    )
    return weeks.select("Week_Start", F.date_add("Week_Start", 6).alias("Week_End"), "Year", "Week_Number", "Total_TSS", "Workout_Count", "Duration_Hours", "Distance_KM", (F.col("Total_TSS") / 7).alias("Avg_Daily_TSS"))


def monthly_rows(workouts: DataFrame) -> DataFrame:
    """Months with their English names; the mean is over the days of the month."""
    tss = F.sum(F.coalesce("tss", F.lit(0.0)))
    months = workouts.groupBy(F.year("date").alias("Year"), F.month("date").alias("Month")).agg(
        tss.alias("Total_TSS"), F.count("*").alias("Workout_Count"), (F.sum("duration_seconds") / 3600).alias("Duration_Hours"), (F.sum("total_distance") / 1000).alias("Distance_KM"), F.max(F.dayofmonth(F.last_day("date"))).alias("days")
    )
    names = F.array(*map(F.lit, ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")))
    return months.select("Year", "Month", F.element_at(names, F.col("Month")).alias("Month_Name"), "Total_TSS", "Workout_Count", "Duration_Hours", "Distance_KM", (F.col("Total_TSS") / F.col("days")).alias("Avg_Daily_TSS"))


def curve_rows(curve: DataFrame) -> DataFrame:
    """A power curve (duration_s, max_power) with minutes to two decimals."""
    return curve.select(F.col("duration_s").alias("Duration_Seconds"), F.format_string("%.2f", F.col("duration_s") / 60).alias("Duration_Minutes"), F.col("max_power").alias("Max_Power_Watts"))


def key_power_rows(keys: DataFrame) -> DataFrame:
    """Key powers (target_s, max_power), a row for each of the five; 0 without one."""
    wanted = keys.sparkSession.createDataFrame([(s, name, system) for s, (name, system) in KEY_POWERS.items()], "target_s int, Duration string, System string")
    return wanted.join(keys, "target_s", "left").select("Duration", F.col("target_s").alias("Duration_Seconds"), F.coalesce("max_power", F.lit(0)).alias("Power_Watts"), "System")


def pmc_rows(series: DataFrame) -> DataFrame:
    return series.withColumn("atl_spike", F.col("atl_spike").cast("int"))


def zone_rows(zones: DataFrame, n: int = 7) -> DataFrame:
    """(workout_id, zone, value) turned to columns zone1 to zone n."""
    return zones.groupBy("workout_id").pivot("zone", list(range(1, n + 1))).agg(F.first("value")).select("workout_id", *[F.col(str(i)).alias(f"zone{i}") for i in range(1, n + 1)])


def platform_rows(workouts: DataFrame) -> DataFrame:
    """Another platform's CSV: US dates, clock durations, kilometres, work in kJ; nulls are 0."""
    sport = F.create_map(*(F.lit(x) for p in EXPORT_SPORTS.items() for x in p))[F.col("sport")]
    s = F.col("duration_seconds")
    clock = F.format_string("%02d:%02d:%02d", F.expr("duration_seconds div 3600"), F.expr("duration_seconds % 3600 div 60"), s % 60)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return workouts.select(
        "workout_id", F.date_format("date", "MM/dd/yyyy").alias("date"), F.coalesce(sport, F.lit("Other")).alias("sport"), clock.alias("duration"), zero(F.col("total_distance") / 1000).alias("km"),
        zero(F.col("avg_power") * s / 1000).alias("work_kj"), zero(F.col("tss")).alias("tss"),
    )


def downsampled(points: DataFrame, most: int = 10_000) -> DataFrame:
    """Every n-th sample and the last, n so that about ``most`` stay."""
    n = F.count("*").over(Window.partitionBy(of("workout_id")))
    x = whole(points).withColumn("n", n).withColumn("step", F.greatest(F.floor(F.col("n") / most), F.lit(1)))
    return x.where((of("seq") % F.col("step") == 0) | (of("seq") == F.col("n") - 1)).select("row.*")


def export(rows: DataFrame, kind: str, path: str) -> None:
    """Write as csv (header), json or parquet, in parallel."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"no export to {kind}")
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_each(rows: DataFrame, path: str) -> int:
    """Write rows (file, at, text) below a folder, which is emptied before: a file for each ``file`` (its path there), its texts in the order of ``at``, each with a line feed; the number of files.

    Spark's writers take a folder, a check sum, a committed copy and three changes of mode for each value of a partition column, which
    many small files can't pay. Here the task that has a file's rows streams it into place; it has its name only when it is whole, so a
    task that is run again leaves the same file. Rows without a file are left out.
    """
    system, root = opened(path)
    system.create_dir(root)
    system.delete_dir_contents(root)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        folders, name, draft, out, n = set(), None, None, None, 0

        def close() -> int:
            if out is None:
                return 0
            out.close()
            system.move(draft, f"{root}/{name}")
            return 1

        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            codes = names.dictionary_encode()
            known, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            edges = np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
            for start, end in zip(edges, [*edges[1:], len(codes)], strict=True):
                if known[codes[start]] != name:
                    n += close()
                    name = known[codes[start]]
                    folder, _, own = f"{root}/{name}".rpartition("/")
                    if folder not in folders:
                        system.create_dir(folder)
                        folders.add(folder)
                    draft = f"{folder}/.{own}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(draft)
                out.write("".join(f"{text}\n" for text in texts[start:end]).encode())
        n += close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    dealt = rows.where("file IS NOT NULL").repartition("file").sortWithinPartitions("file", "at").select("file", "text")
    n = dealt.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    system.open_output_stream(f"{root}/_SUCCESS").close()
    return n


#: Entries of a power curve that a workout file holds, about.
CURVE_ENTRIES = 300


def export_as(kind: str, what: str, workouts: DataFrame, path: str, points: DataFrame | None = None, curves: DataFrame | None = None) -> None:
    """The five exports there are: csv summaries, csv pmc, json and text reports (by athlete), pwx of exactly one workout, its samples downsampled; others are an error."""
    if (kind, what) == ("csv", "summaries"):
        export(summary_rows(workouts), "csv", path)
    elif (kind, what) == ("csv", "pmc"):
        export(pmc_rows(load.pmc(load.daily_tss(workouts.withColumn("all", F.lit("all")), "all"), "all")).drop("all"), "csv", path)
    elif (kind, what) == ("json", "report"):
        export(load.report_totals(workouts, "athlete_id"), "json", path)
    elif (kind, what) == ("text", "report"):
        admin.text_report(load.report_totals(workouts, "athlete_id"), "athlete_id").select("line").write.mode("overwrite").text(path)
    elif (kind, what) == ("pwx", "workout"):
        if len(workouts.limit(2).collect()) != 1:
            raise ValueError("a workout file holds exactly one workout")
        from cadentia.sources import workout_files

        workout_files.write(workouts, downsampled(points.join(workouts.select("workout_id"), "workout_id", "left_semi")), path, curves)
    else:
        raise ValueError(f"no export of {what} as {kind}")


def importable(files: DataFrame) -> DataFrame:
    """Whether each file (path) has an extension that is read: csv or fit, in any case."""
    return files.withColumn("importable", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("csv", "fit"))


def validate_only(files: DataFrame, points: DataFrame) -> DataFrame:
    """What an import would give, without storing: path, ok, points of each file (path); points has workout_id as its path."""
    read = points.groupBy(F.col("workout_id").alias("path")).agg(F.count("*").alias("points"))
    return files.select("path").join(read, "path", "left").select("path", (F.coalesce("points", F.lit(0)) > 0).alias("ok"), F.coalesce("points", F.lit(0)).alias("points"))


def cache_metrics(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """One row from lookups (hit) and the cache (size): hits, misses, hit rate, entries, bytes, mean bytes."""
    asked = lookups.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    held = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_bytes"))
    rate = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")), F.lit(0.0))
    return asked.join(held, F.lit(True)).select("hits", "misses", rate.alias("hit_rate"), "entries", "bytes", "mean_bytes")  # one row each
