"""Folder imports that survive bad files: samples, and one row a file that says what became of it."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.sources import files, fit

#: What a file can be after an import.
IMPORTED, FAILED, SKIPPED = "imported", "failed", "skipped"
_KINDS = {
    "path": pa.string(), "seq": pa.int32(), "at": pa.int64(), "lap_number": pa.int32(), "sport_transition": pa.bool_(), **{c: pa.float64() for c in fit.CHANNELS},
    "session": pa.int32(), "sport": pa.string(), "ts_s": pa.int32(), "is_report": pa.bool_(), "state": pa.string(), "reason": pa.string(), "points": pa.int64(), "millis": pa.float64(), "bytes_lost": pa.int64(),
}
_DDL = ", ".join(f"{k} {'boolean' if v == pa.bool_() else 'long' if v == pa.int64() else 'int' if v == pa.int32() else 'double' if v == pa.float64() else 'string'}" for k, v in _KINDS.items())


_RESULT = ("path", "state", "reason", "points", "millis", "bytes_lost")


def _failed(reason: str, state: str = FAILED) -> list:
    """Result columns of files that gave nothing."""
    return [F.lit(state).alias("state"), F.lit(reason).alias("reason"), F.lit(0).cast("long").alias("points"), F.lit(None).cast("double").alias("millis"), F.lit(0).cast("long").alias("bytes_lost")]


class Import(NamedTuple):
    """Samples (workout_id, seq, ts_s, ...), results (path, state, reason, points, millis, bytes_lost), and what was counted as they were written."""

    points: DataFrame
    results: DataFrame
    counted: dict[str, int]


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path) of a folder's files, also empty ones, which Spark's readers pass over; the driver has the listing as for any read."""
    return named(spark, spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def named(spark: SparkSession, read: DataFrame) -> DataFrame:
    """(path) of the files that a table is read from, by the listing that its reader made."""
    return spark.createDataFrame([(unquote(re.sub("^file:///", "file:/", p)),) for p in read.inputFiles()], "path string")


def _decoded(salvage: bool) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                began = time.perf_counter()
                end = fit.End()
                found = fit.samples(path, data, end, salvage)
                n = len(found["seq"])
                state, reason = (IMPORTED, None) if n and (salvage or end.reason is None) else (FAILED, end.reason or "no samples")
                if n and state == IMPORTED:
                    columns = {"path": found.pop("workout_id"), **found, "is_report": [False] * n}
                    yield from pa.Table.from_arrays([pa.array(columns.get(k, [None] * n), kind) for k, kind in _KINDS.items()], names=list(_KINDS)).to_batches(fit.BATCH)
                told = {"path": path, "is_report": True, "state": state, "reason": end.reason or reason, "points": n if state == IMPORTED else 0, "millis": (time.perf_counter() - began) * 1000, "bytes_lost": end.bytes_lost}
                yield pa.RecordBatch.from_arrays([pa.array([told.get(k)], kind) for k, kind in _KINDS.items()], names=list(_KINDS))

    return work


def import_fit(spark: SparkSession, path: str, folder: str, salvage: bool = False) -> Import:
    """Decode the FIT files of a folder (not of those below; the extension must be exactly ``fit``) into ``folder``, samples and results in one pass.

    A file that breaks off, is damaged or is none of the format fails with its reason and gives no samples, and stops nothing; so does one without
    samples. With ``salvage`` what can be read of a damaged file is kept: it is imported, with its reason and the bytes that were lost. The files are read once.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.fit").option("recursiveFileLookup", False).load(path).select("path", "content")
    seen = Observation()
    told = F.col("is_report")
    rows = listed.mapInArrow(_decoded(salvage), _DDL).observe(
        seen, F.count_if(told).alias("files"), F.count_if(told & (F.col("state") == IMPORTED)).alias("imported"), F.count_if(told & (F.col("state") == FAILED)).alias("failed"), F.count_if(~told).alias("points"), F.coalesce(F.sum("bytes_lost"), F.lit(0)).alias("bytes_lost")
    )
    rows.write.mode("overwrite").partitionBy("is_report").parquet(folder)
    written = spark.read.schema(f"{_DDL.replace('is_report boolean, ', '')}, is_report boolean").parquet(folder)
    whole = {c: F.col(c).cast("int") for c in ("elevation", "heart_rate", "cadence", "power", "balance", "ground_contact_time", "vertical_oscillation")}
    points = written.where(~told).select(F.col("path").alias("workout_id"), *(k for k in _KINDS if k not in ("path", "is_report", "state", "reason", "points", "millis", "bytes_lost"))).withColumns(whole)
    results = written.where(told).select(*_RESULT)
    empty = listing(spark, path, "*.fit").join(results, "path", "left_anti").select("path", *_failed("empty file"))
    return Import(points, results.unionByName(empty), seen.get)


def import_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Samples of a folder's CSV files, and their results; a file without a row below its header fails. Both come from one pass over the files."""
    read = files.read_csv(spark, path, "*.csv")
    known = F.count_if(F.coalesce(*(c for c in files.ALIASES if c != "timestamp")).isNotNull())
    found = read.groupBy(F.col("workout_id").alias("path")).agg(F.count("*").alias("points"), known.alias("known"))
    reason = F.when(F.col("points").isNull(), "no rows").when(F.col("known") == 0, "no known column has a value")
    told = named(spark, read).join(found, "path", "left").withColumn("reason", reason)
    state = F.when(F.col("reason").isNull(), IMPORTED).otherwise(FAILED)
    results = told.select("path", state.alias("state"), "reason", F.when(F.col("reason").isNull(), F.col("points")).otherwise(0).alias("points"), F.lit(None).cast("double").alias("millis"), F.lit(0).cast("long").alias("bytes_lost"))
    good = read.withColumn("_known", known.over(Window.partitionBy("workout_id"))).where("_known > 0").drop("_known")
    return good, results


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """Results of a folder's files that no reader takes."""
    others = listing(spark, path).where(~F.regexp_extract("path", r"\.([^./]+)$", 1).isin("csv", "fit"))
    return others.select("path", *_failed("unsupported format", SKIPPED))


def report(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: files, imported, failed, skipped, success rate in per cent of the files that were read, points, mean milliseconds of imported files, imported files a second where ``seconds`` are given. An empty table has rate 0."""
    count = lambda x: F.count_if(F.col("state") == x)
    rate = F.coalesce(F.try_divide(count(IMPORTED) * 100.0, count(IMPORTED) + count(FAILED)), F.lit(0.0))
    return results.agg(
        F.count("*").alias("files"), count(IMPORTED).alias("imported"), count(FAILED).alias("failed"), count(SKIPPED).alias("skipped"), rate.alias("success_pct"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"),
        F.avg(F.when(F.col("state") == IMPORTED, F.col("millis"))).alias("mean_millis"), *([(count(IMPORTED) / F.lit(float(seconds))).alias("files_per_second")] if seconds else []),
    )


def failures_by_reason(results: DataFrame) -> DataFrame:
    return results.where(F.col("state") != IMPORTED).groupBy("state", "reason").agg(F.count("*").alias("files"))
