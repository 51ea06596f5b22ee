"""The workout store on disk: batches that can be written again, and tables whose rows are replaced by key.

Both write Parquet partitions by dynamic overwrite, so a task or a job that is run again after a failure leaves
the same rows; no lock and no log of its own is kept. A table has one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadentia.operators import store

#: The partition column of a store of batches.
BATCH = "stored_in"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What the store holds, with the batch of each row; None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int, order: str = "workout_id") -> None:
    """Store a batch of workouts: those whose natural key neither another batch nor an earlier row of this one has.

    Earlier means a smaller ``order``. A batch that was written before is replaced, so writing it twice leaves one copy. A row whose
    key has a null is never a duplicate.
    """
    if BATCH in rows.columns:
        raise ValueError(f"{BATCH} names the batch")
    held = stored(rows.sparkSession, path)
    fresh = store.first_twins(rows, order) if held is None else store.new_rows(rows, held.where(F.col(BATCH) != batch), order)
    _overwrite(fresh.withColumn(BATCH, F.lit(batch).cast("long")), path, BATCH)


def append_stream(rows: DataFrame, path: str, checkpoint: str, order: str = "workout_id") -> StreamingQuery:
    """Store a stream of workouts, micro-batch by micro-batch, until what is there now is stored; a micro-batch that is run again replaces itself."""
    write = lambda batch, number: append_batch(batch, path, number, order)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_rows(rows: DataFrame, path: str, key: list[str], version: str, partition: str) -> None:
    """Upsert into a table that is partitioned by a column of the key: only partitions that have new rows are read and written.

    The latest row of a key by ``version`` stays, the new one on ties; among new rows alone any of equal version.
    """
    if partition not in key:
        raise ValueError("the partition's column must be part of the key, or a key could stand in two partitions")
    spark = rows.sparkSession
    held = stored(spark, path)
    if held is None:
        held = rows.limit(0)
    touched = held.join(rows.select(partition).distinct(), partition, "left_semi").select(*rows.columns)
    latest = store.upsert(touched, rows, key, version)
    # what is read is overwritten: it must stand elsewhere before
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    _overwrite(latest.checkpoint(eager=True), path, partition)
