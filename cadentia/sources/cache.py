"""The cache of decoded files as a table: entries (path, fingerprint, size, cached_at, accessed_at), one a path.

Each step takes a state and gives the next one; ``Manifest`` keeps states as numbered versions on disk, so a step that is run again writes the
same version. Look-ups move the access time; what is stale or too old goes; putting entries makes room by dropping what was used least recently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.sources.storage import stored

SCHEMA = "path string, fingerprint string, size long, cached_at timestamp, accessed_at timestamp"
COLUMNS = ["path", "fingerprint", "size", "cached_at", "accessed_at"]
#: Days since the last access that an entry lives, and bytes that the cache may hold.
DAYS, BYTES = 30, 500 << 20


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, fingerprint, size) of files (path, content): SHA-256 and length of the content."""
    return files.select("path", F.sha2("content", 256).alias("fingerprint"), F.length("content").cast("long").alias("size"))


def _moment(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp")


def look_up(cache: DataFrame, asked: DataFrame, now: str | Column, days: int = DAYS) -> tuple[DataFrame, DataFrame]:
    """Answers (the columns of asked, hit) for rows asked (path, fingerprint), and the cache afterwards.

    A hit has the path's entry with this fingerprint, accessed at most ``days`` days ago, and moves its access time to now. An entry with another fingerprint or an older
    access is removed. A path that is asked several times at once counts as asked in turn: it is removed if any of its fingerprints is another one, and those
    rows that have the entry's own are hits only if no other is asked.
    """
    w = Window.partitionBy("path")
    wanted = asked.withColumn("asked_for", F.size(F.collect_set("fingerprint").over(w)))
    known = cache.select("path", F.col("fingerprint").alias("held"), "accessed_at")
    fresh = F.col("accessed_at") >= _moment(now) - F.expr(f"interval {days} days")
    hit = F.coalesce((F.col("held") == F.col("fingerprint")) & fresh & (F.col("asked_for") == 1), F.lit(False))
    answers = wanted.join(known, "path", "left").select(*(F.col(f"`{c}`") for c in asked.columns), hit.alias("hit"))
    seen = answers.groupBy("path").agg(F.bool_and("hit").alias("hit"))
    after = cache.join(seen, "path", "left").where("hit IS NULL OR hit").withColumn("accessed_at", F.when(F.col("hit"), _moment(now)).otherwise(F.col("accessed_at")))
    return answers, after.select(*COLUMNS)


def put(cache: DataFrame, entries: DataFrame, now: str | Column, most: int | None = BYTES) -> DataFrame:
    """The cache with entries (path, fingerprint, size) put in; of several for a path the largest fingerprint counts.

    If old and new sizes together pass ``most``, entries go by their access time, the oldest first (equal times by path), until the surplus is freed; then the
    new ones replace those of their paths. New entries stay even where they alone are too large. Without ``most`` nothing goes.
    """
    new = entries.groupBy("path").agg(F.max_by("size", "fingerprint").alias("size"), F.max("fingerprint").alias("fingerprint"))
    new = new.select("path", "fingerprint", "size", _moment(now).alias("cached_at"), _moment(now).alias("accessed_at"))
    if most is None:
        return cache.select(*COLUMNS).join(new.select("path"), "path", "left_anti").unionByName(new)
    surplus = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("held")).join(new.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("more")), F.lit(True)).select((F.col("held") + F.col("more") - most).alias("surplus"))  # one row
    # sizes are summed within a day of access, days in order: a cache of any size has few of them
    day = F.to_date("accessed_at").alias("day")
    days = cache.groupBy(day).agg(F.sum("size").alias("bytes"))
    before = days.select("day", F.coalesce(F.sum("bytes").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    older = Window.partitionBy("day").orderBy("accessed_at", "path").rowsBetween(Window.unboundedPreceding, -1)
    freed = cache.select("*", day).join(before, "day").withColumn("freed", F.col("earlier") + F.coalesce(F.sum("size").over(older), F.lit(0)))
    kept = freed.join(F.broadcast(surplus), F.lit(True)).where("freed >= surplus").select(*COLUMNS)
    return kept.join(new.select("path"), "path", "left_anti").unionByName(new)


class Manifest:
    """A cache's states under a path, a folder for each version; the highest one counts, a version that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def latest(self) -> int:
        """The number of the last version, 0 before the first."""
        held = stored(self.spark, self.path)
        return 0 if held is None else held.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/version={version}")

    def write(self, cache: DataFrame, version: int) -> None:
        """The state as a version; it is read from versions before it."""
        cache.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def incremental(self, files: DataFrame, now: str, days: int = DAYS, most: int | None = BYTES) -> DataFrame:
        """Files (path, content) that must be decoded anew, as rows with their fingerprint; they are in the cache from then on.

        One version a call: the look-up's outcome and what was put. If the job fails before the version is written, the next call starts from the version before.
        """
        at = self.latest()
        told = files.join(fingerprints(files).select("path", "fingerprint", "size"), "path")
        answers, after = look_up(self.read(at), told.drop("content"), now, days)
        missed = answers.where("NOT hit").select("path", "fingerprint", "size")
        self.write(put(after, missed, now, most), at + 1)
        return told.join(missed.select("path"), "path", "left_semi")
