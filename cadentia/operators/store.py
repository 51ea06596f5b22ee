"""The workout store: queries, duplicates, upserts, statistics, nearest merges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.operators.rows import of, whole

#: What makes two stored workouts the same.
NATURAL_KEY = ("athlete_id", "date", "duration_seconds", "sport")


def query_workouts(workouts: DataFrame, limit: int | None = None, athlete: int | None = None, first: str | None = None, last: str | None = None, sport: str | None = None) -> DataFrame:
    """Newest first, limited, and only then filtered: the order of operations is the contract."""
    out = workouts.orderBy(F.desc("date"), F.desc("workout_id"))
    if limit is not None:
        out = out.limit(limit)
    return between_dates(out.where(F.lit(True) if athlete is None else F.col("athlete_id") == athlete), first, last).where(F.lit(True) if sport is None else F.col("sport") == sport)


def between_dates(rows: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Inclusive range, open where an end is missing."""
    if first is not None:
        rows = rows.where(F.col("date") >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col("date") <= F.lit(last).cast("date"))


def trailing_days(rows: DataFrame, end: str, days: int) -> DataFrame:
    """``days`` days ending with ``end``."""
    return rows.where(F.col("date").between(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date")))


def asked_range(rows: DataFrame, first: str | None, last: str | None, today: str, last_days: int | None = None) -> DataFrame:
    """Rows of a range as a user gives it: ``last_days`` (back from today) overrides both ends, an end that is no date counts as open."""
    if last_days is not None:
        return rows.where(F.col("date").between(F.date_sub(F.lit(today).cast("date"), last_days), F.lit(today).cast("date")))

    def known(text: str | None) -> str | None:
        try:
            return date.fromisoformat(text).isoformat() if text else None
        except ValueError:
            return None

    return between_dates(rows, known(first), known(last))


def sport_like(workouts: DataFrame, text: str, minutes: int = 0) -> DataFrame:
    """Sports whose name contains the text, whatever its case, of at least so many minutes."""
    return workouts.where(F.contains(F.lower("sport"), F.lit(text.lower())) & (F.col("duration_seconds") >= minutes * 60))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(" and ".join(f"{c} is not null" for c in NATURAL_KEY))


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """(id, athlete_id, n_later): rows of the same natural key with a larger id; null athletes never match. Rows that share id and athlete are one, their counts summed.

    One window over the key instead of a self-join: a key that many rows share stays linear.
    """
    w = Window.partitionBy(*NATURAL_KEY).orderBy(F.desc("id"))
    # rows with an equal id see the same count
    later = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(Window.partitionBy(*NATURAL_KEY, "id"))
    return _keyed(rows).select("id", "athlete_id", later.alias("n_later")).where("n_later > 0").groupBy("id", "athlete_id").agg(F.sum("n_later").alias("n_later"))


def duplicates_to_remove(rows: DataFrame) -> DataFrame:
    """(id, n_earlier) of rows with an earlier twin by creation; ties of creation survive. Rows that share an id are one, their twins summed."""
    w = Window.partitionBy(*NATURAL_KEY).orderBy("created_at")
    earlier = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)) - F.count("*").over(Window.partitionBy(*NATURAL_KEY, "created_at"))
    return _keyed(rows).select("id", earlier.alias("n_earlier")).where("n_earlier > 0").groupBy("id").agg(F.sum("n_earlier").alias("n_earlier"))


def without_duplicates(rows: DataFrame) -> DataFrame:
    return rows.join(duplicates_to_remove(rows).select("id"), "id", "left_anti")


def first_twins(incoming: DataFrame, order: str = "workout_id") -> DataFrame:
    """The first row (smallest ``order``) of each natural key; rows whose key has a null all stay."""
    w = Window.partitionBy(*(of(c) for c in NATURAL_KEY)).orderBy(of(order))
    keyless = F.lit(False)
    for c in NATURAL_KEY:
        keyless = keyless | of(c).isNull()
    return whole(incoming).select("row", F.row_number().over(w).alias("place"), keyless.alias("keyless")).where("place = 1 OR keyless").select("row.*")


def new_rows(incoming: DataFrame, stored: DataFrame, order: str = "workout_id") -> DataFrame:
    """Incoming rows whose natural key is neither stored nor that of an earlier incoming row; a null in the key is never a duplicate."""
    return first_twins(incoming, order).join(stored.select(*NATURAL_KEY).distinct(), list(NATURAL_KEY), "left_anti").select(*(f"`{c}`" for c in incoming.columns))


def duplicates_by_sport(rows: DataFrame) -> DataFrame:
    """Pairs of duplicates by sport, from the sizes of equal keys: n * (n - 1) / 2, equal ids apart."""
    same = _keyed(rows).groupBy(*NATURAL_KEY, "id").agg(F.count("*").alias("m"))
    keys = same.groupBy(*NATURAL_KEY).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return keys.groupBy("sport").agg(F.expr("sum(n * n - q) div 2").alias("n")).where("n > 0")


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key by ``version``; incoming wins ties."""
    both = whole(stored).withColumn("newer", F.lit(0)).unionByName(whole(incoming.select(*(f"`{c}`" for c in stored.columns))).withColumn("newer", F.lit(1)))
    w = Window.partitionBy(*map(of, key)).orderBy(of(version).desc(), F.desc("newer"))
    return both.select("row", F.row_number().over(w).alias("place")).where("place = 1").select("row.*")


def statistics(workouts: DataFrame) -> DataFrame:
    """One row: workouts, athletes, sports, first and last day, stored seconds."""
    return workouts.agg(F.count("*").alias("workouts"), F.countDistinct("athlete_id").alias("athletes"), F.countDistinct("sport").alias("sports"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("duration_seconds").alias("seconds"))


def series_statistics(series: DataFrame) -> DataFrame:
    """One row from stored series (original_size, stored_size): how many, both sums, and their ratio, 0 where nothing is stored."""
    g = series.agg(F.count("*").alias("series"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"))
    return g.withColumn("ratio", F.when(F.col("stored_bytes") > 0, F.col("original_bytes") / F.col("stored_bytes")).otherwise(0.0))


def merge_nearest(left: DataFrame, right: DataFrame, key: str, time: str, tolerance: int, value: str) -> DataFrame:
    """Left rows with the value of the nearest right row of the key less than ``tolerance`` away (the earlier on ties, then the smaller value), null without one.

    Times fall into buckets of the tolerance's width. Right rows, which are narrow, go to their own bucket and both
    neighbours; there each left row looks back and ahead in the sorted bucket. One shuffle, no key's rows are paired.
    """
    bucket = lambda c: F.floor(c / tolerance)
    item = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    l = left.select(F.col(key).alias("k"), bucket(F.col(time)).alias("b"), F.col(time).alias("t"), F.lit(True).alias("is_left"), F.lit(None).cast(right.schema[value].dataType).alias("v"), item.alias("item"))
    near = F.explode(F.array(*[bucket(F.col(time)) + i for i in (-1, 0, 1)]))
    r = right.where(F.col(time).isNotNull()).select(F.col(key).alias("k"), near.alias("b"), F.col(time).alias("t"), F.lit(False).alias("is_left"), F.col(value).alias("v"), F.lit(None).cast(l.schema["item"].dataType).alias("item"))
    at = F.when(~F.col("is_left"), F.struct("t", "v"))
    seen = lambda *order: F.last(at, ignorenulls=True).over(Window.partitionBy("k", "b").orderBy(*order, "is_left", F.desc("v")).rowsBetween(Window.unboundedPreceding, 0))
    found = l.unionByName(r).select("item", "is_left", "t", seen(F.asc("t")).alias("back"), seen(F.desc("t")).alias("ahead")).where("is_left")
    away = lambda x: F.coalesce(F.abs(F.col("t") - F.col(f"{x}.t")), F.lit(tolerance))
    best = F.when(away("back") <= away("ahead"), F.when(away("back") < tolerance, F.col("back.v"))).when(away("ahead") < tolerance, F.col("ahead.v"))
    return found.select("item.*", best.alias(value))


def incremental(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content's SHA-256 isn't cached."""
    return files.withColumn("fingerprint", F.sha2("content", 256)).join(cache.select("fingerprint"), "fingerprint", "left_anti")


def evict(cache: DataFrame, now: str, days: int = 30, bytes_: int = 500 << 20) -> DataFrame:
    """What stays in the cache: accessed in the last days and, newest first, within the size."""
    accessed, size = of("accessed_at"), of("size")
    live = whole(cache.where(F.col("accessed_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")))
    # files are summed within their day, days over the month that they span
    dated = live.withColumn("day", F.to_date(accessed))
    newer = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    before = dated.groupBy("day").agg(F.sum(size).alias("n")).select("day", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("newer"))
    w = Window.partitionBy("day").orderBy(accessed.desc(), of("fingerprint")).rowsBetween(Window.unboundedPreceding, 0)
    summed = dated.join(F.broadcast(before), "day").withColumn("total", F.col("newer") + F.sum(size).over(w))  # days + 1 rows
    return summed.where(F.col("total") <= bytes_).select("row.*")
