"""What the corpus operators share: checkpoints, word hashes, batch helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a worker keeps hashed; past it the memo starts anew.
MEMO_WORDS = 200_000
#: Bytes of text that a worker takes on at once.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's ``spark.checkpoint.dir``.

    Where none is named, a local session (tests) gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="cadentia-checkpoint-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that are worth a task in passes over a settled table, and the tasks a core that it has at least.
TASK_ROWS, CORE_TASKS = 10_000, 2


def _least_tasks(df: DataFrame) -> int:
    return CORE_TASKS * df.sparkSession.sparkContext.defaultParallelism


def compact(df: DataFrame, n_rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """A settled table of so many rows, read in no more tasks than they are worth.

    It lies in as many files as its shuffle had partitions, and a union's sides add theirs. A task for each
    would write as many files for the next shuffle, however few rows there are.
    """
    tasks = max(_least_tasks(df), -(-n_rows // task_rows))
    return df.coalesce(tasks) if tasks < df.rdd.getNumPartitions() else df


def counted(df: DataFrame, task_rows: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """The table settled and compact, and its number of rows."""
    df = settle(df)
    n_rows = df.coalesce(max(_least_tasks(df), df.rdd.getNumPartitions() // 16)).count()
    return compact(df, n_rows, task_rows), n_rows


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class WordHashes(dict):
    """64-bit hashes of words, memoised; stable across processes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


def split_words(texts: pa.Array, lower: bool = False) -> pa.Array:
    """Lists of each text's runs without ASCII white space, and an empty one where white space begins or ends it; null as empty, A-Z lower-cased if asked.

    The texts are copied first: kernels misread what is a slice of a larger array and cast.
    """
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())
    return pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)


def tidied(work: Callable) -> Callable:
    """The work of a task on Arrow batches; when it is done, its memory goes back to the system, as workers are kept."""

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // SLICE_BYTES
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as one struct, ``doc``: so no name that an operator gives meets a user's column."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def one_for_each(rows: DataFrame, keys: DataFrame, key: str, copies: str) -> DataFrame:
    """Rows joined to keys (key, copies, ...), one row a key; only keys with several equal rows are deduplicated."""
    joined = rows.join(keys, key)
    return joined.where(F.col(copies) == 1).unionByName(joined.where(F.col(copies) > 1).dropDuplicates([key])).drop(copies)


#: Keys that hold more than this share of the rows are few enough to broadcast, whatever the corpus.
HEAVY_KEYS = 20_000


def join_uneven(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to unique keys whose column ``size`` tells how many rows each has.

    Rows of heavy keys stay where they are and meet a broadcast of at most HEAVY_KEYS
    keys; the others meet by shuffle, where no key has more than a small share.
    """
    limit = max(1000, total // HEAVY_KEYS)
    heavy = F.broadcast(keys.where(F.col(size) > limit))
    light = rows.join(heavy.select(*on), on, "left_anti").join(keys.where(F.col(size) <= limit), on)
    return rows.join(heavy, on).unionByName(light)


#: Keys with more rows than this are hot; of these the HOT_KEYS largest are broadcast, whatever the corpus.
HOT_ROWS, HOT_KEYS = 1000, 2000


def hot_keys(rows: DataFrame, on: str, n_rows: int | None = None) -> list:
    """The largest keys of the rows: HOT_KEYS at most, each with more than HOT_ROWS rows; null is none.

    Where all n_rows are no more than that, they need no pass.
    """
    if n_rows is not None and n_rows <= HOT_ROWS:
        return []
    counted = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > HOT_ROWS)
    return [r[0] for r in counted.orderBy(F.desc("n_rows")).limit(HOT_KEYS).collect()]


def join_hot(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner", hot: list | None = None, n_keys: int | None = None) -> DataFrame:
    """Join (inner or left) of rows to unique keys, where some keys may have a large share of the rows.

    Rows of hot keys (found in one pass unless given) stay where they are and meet a broadcast of HOT_KEYS
    keys at most; the others meet by shuffle, where no key has more than one in HOT_KEYS of the rows or HOT_ROWS.
    Where all keys are known to be HEAVY_KEYS at most (small ones: they are broadcast), no rows move.
    """
    if n_keys is not None and n_keys <= HEAVY_KEYS:
        return rows.join(F.broadcast(keys), on, how)
    hot = hot_keys(rows, on) if hot is None else hot
    if not hot:
        return rows.join(keys, on, how)
    held = rows.sparkSession.createDataFrame([(k,) for k in hot], rows.select(on).schema)
    few = F.broadcast(held)
    there = rows.join(few, on, "left_semi").join(F.broadcast(keys.join(few, on, "left_semi")), on, how)
    return there.unionByName(rows.join(few, on, "left_anti").join(keys, on, how))
