"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.llm.common import one_for_each, settle, whole_rows

#: Words in a block and in an output shard, about; blocks of a source and shards of the mix at least.
BLOCK_WORDS, SHARD_WORDS, LEAST_BLOCKS, LEAST_SHARDS = 1_000_000, 2_000_000, 256, 16
#: Nodes down to which the driver splits the tree; the subtrees below, to single shards, are split by tasks.
LEAVES = 4096
#: Blocks, and draws, of a source that one task orders, about; partitions of the mix at most (a task may write several shards).
RUN, PARTITIONS = 4096, 65_536
#: Words as the mix counts them.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[object, int]], weights: list[float], share: float, most: float) -> list[float]:
    """Each source's target words: shares by weight of ``share`` times all words, none above ``most`` times its own.

    ``sizes`` are in the order in which the weights repeat. What a full source
    can't take is dealt again by weight among the others until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    goal, open_ = share * sum(n for _, n in sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in sorted(open_) if goal * weight[i] / total > most * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = goal * weight[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
            open_.discard(i)
        goal -= sum(out[i] for i in over)
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int | list[int]) -> np.ndarray:
    """Deal block quotas of all sources to shards: an array of shards x sources.

    A node of the tree halves its shards and draws how many of each source's
    blocks go left from the multivariate hypergeometric law, so every shard is
    a simple random sample of the blocks and the sums stay exact.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(first: int, last: int, left: np.ndarray) -> None:
        if last - first == 1:
            out[first] = left
            return
        middle = (first + last) // 2
        total = int(left.sum())
        part = rng.multivariate_hypergeometric(left, total * (middle - first) // (last - first), method="marginals") if total else left
        node(first, middle, part)
        node(middle, last, left - part)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20_240_501) -> DataFrame:
    """Take words of every source until its target; one row per document of the input.

    Columns: doc_id, lot, size, source, source_size, target, taken, and draws, an array
    of (pass, shard, position, words): the output shard that gets this copy, its
    shuffled position there, and how many of its words. lot is xxhash64(seed, doc_id, text), to join by. A source is cut by hash into
    permuted blocks; whole passes take all of them, the last pass takes
    blocks in permuted order and the block at the edge document by document, the last one in
    part, so the sum meets the rounded target. No document gives more than ``most`` (a whole number) times its words.
    Blocks and shards grow in number with the corpus, not in size.

    A null text has size 0, a null source is a source of its own and comes last;
    repeated rows each count; equal rows may swap their draws. A source without words
    has target 0. An empty table gives no rows. Other columns are not read. The driver
    holds a row for each source and, for the upper part of the tree, LEAVES x sources numbers at most.
    """
    return _mix(docs, weights, share, most, seed)[0]


def _mix(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> tuple[DataFrame, int]:
    """The drawn documents, and how many shards there are."""
    spark = docs.sparkSession
    sized = settle(docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("lot"),
    ))
    totals = [(r[0], int(r[1])) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    totals.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets(totals, list(weights), share, most)
    blocks = max(LEAST_BLOCKS, max((n for _, n in totals), default=0) // BLOCK_WORDS)
    shards = max(LEAST_SHARDS, -(-round(sum(goal)) // SHARD_WORDS))
    leaves = min(shards, LEAVES)
    each = -(-shards // leaves)
    rows = []
    for i, ((source, size), target) in enumerate(zip(totals, goal, strict=True)):
        whole = min(round(target), int(most * size))
        rows.append((i, source, size, float(target), whole // size if size else 0, whole % size if size else 0))
    plan = spark.createDataFrame(rows, "number int, source string, source_size long, target double, passes long, rest long")
    plan = F.broadcast(plan)  # a row for each source

    sized = sized.withColumn("block", F.pmod("lot", F.lit(blocks)).cast("long"))
    # blocks in permuted order: ranks and sums within runs of the order, and over the runs before
    bits = (blocks // RUN).bit_length()
    key = F.xxhash64(F.lit(seed), "block")
    sums = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    keyed = (
        sums.join(plan, sums["source"].eqNullSafe(plan["source"]))
        .select(sums["source"], "block", "number", "source_size", "target", "passes", "rest", "words", key.alias("key"), (F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")).alias("run"))
    )
    by_run = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = keyed.groupBy("number", "run").agg(F.count("*").alias("n"), F.sum("words").alias("in_run"))
    runs = runs.select("number", "run", F.coalesce(F.sum("n").over(by_run), F.lit(0)).alias("n_before"), F.coalesce(F.sum("in_run").over(by_run), F.lit(0)).alias("words_before"), F.sum("n").over(Window.partitionBy("number")).alias("filled"))
    order = Window.partitionBy("number", "run").orderBy("key", "block")
    turned = (
        keyed.join(runs, ["number", "run"])
        .withColumn("turn", F.col("n_before") + F.row_number().over(order) - 1)
        .withColumn("before", F.col("words_before") + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("words") <= F.col("rest"))
        .withColumn("edge", ~F.col("whole") & (F.col("before") < F.col("rest")))
        .withColumn("times", F.col("passes") + (F.col("whole") | F.col("edge")).cast("int"))
        .drop("key", "run", "n_before", "words_before")
    )
    turned = settle(turned)  # a row for each block

    quota = [0] * len(totals)
    for number, n in turned.groupBy("number").agg(F.sum("times")).collect():
        quota[number] = int(n)
    dealt = split_quotas(np.array(quota, np.int64), leaves, seed)
    begins = np.cumsum(dealt, axis=0) - dealt

    def subtrees(batches):
        for batch in batches:
            for leaf, quotas, starts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts = split_quotas(np.array(quotas, np.int64), each, [seed, leaf])
                at = np.array(starts, np.int64) + np.cumsum(parts, axis=0) - parts
                shard, number = np.nonzero(parts)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (number, at[shard, number], parts[shard, number], leaf * each + shard)], names=["number", "at", "n", "shard"])

    upper = spark.createDataFrame([(i, dealt[i].tolist(), begins[i].tolist()) for i in range(leaves)], "leaf long, quotas array<long>, begins array<long>")
    starts = settle(upper.mapInArrow(subtrees, "number long, at long, n long, shard long"))
    # a source's draws in order, pass by pass; the last start at or before a draw is its shard's. Both are cut into runs of draws
    spread = starts.select("number", "at", "shard", F.explode(F.sequence(F.floor(F.col("at") / RUN), F.floor((F.col("at") + F.col("n") - 1) / RUN))).alias("run"))
    spread = spread.select("number", "run", F.greatest("at", F.col("run") * RUN).alias("at"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("k"), "shard")
    draws = turned.where("times > 0").select(F.col("number").cast("long").alias("number"), "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("k"), "filled", "turn")
    draws = draws.select("number", ((F.col("k") - 1) * F.col("filled") + F.col("turn")).alias("at"), "block", "k")
    both = draws.select("number", F.floor(F.col("at") / RUN).alias("run"), "at", "block", "k", F.lit(None).cast("long").alias("shard")).unionByName(spread)
    last = Window.partitionBy("number", "run").orderBy("at", F.col("block").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("shard", F.last("shard", ignorenulls=True).over(last)).where("block is not null")
    found = found.groupBy("number", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shard"))), lambda x: x["shard"]).alias("shards"))  # most + 1 passes

    known = turned.join(found, ["number", "block"], "left").alias("b")
    joined = sized.alias("d").join(known, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
    joined = joined.select("doc_id", "d.source", "size", "lot", "d.block", "source_size", "target", "passes", "rest", "before", "whole", "edge", "shards")
    # one block of each source is ranked document by document
    within = Window.partitionBy("source").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where("edge").withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    rest = joined.where(~F.col("edge")).withColumn("part", F.when(F.col("whole"), F.col("size")).otherwise(F.lit(0)))
    every = rest.unionByName(edge.withColumn("part", F.col("part").cast("long")))
    draw = lambda k: F.struct(
        k.cast("int").alias("pass"),
        F.get("shards", k.cast("int")).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed), k, "lot").alias("position"),
        F.when(k < F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"),
    )
    out = every.withColumn("taken", F.col("size") * F.col("passes") + F.col("part")).withColumn(
        "draws", F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), draw), lambda d: d["words"] > 0)
    )
    return out.select("doc_id", "lot", "size", "source", "source_size", "target", "taken", "draws"), leaves * each


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 20_240_501, shard: str | None = None) -> DataFrame:
    """The mix itself: a row for each draw with all of docs' columns as they are, dealt by shard and shuffled within; ``shard`` names a column to add for its number.

    The one document that a source's target cuts is drawn whole if at least half of it is taken, else not.
    Otherwise as mix_documents.
    """
    drawn, shards = _mix(docs, weights, share, most, seed)
    whole = F.filter("draws", lambda d: 2 * d["words"] >= F.col("size"))
    drawn = drawn.select("lot", whole.alias("draws")).where(F.size("draws") > 0)
    drawn = drawn.groupBy("lot").agg(F.flatten(F.collect_list("draws")).alias("draws"), F.count("*").alias("copies"))  # more than one for repeated rows only
    found = one_for_each(whole_rows(docs).withColumn("lot", F.xxhash64(F.lit(seed), "doc.doc_id", "doc.text")), drawn, "lot", "copies")
    rows = found.select("doc", F.explode("draws").alias("draw")).repartition(min(shards, PARTITIONS), "draw.shard").sortWithinPartitions("draw.shard", "draw.position")
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), *([F.col("draw.shard").alias(shard)] if shard else []))
