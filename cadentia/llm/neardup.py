"""Near-duplicates by banded MinHash, verified with odd sketches and on full sets.

A document's set holds its distinct word shingles. MinHash samples make bands
(documents that share a band meet in a bucket) and fold into an odd sketch: each
sample flips one bit of a parity bitmap, so the population count of two bitmaps' XOR
estimates how many samples differ, and with them the similarity, precisely where it is
high. Pairs whose estimate is near the threshold or above meet a second parity bitmap, of
all the set's items and in proportion to its size: its XOR count never exceeds the
symmetric difference, so it rejects without loss. What remains is confirmed on the full sets.

Documents with equal sets are one class and go on as one node. A bucket doesn't
emit its pairs: every node is paired with its bucket's leader (another one in each band), links
join nodes to components, and only where a bucket still has several components are
nodes of different ones paired. So each pair that shares a bucket is either
tested or already joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import HEAVY_KEYS, HOT_KEYS, HOT_ROWS, WordHashes, compact, counted, hot_keys, join_hot, join_uneven, mix64, one_for_each, settle, slices, texts, tidied, whole_rows

#: 25 bands of 5: a pair at 0.85 shares none with probability (1 - 0.85 ** 5) ** 25, below 1e-6; at 0.8, 5e-5.
BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH = 512
#: Standard deviations that a pair's estimate may lie below the threshold and still be confirmed.
SLACK = 5.0
#: In buckets up to SMALL nodes, leftover pairs come from a join; in larger ones from blocks of BLOCK nodes.
SMALL, BLOCK = 64, 512
#: Nodes whose sets are looked up by a broadcast of their keys (about 16 bytes each); more go by shuffle.
BROADCAST_NODES = 400_000
#: Full sets that are worth a task.
SETS_ROWS = 1000

_rng = np.random.default_rng(0x0DD5)
_XOR = _rng.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, (SAMPLES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = [int(x) for x in _rng.integers(0, 1 << 62, BANDS)]
_SALT = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text's word hashes; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(hashes))):
        out = mix64(out * _A + hashes[i : i + n] + _B)
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    x = items.astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        h = (x[None, at : at + 1024] ^ _XOR) * _MULTIPLY
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        out = mix64(out * _A + samples[i::ROWS][:BANDS] + _SALT[:BANDS])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap of the samples, each with its number."""
    place = mix64(samples.astype(np.uint64) + _SALT) >> np.uint64(64 - SKETCH.bit_length() + 1)
    odd = np.bincount(place.astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parity(items: np.ndarray) -> bytes:
    """Parity bitmap of all items, 4 to 8 bits for each, a power of two and 256 at least."""
    size = max(256, 1 << (4 * len(items) - 1).bit_length())
    odd = np.bincount((mix64(items) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap (as 64-bit words) folded to a smaller one: what each place has of all items."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets that together have so many items."""
    return (100 - percent) * total // (100 + percent)


def most_odd_bits(similarity: float) -> int:
    """XOR population count that pairs at the similarity stay below, but for SLACK standard deviations."""
    least = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / SAMPLES)
    apart = 2 * SAMPLES * (1 - max(least, 0.0))
    expected = SKETCH / 2 * (1 - np.exp(-2 * apart / SKETCH))
    return int(np.ceil(expected + 3 * np.sqrt(expected)))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, key, n, digest, bands, sketch, parity); for an empty set all from digest on are null."""

    def sign(batches):
        memo = WordHashes()
        for batch in slices(batches):
            n, digest, keys, sketch, odd = [], [], [], [], []
            for text in texts(batch):
                items = shingles(memo.of((text or b"").lower().split()), words)
                n.append(len(items))
                if len(items):
                    samples = signature(items)
                    digest.append(xxhash.xxh3_128_digest(items.tobytes()))
                    keys.append(bands(samples).tolist())
                    sketch.append(odd_sketch(samples))
                    odd.append(parity(items))
                else:
                    for column in (digest, keys, sketch, odd):
                        column.append(None)
            columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "key", "n", "digest", "bands", "sketch", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(tidied(sign), f"doc_id {kind}, key long, n long, digest binary, bands array<long>, sketch binary, parity binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node it reaches.

    Each round hooks a vertex to its smallest neighbour, follows hooks twice and
    contracts; vertices at least halve. State is settled each round; once the hooks
    are few, they are broadcast.
    """
    edges, left = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, n_nodes = counted(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("label")))
    while left:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, n = counted(both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"), "n"))
        # a vertex that many hook to, or that has many edges, has as many neighbours
        hubs = [r[0] for r in hook.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS).select("v").collect()] if n > HEAVY_KEYS else []
        hook = hook.drop("n")
        for hot in (hubs, None):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = compact(settle(join_hot(hook, up, "p", "left", hot, n).select("v", F.coalesce("pp", "p").alias("p"))), n)
        labels = compact(settle(join_hot(labels, hook.withColumnRenamed("v", "label"), "label", "left", n_keys=n).select("node", F.coalesce("p", "label").alias("label"))), n_nodes)
        to = lambda side: hook.select(F.col("v").alias(side), F.col("p").alias(f"{side}p"))
        met = join_hot(join_hot(edges, to("a"), "a", hot=hubs, n_keys=n), to("b"), "b", hot=hubs, n_keys=n)
        edges, left = counted(met.select(F.least("ap", "bp").alias("a"), F.greatest("ap", "bp").alias("b")).where("a <> b").distinct())
    return labels


def _linked(pairs: DataFrame, n_pairs: int, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """Of so many settled pairs (a, b) of nodes those whose full sets are linked, and their number."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("parity").alias(f"p_{x}"))
    far = most_odd_bits(percent / 100)

    def close(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5))
            keep = np.bitwise_count(left ^ right).sum(axis=1) <= far
            apart = most_apart(batch.column(2).to_numpy() + batch.column(3).to_numpy(), percent)
            for i, x, y in zip(np.flatnonzero(keep), *(batch.column(c).filter(pa.array(keep)).to_pylist() for c in (6, 7)), strict=True):
                x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(x.shape[1], y.shape[1])
                keep[i] = np.bitwise_count(fold(x, words) ^ fold(y, words)).sum() <= apart[i]
            yield batch.select([0, 1]).filter(pa.array(keep))

    hot = {x: hot_keys(pairs, x, n_pairs) for x in "ab"}
    sized = join_hot(join_hot(pairs, side("a"), "a", hot=hot["a"]), side("b"), "b", hot=hot["b"]).where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs, _ = counted(sized.select("a", "b", "n_a", "n_b", "s_a", "s_b", "p_a", "p_b").mapInArrow(tidied(close), "a long, b long"))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted, n_wanted = counted(nodes.join(ends, "node", "left_semi").select("key", "node"))
    if n_wanted <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)

    def sets(batches):
        memo = WordHashes()
        for batch in slices(batches):
            found = [shingles(memo.of((text or b"").lower().split()), words).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary()).cast(pa.binary())], names=["node", "items"])

    held = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(wanted, "key").select("node", "text")
    held = compact(settle(held.mapInArrow(tidied(sets), "node long, items binary").dropDuplicates(["node"])), n_wanted, SETS_ROWS)  # both sides read it

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: held.select(F.col("node").alias(x), F.col("items").alias(f"i_{x}"))
    return counted(join_hot(join_hot(pairs, of("a"), "a", hot=hot["a"]), of("b"), "b", hot=hot["b"]).select("a", "b", "i_a", "i_b").mapInArrow(tidied(confirm), "a long, b long"))


def _across_blocks(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Close pairs (a, b) of different components in large buckets.

    A bucket is cut into blocks of about BLOCK nodes and every two blocks meet in a task, which
    compares sketches in place and returns only pairs that may be linked. Its memory is two blocks with their parity
    bitmaps (4 to 8 bits a shingle); a block's nodes travel as often as the bucket has blocks.
    """
    far = most_odd_bits(percent / 100)
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).join(nodes.select("node", "n", "sketch", "parity"), "node")
    dealt = dealt.select("bucket", "node", "label", "n", "sketch", "parity", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    dealt = dealt.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))

    def meet(group):
        bits = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group), -1)
        block, label, n, node = (group[c].to_numpy() for c in ("block", "label", "n", "node"))
        first = np.flatnonzero(block == group["low"].iloc[0])
        second = np.flatnonzero(block == group["high"].iloc[0])
        odd = [np.frombuffer(x, np.uint64)[None] for x in group["parity"]]
        width = np.array([x.shape[1] for x in odd])
        found = []
        for i in first:
            rest = second[(label[second] != label[i]) & (np.minimum(n[second], n[i]) * 100 >= np.maximum(n[second], n[i]) * percent)]
            close = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1) <= far]
            near = []
            for words in np.unique(np.minimum(width[close], width[i])):
                part = close[np.minimum(width[close], width[i]) == words]
                bitmaps = np.concatenate([fold(odd[j], words) for j in part])
                near.append(part[np.bitwise_count(bitmaps ^ fold(odd[i], words)).sum(axis=1) <= most_apart(n[part] + n[i], percent)])
            close = np.concatenate(near) if near else close
            found.append(np.stack([np.minimum(node[i], node[close]), np.maximum(node[i], node[close])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("bucket", "low", "high").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: doc_id, key, n_shingles, component_id, kept, chosen.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets
    (words: runs without ASCII white space, A-Z lower-cased; fewer than ``words`` of them make one shingle).
    component_id is the smallest doc_id reachable, kept tells doc_id = component_id;
    chosen is true for exactly one row of each component, whatever the ids. key is
    xxhash64(doc_id, text), to join by. A null text, or one without words, has an empty set and is
    linked with nothing; a null doc_id never counts as smallest, and such rows are kept
    only where the whole component has no id; repeated rows are of one component;
    an empty table gives no rows; columns besides doc_id and text are not read.
    """
    signed = settle(signatures(docs, words).withColumn("row", F.monotonically_increasing_id()))
    classes = signed.where("n > 0").groupBy("n", "digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    nodes, n_nodes = counted(signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node").select("node", "key", "n", "bands", "sketch", "parity"))

    masks = F.array(*map(F.lit, _MASKS))
    entries = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node", F.element_at(masks, F.col("band") + 1).alias("mask"))
    # a bucket's leader is its smallest node under the band's mask: another order in each band
    buckets, _ = counted(entries.groupBy("bucket").agg(F.min(F.col("node").bitwiseXOR(F.col("mask"))).alias("code"), F.count("*").alias("size")).where("size > 1"))
    held = join_uneven(entries, buckets, ["bucket"], "size", n_nodes * BANDS).withColumn("leader", F.col("code").bitwiseXOR(F.col("mask")))
    pair = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    stars, n_stars = counted(pair(held, "node", "leader"))
    edges, _ = _linked(stars, n_stars, nodes, docs, words, percent)
    labels = components(edges)

    # buckets that still hold several components: pairs across them that weren't tested
    placed, _ = counted(held.select("bucket", "node", "size").join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("label", "node").alias("label")))
    mixed, n_mixed = counted(placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"))
    if n_mixed:
        across, _ = counted(join_hot(placed, mixed, "bucket", n_keys=n_mixed))
        few = across.where(F.col("size") <= SMALL)
        other = few.select("bucket", F.col("node").alias("other"), F.col("label").alias("other_label"))
        few = pair(few.join(other, "bucket").where("label <> other_label and node < other"), "node", "other")
        large = _across_blocks(across.where(F.col("size") > SMALL), nodes, percent)
        more, n_more = counted(few.union(large).distinct().join(stars, ["a", "b"], "left_anti"))
        found, n_found = _linked(more, n_more, nodes, docs, words, percent)
        if n_found:
            labels = components(edges.union(found))

    # labels meet classes before classes meet rows: a row for each distinct set, then one join for all rows
    named, _ = counted(classes.join(labels, "node", "left").select("n", "digest", "copies", F.coalesce("label", "node").alias("label")))
    total = signed.count()
    full = signed.where("n > 0").select("row", "doc_id", "key", "n", "digest")
    whole = join_uneven(full, named, ["n", "digest"], "copies", total).select("row", "doc_id", "key", "n", "label")
    whole = compact(settle(whole.unionByName(signed.where("n = 0").select("row", "doc_id", "key", "n", F.col("row").alias("label")))), total)
    # ids in order, null last, then rows: the first names the component and is its chosen row
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    first, _ = counted(whole.groupBy("label").agg(order.alias("first"), F.count("*").alias("rows")).select("label", "rows", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("lead")))
    return join_uneven(whole, first, ["label"], "rows", total).select(
        "doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("lead")).alias("chosen")
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates chooses, one of each component, with all columns."""
    found = near_duplicates(docs, words, percent)
    keys = found.groupBy("key").agg(F.max("chosen").alias("chosen"), F.count("*").alias("copies")).where("chosen").drop("chosen")
    rows = one_for_each(whole_rows(docs).withColumn("key", F.xxhash64("doc.doc_id", "doc.text")), keys, "key", "copies")
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
