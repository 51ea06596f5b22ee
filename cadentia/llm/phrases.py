"""Phrase collocation mining: frequent n-grams by mergeable Misra-Gries summaries, then exact counts and scores.

First pass: every n-gram of one to five words is hashed to one of P hash partitions and to a fingerprint
in it. Tasks summarise their fingerprints' counts a partition; summaries of a partition are merged.
With more counters than the partition's mass over the threshold, what decrements take from any
count stays below the threshold, so each frequent n-gram's fingerprint survives; fingerprints
only join counts, so they never hide one. The largest decrement is read back as a certificate; a
summary that lost more is made anew with twice the counters. Second pass: the survivors,
a bitmap of bounded size, sift the texts' n-grams, and what is left is counted exactly, as phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadentia.llm.common import join_hot, mix64, settle, slices, texts, tidied

#: Longest phrase in words.
LONGEST = 5
#: Bytes that end a piece (fixed values); a tab parts words as a blank does.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARKS = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
#: Counters of one partition's summary that P is chosen for; counters that a task holds before it hands them on.
COUNTERS, HELD = 1 << 20, 1 << 21
#: The bitmap of survivors has so many bits at most; with more fingerprints it is folded, lets more through, and loses none.
BITMAP_BITS = 1 << 30
#: Phrases that a task counts before it hands their counts on.
PHRASES = 200_000
_ODD = np.uint64(0xD6E8FEB86659FD93)


class _Numbers(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Slice:
    """A slice's tokens: numbers of words (0 where a piece or a text ends), the words, and each token's language."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        numbers = _Numbers({b"\n": 0, b"": 1})
        parts, sizes = [], []
        for text in texts(batch):
            words = (text or b"").lower().translate(_MARKS).replace(b"\n", b" \n ").split(b" ")
            words.append(b"\n")
            part = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            parts.append(part[part != 1])
            sizes.append(len(parts[-1]))
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.words = list(numbers)
        self.language = np.repeat(np.arange(len(sizes)), sizes)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the hash of the n-gram at every place, and whether one stands there."""
        seeds = np.array([xxhash.xxh64_intdigest((x or "").encode(), 1) for x in self.langs], np.uint64)[self.language]
        word = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[self.tokens]
        there = self.tokens != 0
        hashed, stands = mix64(seeds ^ word), there
        for n in range(1, LONGEST + 1):
            if n > 1:
                hashed = mix64(hashed[:-1] * _ODD + word[n - 1 :])
                stands = stands[:-1] & there[n - 1 :]
            yield n, hashed, stands


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes once, in order, with their counts' sum."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - codes.dtype.type(1))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def decremented(codes: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: with more codes than counters all counts fall by the largest that must go; (codes, counts, the fall)."""
    if len(codes) <= counters:
        return codes, counts, 0
    fall = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    left = counts > fall
    return codes[left], counts[left] - fall, fall


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, byte by byte of each side by side, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, size).T).view("<u4").ravel()


_SUMMARY = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("fall", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])


def _summarised(bits: int, part_bits: int, counters: int):
    """Summaries of a task's fingerprints, a row for each hash partition and flush."""
    inner = bits - part_bits

    def rows(codes, counts):
        parts = codes >> np.uint64(inner)
        edges = np.flatnonzero(np.diff(parts, prepend=parts[:1] + np.uint64(1), append=parts[-1:] + np.uint64(1)))
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            fingers, n, fall = decremented(codes[a:b] & np.uint64((1 << inner) - 1), counts[a:b], counters)
            out.append((int(parts[a]), len(fingers), fall, _packed(np.diff(fingers, prepend=np.uint64(0))), _packed(n)))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)

    def work(batches):
        held, pending, size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for batch in slices(batches):
            for _, hashed, stands in _Slice(batch).grams():
                pending.append(hashed[stands] >> np.uint64(64 - bits))
                size += len(pending[-1])
            if size >= HELD // 2:
                codes, counts = np.unique(np.concatenate(pending), return_counts=True)
                held = _merged(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))
                pending, size = [], 0
                if len(held[0]) > HELD:
                    yield rows(*held)
                    held = held[0][:0], held[1][:0]
        codes, counts = np.unique(np.concatenate([*pending, held[0][:0]]), return_counts=True)
        held = _merged(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))
        if len(held[0]):
            yield rows(*held)

    return tidied(work)


def _merge_summaries(inner: int, counters: int, threshold: int, limit: int):
    """Merge each partition's summaries; fingerprints that may reach the threshold as places in the bitmap, and a row with the decrements (place null)."""

    def work(batches):
        parts: dict[int, list] = {}

        def merge(state):
            codes, counts, fall = decremented(*_merged(np.concatenate([x for x, _ in state[0]]), np.concatenate([x for _, x in state[0]])), counters)
            state[0], state[1], state[2] = [(codes, counts)], len(codes), state[2] + fall
            state[3] = len(codes)

        for batch in batches:
            for part, size, fall, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = parts.setdefault(part, [[], 0, 0, 0])  # summaries, their counters, decrements, counters after the last merge
                state[0].append((np.cumsum(_unpacked(codes, size), dtype=np.uint32), _unpacked(counts, size).astype(np.int64)))
                state[1] += size
                state[2] += fall
                if state[1] > max(2 * state[3], 1 << 18):
                    merge(state)
        for part, state in parts.items():
            merge(state)
            codes, counts = state[0][0]
            places = ((np.uint64(part) << np.uint64(inner)) + codes[counts + state[2] >= threshold].astype(np.uint64)) % np.uint64(limit)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.nulls(len(places), pa.int64())], names=["place", "fall"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([state[2]], pa.int64())], names=["place", "fall"])

    return tidied(work)


def _power(x: float) -> int:
    """The exponent of the smallest power of two that is x at least."""
    return max(0, int(np.ceil(np.log2(max(x, 1)))))


def survivors(docs: DataFrame, threshold: int, counters: int | None = None) -> tuple[np.ndarray, int]:
    """The bitmap of fingerprints whose count may reach the threshold, and a fingerprint's bits; docs: rows (lang, text).

    A text of b bytes has (b + 1) / 2 words at most, so the mass is bounded before the texts are read.
    """
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    mass = LONGEST * (size + rows) // 2
    bits = min(60, max(16, _power(8 * mass / threshold)))
    part_bits = min(max(3, _power(2 * mass / threshold / COUNTERS)), bits - 4)
    part_bits = max(part_bits, bits - 32)
    counters = counters or 2 * mass // (threshold << part_bits) + 1
    limit = min(1 << bits, BITMAP_BITS)
    while True:
        summaries = docs.mapInArrow(_summarised(bits, part_bits, counters), "part long, size long, fall long, codes binary, counts binary")
        dealt = summaries.repartition(min(1 << part_bits, 4000), "part")
        merged = settle(dealt.mapInArrow(_merge_summaries(bits - part_bits, counters, threshold, limit), "place long, fall long"))
        if (merged.agg(F.max("fall")).first()[0] or 0) < threshold:
            break
        counters *= 2
    at = F.col("place") + 1
    chunks = merged.where("place IS NOT NULL").groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bitmap = np.zeros((max(limit >> 15, 1), 4096), np.uint8)
    for row in chunks.toLocalIterator():
        bitmap[row.chunk - 1] = np.frombuffer(row.bits, np.uint8)
    return bitmap.ravel(), bits


_COUNTS = pa.schema([("part", pa.int64()), ("langs", pa.list_(pa.string())), ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _counted(bitmap, bits: int, parts: int):
    """Exact counts of the n-grams that the bitmap lets through, packed by hash partition; a language's words under a null phrase.

    A longer n-gram is looked at only where both n-grams that it is made of are let through.
    """

    def work(batches):
        sifted = bitmap.value
        limit = np.uint64(8 * len(sifted))
        held: dict[tuple, int] = {}

        def rows():
            packed: dict[int, tuple[list, list, list]] = {}
            for (lang, phrase), n in held.items():
                row = packed.setdefault(xxhash.xxh64_intdigest(phrase or b"", 2) % parts, ([], [], []))
                row[0].append(lang)
                row[1].append(None if phrase is None else phrase.decode())
                row[2].append(n)
            columns = [list(packed), *([row[i] for row in packed.values()] for i in range(3))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

        for batch in slices(batches):
            part = _Slice(batch)
            langs = {x: i for i, x in enumerate(dict.fromkeys(part.langs))}
            lang = np.array([langs[x] for x in part.langs], np.int64)[part.language]
            names, width = list(langs), len(part.words) + 1
            exact, kept = lang, None
            for n, hashed, stands in part.grams():
                if n == 1:
                    for i, total in enumerate(np.bincount(lang[stands], minlength=len(names)).tolist()):
                        held[names[i], None] = held.get((names[i], None), 0) + total
                else:
                    stands = stands & kept[:-1] & kept[1:]
                at = np.flatnonzero(stands)
                place = (hashed[at] >> np.uint64(64 - bits)) % limit
                at = at[sifted[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
                _, first, number, counts = np.unique(exact[at] * width + part.tokens[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                kept, exact = np.zeros(len(stands), bool), np.zeros(len(stands), np.int64)
                kept[at], exact[at] = True, number
                for i, count in zip(at[first].tolist(), counts.tolist(), strict=True):
                    key = names[lang[i]], b" ".join(map(part.words.__getitem__, part.tokens[i : i + n].tolist()))
                    held[key] = held.get(key, 0) + count
            if len(held) > PHRASES:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return tidied(work)


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of a partition summed, as rows (lang, phrase, n); with too many phrases at once a phrase may have several rows."""
    held: dict[tuple, int] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "phrase", "n"])

    for batch in batches:
        for langs, phrases, counts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            for lang, phrase, n in zip(langs, phrases, counts, strict=True):
                held[lang, phrase] = held.get((lang, phrase), 0) + n
            if len(held) > 5 * PHRASES:
                yield rows()
                held.clear()
    if held:
        yield rows()


def frequent(docs: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """All n-grams of one to five words with ``threshold`` occurrences or more (lang, phrase, a), and (lang, n): a language's words.

    Counted within pieces, overlaps included; a null lang is ``und``, a null text is empty.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    bitmap, bits = survivors(docs, threshold)
    parts = max(16, 8 * len(bitmap) // COUNTERS)  # a partition's survivors are fewer than its bits
    packed = docs.mapInArrow(_counted(spark.sparkContext.broadcast(bitmap), bits, parts), "part long, langs array<string>, phrases array<string>, counts array<bigint>")
    counts = packed.repartition(parts, "part").mapInArrow(tidied(_merge_counts), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    counts = settle(counts.where((F.col("a") >= threshold) | F.col("phrase").isNull()))
    return counts.where("phrase IS NOT NULL"), counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))


def _key(phrase: str) -> Column:
    """Phrase and language as one join key; phrases have no tab."""
    return F.concat(F.col(phrase), F.lit("\t"), F.col("lang"))


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of two to five words with a = f(phrase) >= threshold. A cut after k words gives l = f(first part),
    r = f(rest) and floor(1000 a n / (l r)); the lowest cut counts, ties to the smallest k. Candidates inside a longer one
    that is as frequent are dropped (one of a word more then is too). First ``top`` by score and a descending, then phrase.
    """
    counts, words = frequent(docs, threshold)
    length = F.size(F.split("phrase", " "))
    candidates = counts.where(length >= 2).withColumn("words", length)
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    # an inner join loses none: parts are as frequent as the whole
    known = counts.select(_key("phrase").alias("key"), F.col("a").alias("f"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = settle(join_hot(cuts.withColumn("key", _key(part)), known, "key").withColumnRenamed("f", name).drop("key", part))
    cuts = join_hot(cuts, words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"top": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "low": wide("l") * wide("r")}).withColumn("score", F.expr("top div low"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("words > 2")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    covers = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    left = best.join(covers, ["lang", "phrase"], "left").where("cover IS NULL OR cover < a")
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
