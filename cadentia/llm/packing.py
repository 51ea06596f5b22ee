"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Bands of lengths are packed from the longest down. In a superstep the band's pieces
and the open gaps (the free ends of sequences) are sorted by range together, the
largest first, and swept: read as brackets, a gap opens and a piece closes, so each piece meets
the smallest free gap that holds it (its successor). A range sweeps alone; what it leaves meets
across ranges by its rank, the bracket depth, which the ranges' counts tell. Then gaps shrink and the
next superstep begins. Pieces that no gap holds open new sequences with others of their harmonic class.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from cadentia.llm.common import settle, slices, split_words, tidied

#: Word stems that a worker keeps encoded.
MEMO_WORDS = 250_000
#: ASCII signs that end a stem: the tokenizer splits letters from signs anyway.
SIGNS = ".,;:!?)]}%$#&*|\""
#: Bands of lengths end at these parts of the capacity; supersteps in a band at most (what is left then opens sequences).
BANDS, SWEEPS = (2, 4, 8, 32), 4
#: Largest capacity: a sequence's number is its step, the pieces in it, a group and a place there, in 6, 17, 24 and 16 bits.
MOST_CAPACITY = (1 << 17) - 1
#: Pieces of one class that are ranked together, about.
GROUP_ROWS = 1000


TAIL = "(?P<tail>[" + "".join(f"\\{c}" for c in SIGNS) + "]+)$"
#: Letters outside ASCII that stay one letter when normalised; others are looked at one by one.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+$"


def _stays_letters(text: str) -> bool:
    """Whether a text of European letters is letters only, also as the tokenizer normalises it (a dotted capital I isn't)."""
    return bool(text) and max(text) < "\u0530" and text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


class _Encoder:
    """Ids of texts, by their white-space-free chunks: each distinct one of a batch is looked up once.

    Chunks of letters and closing signs are cut in two, and stems not yet known
    are encoded many at a time: each is one word to the tokenizer, and a word's last token
    is marked in its vocabulary. Where the marks don't tally, and for all other chunks, the tokenizer reads them singly.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}

    def _singly(self, chunks: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {chunk: np.array(x.ids, "<u4").tobytes() for chunk, x in zip(chunks, found, strict=True)}

    def _learn_stems(self, stems: list[str]) -> None:
        parts = [stems[at : at + 500] for at in range(0, len(stems), 500)]
        joined = self.tokenizer.encode_batch_fast([" ".join(part) for part in parts], add_special_tokens=False)
        for part, found in zip(parts, joined, strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for stem, end in zip(part, (4 * ends).tolist(), strict=True):
                    self.memo[stem] = raw[at:end]
                    at = end
            else:
                self.memo |= self._singly(part)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with one more place for the end; null as empty."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        chunks = split_words(texts)
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.ascii_rtrim(words, characters=SIGNS)
        ascii_ = pc.string_is_ascii(stems)
        stems = pc.if_else(ascii_, pc.ascii_lower(stems), stems)
        cut = pc.or_(pc.and_(ascii_, pc.ascii_is_alpha(stems)), pc.match_substring_regex(stems, LATIN)).to_numpy(zero_copy_only=False).copy()
        for i in np.flatnonzero(~cut & ~ascii_.to_numpy(zero_copy_only=False)):
            cut[i] = _stays_letters(stems[i].as_py())
        mask = pa.array(cut)
        heads = pc.if_else(mask, stems, words).dictionary_encode()
        known = heads.dictionary.to_numpy(zero_copy_only=False).tolist()
        is_stem = np.zeros(len(known), bool)
        is_stem[heads.indices.to_numpy()[cut]] = True
        signed = np.flatnonzero(cut & (pc.binary_length(words).to_numpy() > pc.binary_length(stems).to_numpy()))
        tails = pc.extract_regex(words.take(pa.array(signed)), TAIL).field(0).dictionary_encode()
        signs = tails.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn_stems([x for x, stem in zip(known, is_stem.tolist(), strict=True) if stem and x not in self.memo])
        self.memo |= self._singly([x for x in [*known, *signs, ""] if x not in self.memo])
        raw = [self.memo[x] for x in (*known, *signs, "")]
        pool, n_ids = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        # every token as two parts: stem and closing signs, or itself and nothing
        parts = np.full((len(words), 2), len(raw) - 1)
        parts[:, 0] = heads.indices.to_numpy()
        parts[signed, 1] = len(known) + tails.indices.to_numpy()
        parts = parts[coded.indices.to_numpy()].ravel()
        n_each = n_ids[parts]
        ends = np.cumsum(n_each)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat((np.cumsum(n_ids) - n_ids)[parts] - (ends - n_each), n_each)]
        borders = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return ids, np.append(0, ends[1::2])[borders]


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def tokenize_pieces(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32.

    White space in ASCII ends every token of this tokenizer, so a text's ids are
    its chunks' ids in order, and a worker encodes a chunk once. A null text counts
    as empty; an empty text is the end id alone. Repeated rows give repeated pieces.
    """

    def cut(batches):
        encoder, end = _encoder(path), np.array([end_id], "<u4")
        for batch in slices(batches):
            ids, at = encoder.encode(batch.column(1))
            rows = ([], [], [], [], [])
            for doc_id, first, last in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for piece, start in enumerate(range(first, last + 1, length)):
                    part, closes = ids[start : min(start + length, last)], last < start + length
                    crc = zlib.crc32(part)
                    for column, value in zip(rows, (doc_id, piece, start - first, len(part) + closes, zlib.crc32(end, crc) if closes else crc), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _joined(tables: list[DataFrame]) -> DataFrame:
    """The rows of several settled tables, in no more partitions than a shuffle has: unions of unions would pile up small ones."""
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole.coalesce(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sweep(pieces: DataFrame, gaps: DataFrame, free: Column, known: dict[int, Row]) -> tuple[DataFrame, DataFrame]:
    """One superstep: (item, row, length, sequence_id) of matched pieces, and the pieces that remain.

    ``known`` has n, low and high of the pieces' lengths (1) and of the gaps (0). A gap that holds
    several of the longest pieces takes part in as many equal slots, as far as there are pieces for them.
    """
    spark, (slots_of, lengths) = pieces.sparkSession, (known[0], known[1])
    longest = min(lengths.high, slots_of.high)
    n = F.greatest(F.lit(1), F.least(F.floor(free / longest), F.lit(1 + 2 * lengths.n // slots_of.n)))
    kind = pieces.schema["item"].dataType
    slots = (
        gaps.where(free >= lengths.low)
        .select("sequence_id", F.floor(free / n).alias("value"), F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))).alias("row"))
        .select(F.lit(None).cast(kind).alias("item"), "row", F.col("value").cast("long").alias("value"), "sequence_id", F.lit(0).alias("kind"), F.xxhash64("sequence_id", "row").alias("tie"))
    )
    fitting = pieces.where(F.col("length") <= slots_of.high)
    both = slots.unionByName(fitting.select("item", "row", F.col("length").alias("value"), F.lit(None).cast("long").alias("sequence_id"), F.lit(1).alias("kind"), F.xxhash64("row").alias("tie")))
    order = [F.desc("value"), F.asc("kind"), F.asc("tie")]  # equal lengths are dealt over ranges too

    def match(batches):
        part, open_, late = TaskContext.get().partitionId(), [], 0

        def rows(item, row, length, owners, nth):
            n = len(nth)
            return pa.RecordBatch.from_arrays([item, row, length, pa.array(owners, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(nth, pa.int64())], names=names)

        for batch in batches:
            owners, nth = [], []
            for is_piece, sequence in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not is_piece:
                    open_.append(sequence)
                elif open_:
                    owners.append(open_.pop())
                    nth.append(None)
                else:
                    owners.append(None)
                    nth.append(late)
                    late += 1
            found = batch.filter(pc.equal(batch.column(4), 1))
            item_type = batch.schema.field(0).type
            if found.num_rows:
                yield rows(found.column(0), found.column(1), found.column(2), owners, nth)
        for at in range(0, len(open_), 10_000):
            some = open_[at : at + 10_000]
            yield rows(pa.nulls(len(some), item_type), *(pa.nulls(len(some), pa.int64()) for _ in range(2)), some, list(range(at, at + len(some))))

    names = ["item", "row", "length", "sequence_id", "part", "nth"]
    schema = StructType([StructField("item", kind), *(StructField(x, LongType()) for x in names[1:])])
    swept = settle(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(match), schema))

    # brackets that a range leaves: pieces close gaps of ranges before, gaps stay open for ranges after
    left = swept.where("nth is not null").groupBy("part").agg(F.count("item").alias("pieces"), F.count(F.when(F.col("item").isNull(), 1)).alias("gaps"))
    depth, levels = 0, []
    for r in sorted(left.collect(), key=lambda r: r.part):  # a row for each range
        levels.append((r.part, depth, max(0, depth - r.pieces)))
        depth = levels[-1][2] + r.gaps
    columns, late = ["item", "row", "length", "sequence_id"], pieces.where(F.col("length") > slots_of.high)
    matched = swept.where("nth is null").select(*columns)
    if not any(depth for _, depth, _ in levels):  # nothing is open where a range begins
        return matched, _joined([swept.where("nth is not null and item is not null").select("item", "row", "length"), late])
    levels = F.broadcast(spark.createDataFrame(levels, "part long, depth long, floor long"))
    loose = swept.where("nth is not null").join(levels, "part").withColumn("level", F.when(F.col("item").isNull(), F.col("floor") + F.col("nth") + 1).otherwise(F.col("depth") - F.col("nth")))
    # a level holds two brackets of a range at most, and they alternate
    by_level = Window.partitionBy("level").orderBy("part", F.col("item").isNull())
    crossed = settle(loose.where("level > 0").withColumn("sequence_id", F.lag("sequence_id").over(by_level)).where("item is not null").select(*columns))
    again = crossed.where("sequence_id is null").unionByName(loose.where("level <= 0 and item is not null").select(*columns)).drop("sequence_id")
    return _joined([matched, crossed.where("sequence_id is not null")]), _joined([again, late])


def _opened(pieces: DataFrame, capacity: int, step: int) -> tuple[DataFrame, DataFrame, bool]:
    """New sequences of k pieces each for pieces of which k fit in one, what is too little for a sequence, and whether that is bounded.

    Classes k (some hundred at most) are dealt by hash into groups of some thousand pieces, each ranked alone.
    """
    classed = pieces.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    salts = {int(r[0]): -(-int(r[1]) // max(GROUP_ROWS, 16 * int(r[0]))) for r in classed.groupBy("k").count().collect()}
    if not salts:
        none = pieces.withColumn("sequence_id", F.lit(0).cast("long"))
        return none.limit(0), pieces, True
    parts = F.create_map(*(F.lit(x) for pair in salts.items() for x in pair))[F.col("k").cast("int")]
    dealt = classed.withColumn("salt", F.pmod(F.xxhash64(F.lit(step), "row"), parts).cast("long"))
    group = Window.partitionBy("k", "salt")
    ranked = dealt.withColumn("place", F.row_number().over(group.orderBy(F.desc("length"), "row")) - 1).withColumn("whole", F.floor(F.count("*").over(group) / F.col("k")) * F.col("k"))
    number = F.floor(F.col("place") / F.col("k")).cast("long")
    sequence = F.when(F.col("place") < F.col("whole"), ((F.lit(step).cast("long") * (MOST_CAPACITY + 1) + F.col("k")) * (1 << 24) + F.col("salt")) * (1 << 16) + number)
    done = settle(ranked.select("item", "row", "length", sequence.alias("sequence_id")))
    return done.where("sequence_id is not null"), done.where("sequence_id is null").drop("sequence_id"), max(salts.values()) <= 1


def _fitted(pieces: DataFrame, capacity: int, step: int) -> DataFrame:
    """Best fit of a number of pieces that the capacity bounds, in one task."""

    def fit(batches):
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        rows = pa.Table.from_batches(table)
        lengths, ids = rows.column("length").to_numpy(), rows.column("row").to_numpy()
        gaps, opened, owner = [], 0, np.zeros(len(lengths), np.int64)
        for i in np.lexsort((ids, -lengths)):
            at = bisect_left(gaps, (int(lengths[i]), -1))
            if at < len(gaps):
                gap, sequence = gaps.pop(at)
            else:
                gap, sequence, opened = capacity, opened, opened + 1
            insort(gaps, (gap - int(lengths[i]), sequence))
            owner[i] = sequence
        yield from rows.append_column("sequence_id", pa.array(owner + (step << 57), pa.int64())).to_batches()

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType())])
    return pieces.repartition(1).mapInArrow(tidied(fit), schema)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each row its sequence_id and offset; column ``length`` tells its size, from 1 to ``capacity``.

    All columns are kept as they are (they travel as one struct); rows without a length, of none
    or beyond the capacity are an error, as is a capacity above MOST_CAPACITY. Equal rows are packed as often as they come; an empty table gives none.
    Within a sequence the longest comes first. Work on the driver: a row for each range and for each class.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"a sequence holds 1 to {MOST_CAPACITY} tokens")
    wrong = F.raise_error(F.format_string(f"a piece's length must be from 1 to {capacity}, not %s", F.coalesce(F.col("`length`").cast("string"), F.lit("null")))).cast(pieces.schema["length"].dataType)
    checked = {"length": F.when(F.col("`length`").between(1, capacity), F.col("`length`")).otherwise(wrong).alias("length")}
    rows = pieces.select(F.struct(*(checked.get(c, F.col(f"`{c}`")) for c in pieces.columns)).alias("item"))
    rows = settle(rows).withColumn("row", F.monotonically_increasing_id()).withColumn("length", F.col("item.length").cast("long"))
    free = F.lit(capacity) - F.col("used")
    placed, gaps, tails, high, step = [], None, None, capacity, 0

    def shrunk(gaps, more):
        more = more.select("sequence_id", F.col("length").alias("used"))
        return _joined([more] if gaps is None else [gaps, more]).groupBy("sequence_id").agg(F.sum("used").alias("used")).where(free > 0)

    for low in (*(capacity // d for d in BANDS), 0):
        waiting = rows.where((F.col("length") > low) & (F.col("length") <= high))
        for _ in range(SWEEPS if gaps is not None else 0):
            sizes = waiting.select(F.lit(1).alias("kind"), "length").unionByName(gaps.select(F.lit(0).alias("kind"), free.alias("length")))
            known = {r.kind: r for r in sizes.groupBy("kind").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high")).collect()}
            if len(known) < 2 or known[0].high < known[1].low:
                break
            matched, waiting = _sweep(waiting, gaps, free, known)
            placed.append(matched)
            gaps = shrunk(gaps, matched)
        opened, left, _ = _opened(waiting, capacity, step := step + 1)
        placed.append(opened)
        gaps = settle(shrunk(gaps, opened))
        tails, high = left if tails is None else _joined([tails, left]), low
    bounded = False
    while not bounded:
        opened, tails, bounded = _opened(tails, capacity, step := step + 1)
        placed.append(opened)
    placed.append(_fitted(tails, capacity, step := step + 1))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return _joined(placed).select("item", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")).select("item.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens.

    Each row is a piece: doc_id, piece (from 0), start, length, ids_crc32,
    sequence_id, offset. Only documents longer than ``length`` are cut. Nulls count
    as empty texts; repeated rows are packed as often as they come; an empty table
    gives no rows; columns besides doc_id and text are not read.
    """
    return pack(tokenize_pieces(docs, path, length, end_id), length)
