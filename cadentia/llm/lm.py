"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

    P(w | h) = P(class(w) | h) * P(cell(w) | class(w), h) * P(w | cell(w))

The first two factors are softmaxes with features of the history, hashed: for the class the
word before, the two before and the one before that (a skip); for the cell, within the class,
the word before and the one before that, each together with the class. The frequent
words are classes of their own; the others fall into classes by spelling and, within a
class, into cells by their hash. The last factor is the smoothed share of the word's count in its cell.

The weights are trained by distributed gradient updates in rounds: in each, every task steps through
its part of the round's documents from the same weights, and the tasks' weights are averaged,
each row by how often a task has seen its feature, before the next round starts from them. Texts are
scored in numpy batches, sparse in their features.

Counts cover all training documents. Words are known by 64-bit hashes; the frequent
ones' counts go to every task (a fixed number of rows), the others' meet the
documents in a join. The number of feature rows grows with the root of the training tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import settle, slices, split_words, tidied

#: Words that are classes of their own (the end among them); classes by spelling; cells of a class; words whose counts are sent out.
FREQUENT, SPELLINGS, CELLS, HEAD = 32, 32, 16, 1 << 16
CLASSES = FREQUENT + SPELLINGS
#: Rows of hashed features, as powers of two: at least and at most (21 MB).
LEAST_BITS, MOST_BITS = 13, 16
#: A word's number is its 64-bit hash with the class of its spelling in the lowest bits; the next ones tell its cell.
_SPELLING, _CELL_SHIFT = SPELLINGS - 1, SPELLINGS.bit_length() - 1
_END = np.uint64(xxhash.xxh64_intdigest(b"\x20end") & ~_SPELLING)
_KINDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
#: Rows of partial counts that a task holds; words that a worker keeps numbered.
PARTIAL, MEMO_WORDS = 500_000, 500_000


class _Words(dict):
    """Numbers of words; the class of a spelling is the last letters' hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        stem = word.rstrip(b".,;:!?")
        value = xxhash.xxh64_intdigest(word) & ~_SPELLING | xxhash.xxh32_intdigest(stem[-2:]) & _SPELLING
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts in a row, each text's words and the end, and where the texts end; null as empty."""
        chunks = split_words(texts, lower=True)
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        codes = coded.indices.to_numpy()
        real = np.fromiter(map(len, words), np.int64, len(words))[codes] > 0  # white space at the ends splits off empty words
        before = np.append(0, np.cumsum(real))[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        ends = before[1:] + np.arange(1, len(before))
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        closes = np.zeros(len(out), bool)
        closes[ends - 1] = True
        out[closes] = _END
        out[~closes] = numbers[codes[real]]
        return out, ends


_WORDS = _Words()


def _words() -> _Words:
    """One for each worker process."""
    return _WORDS


class Head:
    """Frequent words' numbers (sorted), log10 of counts + 1, and classes; -1 where the spelling tells the class.

    A table by leading bits answers most look-ups; where two words share a place, a search does.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> None:
        self.hashes, self.gain, self.classes = hashes, np.log10(counts + 1.0), classes
        place = (hashes >> np.uint64(44)).astype(np.int64)
        self.row = np.zeros(1 << 20, np.int32)
        self.row[place[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        self.crowded = np.bincount(place, minlength=1 << 20) > 1

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each number, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = (hashes >> np.uint64(44)).astype(np.int64)
        at = self.row[place].astype(np.int64)
        there = self.hashes[at] == hashes
        again = np.flatnonzero(~there & self.crowded[place])
        if len(again):
            at[again] = np.minimum(np.searchsorted(self.hashes, hashes[again]), len(self.hashes) - 1)
            there[again] = self.hashes[at[again]] == hashes[again]
        return at, there

    def classes_of(self, hashes: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        spelling = FREQUENT + (hashes & np.uint64(_SPELLING)).astype(np.int64)
        if not len(self.classes):
            return spelling
        own = np.where(there, self.classes[at], -1)
        return np.where(own >= 0, own, spelling)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(_CELL_SHIFT)).astype(np.int64) & (CELLS - 1)


def histories(tokens: np.ndarray, starts: np.ndarray, first: int, last: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before and the one before that of tokens first to last, and their feature rows (tokens x 3); before a text's start stands the end.

    ``tokens`` are whole texts in a row, ``starts`` marks where they begin.
    """
    padded = np.concatenate([[_END, _END], tokens[max(0, first - 2) : last]]) if first < 2 else tokens[first - 2 : last]
    padded = padded[len(padded) - (last - first) - 2 :]
    one, two = padded[1:-1], padded[:-2].copy()
    two[starts[first:last]] = _END  # the word before is the last text's end already
    shift, (a, b, c, _, _) = np.uint64(64 - bits), _KINDS  # words' numbers are hashes already
    return one, two, np.stack([((x * k) >> shift).astype(np.int32) for x, k in ((one, a), (one * b ^ two, a), (two, c))], axis=1)


def within(one: np.ndarray, two: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """Feature rows of the cell's softmax: each of the two words before, with the class (tokens x 2)."""
    shift, mixed = np.uint64(64 - bits), (classes + 1).astype(np.uint64) * _KINDS[1]
    return np.stack([(((x ^ mixed) * k) >> shift).astype(np.int32) for x, k in ((one, _KINDS[3]), (two, _KINDS[4]))], axis=1)


@dataclass
class Model:
    bits: int
    bias: np.ndarray  # classes
    weights: np.ndarray  # feature rows x classes
    cell_bias: np.ndarray  # classes x cells: log shares
    cell_weights: np.ndarray  # feature rows x cells

    def copy(self) -> Model:
        return Model(self.bits, self.bias.copy(), self.weights.copy(), self.cell_bias, self.cell_weights.copy())


def rows_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are all there, without what indexing with an array costs beside the copy."""
    return np.take(table, at, axis=0, mode="clip")


def margins(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    margin = rows_of(weights, features[:, 0])
    for k in range(1, features.shape[1]):
        margin += rows_of(weights, features[:, k])
    margin += bias
    return np.clip(margin, -60, 60, out=margin)


def log_probabilities(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    margin = margins(weights, bias, features)
    return margin - np.log(np.exp(margin).sum(axis=1, keepdims=True))


def log_probabilities_of(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of one column for each token only."""
    margin = margins(weights, bias, features)
    own = margin[np.arange(len(wanted)), wanted]
    np.exp(margin, out=margin)
    return own - np.log(margin @ np.ones(margin.shape[1], np.float32))


def step(weights: np.ndarray, bias: np.ndarray, features: np.ndarray, wanted: np.ndarray, rate: float) -> np.ndarray:
    """One gradient update of the feature rows over a run of tokens; the mean slope."""
    slope = margins(weights, bias, features)
    np.exp(slope, out=slope)
    ones = np.ones(slope.shape[1], np.float32)
    slope *= (-1 / (slope @ ones))[:, None]
    slope[np.arange(len(wanted)), wanted] += 1
    place = np.arange(len(wanted), dtype=np.uint64)
    for k in range(features.shape[1]):
        keys = np.sort((features[:, k].astype(np.uint64) << np.uint64(20)) | place)
        order, rows = (keys & np.uint64((1 << 20) - 1)).astype(np.int64), (keys >> np.uint64(20)).astype(np.int64)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        n = np.diff(starts, append=len(rows))
        sums = sums_of(rows_of(slope, order), starts, n)
        sums *= (rate / (n + 4)).astype(np.float32)[:, None]  # rare features move less
        at = rows[starts]
        sums += rows_of(weights, at)
        weights[at] = sums
    return np.ones(len(slope), np.float32) @ slope / len(slope)


def sums_of(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows; most are short, so they are added up side by side, and long ones by themselves."""
    out = rows_of(rows, starts)
    longer = np.flatnonzero(sizes > 1)
    for k in range(1, 8):
        out[longer] += rows_of(rows, starts[longer] + k)
        longer = longer[sizes[longer] > k + 1]
    for i in longer:
        out[i] += rows[starts[i] + 8 : starts[i] + sizes[i]].sum(axis=0)
    return out


def learn(model: Model, head: Head, tokens: np.ndarray, ends: np.ndarray, run: int, rate) -> tuple[np.ndarray, np.ndarray]:
    """Step through whole texts in runs of tokens; how often each feature row was seen, of classes and of cells."""
    starts = np.zeros(len(tokens), bool)
    starts[np.append(0, ends[:-1])] = True
    seen, seen_in = np.zeros(len(model.weights)), np.zeros(len(model.cell_weights))
    for i in range(0, len(tokens), run):
        j = min(i + run, len(tokens))
        one, two, features = histories(tokens, starts, i, j, model.bits)
        classes = head.classes_of(tokens[i:j], *head.look(tokens[i:j]))
        now = rate(j - i)
        model.bias += now * step(model.weights, model.bias, features, classes, now)
        seen += np.bincount(features.ravel(), minlength=len(seen))
        several = np.flatnonzero(classes >= FREQUENT)  # a frequent word is alone in its class
        if len(several):
            inner = within(one[several], two[several], classes[several], model.bits)
            step(model.cell_weights, model.cell_bias[classes[several]], inner, cells_of(tokens[i:j][several]), now)
            seen_in += np.bincount(inner.ravel(), minlength=len(seen_in))
    return seen, seen_in


def log10_of(model: Model, head: Head, tokens: np.ndarray, ends: np.ndarray, inside: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token log10 of its class and cell less that of the cell's size, its row in the head, and whether it is there."""
    starts = np.zeros(len(tokens), bool)
    starts[np.append(0, ends[:-1])] = True
    logp, rows, known = np.zeros(len(tokens)), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    for i in range(0, len(tokens), run):
        j = min(i + run, len(tokens))
        one, two, features = histories(tokens, starts, i, j, model.bits)
        rows[i:j], known[i:j] = head.look(tokens[i:j])
        classes, cells = head.classes_of(tokens[i:j], rows[i:j], known[i:j]), cells_of(tokens[i:j])
        found = log_probabilities_of(model.weights, model.bias, features, classes).astype(np.float64)
        several = np.flatnonzero(classes >= FREQUENT)
        if len(several):
            inner = within(one[several], two[several], classes[several], model.bits)
            found[several] += log_probabilities_of(model.cell_weights, model.cell_bias[classes[several]], inner, cells[several])
        cells[classes < FREQUENT] = 0
        logp[i:j] = found / np.log(10) - inside[classes, cells]
    return logp, rows, known


def score(
    docs: DataFrame,
    training: Column,
    keep: dict[str, Column],
    rate: float = 0.8,
    run: int = 4096,
    rounds: int = 3,
) -> DataFrame:
    """doc_id and the columns ``keep`` with n_tokens, n_known, train_tokens, base_score, score.

    ``training`` marks rows to learn from (null counts as no). Tokens are runs without
    ASCII white space, A-Z lower-cased, and one end a text; a null text is empty.
    base_score sums log10((c + 1) / (N + V + 1)) by the training counts; score is the
    model's log10 probability, which gives an unseen word the share of one more word of count 0 in its
    cell. Training reads every text once, a hashed part of them in each round; as tasks step side by side, scores depend a little on
    how the table is cut. Whole texts count; repeated rows each count; without training rows all counts are 0 and
    classes are equally likely; an empty table gives no rows; columns besides
    those named are not read.
    """
    spark = docs.sparkSession
    taught = docs.where(F.coalesce(training, F.lit(False))).select("text")

    def count(batches):
        words, held = _words(), []
        for batch in slices(batches):
            held.append(np.unique(words.of(batch.column(0))[0], return_counts=True))
            if sum(len(x[0]) for x in held) > PARTIAL:
                held = [_merged(held)]
                if len(held[0][0]) > PARTIAL // 2:
                    yield _counts(held.pop())
        if held:
            yield _counts(_merged(held))

    counted = taught.mapInArrow(tidied(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = settle(counted)  # a row for each distinct word
    n_all, v_all = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(_END.astype(np.int64))
    # the end and the most frequent words are classes of their own, however counts are spread
    own = [*counted.where(F.col("h") == end).collect(), *counted.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(FREQUENT - 1).collect()]
    # the head, HEAD words at most beside them: counts in bands a sixteenth of an octave wide, as many bands as fit
    band = F.floor(F.log2("n") * 16)
    bands, least, words_in = counted.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band")).collect(), None, 0  # some hundred rows
    for r in bands:
        words_in += r.n
        if words_in > HEAD:
            break
        least = r.band
    top = {r.h: r.n for r in counted.where(band >= least).collect()} if least is not None else {}
    top |= {r.h: r.n for r in own}
    classes = {r.h: i for i, r in enumerate(own)}
    hashes = np.sort(np.fromiter(top, np.int64, len(top)).view(np.uint64))
    numbers = hashes.view(np.int64).tolist()
    head = Head(hashes, np.array([top[h] for h in numbers], np.int64), np.array([classes.get(h, -1) for h in numbers], np.int64))
    in_cell = np.zeros((CLASSES, CELLS, 2), np.int64)  # tokens and distinct words
    cell = F.shiftrightunsigned("h", _CELL_SHIFT).bitwiseAND(CELLS - 1)
    for spelling, c, n, v in counted.groupBy(F.col("h").bitwiseAND(_SPELLING).alias("spelling"), cell.alias("cell")).agg(F.sum("n"), F.count("*")).collect():
        in_cell[FREQUENT + spelling, c] = n, v
    for i, r in enumerate(own):
        in_cell[FREQUENT + (r.h & _SPELLING), (r.h >> _CELL_SHIFT) & (CELLS - 1)] -= (r.n, 1)
        in_cell[i, 0] = r.n, 1
    shared = spark.sparkContext.broadcast(head)  # HEAD + FREQUENT rows at most, whatever the corpus

    in_class = in_cell[:, :, 0].sum(axis=1)
    bits = int(np.clip(np.floor(np.log2(2 * np.sqrt(max(n_all, 1)))), LEAST_BITS, MOST_BITS))
    model = Model(
        bits,
        np.log((in_class + 1.0) / (in_class.sum() + CLASSES)).astype(np.float32),
        np.zeros((1 << bits, CLASSES), np.float32),
        np.log((in_cell[:, :, 0] + 1.0) / (in_class[:, None] + CELLS)).astype(np.float32),
        np.zeros((1 << bits, CELLS), np.float32),
    )
    for k in range(rounds if n_all else 0):
        part = taught.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        model = _trained(part, shared, model, rate / (1 + k) ** 0.5, run)
    fitted = spark.sparkContext.broadcast((model, np.log10(in_cell.sum(axis=2) + 1.0)))

    names = ["doc_id", *keep]

    def measure(batches):
        known, (fit, inside), words, base_total = shared.value, fitted.value, _words(), np.log10(float(n_all + v_all + 1))
        for batch in slices(batches):
            tokens, ends = words.of(batch.column(len(names)))
            first = np.append(0, ends[:-1])
            logp, at, there = log10_of(fit, known, tokens, ends, inside, run)
            # log10(c + 1) is the numerator of a word's share, in its cell as in all words
            gain = np.zeros(len(tokens))
            if there.any():
                gain[there] = known.gain[at[there]]
            gained = np.add.reduceat(gain, first)
            n = ends - first
            owner = np.repeat(np.arange(len(n)), n)[~there]
            rest = tokens[~there]
            order = np.lexsort((rest, owner))
            owner, rest = owner[order], rest[order]
            new = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(n)))), pa.int32())
            columns = [
                pa.array(n), pa.array(np.add.reduceat(there.astype(np.int64), first)), pa.array(gained - n * base_total), pa.array(np.add.reduceat(logp, first) + gained),
                pa.ListArray.from_arrays(offsets, pa.array(rest[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(np.diff(new, append=len(rest)))),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], names=[*names, "n_tokens", "known", "base", "logp", "rest", "times"])

    read = docs.select("doc_id", *(c.alias(k) for k, c in keep.items()), "text")
    schema = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in names)
    measured = read.mapInArrow(tidied(measure), f"{schema}, n_tokens long, known long, base double, logp double, rest array<long>, times array<long>")
    measured = settle(measured.withColumn("row", F.monotonically_increasing_id()))
    rare = measured.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.times").alias("t"))
    found = rare.join(counted.select("h", "n"), "h").groupBy("row").agg(F.sum("t").alias("more"), F.sum(F.col("t") * F.log10(F.col("n") + 1.0)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    return measured.join(found, "row", "left").select(
        *names,
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("logp") + gain).alias("score"),
    )


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, inverse = np.unique(h, return_inverse=True)
    return unique, np.bincount(inverse, n, len(unique)).astype(np.int64)


def _counts(x: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], names=["h", "n"])


def _trained(taught: DataFrame, shared, model: Model, rate: float, run: int) -> Model:
    """One round: tasks learn from the texts side by side, then each row of weights is averaged by how often the tasks have seen its feature."""
    start = taught.sparkSession.sparkContext.broadcast(model)
    block, rows = 64, 1 << model.bits  # rows of weights that travel together

    def teach(batches):
        own, words, read = start.value.copy(), _words(), 0
        seen = [np.zeros(rows), np.zeros(rows)]

        def falling(n):
            nonlocal read
            read += n
            return rate / (1 + (read - n) / 2e6) ** 0.5

        for batch in slices(batches):
            tokens, ends = words.of(batch.column(0))
            for total, more in zip(seen, learn(own, shared.value, tokens, ends, run, falling), strict=True):
                total += more
        if read:
            keys, values, times = [-1], [own.bias.astype("<f4").tobytes()], [np.array([read], "<f4").tobytes()]
            for kind, (weights, n) in enumerate(zip((own.weights, own.cell_weights), seen, strict=True)):
                for i in range(0, rows, block):
                    keys.append(kind << 32 | i)
                    values.append(weights[i : i + block].astype("<f2").tobytes())  # half precision is finer than the steps
                    times.append(n[i : i + block].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, pa.binary()), pa.array(times, pa.binary())], names=["block", "weights", "seen"])

    def add(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, w, n in zip(*(batch.column(name).to_pylist() for name in ("block", "weights", "seen")), strict=True):
                n = np.frombuffer(n, "<f4").astype(np.float64)
                w = np.frombuffer(w, "<f4" if i < 0 else "<f2").astype(np.float64).reshape(len(n), -1) * n[:, None]
                if i in sums:
                    sums[i][0] += w
                    sums[i][1] += n
                else:
                    sums[i] = [w, n]
        for i, (w, n) in sums.items():
            mean = w / np.maximum(n, 1e-9)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([mean.astype("<f4").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary())], names=["block", "weights", "seen"])

    schema = "block long, weights binary, seen binary"
    parts = int(taught.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    learnt = taught.mapInArrow(tidied(teach), schema).repartition(min(parts, rows // block), "block").mapInArrow(tidied(add), schema)
    out = model.copy()
    for r in learnt.collect():  # a row for each block
        w, n = np.frombuffer(r.weights, "<f4"), np.frombuffer(r.seen, "<f4")
        if r.block < 0:
            out.bias = w.copy()
        else:
            table, at, told = (out.weights, out.cell_weights)[r.block >> 32], r.block & 0xFFFFFFFF, np.flatnonzero(n)
            table[at + told] = w.reshape(len(n), -1)[told]
    return out
