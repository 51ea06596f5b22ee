"""Quality rules: fixed tests on a text's words, and a calibrated classifier.

The classifier is logistic regression on hashed n-grams of words (one, two; two
equal words are one "repeat" gram) and of characters (three, four), each text's counts
damped and scaled to length one; Platt's scaling on a held-out fold makes its output a probability
of good quality, and a fixed threshold on that the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import WordHashes, slices, texts, tidied

BITS = 17
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_REPEAT = np.uint64(0x27D4EB2F165667C5)


def features(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text's n-grams, given its words' hashes."""
    shift = np.uint64(64 - BITS)
    parts = [(hashes * _A) >> shift]
    if len(hashes) > 1:
        pair = np.where(hashes[1:] == hashes[:-1], _REPEAT, hashes[1:] * _B + hashes[:-1])
        parts.append((pair * _A) >> shift)
    b = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(b) > 2:
        key = (b[:-2] << np.uint64(42)) | (b[1:-1] << np.uint64(21)) | b[2:]  # a code point has 21 bits
        parts.append((key * _B) >> shift)
        if len(b) > 3:
            parts.append(((key[:-1] * _A ^ b[3:]) * _C) >> shift)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1)
    rows = np.flatnonzero(counts)
    values = 1 + np.log(counts[rows])
    return rows, values / max(np.sqrt((values**2).sum()), 1e-12)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, rows: np.ndarray, values: np.ndarray) -> float:
        margin = float(self.weights[rows] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60))))


def fit(samples: list[tuple[bytes, int]], epochs: int = 12, rate: float = 2.0, l2: float = 1e-5) -> QualityModel | None:
    """Gradient descent with adaptive rates on four fifths, Platt's scaling on the rest; None without both classes."""
    if len({y for _, y in samples}) < 2:
        return None
    memo = WordHashes()
    rows = [features(t, memo.of(t.split())) for t, _ in samples]
    y = np.array([float(q) for _, q in samples])
    fold = np.arange(len(samples)) % 5 == 4
    if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        fold[:] = False
    weights, power, bias, bias_power = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6), 0.0, 1e-6
    rng, train = np.random.default_rng(11), np.flatnonzero(~fold)
    balance = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            margin = np.bincount(owner, weights[index] * value, len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y[part]) * balance[part] / len(part)
            slope = np.bincount(index, error[owner] * value, 1 << BITS)
            touched = np.flatnonzero(slope)
            step = slope[touched] + l2 * weights[touched]
            power[touched] += step**2
            weights[touched] -= rate * step / np.sqrt(power[touched]) * 0.1
            bias_power += error.sum() ** 2
            bias -= rate * 0.1 * error.sum() / np.sqrt(bias_power)
    on = np.flatnonzero(fold) if fold.any() else train
    margin = np.array([weights[rows[i][0]] @ rows[i][1] + bias for i in on])
    good, bad = y[on].sum(), (1 - y[on]).sum()
    wanted = np.where(y[on] == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps, damped
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        s = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - wanted) * margin).sum(), (p - wanted).sum()])
        hess = np.array([[(s * margin**2).sum(), (s * margin).sum()], [(s * margin).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0] * min(1, 2 / max(abs(step[0]), 1e-9)), b - step[1] * min(1, 2 / max(abs(step[1]), 1e-9))
        if abs(step).max() < 1e-8:
            break
    return QualityModel(weights, bias, a, b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, **options) -> QualityModel | None:
    """Fit on at most ``max_rows`` labelled rows, drawn by hash; the bound is on the fit alone.

    Ratings other than 0 and 1 are left out; an id that is rated or stands among docs several times counts once.
    """
    rated = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("rated"))
    n = rated.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = rated.withColumn("draw", draw).where(F.col("draw") <= min(1.0, 1.3 * max_rows / n))  # about 1.3 * max_rows rows
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(rated), "doc_id")
    one = found.groupBy("doc_id").agg(F.first("draw").alias("draw"), F.min("text").alias("text"), F.first("rated").alias("rated"))
    chosen = one.orderBy("draw", "doc_id").limit(max_rows).collect()
    return fit([(r.text.encode(), r.rated) for r in chosen], **options)


def measure(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero(((b & 0xC0) != 0x80) & ~_IS_SPACE[b]))
    symbols = int(np.count_nonzero(_IS_SYMBOL[b]))
    seen, same = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            same += 1
        elif line.strip(b"\x20\x09\x0a\x0b\x0c\x0d"):
            seen.add(line)
    repeated = 0
    if len(hashes) > 3:
        window = (hashes[:-2] * _A + hashes[1:-1]) * _B + hashes[2:]
        window ^= window >> np.uint64(29)
        _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        cover = np.zeros(len(hashes), bool)
        for shift in range(3):
            cover[shift : shift + len(twice)] |= twice
        repeated = int(np.count_nonzero(cover))
    return chars, symbols, same, repeated


def judge(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    A row fails with fewer than ``least_words`` words or more than ``most_repeated``
    of them in repeated three-word windows; else it is kept if the model gives it at
    least ``threshold`` probability of good quality (1 without a model). A null text has
    no words. Whole texts count; repeated rows give repeated rows; an empty table
    gives none; other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def score(batches):
        known, memo = broadcast.value, WordHashes()
        for batch in slices(batches):
            rows = []
            for text in texts(batch):
                text = text or b""
                words = text.split()
                hashes = memo.of(words)
                counted = measure(text, words, hashes)
                failed = len(words) < least_words or counted[3] > most_repeated * len(words)
                p = known.probability(*features(text, hashes)) if known and words else float(bool(words))
                rows.append((len(words), *counted, failed, p, not failed and p >= threshold))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(tidied(score), schema)
