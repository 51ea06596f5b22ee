"""Language identification by string kernels.

The kernel is the blended spectrum of byte n-grams, presence only: two texts
score the share of n-grams (of every order up to the longest) that both have,
normalised by the geometric mean of their counts. Nyström landmarks turn it into
features, one-versus-rest kernel ridge regression into languages. The kernel is an
inner product of presence vectors, so landmarks, whitening and regression fold
into one matrix with a row for each n-gram of a landmark (n-grams are kept exactly, not
hashed), and a batch of texts is scored by one sparse matrix product.

The regression values of a text sum to one, so they tell languages apart but never
that a text is in none of them. That is told by the kernel itself: a text's mean
similarity to the landmarks of its language against what texts of that language have
at that length, which needs no other language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cadentia.llm.common import SLICE_BYTES, slices, texts, tidied, whole_rows

ORDERS = (1, 2, 3, 4)
#: Octaves of n-gram numbers for which a language has its floor.
OCTAVES = 32
#: A text is foreign below this part of the similarity that all but a hundredth of its language's texts reach.
FLOOR, FLOOR_QUANTILE = 0.9, 0.01


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def grams(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text, sorted: their bytes as a number, the order above them; block by block."""
    text, found = text.lower(), []
    for at in range(0, len(text), SLICE_BYTES):
        b = np.frombuffer(text[at : at + SLICE_BYTES + max(ORDERS) - 1], np.uint8).astype(np.uint64)
        key, keys = np.zeros(len(b), np.uint64), []
        for n in ORDERS:
            if len(b) < n:
                break
            key = b if n == 1 else (key[:-1] << np.uint64(8)) | b[n - 1 :]
            keys.append(key | np.uint64(n << 32))
        found.append(_distinct(np.concatenate(keys)))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def has_letter(text: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys among the known ones, which come before a last place that stands for all others."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    at[known[at] != keys] = len(known)
    return at


@dataclass
class LanguageModel:
    languages: list[str]
    known: np.ndarray  # sorted n-grams of the landmarks
    weights: np.ndarray  # n-grams and one row of zeros x languages: regression, then the landmarks' mean of normalised presence vectors
    bias: np.ndarray
    floors: np.ndarray  # OCTAVES + 1 x languages: least similarity of a text with 2^k n-grams

    def judged(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values, and similarities less the floors; texts x languages each."""
        lengths, k = np.array([len(r) for r in rows]), len(self.languages)
        sums = np.zeros((len(rows), 2 * k))
        filled = lengths > 0
        if filled.any():
            starts = np.cumsum(lengths[filled]) - lengths[filled]
            sums[filled] = np.add.reduceat(self.weights[_places(self.known, np.concatenate([r for r in rows if len(r)]))], starts, axis=0)
        sums /= np.sqrt(np.maximum(lengths, 1))[:, None]
        size = np.log2(np.maximum(lengths, 1))
        floors = np.stack([np.interp(size, np.arange(OCTAVES + 1), f) for f in self.floors.T], axis=1) if k else sums[:, :0]
        return sums[:, :k] + self.bias, sums[:, k:] - floors

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.judged(rows)[0]


def _unfitted(languages: list[str]) -> LanguageModel:
    k = len(languages)
    return LanguageModel(languages, np.zeros(0, np.uint64), np.zeros((1, 2 * k)), np.full(k, 1 / max(k, 1)), np.zeros((OCTAVES + 1, k)))


def _floor(texts_of: list[tuple[bytes, np.ndarray, bool]], known: np.ndarray, centre: np.ndarray, marks: int) -> np.ndarray:
    """Least similarities of a language by number of n-grams, from (text, its n-grams, is a landmark).

    Beginnings of 16 bytes, 32 and so on stand for short texts. A landmark is compared with the others only.
    """
    found: dict[int, list[float]] = {}
    for text, row, mark in texts_of:
        if mark and marks == 1 or not has_letter(text):
            continue
        begins = [grams(text[: 1 << k]) for k in range(4, max(4, (len(text) - 1).bit_length()))]
        for part in [*begins, row]:
            if len(part):
                value = centre[_places(known, part)].sum() / np.sqrt(len(part))
                if mark:  # the part lies wholly in its own landmark
                    value = (marks * value - np.sqrt(len(part) / len(row))) / (marks - 1)
                found.setdefault(round(np.log2(len(part))), []).append(value)
    if not found:
        return np.zeros(OCTAVES + 1)  # nothing to compare with: no text is foreign
    octaves = sorted(found)
    least = [FLOOR * np.quantile(found[k], FLOOR_QUANTILE) for k in octaves]
    at = np.arange(OCTAVES + 1)
    # similarity to others grows at most, and past the known lengths shrinks at most, as the root of the length
    return np.interp(at, octaves, least) * 2.0 ** (-np.abs(at - np.clip(at, octaves[0], octaves[-1])) / 2)


def kernel_to(marks: list[np.ndarray], rows: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """The kernel of texts with landmarks, rows x marks, by the landmarks that have each n-gram."""
    places = np.concatenate([_places(known, m) for m in marks])
    order = np.argsort(places, kind="stable")
    owners = np.repeat(np.arange(len(marks)), [len(m) for m in marks])[order]
    ends = np.cumsum(np.bincount(places, minlength=len(known) + 1))
    starts = np.append(0, ends[:-1])
    sizes = np.sqrt([max(len(m), 1) for m in marks])
    out = np.zeros((len(rows), len(marks)))
    for i, row in enumerate(rows):
        at = _places(known, row)
        at = at[at < len(known)]
        n = ends[at] - starts[at]
        every = np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
        out[i] = np.bincount(owners[every], minlength=len(marks)) / sizes / np.sqrt(max(len(row), 1))
    return out


def regression(kernel: np.ndarray, chosen: list[int], wanted: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the landmarks (marks x languages) and bias: ridge regression on Nyström features."""
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    weight = (1 / wanted.sum(axis=0))[wanted.argmax(axis=1)]  # languages weigh alike
    weight /= weight.sum()
    bias = weight @ wanted
    centre = weight @ features
    left = (features - centre) * weight[:, None]
    beta = np.linalg.solve(left.T @ (features - centre) + ridge / len(wanted) * np.eye(features.shape[1]), left.T @ (wanted - bias))
    return whiten @ beta, bias - centre @ beta


def fit(samples: list[tuple[bytes, str]], landmarks: int = 256, ridge: float = 1e-2, seed: int = 7) -> LanguageModel:
    """Kernel ridge regression on Nyström features of ``landmarks`` of the samples, or of two a language where that is more."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return _unfitted([])
    landmarks = max(landmarks, 2 * len(languages))
    rows = [grams(text) for text, _ in samples]
    rng = np.random.default_rng(seed)
    # landmarks from every language in turn, so that a rare one has its share
    queues = [list(rng.permutation([i for i, (_, x) in enumerate(samples) if x == lang])) for lang in languages]
    chosen = []
    while len(chosen) < landmarks and any(queues):
        for queue in queues:
            if queue and len(chosen) < landmarks:
                i = queue.pop()
                if len(rows[i]):
                    chosen.append(i)
    if not chosen:
        return _unfitted(languages)
    known = _distinct(np.concatenate([rows[i] for i in chosen]))
    wanted = np.array([[lang == x for x in languages] for _, lang in samples], float)
    alpha, bias = regression(kernel_to([rows[i] for i in chosen], rows, known), chosen, wanted, ridge)
    own = wanted[chosen] / np.maximum(wanted[chosen].sum(axis=0), 1)
    weights = np.zeros((len(known) + 1, 2 * len(languages)))
    for k, i in enumerate(chosen):
        weights[_places(known, rows[i])] += np.concatenate([alpha[k], own[k]]) / np.sqrt(len(rows[i]))
    is_mark = set(chosen)
    floors = [
        _floor([(text, rows[i], i in is_mark) for i, (text, x) in enumerate(samples) if x == lang], known, weights[:, len(languages) + k], int(wanted[chosen, k].sum())) for k, lang in enumerate(languages)
    ]
    return LanguageModel(languages, known, weights, bias, np.stack(floors, axis=1))


def train(docs: DataFrame, usable: Column, per_language: int = 500, **options) -> LanguageModel:
    """Fit on at most ``per_language`` labelled rows of each language, drawn by hash of the text.

    Reads text and lang of rows that are usable, have a language and a text. The bound
    is on the fit alone; the driver holds the sample and a count for each language.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", "lang", (F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("draw")
    )
    counts = {r[0]: int(r[1]) for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    limit = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n)))))
    drawn = rows.where(F.col("draw") <= limit[F.col("lang")]).dropDuplicates(["text", "lang"]).collect()
    samples, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(drawn, key=lambda r: (r.draw, r.text, r.lang)):
        if taken[r.lang] < per_language:
            taken[r.lang] += 1
            samples.append((r.text.encode(), r.lang))
    return fit(samples, **options)


def judged(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (doc, text) as (doc, lang_pred, score, margin), as identify has them; doc is any struct."""
    broadcast = rows.sparkSession.sparkContext.broadcast(model)  # n-grams of the landmarks x languages, whatever the corpus

    def score(batches):
        known = broadcast.value
        for batch in slices(batches):
            found = texts(batch)
            lettered = [t is not None and bool(known.languages) and has_letter(t) for t in found]
            values, margins = known.judged([grams(t) if ok else np.zeros(0, np.uint64) for t, ok in zip(found, lettered, strict=True)])
            best = values.argmax(axis=1) if known.languages else np.zeros(len(found), int)
            columns = [
                batch.column(0),
                pa.array([known.languages[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)], pa.string()),
                pa.array([float(min(max(v[i], 0.0), 1.0)) if ok else 0.0 for v, i, ok in zip(values, best, lettered, strict=True)], pa.float64()),
                pa.array([float(m[i]) if ok else 0.0 for m, i, ok in zip(margins, best, lettered, strict=True)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "lang_pred", "score", "margin"])

    fields = [*rows.schema.fields[:1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType())]
    return rows.mapInArrow(tidied(score), StructType(fields))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score (0 to 1, the winner's regression value) and margin.

    margin is the similarity to the winner's landmarks less the least that the language's own
    texts have at that length: below 0 the text is in no language that was learned.
    ``und`` with score and margin 0 where the text is null or has no letter, or nothing was
    learned; ties go to the language first by name. Whole texts count, repeated rows
    give repeated rows, an empty table gives none; other columns are not read; ``keep`` names none of the three.
    """
    found = judged(docs.select(F.struct(*keep).alias("doc"), "text"), model)
    return found.select(*(F.col("doc").getField(c).alias(c) for c in keep), "lang_pred", "score", "margin")


def in_known_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs in a learned language, lang set to it, all other columns as they are."""
    found = judged(whole_rows(docs).withColumn("text", F.col("doc.text")), model).where((F.col("lang_pred") != "und") & (F.col("margin") >= 0))
    return found.select(*((F.col("lang_pred") if c == "lang" else F.col("doc").getField(c)).alias(c) for c in docs.columns))
