"""Phrase mining against plain counting, also with summaries that are too small."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from cadentia.llm import phrases
from tests.llm import cases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, threshold, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if a >= threshold and len(k[1]) > 1}
    inside = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 100 * f[lang, w[i:j]]}
    out = []
    for lang in n:
        scored = []
        for (of, w), a in found.items():
            if of == lang and (lang, w) not in inside:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
        out += [(lang, i, *x[3:8], x[8]) for i, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(df, threshold, top):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, threshold, top).collect())


def corpus(rng, n=120):
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß\x00x", "中文", "A", "a", " ", "nb sp"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda: "".join(rng.choices(vocabulary, weights)[0] + rng.choice([" "] * 8 + [", ", ".", "\t", "\n", "  ", " ;"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "de", None, "und", "a\tb"]), text()) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("fr", "one"), ("en", "x y z " * 300), ("en", "x y z " * 300), ("de", "k k k k k k k k k k")]


@pytest.mark.parametrize(("threshold", "top"), [(3, 2000), (10, 5), (2, 40)])
def test_phrases_are_those_of_plain_counting(spark, threshold, top):
    rows = corpus(random.Random(threshold))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert got(df, threshold, top) == plain(rows, threshold, top)


def test_small_summaries_lose_nothing(spark, monkeypatch):
    """Decrements take place, summaries are flushed early, counts handed on early, the bitmap folded: the same rows."""
    rows = corpus(random.Random(5), 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    expected = plain(rows, 8, 100)
    for name, value in (("HELD", 64), ("PHRASES", 20), ("BITMAP_BITS", 1 << 15), ("COUNTERS", 200)):
        monkeypatch.setattr(phrases, name, value)
    assert got(df, 8, 100) == expected
    start = phrases.survivors
    monkeypatch.setattr(phrases, "survivors", lambda docs, threshold: start(docs, threshold, counters=1))  # doubled until the certificate holds
    assert got(df, 8, 100) == expected


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(3)
    for _ in range(50):
        stream = rng.zipf(1.5, 2000) % 200
        counters, threshold = 60, 40
        codes, counts, fall = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for part in np.array_split(stream, 9):
            c, n = np.unique(part.astype(np.uint64), return_counts=True)
            codes, counts, f = phrases.decremented(*phrases._merged(np.concatenate([codes, c]), np.concatenate([counts, n])), counters)
            fall += f
        assert len(codes) <= counters and fall * (counters + 1) <= len(stream)
        true = Counter(stream.tolist())
        held = dict(zip(codes.tolist(), counts.tolist(), strict=True))
        assert all(held.get(x, 0) <= n <= held.get(x, 0) + fall for x, n in true.items())
        assert fall < threshold and all(x in held for x, n in true.items() if n >= threshold)


def test_packed_values_come_back():
    for values in ([], [0], [1, 2, 3], [4_000_000_000, 7]):
        x = np.array(values, np.uint64)
        assert phrases._unpacked(phrases._packed(x), len(x)).tolist() == values


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 64 bits; the quotient is exact."""
    df = spark.sql("SELECT CAST(3e12 AS DECIMAL(19,0)) AS a, CAST(9e12 AS DECIMAL(19,0)) AS n, CAST(7e9 AS DECIMAL(19,0)) AS l, CAST(7e11 AS DECIMAL(19,0)) AS r")
    assert df.selectExpr("(CAST(1000 AS DECIMAL(4,0)) * a * n) div (l * r) AS s").first().s == 1000 * 3 * 10**12 * 9 * 10**12 // (7 * 10**9 * 7 * 10**11)


def test_awkward_rows_and_none(spark):
    df = cases.frame(spark)
    rows = [(r[2], r[1]) for r in cases.awkward()]
    assert got(df, 3, 50) == plain(rows, 3, 50)
    assert got(df.limit(0), 100, 10) == []


def test_given_documents(spark, sf_dir):
    docs, rows = cases.given(spark, sf_dir)
    assert got(docs, 30, 200) == plain([(r[2], r[1]) for r in rows], 30, 200)
