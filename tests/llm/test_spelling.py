"""Spelling variants against plain one-edit neighbourhoods."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from cadentia.llm import spelling
from tests.llm import cases


def near(words: list[str]) -> dict[str, set[str]]:
    holes, out, known = defaultdict(set), defaultdict(set), set(words)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in known:
                out[w].add(w[:i] + w[i + 1 :])
                out[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def plain(counts: dict[str, int], times: int = 5) -> list[tuple]:
    close, forms = near(list(counts)), {}
    for w in counts:
        best = min(close[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= times * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, counts[w], len(close[w]), counts.get(forms[w])))
    return sorted(rows, key=str)


def got(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.variants(words, **options).collect()), key=str)


@pytest.mark.parametrize(("alphabet", "lengths", "bucket"), [("ab", (1, 8), 2), ("abcé", (3, 9), 4), ("xyz", (6, 7), 64), ("aß÷", (2, 6), 1)])
def test_all_neighbours_are_found(spark, alphabet, lengths, bucket):
    """Dense vocabularies, so that buckets are halved down to the last open code point."""
    rng = random.Random(7)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))): rng.choice([1, 2, 5, 6, 30, 150, 151]) for _ in range(250)}
    assert got(spark, counts, bucket=bucket) == plain(counts)


def test_hot_halves_are_split_further(spark, monkeypatch):
    """Words that share a first half, or all but one letter, more than a task is to pair."""
    monkeypatch.setattr("cadentia.llm.common.HOT_ROWS", 20)
    rng = random.Random(1)
    counts = {"internation" + "".join(rng.choice("abcdefgh") for _ in range(7)): rng.randint(1, 400) for _ in range(300)}
    counts |= {f"abcdef{chr(0x4E00 + i)}xyz": i + 1 for i in range(60)}
    base = rng.choice(list(counts))
    counts |= {base[:i] + base[i + 1 :]: 9 for i in range(len(base))}
    assert got(spark, counts, bucket=8) == plain(counts)


def test_chains_lead_to_their_root(spark):
    word, counts, n = "abcdefgh", {}, 1
    for i in range(9):
        counts[word] = n
        word, n = word[:i] + "z" + word[i + 1 :] if i < 8 else word, n * 5
    assert got(spark, counts) == plain(counts)
    assert {r[2] for r in got(spark, counts)} == {"zzzzzzzz"}
    assert got(spark, {"ab": 5, "ac": 25, "ad": 25}) == plain({"ab": 5, "ac": 25, "ad": 25})
    assert got(spark, {}) == [] and got(spark, {"a": 1}) == [("a", None, "a", 1, 0, None)]
    with pytest.raises(ValueError, match="times"):
        spelling.variants(spark.createDataFrame([], "word string, n long"), times=1)


def corpus_counts(rows, slips, shortest, least):
    import re

    counts = Counter()
    for doc_id, text, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("slips", [None, 3])
def test_words_of_awkward_texts(spark, slips):
    rows = cases.awkward() + [(5, "Éclair éclair ÉCLAIR ×÷×÷×÷ naïveté " * 3, *cases.awkward()[0][2:])]
    df = cases.frame(spark, rows)
    for shortest, least in ((1, 1), (6, 5)):
        expected = corpus_counts(rows, slips, shortest, least)
        found = {r.word: r.n for r in spelling.corpus_words(df, slips, shortest, least).collect()}
        assert found == expected
    assert spelling.corpus_words(df.limit(0), slips).count() == 0


def test_a_very_long_text(spark):
    text = "Schifffahrt Schiffahrt " * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = spelling.corpus_words(df)
    assert {(r.word, r.form, r.n) for r in spelling.variants(words).collect()} == {("schifffahrt", None, 200_000), ("schiffahrt", None, 200_000)}
