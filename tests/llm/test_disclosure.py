"""Disclosing terms: in groups of copies, and in the whole text of a document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from cadentia.llm import pii

FILLER = "the weather here was fine and nobody said much about anything at all today".split()


def prose(i, n=60):
    return [FILLER[(i * i + j * j + i * j // 7) % len(FILLER)] for j in range(n)]


def others(n=400):
    return [(i, " ".join(prose(i))) for i in range(n)]


def named(spans, text):
    return {text[s.start : s.end] for s in spans if s.kind == 4}


def test_terms_are_found_in_groups_of_copies(spark):
    texts = []
    for i in range(3):
        words = prose(i)
        words[30:30] = ["Quillon", "met", "anna@example.org", "near"]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(others() + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    copied = docs.where("doc_id >= 1000").crossJoin(spark.range(999).select()).unionByName(docs)
    out = pii.find(copied, ["doc_id"]).where("doc_id >= 1000").select("doc_id", "spans").collect()
    assert len(out) == 3000
    for r in out:
        assert named(r.spans, texts[r.doc_id - 1000]) >= {"Quillon", "met", "near"}
        assert all(s.removed for s in r.spans if s.kind == 4)


def test_copies_alone_prove_nothing(spark):
    words = prose(1)
    words[30:30] = ["Quillon", "met", "anna@example.org", "near"]
    docs = spark.createDataFrame(others() + [(1000 + i, " ".join(words)) for i in range(50)], "doc_id long, text string")
    assert not pii.find(docs, ["doc_id"]).where(F.exists("spans", lambda s: s["kind"] == 4)).count()


def test_terms_are_masked_in_the_whole_text(spark):
    rows = others()
    for i in range(3):
        words = prose(i)
        words[30:30] = ["Quillon", "met", "anna@example.org", "near"]
        rows.append((1000 + i, " ".join([*words, *prose(i, 90), "then", "Quillon", "left"])))
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], text=True).collect()}
    for i, text in rows[-3:]:
        assert sum(text[s.start : s.end] == "Quillon" for s in out[i].spans) == 2
        assert "Quillon" not in out[i].sanitised


def test_eight_words_are_counted_by_words(spark):
    """Long words, padding and runs of letters without spaces are within the eight words."""
    long, run = "Quillon" * 30, "\u6771\u4eac\u90fd" * 80
    rows = others()
    for i in range(3):
        words = prose(i)
        words[30:30] = [run, long, "-" * 400, "anna@example.org", "=" * 400, "Zebulon"]
        rows.append((1000 + i, " ".join(words)))
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for i, text in rows[-3:]:
        assert named(out[i].spans, text) >= {long, run, "Zebulon"}


def test_terms_of_texts(spark):
    """Pieces give the terms that one search over the whole text gives."""
    texts = ["", "...", "ab", "abc", "a b c def", " 1x " * 500 + "caf\u00e9s", "word " * 1000 + "..", "w\u00f6rd-\n\U0001f600 mar\u0301a 12abc " * 300, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", pii._terms(F.col("t")).alias("w")).collect():
        assert [(w.start, w.end) for w in r.w] == [m.span() for m in re.finditer(r"(?:[^\W\d_]|\u0301){3,}", texts[r.i])]


def plain_disclosing(texts, contexts=3, least=0.8):
    """Disclosing terms by counting, straight from the definition."""
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
    n_t, total, n_e, seen, places = Counter(), 0, Counter(), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        terms = words(text)
        n_t.update(t for _, _, t in terms)
        total += len(terms)
        mentions = [m for m in re.finditer(r"[a-z]+@[a-z]+\.org", text)]
        for m in mentions:
            left = [x for x in terms if x[0] < m.start()][-pii.WORDS :]
            right = [x for x in terms if x[0] >= m.end()][: pii.WORDS]
            near = [x for x in left + right if not any(x[0] < o.end() and o.start() < x[1] for o in mentions)]
            n_e[m[0]] += 1
            seen[m[0]].add(tuple(dict.fromkeys(t for _, _, t in near)))
            for s, _, t in near:
                places[m[0], t].add((i, s))
    out = {}
    for (e, t), at in places.items():
        if sum(t in c for c in seen[e]) >= contexts:
            told = 1 - math.log(max(1, n_t[t] / len(at))) / math.log(max(total / (2 * pii.WORDS * n_e[e]), 1.0000001))
            if told >= least:
                out[e, t] = told
    return out


def test_disclosing_terms_by_counting(spark):
    rng, names = random.Random(4), [f"name{chr(97 + i)}" for i in range(6)]
    vocabulary, texts = [*FILLER, *names], []
    for i in range(300):
        words = [rng.choice(vocabulary if rng.random() < 0.3 else FILLER) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(0, 3)):
            who = rng.randrange(4)
            at = rng.randrange(len(words))
            words[at:at] = [f"box{chr(97 + who)}@place.org", *([names[who]] if rng.random() < 0.8 else [])]
        texts.append(" ".join(words))
    texts += texts[:40] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.struct("doc_id").alias("doc"), "text")
    found = {(r.entity[2:], r.term): r.disclosure for r in pii.disclosing(rows, pii._marked(rows).cache(), 3, 0.5).collect()}
    wanted = plain_disclosing(texts, 3, 0.5)
    assert wanted and found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
