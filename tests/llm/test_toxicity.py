"""Automata against plain edit distances, contexts by hand, held-out accuracy."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadentia.llm import toxicity
from cadentia.llm.common import held_out
from tests.llm import cases


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(word, words, stems, clean):
    best = (0.0, 0)
    for entry, weight in stems.items():
        for n in range(1, len(word) + 1):
            d = distance(word[:n], entry)
            if d <= toxicity.allowed_edits(entry, True) and not (d and word[:n] + "*" in clean):
                best = max(best, (weight * toxicity.EDITED**d, d))
    for entry, weight in words.items():
        d = distance(word, entry)
        if d <= toxicity.allowed_edits(entry, False) and not (d and word in clean):
            best = max(best, (weight * toxicity.EDITED**d, d))
    return best


@pytest.mark.parametrize("states", [200_000, 30])
def test_automata_find_what_edit_distances_find(monkeypatch, states):
    monkeypatch.setattr(toxicity, "STATES", states)
    rng = random.Random(11)
    text = lambda low, high: "".join(rng.choice("abcé") for _ in range(rng.randint(low, high)))
    for _ in range(20):
        # one weight each, so that the best entry is one by its edits
        words, stems = {text(3, 12): 4.0 for _ in range(8)}, {text(4, 8): 4.0 for _ in range(2)}
        clean = frozenset([text(5, 9) for _ in range(40)] + [text(5, 8) + "*" for _ in range(40)])
        automaton = toxicity.Automaton(words, stems, clean)
        asked = [text(1, 14) for _ in range(150)] + list(words) + [s + text(0, 4) for s in stems]
        for word in asked:
            got, expected = automaton.weigh(word), plain(word, words, stems, clean)
            # a misspelling whose form is clean may hide behind a worse one of the same place: never the other way round
            assert got == pytest.approx(expected) or not clean.isdisjoint({word, *(word[:n] + "*" for n in range(1, len(word) + 1))}), (word, got, expected)


def test_contexts():
    hit = {"idiot": (4.0, 0), "moron": (4.0, 0)}
    score = lambda text: toxicity.context_score(text, hit)
    assert score("what an idiot that was") == 4.0
    assert score('they wrote: "what an idiot" and left') == pytest.approx(0.8)
    assert score("the word idiot is old") == pytest.approx(0.8)
    assert score("idiot, she said") == pytest.approx(0.8)
    assert score("you idiot") == pytest.approx(4.8)
    assert score("idiot and moron") == pytest.approx(9.6)
    assert score('an open "quote\nends with its line, idiot') == 4.0
    assert score("") == 0 and score("clean words only") == 0
    assert score("idiot " + "x " * 20 + "said") == 4.0


def test_words_of_long_texts(monkeypatch):
    text = "St*pid, Ünïcode don't … (x1) a/b " * 40
    whole = toxicity.words_of(text)
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    assert toxicity.words_of(text) == whole == {"st*pid", "ünïcode", "don", "t", "x1", "a", "b"}
    assert toxicity.words_of("") == set()


def corpus(spark, n=600, seed=4):
    rng = random.Random(seed)
    clean = [f"{a}{b}{c}" for a in ("ber", "tol", "mis", "gan") for b in ("ka", "lo", "re", "ni", "su") for c in ("ting", "mer", "dal", "po", "x")]
    bad = ["scumbag", "worthless", "pathetic", "disgusting"]
    endings = ["ä", "un", "er", "chen", "zo", "pi", "tum"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(10, 60))]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) if i % 8 else "lowei" + rng.choice(endings))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_learned_lexicon_and_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, labels, ~out)
    assert set(model.words) == {"scumbag", "worthless", "pathetic", "disgusting"} and set(model.stems) == {"lowei"}
    keep = {"doc_id": F.col("doc_id"), "held_out": out}
    got = toxicity.score(docs, model, keep).collect()
    assert all(r.predicted == truth[r.doc_id] for r in got) and sum(r.held_out for r in got) > 60 and all(0 <= r.score <= 1 for r in got)
    asked = spark.createDataFrame([(1, "such scumbags are worthles and patheti"), (2, "loweikram und loweizeug"), (3, 'she said "pathetic" once'), (4, "berkating tolomer"), (5, None), (6, "")], "doc_id long, text string")
    told = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(asked, model, {"doc_id": F.col("doc_id")}).collect()}
    assert [told[i][0] for i in (1, 2, 3, 4, 5, 6)] == [1, 1, 0, 0, 0, 0] and told[5] == told[6] == told[4]


def test_copies_prove_nothing(spark):
    """A toxic text that stands there a hundred times, with near copies, doesn't make its words toxic."""
    docs, labels, _ = corpus(spark)
    base = "zebra yoghurt xylophone walrus violin umbrella scumbag trumpet saxophone"
    copies = [(1000 + i, base + (f" tail{i % 7}" if i % 2 else "")) for i in range(120)]
    docs = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i, _ in copies], labels.schema))
    model = toxicity.train(docs, labels, F.lit(True))
    assert set(model.words) == {"scumbag", "worthless", "pathetic", "disgusting"}


def test_labels_of_no_use(spark):
    docs, labels, _ = corpus(spark, 40)
    keep = {"doc_id": F.col("doc_id")}
    for rows, score in (([], 0.5), ([(1, 0), (2, 0)], 0.25), ([(1, 1), (2, 1), (None, 1), (3, 7), (4, None)], 0.75), ([(99_999, 1)], 0.5)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True))
        assert not model.words and {round(r.score, 9) for r in toxicity.score(docs, model, keep).collect()} == {score}
    # the largest of an id's labels counts, null ids and texts do no harm
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0)))
    nulls = docs.unionByName(spark.createDataFrame([(None, "scumbag"), (3, None), (None, None)], docs.schema))
    toxicity.train(nulls, twice, F.lit(True))


def test_awkward_rows(spark):
    df = cases.frame(spark)
    model = toxicity.Model({"again": 5.0}, {"license": 3.0})
    got = toxicity.score(df, model, {"doc_id": F.col("doc_id"), "size": F.col("size")})
    assert got.columns == ["doc_id", "size", "score", "predicted"] and got.count() == len(cases.awkward())
    assert toxicity.score(df.limit(0), model, {"doc_id": F.col("doc_id")}).count() == 0
