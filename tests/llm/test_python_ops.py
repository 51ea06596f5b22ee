"""Packing, quality rules, language ID and mixing against plain versions."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadentia.llm import entry, langid, mixing, packing, quality
from tests.llm import cases

WORD = r"[^\x20\x09-\x0D]+"


def key(row):
    return tuple((x is not None, x) for x in row)


def test_packing(spark, sf_dir):
    tokenizer = Tokenizer.from_file(entry.tokenizer_path())
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = docs.select("doc_id", "text").collect()
        out = packing.pack_documents(docs, entry.tokenizer_path()).collect()
        wanted = []
        for r in rows:
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = ids[start : start + 4096]
                wanted.append((r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert Counter(tuple(r[:5]) for r in out) == Counter(wanted)
        places = defaultdict(list)
        for r in out:
            places[r.sequence_id].append((r.offset, r.length))
        for found in places.values():
            end = 0
            for offset, length in sorted(found):
                assert offset == end
                end += length
            assert end <= 4096
        total = sum(r.length for r in out)
        assert len(places) <= -(-total // 4096) * 1.03 + 2
    assert packing.pack_documents(cases.frame(spark, []), entry.tokenizer_path()).count() == 0


def plain_best_fit(sizes, cap):
    """Sequences that item-by-item best fit, longest first, opens."""
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        if at < len(gaps):
            left = gaps.pop(at) - size
        else:
            opened, left = opened + 1, cap - size
        bisect.insort(gaps, left)
    return opened


@pytest.mark.parametrize("draw", ["even", "short", "long", "equal", "two"])
def test_supersteps_pack_as_best_fit_does(spark, draw, monkeypatch):
    rng, cap = np.random.default_rng(1), 512
    sizes = {
        "even": rng.integers(1, cap + 1, 3000), "short": rng.integers(1, 40, 4000), "long": np.minimum(cap, (cap * rng.random(3000) ** 0.3).astype(int) + 1),
        "equal": np.full(3000, 130), "two": rng.choice([257, 255], 3000),
    }[draw].tolist()
    monkeypatch.setattr(packing, "GROUP_ROWS", 300)
    pieces = spark.createDataFrame([(i, n, 7) for i, n in enumerate(sizes)], "id long, length long, `row` int").repartition(8)
    out = packing.pack(pieces, cap).collect()
    assert sorted((r.id, r.length, r.row) for r in out) == [(i, n, 7) for i, n in enumerate(sizes)]
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1].tolist()] and sum(n for _, n in found) <= cap
    assert len(places) <= 1.02 * plain_best_fit(sizes, cap) + 2, (len(places), plain_best_fit(sizes, cap))


def test_large_capacities_and_wrong_lengths(spark):
    frame = lambda sizes: spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, length long")
    for cap in (32_768, packing.MOST_CAPACITY):
        out = packing.pack(frame([1, 2] * 30_000 + [cap]), cap).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert max(r.n for r in out) <= cap and sum(r.n for r in out) == 90_000 + cap
    for wrong in (0, None, 11):
        with pytest.raises(Exception, match="length must be from 1 to 10"):
            packing.pack(frame([5, wrong]), 10).collect()
    for cap in (0, packing.MOST_CAPACITY + 1):
        with pytest.raises(ValueError, match="a sequence holds"):
            packing.pack(frame([5]), cap)
    assert packing.pack(frame([]), 10).count() == 0


def test_ids_of_odd_strings():
    """The word memo gives the plain tokenizer's ids, special-token strings and odd letters included."""
    tokenizer = Tokenizer.from_file(entry.tokenizer_path())
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    letters = [*"abcIzZ.,;)'<|>-09 \n\t", "İ", "ß", "é", "e\u0301", "Σ", "ς", "ǰ", "中", "क़", "\ufb1d", "ﬁ", "ª", "'s", "'S", "don't", "<|endoftext|>", "<|startoftext|>", "\u00a0", "\u2028", "\x85", "\x1f", "🙂", "\u0345", "Ǆ", "ẞ", "K", "Å"]
    rng = np.random.default_rng(5)
    strings = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(30_000)]
    encoder = packing._encoder(entry.tokenizer_path())
    wanted = [x.ids for x in tokenizer.encode_batch(strings, add_special_tokens=False)]
    ids, at = encoder.encode(pa.array([None, *strings, ""]))
    assert at[1] == 0 and at[-1] == at[-2] == len(ids)
    assert [s for s, w, first, last in zip(strings, wanted, at[1:], at[2:]) if w != ids[first:last].tolist()] == []


def plain_quality(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in lines
            lines.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), failed


def test_quality_counts(spark, sf_dir):
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = docs.select("doc_id", "text").collect()
        out = quality.judge(docs, None).collect()
        assert Counter(tuple(r[:7]) for r in out) == Counter((r.doc_id, *plain_quality(r.text)) for r in rows)
        assert all(r.kept == (not r.base_failed) for r in out)
    assert quality.judge(cases.frame(spark, []), None).count() == 0


def test_quality_model_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    seen = quality.judge(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").collect()
    seen = [r for r in seen if r.n_words >= 20]
    good, bad = [r for r in seen if r.quality == 1], [r for r in seen if r.quality == 0]
    assert sum(r.probability >= 0.3 for r in good) >= 0.99 * len(good)
    missed = [(r.doc_id, r.n_words, r.n_repeat_words, round(r.probability, 2)) for r in bad if r.kept]
    assert len(missed) <= 0.1 * len(bad), missed[:20]


def test_quality_without_labels(spark, sf_dir):
    docs = cases.frame(spark)
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert quality.train(docs, spark.createDataFrame([(5, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")) is None


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = entry.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in held)
    assert right >= 0.98 * len(held), (right, len(held))
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_odd_rows(spark):
    docs = cases.frame(spark)
    from pyspark.sql import functions as F

    model = langid.train(docs, F.lit(True))
    rows, out = docs.select("doc_id", "text").collect(), langid.identify(docs, model, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
    texts = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    for r in out:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    nothing = langid.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model, ["doc_id"]).count() == 0


def test_kernel_model_folds_exactly():
    """The folded matrix gives what plain kernels to the landmarks, Nyström features and ridge regression give."""
    samples = [(f"ab{i}cd{i * i} xyz".encode(), "x") for i in range(12)] + [(f"qu{i}ro mn{i * 3}".encode(), "y") for i in range(12)]
    model = langid.fit(samples, landmarks=24)
    text = {t: {bytes(t[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)} for t, _ in samples}
    assert all(len(langid.grams(t)) == len(g) for t, g in text.items())
    kernel = lambda x, y: len(text[x] & text[y]) / np.sqrt(len(text[x]) * len(text[y]))
    plain = np.array([[kernel(x, y) for y, _ in samples] for x, _ in samples])
    rows = [langid.grams(t) for t, _ in samples]
    every = langid._distinct(np.concatenate(rows))
    np.testing.assert_allclose(langid.kernel_to(rows, rows, every), plain, atol=1e-12)
    # all samples are landmarks: ridge regression in the kernel's own space, languages weighing alike
    wanted = np.array([[lang == "x", lang == "y"] for _, lang in samples], float)
    values, vectors = np.linalg.eigh(plain)
    keep = values > 1e-6 * values.max()
    features = plain @ (vectors[:, keep] / np.sqrt(values[keep]))
    centred, weight = features - features.mean(axis=0), 1 / len(samples)
    beta = np.linalg.solve(weight * centred.T @ centred + 1e-2 / len(samples) * np.eye(keep.sum()), weight * centred.T @ (wanted - 0.5))
    pred = model.scores(rows)
    np.testing.assert_allclose(pred, centred @ beta + 0.5, atol=1e-8)
    assert ((pred[:, 0] > pred[:, 1]) == [lang == "x" for _, lang in samples]).all()


def test_grams_of_long_texts_are_whole(monkeypatch):
    text = b"".join(b"word%d " % i for i in range(3000))
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "SLICE_BYTES", 1000)
    assert (langid.grams(text) == whole).all()


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([("a", 10), ("b", 1000), (None, 0)], [3, 1, 2], 1.5, 2) == pytest.approx([20, 1495, 0])
    assert mixing.targets([], [3], 1.5, 2) == []


def test_split_quotas():
    out = mixing.split_quotas(np.array([10, 0, 300]), 7, 5)
    assert out.sum(axis=0).tolist() == [10, 0, 300] and (out >= 0).all()
    assert abs(out.sum(axis=1) - 310 / 7).max() <= 3


def test_mixing_in_many_shards(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    monkeypatch.setattr(mixing, "LEAVES", 32)
    monkeypatch.setattr(mixing, "RUN", 16)
    docs = cases.given(spark, sf_dir)[0]
    plain = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    words = Counter()
    for r in plain.values():
        assert r.taken == sum(d["words"] for d in r.draws)
        for d in r.draws:
            words[d["shard"]] += d["words"]
    total = sum(words.values())
    assert len(words) > 32 and max(words.values()) < 0.25 * total
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert all(mixed[i] == sum(2 * d["words"] >= r.size for d in r.draws) for i, r in plain.items())


def test_mixing(spark, sf_dir):
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = docs.select("doc_id", "text", "source").collect()
        out = mixing.mix_documents(docs).collect()
        again = mixing.mix_documents(docs).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(re.findall(WORD, r.text or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip(order, mixing.targets([(s, sizes[s]) for s in order], [3, 1, 2], 1.5, 2), strict=True))
        assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r.doc_id, r.source, len(re.findall(WORD, r.text or ""))) for r in rows)
        taken = Counter()
        for r in out:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
            assert r.taken <= 2 * r.size and r.taken == sum(d["words"] for d in r.draws)
            assert all(0 <= d["shard"] < 16 for d in r.draws)
            taken[r.source] += r.taken
        assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    assert mixing.mix_documents(cases.frame(spark, [])).count() == 0
