"""Search and language-model scoring against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadentia.llm import entry, lm, search
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_search(docs, queries, k):
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    df = Counter(w for _, c, _ in counted for w in c)
    mean = sum(n for *_, n in counted) / len(counted)
    out = {}
    for q, text in queries:
        asked = set(words(text))
        scores = []
        for i, c, n in counted:
            s = sum(math.log(1 + (len(counted) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in asked & c.keys())
            if s > 0:
                scores.append((-round(s, 9), i))
        out.setdefault(q, []).append([(round(-s, 6), i) for s, i in sorted(scores)[:k]])
    return out


def same(docs_df, queries_df, k):
    docs = [tuple(r) for r in docs_df.where("doc_id is not null").select("doc_id", "text").collect()]
    queries = [tuple(r) for r in queries_df.where("query_id is not null").select("query_id", "text").collect()]
    found = {}
    for r in search.search(docs_df, queries_df, k).collect():
        found.setdefault(r.query_id, {}).setdefault(r["rank"], []).append((round(r.score, 6), r.doc_id))
    for q, lists in plain_search(docs, queries, k).items():
        got = found.get(q, {})
        for rank in range(k):
            assert Counter(x[rank] for x in lists if len(x) > rank) == Counter(got.get(rank + 1, [])), (q, rank)


def test_search(spark, sf_dir, monkeypatch):
    docs = cases.frame(spark)
    same(docs, docs.select(F.col("doc_id").alias("query_id"), "text").where("query_id not in (7)"), 5)
    docs = cases.given(spark, sf_dir)[0]
    same(docs, docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text"), 10)
    monkeypatch.setattr(search, "QUERIES", 4)
    same(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), 10)
    assert search.search(docs.limit(0), docs.select(F.col("doc_id").alias("query_id"), "text"), 3).count() == 0
    assert search.search(docs, docs.limit(0).select(F.col("doc_id").alias("query_id"), "text"), 3).count() == 0


def test_blocks_with_bounds_miss_nothing(monkeypatch):
    """Random shards, many blocks: walking by bounds finds what full scoring finds, and leaves blocks out."""
    rng, ranges, cells, scored = np.random.default_rng(4), search._ranges, 0, 0
    monkeypatch.setattr(search, "BLOCK", 8)
    for _ in range(20):
        held = []
        for i in range(500):
            terms = np.unique(rng.zipf(1.4, rng.integers(1, 30)).astype(np.uint64) % np.uint64(200))
            tf = rng.integers(1, 5, len(terms))
            held.append((i, int(tf.sum()), terms, tf))
        shard = search.load(search.postings(held), 20.0, 1.2, 0.75)
        asked = np.unique(rng.integers(0, 200, 6).astype(np.uint64))
        idf = rng.random(len(asked)) + 0.1
        full = np.zeros(500)
        for i, n, terms, tf in held:
            for t, c in zip(terms, tf, strict=True):
                if t in asked:
                    full[i] += idf[asked == t][0] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / 20.0))
        looked = []
        monkeypatch.setattr(search, "_ranges", lambda a, b: (looked.append((len(a), int((b - a).sum()))), ranges(a, b))[1])
        places, scores = search.top(shard, asked, idf, 7)
        cells += looked[0][1]  # terms in blocks: of all the shard, then of the blocks that are scored
        scored += sum(n for n, _ in looked[1:])
        wanted = sorted((x for x in full if x > 0), reverse=True)[:7]
        assert np.allclose(scores, wanted)
    assert scored < 0.9 * cells, (scored, cells)


def test_long_queries_share_matrices(monkeypatch):
    """Random shards of two languages: what many queries share with many documents is no posting's visit, and scores are those of full scoring."""
    rng, count, looked, shared = np.random.default_rng(5), np.bincount, 0, 0
    mean, k = 60.0, 7
    for at_least in (0.0, 0.9):
        held = []
        for i in range(1000):
            terms, tf = np.unique(rng.zipf(1.2, rng.integers(1, 300)).astype(np.uint64) % np.uint64(3000) + np.uint64(i % 2 * 2900), return_counts=True)
            held.append((3 * i, int(tf.sum()), terms, tf))
        kind = search.kinds(held)
        held = [held[i] for i in np.argsort(kind, kind="stable")]
        stored, cuts = search.postings(held), np.append(0, np.cumsum(count(kind, minlength=search.KINDS)))
        vocabulary = np.unique(np.concatenate([x[2] for x in held[::2]]))
        idf = rng.random(len(vocabulary)) + 0.1
        queries = [np.searchsorted(vocabulary, x[2]) for x in held[::2]]
        full = np.zeros((len(queries), len(held)))
        for d, (_, n, terms, tf) in enumerate(held):
            at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            weight = np.zeros(len(vocabulary))
            weight[at] = np.where(vocabulary[at] == terms, idf[at] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)), 0)
            for q, terms in enumerate(queries):
                full[q, d] = weight[terms].sum()
                shared += np.count_nonzero(weight[terms])
        wanted = [sorted((x for x in row if x > 0), reverse=True)[:k] for row in full]
        least = [at_least * x[-1] for x in wanted]
        visits = []
        monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: (visits.append(len(x) if weights is not None else 0), count(x, weights, minlength))[1])
        out = search.together(stored, cuts, mean, 1.2, 0.75, vocabulary, idf, queries, k, least)
        monkeypatch.setattr(np, "bincount", count)
        looked += sum(visits)
        for q, (places, scores) in enumerate(out):
            assert np.allclose(scores, full[q, places], rtol=1e-12)
            assert np.allclose(sorted(scores, reverse=True), wanted[q], rtol=1e-12)
        assert all(not len(x) for x, _ in search.together(stored, cuts, mean, 1.2, 0.75, vocabulary, idf, queries, k, [2 * x[0] for x in wanted]))
    assert looked < 0.5 * shared, (looked, shared)


def plain_base(rows, training):
    counts = Counter()
    for (i, t), teach in zip(rows, training, strict=True):
        if teach:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        out.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 4)))
    return out


def test_lm_base_scores(spark, sf_dir):
    for docs in (cases.frame(spark), cases.given(spark, sf_dir)[0]):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
        teach = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
        out = lm.score(docs, ~held, {"held_out": held}).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == Counter(plain_base(rows, teach))
        assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert lm.score(cases.frame(spark, []), F.lit(True), {}).count() == 0
    untaught = lm.score(cases.frame(spark), F.lit(False), {}).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in untaught)


def test_lm_beats_counts_on_held_out_texts(spark):
    out = [r for r in entry.op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_is_a_distribution():
    """Classes, and cells within a class, sum to one, and so do words' shares in a cell with one unseen word."""
    rng = np.random.default_rng(1)
    tokens, starts = rng.integers(0, 1 << 60, 50).astype(np.uint64), np.zeros(50, bool)
    one, two, f = lm.histories(tokens, starts, 0, 50, 13)
    for width, rows in ((lm.CLASSES, f), (lm.CELLS, lm.within(one, two, rng.integers(0, lm.CLASSES, 50), 13))):
        w, b = rng.normal(size=(1 << 13, width)).astype(np.float32), rng.normal(size=width).astype(np.float32)
        assert rows.max() < 1 << 13
        assert np.allclose(np.exp(lm.log_probabilities(w, b, rows)).sum(axis=1), 1, atol=1e-4)
    counts = np.array([5, 2, 1, 0])
    assert math.isclose(((counts + 1) / (counts.sum() + 3 + 1)).sum(), 1)


def test_lm_step_raises_the_likelihood():
    rng = np.random.default_rng(2)
    _, _, f = lm.histories(rng.integers(0, 50, 4000).astype(np.uint64), np.zeros(4000, bool), 0, 4000, 13)
    classes = f[:, 0] % lm.CLASSES
    w, b = np.zeros((1 << 13, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32)
    at = lambda: lm.log_probabilities(w, b, f)[np.arange(len(f)), classes].mean()
    before = at()
    for _ in range(20):
        b += 0.8 * lm.step(w, b, f, classes, 0.8)
    assert at() > before + 1


def test_lm_sums_of_stretches():
    rng = np.random.default_rng(5)
    sizes = rng.choice([1, 2, 3, 7, 8, 9, 30], 200)
    rows, starts = rng.normal(size=(sizes.sum(), 5)).astype(np.float32), np.cumsum(sizes) - sizes
    assert np.allclose(lm.sums_of(rows, starts, sizes), np.add.reduceat(rows, starts, axis=0), atol=1e-4)


def test_lm_tokens_and_histories():
    texts = ["A b  a\n", None, "", "É b", "\u00a0x \x1f y\t"]
    tokens, ends = lm._Words().of(pa.array(texts))
    wanted = [[*(t or "").encode().lower().split(), None] for t in texts]
    number = lm._Words()
    assert [number[w] if w is not None else int(lm._END) for t in wanted for w in t] == tokens.tolist()
    assert ends.tolist() == np.cumsum([len(t) for t in wanted]).tolist()
    starts = np.zeros(len(tokens), bool)
    starts[[0, *ends[:-1]]] = True
    for run in (1, 2, 3, len(tokens)):  # runs of any length see the same words before
        ones, twos = [], []
        for i in range(0, len(tokens), run):
            one, two, _ = lm.histories(tokens, starts, i, min(i + run, len(tokens)), 13)
            ones += one.tolist()
            twos += two.tolist()
        plain = [([int(lm._END)] * 2 + [number[w] if w is not None else int(lm._END) for w in t]) for t in wanted]
        assert ones == [x for t in plain for x in t[1:-1]] and twos == [x for t in plain for x in t[:-2]]


def test_lm_cells_learn_from_the_word_before():
    """Within a class of many words the history tells the cell: after a known word its follower gets likelier than its share."""
    rng = np.random.default_rng(3)
    words = [b"w%dzz" % i for i in range(400)]  # one spelling class
    number = lm._Words()
    follow = {w: words[(7 * i + 3) % 400] for i, w in enumerate(words)}
    texts = [" ".join(x.decode() for w in rng.choice(words, 20) for x in (w, follow[w])) for _ in range(400)]
    tokens, ends = number.of(pa.array(texts))
    head = lm.Head(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    zero = lambda width: np.zeros((1 << 13, width), np.float32)
    model = lm.Model(13, np.zeros(lm.CLASSES, np.float32), zero(lm.CLASSES), np.zeros((lm.CLASSES, lm.CELLS), np.float32), zero(lm.CELLS))
    for _ in range(5):
        lm.learn(model, head, tokens, ends, 512, lambda n: 0.8)
    inside = np.zeros((lm.CLASSES, lm.CELLS))
    at = np.arange(len(tokens))
    followers = np.concatenate([np.arange(s + 1, e - 1, 2) for s, e in zip([0, *ends[:-1]], ends)])
    model.weights[:], model.bias[:] = 0, 0  # the classes' part is left out
    logp = lm.log10_of(model, head, tokens, ends, inside, 512)[0] + np.log10(lm.CLASSES)
    assert logp[followers].mean() > logp[np.setdiff1d(at, [*followers, *(ends - 1)])].mean() + 0.3
