"""Near-duplicates against all pairs, and the sketches on their own."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from cadentia.llm import neardup
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, k, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        classes[s if s else (i,)].append(i)
    parent = {c: c for c in classes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    of = defaultdict(list)
    for s in classes:
        if isinstance(s, frozenset):
            for x in s:
                of[x].append(s)
    for s in classes:
        if isinstance(s, frozenset):
            for other, both in Counter(o for x in s for o in of[x] if o is not s).items():
                if 100 * both >= percent * (len(s) + len(other) - both):
                    parent[root(s)] = root(other)
    groups = defaultdict(list)
    for c, members in classes.items():
        groups[root(c)] += members
    out = []
    for members in groups.values():
        low = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), low, rows[i][0] == low) for i in members]
    return Counter(out)


def same(docs, k=3, percent=85):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = neardup.near_duplicates(docs, k, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == plain(rows, k, percent)
    groups = Counter((r.component_id, r.key if r.component_id is None else 0) for r in found if r.chosen)
    assert all(n == 1 for (c, _), n in groups.items() if c is not None)


def test_awkward_rows(spark):
    same(cases.frame(spark))
    same(cases.frame(spark), 5, 80)
    assert neardup.near_duplicates(cases.frame(spark, [])).count() == 0


def test_given_rows(spark):
    same(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_chains_and_groups_of_near_copies(spark):
    """Copies that differ near the threshold, so that leaders alone don't connect them."""
    rng = random.Random(5)
    rows, i = [], 0
    for group in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        for _ in range(60):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
            if group % 2:
                words = copy  # a chain drifts away from its start
            rows.append((i, " ".join(copy), *[None] * 8))
            i += 1
    same(cases.frame(spark, rows))


def test_many_partitions_take_few_tasks(spark):
    """With many shuffle partitions that nothing joins, later passes don't take a task and its files for each, let alone for each side of their unions."""
    rng = random.Random(6)
    rows = []
    for group in range(3):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
        for _ in range(40):
            words = list(words)
            words[rng.randrange(150)] = words[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words), *[None] * 8))
    docs, context = cases.frame(spark, rows), spark.sparkContext
    conf = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        context.setJobGroup("near", "near-duplicates")
        same(docs)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    told = context.statusTracker()
    stages = {x for job in told.getJobIdsForGroup("near") for x in told.getJobInfo(job).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)
    assert tasks < 31 * 125  # 2571 of 6333 before, on 8 cores


def test_odd_sketch_tells_similarity():
    rng = np.random.default_rng(2)
    far = neardup.most_odd_bits(0.85)
    close = apart = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 850).astype(np.uint64)
        for extra, near in ((75, True), (850, False)):
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, extra).astype(np.uint64)])) for _ in range(2))
            x, y = (np.frombuffer(neardup.odd_sketch(neardup.signature(s)), np.uint8) for s in (a, b))
            passed = np.bitwise_count(x ^ y).sum() <= far
            close += near and passed
            apart += not near and passed
    assert close == 200 and apart == 0
