"""Toxicity: a learned lexicon, found through Levenshtein automata, weighed by the words around each hit.

Labelled rows teach which words, and which beginnings of several words, tell toxic texts from others. The
lexicon is a trie; one automaton accepts what lies within an entry's allowed edits (all Levenshtein automata,
run through the trie at once and made deterministic state by state, as words need it). A hit counts less inside
quotation marks or beside a reporting word, more beside a word of address or another hit. The sum is scaled to
the probability of label 1 by Platt's method.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import MEMO_WORDS, settle, slices, tidied

# Characters that part words ($, * and @ may stand for a letter), quotation marks, reporting words and words of address.
WORD = re.compile(r"[^\s\x00-\x23\x25-\x29\x2B-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7F“”„«»‘’…–—]+")
TOKEN = re.compile(WORD.pattern + r'|["“”„«»\n]')
REPORTING = frozenset("said says wrote called quoted word term sagte schrieb nannte zitat wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your du dich dir dein vous votre tu toi ton usted tú te".split())
#: Words on either side of a hit that make its context.
WINDOW = 6
#: A hit's factor for each edit, in a quotation or report, and with a word of address or another hit in its window.
EDITED, QUOTED, AIMED = 0.6, 0.2, 1.2
#: Code points of the beginnings that may become stems; distinct words that a stem must have.
STEMS, STEM_WORDS = (4, 5, 6, 7, 8), 3
#: Entries of the lexicon at most; a log-likelihood ratio (chance gives one form in a million as much), a share of toxic texts and a number of contexts that an entry reaches.
ENTRIES, RATIO, PURE, CONTEXTS = 2000, 24.0, 0.8, 3
#: Largest weight of an entry; states that an automaton keeps.
HEAVIEST, STATES = 6.0, 200_000
#: Code points of a text that are split at once.
_PIECE = 1 << 20


def allowed_edits(entry: str, stem: bool) -> int:
    """Edits within which an entry is found: none in short ones, two in words of nine code points and more."""
    if stem:
        return int(len(entry) >= 6)
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class _State:
    """Trie nodes that a word may have reached, with the fewest edits for each; what it accepts here, as (weight, edits)."""

    __slots__ = ("items", "next", "stem", "word")

    def __init__(self, items: dict[int, int], trie: Automaton):
        self.items, self.next = items, {}
        self.word = self.stem = (0.0, 0)
        for node, edits in items.items():
            for kind in ("word", "stem"):
                weight, allowed = getattr(trie, f"{kind}s").get(node, (0.0, -1))
                if edits <= allowed:
                    setattr(self, kind, max(getattr(self, kind), (weight * EDITED**edits, edits)))


class Automaton:
    """The Levenshtein automata of a lexicon's entries, intersected with its trie and determinised as far as words ask for it.

    words, stems: entry to weight. ``clean``: forms that are near an entry but known from clean texts.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], clean: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.reach = [0]  # the most edits that any entry below allows
        self.words: dict[int, tuple[float, int]] = {}
        self.stems: dict[int, tuple[float, int]] = {}
        self.clean = clean
        for entries, at, stem in ((words, self.words, False), (stems, self.stems, True)):
            for entry, weight in entries.items():
                allowed, node = allowed_edits(entry, stem), 0
                for c in entry:
                    self.reach[node] = max(self.reach[node], allowed)
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.reach.append(0)
                    node = self.children[node][c]
                self.reach[node] = max(self.reach[node], allowed)
                at[node] = (weight, allowed)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[frozenset, _State] = {}
        self.start = self._state({0: 0})

    def _state(self, items: dict[int, int]) -> _State:
        # left-out letters of an entry cost an edit each
        queue = deque(items.items())
        while queue:
            node, edits = queue.popleft()
            if edits > items[node]:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.reach[child] and items.get(child, 99) > edits + 1:
                    items[child] = edits + 1
                    queue.append((child, edits + 1))
        key = frozenset(items.items())
        if key not in self.known:
            self.known[key] = _State(items, self)
        return self.known[key]

    def _step(self, state: _State, c: str) -> _State:
        items: dict[int, int] = {}
        for node, edits in state.items.items():
            if edits < self.reach[node]:
                items[node] = min(items.get(node, 99), edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost <= self.reach[child] and cost < items.get(child, 99):
                    items[child] = cost
        state.next[c] = out = self._state(items)
        return out

    def weigh(self, word: str) -> tuple[float, int]:
        """The weight of the best entry that the word is, begins with, or is near to, and the edits; (0, 0) for none."""
        if len(self.known) > STATES:
            self._reset()
        state, best = self.start, (0.0, 0)
        for length, c in enumerate(word, 1):
            following = state.next.get(c)
            state = self._step(state, c) if following is None else following
            if not state.items:
                return best
            if state.stem > best and (not state.stem[1] or word[:length] + "*" not in self.clean):
                best = state.stem
        return state.word if state.word > best and (not state.word[1] or word not in self.clean) else best


class _Memo(dict):
    """Weights of words, remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[float, int]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        weight = self[word] = self.automaton.weigh(word)
        return weight


def words_of(text: str) -> set[str]:
    """A text's distinct words, lower-cased; split piece by piece, so a long text needs the memory of its distinct words."""
    out: set[str] = set()
    at = 0
    while at < len(text):
        gap = re.compile(r"\s").search(text, at + _PIECE)
        end = gap.end() if gap else len(text)
        out.update(WORD.findall(text[at:end].lower()))
        at = end
    return out


def context_score(text: str, found: dict[str, tuple[float, int]]) -> float:
    """The sum of a text's hits, each by its context: quotation marks up to the line's end, and words within WINDOW places."""
    total, quoted, place, last = 0.0, False, 0, -WINDOW - 1
    before: deque[str] = deque(maxlen=WINDOW)
    open_hits: list[list] = []  # place, weight, quoted, aimed: until the words after it are read

    def settled(hit) -> float:
        return hit[1] * (QUOTED if hit[2] else AIMED if hit[3] else 1.0)

    for match in TOKEN.finditer(text.lower()):
        token = match.group()
        if token == "\n":
            quoted = False
        elif token in '"“”„«»':
            quoted = not quoted
        else:
            place += 1
            while open_hits and open_hits[0][0] < place - WINDOW:
                total += settled(open_hits.pop(0))
            reported, address, hit = token in REPORTING, token in ADDRESS, found.get(token)
            for h in open_hits:
                h[2], h[3] = h[2] or reported, h[3] or address or hit is not None
            if hit is not None:
                near = last >= place - WINDOW
                open_hits.append([place, hit[0], quoted or not REPORTING.isdisjoint(before), near or not ADDRESS.isdisjoint(before)])
                last = place
            before.append(token)
    return total + sum(map(settled, open_hits))


@dataclass
class Model:
    """Lexicon, forms known as clean, and Platt's slope and offset for log(1 + sum)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = 0.0


def _summed(model: Model):
    """Rows with their text's sum of hits in its place."""

    def work(batches):
        memo = _Memo(Automaton(model.words, model.stems, model.clean))
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            sums = []
            for text in batch.column(at).to_pylist():
                found = {w: memo[w] for w in words_of(text or "") if memo[w][0]}
                sums.append(context_score(text, found) if found else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()) if i == at else c for i, c in enumerate(batch.columns)], names=[*batch.schema.names[:at], "hits", *batch.schema.names[at + 1 :]])

    return tidied(work)


def _forms(batches):
    """Counts of a task's words and beginnings: (form, toxic, clean) in texts, a beginning marked by a star, and distinct words below it."""
    counts: dict[str, list[int]] = {}
    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text or "")
            forms = {w for w in words if len(w) <= 40}
            for n in STEMS:
                forms.update(w[:n] + "*" for w in words if len(w) > n)
            for f in forms:
                counts.setdefault(f, [0, 0])[1 - toxic] += 1
        if len(counts) > MEMO_WORDS:
            yield _counted_forms(counts)
            counts = {}
    if counts:
        yield _counted_forms(counts)


def _counted_forms(counts):
    return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["form", "toxic", "clean"])


def _contexts(candidates: frozenset[str]):
    """(form, word, left) of candidates in toxic texts: the word that the form stands for, and the word before it."""

    def work(batches):
        for batch in slices(batches):
            seen = set()
            for text in batch.column(0).to_pylist():
                left = ""
                for match in WORD.finditer((text or "").lower()):
                    word = match.group()
                    for form in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                        if form in candidates:
                            seen.add((form, word[:40], left[:40]))
                    left = word
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["form", "word", "left"])

    return tidied(work)


def _ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Dunning's log-likelihood ratio of a form's two shares."""
    share = (toxic + clean) / float(n_toxic + n_clean)
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    return 2 * (part(toxic, share * n_toxic) + part(clean, share * n_clean) + part(n_toxic - toxic, (1 - share) * n_toxic) + part(n_clean - clean, (1 - share) * n_clean))


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature, by damped Newton steps with Platt's softened targets and a weak prior on the slope."""
    ones, zeros = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    theta = np.array([2.0, np.log((ones + 1) / (zeros + 1))])
    features = np.stack([x, np.ones(len(x))], 1)

    def loss(t):
        z = features @ t
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 0.05 * (t[0] - 2) ** 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -500, 500)))
        gradient = features.T @ (weight * (p - target)) + np.array([0.1 * (theta[0] - 2), 0])
        step = np.linalg.solve((features * (weight * p * (1 - p))[:, None]).T @ features + np.diag([0.1, 1e-6]), gradient)
        scale = 1.0
        while loss(theta - scale * step) > loss(theta) and scale > 1e-6:
            scale /= 2
        theta = theta - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = 10_000) -> Model:
    """Learn from rows of docs (doc_id, text) where ``learn`` holds and labels (doc_id, toxic) has 0 or 1.

    At most about ``max_rows`` rows of either label are drawn by a hash of the id; the classes' true shares weigh the calibration. Several
    labels of an id: the largest counts. Equal texts count once, a form in near copies by its distinct left neighbours.
    Without labels of both kinds the lexicon is empty and the score is the share of toxic rows (a half without any).
    """
    known = docs.select("doc_id").where(learn & F.col("doc_id").isNotNull()).distinct()
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).join(known, "doc_id")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 2) if toxic + clean else 0.5
        return Model(offset=float(np.log(share / (1 - share))))
    rate = F.when(F.col("toxic") == 1, max_rows / toxic).otherwise(max_rows / clean)
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    rows = settle(docs.select("doc_id", "text").where(learn).join(F.broadcast(drawn), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").dropDuplicates(["text", "toxic"]))
    counted = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = counted.get(1, 0), counted.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(offset=float(np.log(toxic / clean)))
    forms = settle(rows.mapInArrow(tidied(_forms), "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean > 1"))

    def chosen(table: DataFrame, limit: int) -> DataFrame:
        scored = table.withColumn("ratio", _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).withColumn("pure", (F.col("toxic") / n_toxic) / (F.col("toxic") / n_toxic + (F.col("clean") + 0.5) / n_clean))
        return scored.where((F.col("ratio") >= RATIO) & (F.col("pure") >= PURE)).orderBy(F.desc("ratio"), F.desc(F.length("form")), "form").limit(limit)

    candidates = chosen(forms, 10 * ENTRIES).collect()
    if not candidates:
        return Model(offset=float(np.log(toxic / clean)))
    spark = docs.sparkSession
    contexts = rows.where("toxic = 1").select("text").mapInArrow(_contexts(frozenset(r.form for r in candidates)), "form string, word string, left string").groupBy("form").agg(F.countDistinct("left").alias("lefts"), F.countDistinct("word").alias("below"))
    table = spark.createDataFrame([(r.form, r.toxic, r.clean) for r in candidates], "form string, toxic long, clean long")
    proven = table.join(contexts, "form").where(F.col("lefts") >= F.greatest(F.lit(float(CONTEXTS)), F.sqrt("toxic"))).select("form", F.least("toxic", "lefts").alias("toxic"), "clean", "below")
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for r in chosen(proven, ENTRIES).collect():
        stem = r.form.endswith("*")
        entry = r.form[:-1] if stem else r.form
        # the best of nested entries is enough
        if (stem and (r.below < STEM_WORDS or any(e.startswith(entry) for e in (*words, *stems)))) or any(entry[:n] in stems for n in STEMS if n <= len(entry)):
            continue
        weight = np.log((r.toxic + 0.5) / (n_toxic + 1)) - np.log((r.clean + 0.5) / (n_clean + 1))
        (stems if stem else words)[entry] = float(min(HEAVIEST, weight))
    model = Model(words, stems)
    model.clean = _known_clean(forms, model)
    sums = rows.mapInArrow(_summed(model), "hits double, toxic int").toPandas()
    y = sums.toxic.to_numpy(float)
    weight = np.where(y == 1, toxic / n_toxic, clean / n_clean)
    model.slope, model.offset = _platt(np.log1p(sums.hits.to_numpy()), y, weight * len(y) / weight.sum())
    return model


def _known_clean(forms: DataFrame, model: Model) -> frozenset[str]:
    """Forms near an entry that stand in clean texts more than in toxic ones: they are no misspellings."""
    words, stems = model.words, model.stems

    def work(batches):
        automaton = Automaton(words, stems)
        for batch in batches:
            out = []
            for form in batch.column(0).to_pylist():
                if form.endswith("*"):
                    state = automaton.start
                    for c in form[:-1]:
                        state = state.next.get(c) or automaton._step(state, c)
                    near = state.stem[1]
                else:
                    near = automaton.weigh(form)[1]
                if near:
                    out.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["form"])

    return frozenset(r.form for r in forms.where("clean >= toxic").select("form").mapInArrow(tidied(work), "form string").collect())


def score(docs: DataFrame, model: Model, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` of each row, and score (0 to 1) and predicted (1 from 0.5 on); a null text is an empty one."""
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "hits double"])
    summed = rows.mapInArrow(_summed(model), schema)
    likely = 1 / (1 + F.exp(-(model.slope * F.log1p("hits") + model.offset)))
    return summed.select(*keep, likely.alias("score"), (likely >= 0.5).cast("int").alias("predicted"))
