"""Finding and sanitising personal data, in DataFrame operations.

Patterns find the protected entities (email, ip, card, phone). Then
information theory finds the words that give an entity away: a term that stands in
enough contexts of an entity (the words around its places, equal ones counted once) is
weighed by how often it stands there and how often in the whole corpus, copies included in both,

    disclosure(t, e) = 1 - ln(n(t) / n(t, e)) / ln(T / (2 * WORDS * n(e)))

that is the pointwise mutual information of term and entity over the entity's own
information: 1 for a term that is found with the entity only, 0 for one that is found
there as often as anywhere. A term beyond the lower threshold is generalised, beyond
the upper one removed, wherever it stands in a text that holds its entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import settle, whole_rows

#: Kinds in their order of rank, and what stands for each in sanitised text.
KINDS = ("email", "ip", "card", "phone", "term")
MASKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
REMOVED = "[REMOVED]"
# Each finds what the plain pattern finds, leftmost first, in linear time: a run of its
# first class is tried from its start (or from the last match's end, \G), not from each character.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# whole chains of 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words on each side that make an entity's context.
WORDS = 8
TERM = r"[\p{L}\p{M}]{3,}"
# up to 64 runs of letters with what stands before them, or a tail without any; the pieces join without a gap and cut no run
PIECE = r"(?:[^\p{L}\p{M}]*+[\p{L}\p{M}]++){1,64}+|[^\p{L}\p{M}]++"
#: Candidate terms up to here are broadcast (about 100 bytes each) to count them in the corpus.
BROADCAST_TERMS = 50_000
#: Tasks over which an entity's documents are dealt where its terms aren't broadcast.
SALTS = 32
#: Numbers of an array that are summed in one run; code points of a text that are cut at once.
RUN, CHUNK = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each whole number of an array what the ones before it come to, 0 at first; in blocks, so that appending copies little."""
    ints = F.array().cast("array<int>")

    def scan(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), ints.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def whole(vs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / RUN).cast("int")), lambda k: F.slice(vs, k * RUN + 1, RUN))
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), join)), F.lit(0)), scan)))

    return bound(values, lambda vs: F.when(F.size(vs) > 0, whole(vs)).otherwise(ints))


def below(marks: Column, values: Column, equal: bool) -> Column:
    """For each of the marks, in order, how many values are below it (or equal); by one sort, not a search a mark."""
    at_mark, at_value = (1, 0) if equal else (0, 1)
    ends = F.transform(marks, lambda m, k: F.struct(m.alias("at"), F.lit(at_mark).alias("of"), k.alias("k")))
    starts = F.transform(values, lambda v: F.struct(v.alias("at"), F.lit(at_value).alias("of"), F.lit(0).alias("k")))
    placed = F.transform(F.array_sort(F.concat(ends, starts)), lambda x, i: F.struct(x["of"].alias("of"), x["k"].alias("k"), i.alias("i")))
    counted = F.transform(F.filter(placed, lambda x: x["of"] == at_mark), lambda x, j: F.struct(x["k"].alias("k"), (x["i"] - j).alias("n")))
    return F.transform(F.array_sort(counted), lambda x: x["n"])


def located(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, value), in code points, end exclusive."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda x: x["gap"] + F.length(x["value"])))
        start = lambda x, at: (at + x["gap"]).alias("start")
        return F.zip_with(found, before, lambda x, at: F.struct(start(x, at), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    return bound(zipped, placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    back = F.reverse(_digits(x))
    digit = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), F.length(back) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _octet(x: Column) -> Column:
    bare = F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """The pattern kinds' spans, array of (start, kind, end, value), sorted; empty for null."""
    phone_digits = lambda x: F.length(_digits(x)).between(10, 15)
    found = [
        F.when(text.contains("@"), located(text, EMAIL)),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), _octet))),
        F.when(text.rlike(CARD), F.filter(located(text, CARD), lambda s: _luhn(s["value"]))),
        F.when(text.contains("+"), F.filter(located(text, PHONE), lambda s: phone_digits(s["value"]))),
    ]
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of_kind(spans: Column, k: int) -> Column:
        return F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))), empty)

    return F.array_sort(F.concat(*(of_kind(spans, k) for k, spans in enumerate(found))))


def _terms(text: Column) -> Column:
    """All terms of a text: array of (start, end, term), in order, piece by piece so that long texts take linear time."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    moved = lambda at, piece: F.transform(located(piece, TERM), lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), F.lower(s["value"]).alias("term")))
    return bound(pieces, lambda ps: F.flatten(F.zip_with(running(F.transform(ps, lambda x: F.length(x))), ps, moved)))


def _words(text: Column, spans: Column) -> Column:
    """All terms of a text, each with how many base spans it shares a character with."""

    def told(terms: Column) -> Column:
        begun = below(F.transform(terms, lambda t: t["end"]), F.transform(spans, lambda s: s["start"]), equal=False)
        ended = below(F.transform(terms, lambda t: t["start"]), F.transform(spans, lambda s: s["end"]), equal=True)
        inside = F.zip_with(begun, ended, lambda x, y: x - y)
        return F.zip_with(terms, inside, lambda t, n: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["term"].alias("term"), n.alias("inside")))

    return bound(_terms(text), told)


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (doc, text) with base, the base spans, and near, for each of them the entity and the WORDS terms on each side outside of spans."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<struct<start:int,end:int,term:string,inside:int>>")
    rows = rows.withColumn("words", F.when(F.size("base") > 0, _words(F.col("text"), F.col("base"))).otherwise(none))

    def context(words: Column, side: Column) -> Column:
        at = lambda d: F.when(d < 0, side["left"] + d).otherwise(side["right"] + d)
        terms = F.filter(F.transform(F.array(*map(F.lit, range(-WORDS, WORDS))), lambda d: F.get(words, at(d))), lambda t: t["inside"] == 0)
        return F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["term"].alias("term")))

    def beside(words: Column) -> Column:
        ranks = lambda edge: below(F.transform("base", lambda s: s[edge]), F.transform(words, lambda t: t["start"]), equal=False)
        sides = F.zip_with(ranks("start"), ranks("end"), lambda left, right: F.struct(left.alias("left"), right.alias("right")))
        return F.zip_with("base", sides, lambda s, side: F.struct(F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])).alias("entity"), context(words, side).alias("terms")))

    return rows.withColumn("near", bound(F.col("words"), beside)).drop("words")


def disclosing(docs: DataFrame, marked: DataFrame, least_contexts: int, generalise: float) -> DataFrame:
    """(entity, term, disclosure) for terms that tell at least ``generalise`` of an entity in ``least_contexts`` distinct contexts or more."""
    spark = docs.sparkSession
    places = marked.select(F.explode("near").alias("n")).select("n.entity", F.array_distinct(F.transform("n.terms", lambda t: t["term"])).alias("terms"))
    contexts = places.withColumn("digest", F.xxhash64("terms")).dropDuplicates(["entity", "digest"])
    seen = contexts.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= least_contexts)
    proven = (
        contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_c"))
        .where(F.col("n_c") >= least_contexts).join(seen.select("entity"), "entity").select("entity", "term")
    )
    # counts are of places, copies included, as the corpus counts are; a place near two mentions counts once
    beside = F.array_distinct(F.flatten(F.transform("near", lambda n: F.transform(n["terms"], lambda t: F.struct(n["entity"].alias("entity"), t["term"].alias("term"), t["start"].alias("start"))))))
    near = marked.select(F.explode(beside).alias("b")).groupBy("b.entity", "b.term").agg(F.count("*").alias("n_te"))
    mentions = places.groupBy("entity").agg(F.count("*").alias("n_e"))
    together = settle(proven.join(near, ["entity", "term"]).join(mentions, "entity"))
    wanted = together.select("term").distinct()
    n_terms = wanted.count()
    if not n_terms:
        return spark.createDataFrame([], "entity string, term string, disclosure double")
    if n_terms <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    text = F.lower("text")
    counts = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(TERM))), F.lit(0))).first()[0]
    bits = F.log(F.greatest(total / (2.0 * WORDS * F.col("n_e")), F.lit(1.0000001)))
    told = 1 - F.log(F.greatest(F.col("n_t") / F.col("n_te"), F.lit(1.0))) / bits
    return together.join(counts, "term").withColumn("disclosure", told).where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def spans_of(rows: DataFrame, least_contexts: int = 3, generalise: float = 0.8, remove: float = 0.95, text: bool = False) -> DataFrame:
    """Rows (doc, text) as (doc, spans): doc as it is, any struct, and an array of (start, kind, end, removed), sorted, kinds as ranks in KINDS.

    Base spans and disclosing terms; with ``text`` also sanitised, the text with its
    spans masked (null stays null). A null or empty text has no spans; whole texts count;
    overlapping spans are all listed and masked as one; repeated rows give repeated rows; an empty table
    gives none.
    """
    marked = _marked(rows)
    # only rows with spans are settled with their texts; those without are read again where their texts are wanted
    slim = settle((marked.where(F.size("base") > 0) if text else marked).withColumn("row", F.monotonically_increasing_id()).withColumn("text", F.when(F.size("base") > 0, F.col("text"))))
    told = settle(disclosing(rows, slim, least_contexts, generalise))
    # what discloses an entity is masked wherever it stands in the texts that hold the entity
    held = slim.select("row", F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"]))).alias("entity"))
    if told.count() <= BROADCAST_TERMS:
        pairs = held.join(F.broadcast(told), "entity")
    else:  # an entity of many documents is dealt over SALTS tasks
        spread = told.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        pairs = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["entity", "salt"])
    wanted = settle(pairs.groupBy("row", "term").agg((F.max("disclosure") >= remove).alias("removed")))
    words = slim.join(wanted.select("row").distinct(), "row", "left_semi").select("row", F.explode(F.filter(_words(F.col("text"), F.col("base")), lambda t: t["inside"] == 0)).alias("t"))
    hits = (
        words.select("row", "t.term", "t.start", "t.end").join(wanted, ["row", "term"])
        .groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "removed")).alias("terms"))  # at most the words of one text
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("removed")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,removed:boolean>>")
    found = slim.where(F.size("base") > 0).join(hits, "row", "left").withColumn("spans", F.array_sort(F.concat(plain, F.coalesce("terms", empty))))
    if not text:
        return found.select("doc", "spans").unionByName(slim.where(F.size("base") == 0).select("doc", empty.alias("spans")))
    rest = rows.where(F.size(base_spans(F.coalesce("text", F.lit("")))) == 0)
    found = found.select("doc", "spans", masked(F.col("text"), F.col("spans")).alias("sanitised"))
    return found.unionByName(rest.select("doc", empty.alias("spans"), F.col("text").alias("sanitised")))


def find(docs: DataFrame, keep: list[str], least_contexts: int = 3, generalise: float = 0.8, remove: float = 0.95, text: bool = False) -> DataFrame:
    """The columns ``keep`` with spans, and sanitised with ``text``, as spans_of has them; ``keep`` names neither."""
    found = spans_of(docs.select(F.struct(*keep).alias("doc"), "text"), least_contexts, generalise, remove, text)
    return found.select(*(F.col("doc").getField(c).alias(c) for c in keep), "spans", *(["sanitised"] if text else []))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs with texts masked, all other columns as they are."""
    found = spans_of(whole_rows(docs).withColumn("text", F.col("doc.text")), text=True, **options)
    return found.select(*(F.col("sanitised").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def masked(text: Column, spans: Column) -> Column:
    """The text with its sorted spans masked; what overlaps goes under the first one's mask.

    The text is cut into chunks once; what lies between two masks is put together from its chunks.
    """
    mask = lambda s: F.when(s["removed"], F.lit(REMOVED)).otherwise(F.element_at(F.array(*map(F.lit, MASKS)), s["kind"] + 1))

    def between(chunks: Column, first: Column, last: Column) -> Column:
        a, b = F.floor(first / CHUNK).cast("int"), F.floor((last - 1) / CHUNK).cast("int")
        of = lambda i: F.get(chunks, i)
        apart = F.concat(F.substring(of(a), first - a * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(of(b), F.lit(1), last - b * CHUNK))
        return F.when(last <= first, F.lit("")).when(a == b, F.substring(of(a), first - a * CHUNK + 1, last - first)).otherwise(apart)

    def joined(chunks: Column) -> Column:
        done = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        parts = F.zip_with(spans, done, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(between(chunks, at, s["start"]), mask(s))))
        rest = between(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(chunks, joined)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans as text."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
