"""Spelling variants: words that one edit separates, and the frequent form that each stands for.

The join is one of asymmetric q-chunks. Of two words at one edit's distance the shorter one gives
two disjoint chunks, its halves; the edit leaves one of them whole, so the longer word has it as a
gram at the same place or one further on. Words give their chunks and the positional grams that can
meet a chunk within that shift; equal keys are candidates, an exact edit distance decides. A bucket
with too many words is not paired: what its words share is settled, so the chunks of the part that
is still open are halved again, until the bucket is small or all but one code point is shared. Then
the words of a bucket differ in that place alone, and their number is bounded by the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import hot_keys, settle

#: Code points that a run of letters is made of (fixed values).
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bucket with more words than this on either side has its chunks halved again.
BUCKET = 64


def corpus_words(docs: DataFrame, slips: int | None = None, shortest: int = 6, least: int = 5) -> DataFrame:
    """The distinct words of whole texts (word, n): runs of letters, A-Z lower-cased, of ``shortest`` code points and ``least`` occurrences or more.

    With ``slips`` a run loses a code point where crc32 of ``doc_id:run`` is divisible by it, at the place of the crc modulo
    the run's length. A null text has no runs; a null id deletes nothing; copies of rows count.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), run.alias("run"))
    word = F.col("run")
    if slips:
        crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (crc % F.length("run")).cast("int")
        word = F.when(crc % slips == 0, F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _sides(words: DataFrame) -> DataFrame:
    """Each word as the shorter one (gram false), and as the longer or equal one of words of its length and of one less.

    size: the open code points of the shorter word; start, open: where the word's own open part lies.
    """
    length = F.length("word")
    side = lambda gram, size: F.struct(F.lit(gram).alias("gram"), size.alias("size"))
    sides = F.explode(F.array(side(False, length), side(True, length), side(True, length - 1)))
    rows = words.select("word", sides.alias("side")).select("word", "side.*").where("size > 0")
    return rows.withColumns({"key": F.col("size").cast("long"), "start": F.lit(1), "open": F.length("word")})


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first and with the second half of its open part in the key, and the other half open."""
    first = F.floor(F.col("size") / 2).cast("int")
    second = F.col("size") - first

    def half(which: int, begin: Column, length: Column, start: Column, size: Column) -> Column:
        key = F.xxhash64("key", F.lit(which), F.substring("word", begin, length))
        return F.struct(key.alias("key"), size.alias("size"), start.alias("start"), (F.col("open") - length).alias("open"))

    front = half(0, F.col("start"), first, F.col("start") + first, second)
    back = half(1, F.col("start") + F.col("open") - second, second, F.col("start"), first)
    return rows.select("word", "gram", F.explode(F.array(front, back)).alias("half")).select("word", "gram", "half.*")


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct words that exactly one inserted, deleted or replaced code point separates, each pair once.

    words: rows (word), distinct and not null. Every pair is found, whatever the sizes of the buckets.
    """
    rows, found = _sides(words), None
    while True:
        rows = settle(_halved(rows))
        spark = rows.sparkSession
        hot = spark.createDataFrame([(k,) for k in hot_keys(rows, "key")], "key long")
        light = rows.join(F.broadcast(hot), "key", "left_anti")
        sides = light.groupBy("key").agg(F.count_if(~F.col("gram")).alias("n_short"), F.count_if("gram").alias("n_long")).where("n_short > 0 AND n_long > 0")
        small = (F.greatest("n_short", "n_long") <= bucket)
        # what one more half cannot part is paired as it is: its size is the alphabet's
        last = rows.join(F.broadcast(hot), "key", "left_semi").where("size < 2").unionByName(light.where("size < 2")).alias("x")
        cold = light.where("size > 1").join(sides.where(small).select("key"), "key")
        pairs = [_verified(cold), _verified(last.select("x.*"))]
        for p in pairs:
            found = p if found is None else found.unionByName(p)
        dense = light.where("size > 1").join(sides.where(~small).select("key"), "key", "left_semi")
        rows = rows.where("size > 1").join(F.broadcast(hot), "key", "left_semi").unionByName(dense)
        rows = settle(rows)
        if rows.isEmpty():
            return found.distinct()


def _verified(rows: DataFrame) -> DataFrame:
    short = rows.where(~F.col("gram")).select("key", F.col("word").alias("a"))
    long = rows.where("gram").select("key", F.col("word").alias("b"))
    joined = short.join(long, "key").where("a <> b AND (length(a) < length(b) OR a < b)")
    return joined.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def variants(words: DataFrame, times: int = 5, bucket: int = BUCKET) -> DataFrame:
    """Per word (word, n): form, root, n_near and form_n.

    A word's form is its near word of largest n (ties: the smallest), if that n is at least ``times`` the word's; its root is
    where forms lead in the end, itself without a form. ``times`` of 2 or more makes forms grow, so chains end. n and n_near are
    counts; a word without near words has n_near 0, form and form_n null.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their variants: times is 2 at least")
    words = settle(words.select("word", "n"))
    pairs = settle(near_pairs(words.select("word"), bucket))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    ranked = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    formed = F.col("near_n") >= times * F.col("n")
    rows = settle(rows.select("word", F.when(formed, F.col("near")).alias("form"), "n", "n_near", F.when(formed, F.col("near_n")).alias("form_n")))
    return rows.join(_roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: steps doubled until all have arrived, so rounds are the logarithm of a chain."""
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links
