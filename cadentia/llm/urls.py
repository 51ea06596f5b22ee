"""URL filtering by hashed host-suffix and path-prefix expressions, in DataFrame operations.

Rules are stored as digests of ``host`` + ``path``. A URL expands to every
suffix of its host (on label borders) times every prefix of its path that a rule
could have; expressions meet rules in an equi-join on the first digits of the digest, the
full digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import join_hot, settle

#: Hex digits of the digest that the equi-join reads first.
PREFIX_DIGITS = 8
#: Rules up to here are broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_RULES = 50_000


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    after = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rows as a table of rules."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    A rule (verdict, host, path) fits its host and all subdomains if the URL's path
    starts with the rule's; the longest (host and path together) wins, the longer
    host on a tie, block before allow on equal rules. Without a rule, rule is null
    and the verdict is ``default``. A null URL, or one without ``://``, has empty host and path
    and no rule. Repeated URLs are expanded once; repeated rows give repeated rows;
    an empty table gives none; other columns (html) are not read. Rules with a
    null in host or path are dropped.
    """
    host, path = parse(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = (
        rules.where("verdict is not null and host is not null and path is not null and host <> ''")
        .select(
            F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("rule_verdict"),
            F.length("host").alias("host_length"),
            F.length("path").alias("path_length"),
            F.size(F.split("host", r"\.")).alias("labels"),
        )
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # how long a rule's path is and how many labels its host has: few values, so the suffixes and prefixes that can matter are few
    lengths = sorted(r[0] for r in known.select("path_length").distinct().collect())
    depths = sorted(r[0] for r in known.select("labels").distinct().collect())
    labels = F.split("host", r"\.")
    tails = F.transform(F.array(labels), lambda x: F.array_compact(F.array(*(F.when(F.size(x) >= n, F.array_join(F.slice(x, -n, n), ".")) for n in depths))))
    suffixes = tails[0] if depths else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    if lengths and known.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    hosted = parsed.where("host <> ''").withColumn("page", F.concat("host", F.lit("\n"), "path"))
    won = (
        hosted.select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
        .join(known, "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.col("host_length") + F.col("path_length"), "host_length", F.col("rule_verdict") == "block", "rule", "rule_verdict")).alias("best"))
        .select(F.concat("host", F.lit("\n"), "path").alias("page"), F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))
    )
    # rows without a host meet no rule, and rows of common pages stay where they are
    ruled = join_hot(hosted, settle(won), "page", how="left").select("page_id", "host", "path", "rule", "rule_verdict")
    rest = parsed.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"))
    return ruled.unionByName(rest).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
