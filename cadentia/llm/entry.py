"""The subpackage's registered queries: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm import langid, licenses, lm, mixing, neardup, oracles, packing, phrases, pii, quality, search, spelling, toxicity, urls
from cadentia.llm.common import documents, held_out

#: The rules that op2 applies, (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages, urls.rules_table(spark, URL_RULES))


def op3_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return search.search(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    return lm.score(documents(spark, sf_dir), ~out, {"held_out": out})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir), ["doc_id"]))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("probability")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(F.col("doc_id"), 3, 1)
    model = langid.train(docs, ~out)
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a copy as shard:position:words
    shown = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["position"].cast("string"), d["words"].cast("string"))), ",")
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", shown.alias("draws"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out)
    return toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": out})


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), threshold=100, top=2000)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.corpus_words(documents(spark, sf_dir), slips=199))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_url_filter": op2_url_filter,
    "op3_exact_search": op3_exact_search,
    "op4_license_scan": op4_license_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_pii": op6_pii,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_source_mixing": op10_source_mixing,
    "op11_toxicity": op11_toxicity,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = oracles.ORACLES
