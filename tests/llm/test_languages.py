"""Rejection of texts in no language that was learned."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

POLISH = "każdy człowiek ma prawo do życia wolności i bezpieczeństwa swej osoby nikt nie może być torturowany lub karany w szczebrzeszynie chrząszcz brzmi w trzcinie"
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan"
RUSSIAN = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга"


def foreign():
    rng = random.Random(5)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(n)) for words in (POLISH.split(), FINNISH.split(), RUSSIAN.split(), noise) for n in (60, 120, 300)]


@pytest.mark.parametrize("languages", [["en"], ["de", "fr"], ["de", "en", "es", "fr"]])
def test_texts_in_unlearned_languages_go(spark, languages):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(languages)).select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign())], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(strange), "").select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    assert not {i for i in kept if i < 0}
    assert len(lettered - kept) <= 0.01 * len(lettered)


def test_a_learned_language_left_out_goes(spark):
    """Texts of the given languages themselves go where theirs was not learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") >= 500).select("doc_id", "text", "lang")
    docs = docs.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    kept = corpus_pipeline.identify_language(spark, docs, "").groupBy("was").count().collect()
    total = {r.was: r["count"] for r in docs.groupBy("was").count().collect()}
    kept = {r.was: r["count"] for r in kept}
    assert kept.get("fr", 0) <= 0.05 * total["fr"]
    assert all(kept[x] >= 0.98 * total[x] for x in ("en", "de", "es"))
