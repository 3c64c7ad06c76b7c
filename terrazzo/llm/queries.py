"""The corpus operators as registered queries over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, knn_quality, langid, maxent_lm, media, packing, probminhash, quality_rules, spelling, suffix_dedup, tiers, url_filter
from .columns import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn_references(docs), keep=["doc_id"])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 5) == 0
    dictionaries = langid.fit(docs, ~held_out)
    return langid.identify(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), dictionaries, keep=["doc_id", "held_out"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = knn_quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return knn_quality.score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, keep=["doc_id", "held_out"])


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 7) == 2, F.lit(False))
    return maxent_lm.score(docs.withColumn("held_out", held_out), "held_out")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"])


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), keep=["page_id"])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_quality_rules, op3_best_fit_packing, op4_language_id, op5_suffix_dedup, op6_media, op7_quality_classifier, op8_maxent_lm, op9_byte_bpe, op10_url_filter, op11_spelling_variants, op12_collocations, op13_tiered_packing)}
ORACLES = {"op10_url_filter": url_filter.ORACLE, "op12_collocations": collocations.ORACLE}
