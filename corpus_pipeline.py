"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents. An empty table goes through all stages. Further columns stay as they are, but for
those named ``rejected`` or ``kept``, which come back as the verdicts that let a row stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import langid, packing, probminhash, quality_rules, suffix_dedup
from terrazzo.llm.columns import bucket_of
from terrazzo.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a clear language, go."""
    dictionaries = langid.fit(docs, F.coalesce(bucket_of(F.col("doc_id"), 5) != 0, F.lit(False)))
    return langid.identify(docs, dictionaries).filter(~F.col("rejected")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or diverge from every language reference go."""
    return quality_rules.judge(docs, quality_rules.learn_references(docs)).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return probminhash.first_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before are cut from the texts; the documents stay."""
    cut = suffix_dedup.remove_repeats(docs, keep=docs.columns, cut_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language id", language_id), ("quality rules", quality), ("near dedup", near_dedup), ("suffix dedup", repeats), ("packing", pack)]
#: Compression, signatures and packing have no SQL form: tests/llm hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
