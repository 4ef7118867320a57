"""The corpus pipeline: each stage reads what the one before it wrote.

Languages, near duplicates, repeated passages, benchmark passages, packing. All stages but the last
return the columns of documents, whatever other columns there are. Rows may repeat, ids be null and
texts be null or empty; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funclab.llm import decontamination, jaccard_join, language, packing, queries, suffix_dedup
from funclab.llm.common import free_name, read_table, scratch_path

def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows; null texts and those without a letter go.

    A text that is likely in several languages is kept: a doubtful guess is no reason to lose it.
    """
    model = language.LanguageModel.train(docs.filter(~language.held_out()))
    found = free_name("language", docs)
    seen = model.predict(docs, names=(found, free_name("share", docs)))
    return seen.filter(F.col(found) != "und").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take strings of 400 bytes that stand more than once out of the texts."""
    out = suffix_dedup.remove(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth stands in benchmark items."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in windows of 4,096."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language", identify_languages),
    ("near duplicates", join_near_duplicates),
    ("repeats", remove_repeats),
    ("benchmarks", remove_benchmarks),
    ("packing", pack_windows),
]
# Tokenisers and trained models have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written and read again."""
    docs, where = read_table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{where}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{where}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
