"""The corpus pipeline: five stages over documents, each on all that the one before it kept; the last gives words to take, not texts.

1. toxicity: documents that the toxicity model rejects go.
2. near duplicates: of each group by five-word shingles and similarity 0.8, the document of least id stays.
3. repeats: bytes under strings of 200 bytes that start more than once are cut out of the texts.
4. contamination: documents into which a benchmark item is leaked go.
5. mixing: words to take of each document so that sources come to their target weights.

run() writes each stage's rows as Parquet into the shared folder and reads them again, so a lost executor never costs more than
one stage; the rows of the stage before are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, ngram_join, suffix_dedup, toxicity
from tidemark.llm.common import removed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learnt(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("mixing", mix),
]

#: SQL cannot express the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            removed(last)
        last = docs
    return docs
