"""A training corpus from raw documents: quality, repeated passages, near copies, mix, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Each works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.jaccard_join import one_of_each
from tablewright.llm.line_dedup import dedup_lines
from tablewright.llm.mixing import in_mixed_order
from tablewright.llm.packing import pack_documents
from tablewright.llm.quality import THRESHOLD, fit_quality, score_quality
from tablewright.llm.queries import word_tokenizer
from tablewright.session import cut_lineage, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go. Learns from the labels of documents still there."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, score_col="quality_score").where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line passages go from the texts; n_chars follows."""
    cleaned = dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixing schedule."""
    return in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences, in the mixed order."""
    return pack_documents(docs, word_tokenizer(), in_order=True)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Compressed sizes and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
