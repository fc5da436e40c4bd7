"""The corpus pipeline: quality, repeated lines, near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of `documents`; the last returns
the packed pieces.  n_chars follows the text when a stage rewrites it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_dir, table
from tallyloom.llm.decontaminate import contamination, is_contaminated
from tallyloom.llm.line_dedup import dedup_lines
from tallyloom.llm.ngram_join import similar_components
from tallyloom.llm.packing import pack, word_tokens
from tallyloom.llm.quality import classify, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier neither finds toxic nor of low quality; a null id is judged like any other."""
    verdict = classify(docs, fit(docs, table(spark, sf_dir, "labels"))).where("keep").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds; one that loses every line stays, empty."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates, and every document without words or id."""
    groups = similar_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages beyond the contamination rule."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in token-budget batches."""
    return pack(docs, word_tokens(F.col("text")))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("packed", packed)]

#: Training a classifier and optimising bucket bounds are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`, writing each stage's documents to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
