"""Documents to training mix, in five stages; each one's rows are written before the next reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typolith.llm import decontam, secrets
from typolith.llm.line_rules import clean_lines
from typolith.llm.mixing import mix
from typolith.llm.ngram_join import jaccard_classes
from typolith.llm.shared import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that the rules reject."""
    kept = clean_lines(docs).where("kept")
    return kept.withColumns({"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast("long")}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of links stays; of repeated rows, one."""
    named = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    first = jaccard_classes(named.select("_key", "text"), id_col="_key").where("_key = class_id").select("_key").distinct()
    left = named.join(first, "_key", "left_semi")
    one = F.row_number().over(W.partitionBy("_key").orderBy("source"))
    return left.withColumn("_n", one).where("_n = 1").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix(docs).select("doc_id", "lang", "source", "n_chars", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("mixing", source_mix),
]

#: SQL can't express the fingerprints and the Newton steps; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
