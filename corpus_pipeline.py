"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, so a stage works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from termweave.llm.common import stage, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled ones of
    ``docs`` whose crc32 mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").cast("long").alias("__d")).distinct()
    labelled = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__d"), "left_semi")
    model = quality.fit(stage(quality.features(labelled), "pipeline-features"), labels)
    return quality.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, freed of repeated runs of lines; ``n_chars`` follows the text."""
    done = line_dedup.dedup_runs(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, taken
    and the text, to be repeated as often as taken / size says."""
    return mixing.mix(docs, carry=True).where("taken > 0")


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: The quality scores and the near copies can't be told in SQL; a brute-force version in
#: tests/llm/test_pipeline.py stands in its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
