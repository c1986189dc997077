"""A smoke report on loaded terminology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.link import Knowledge, LinkConfig, link_diagnoses, link_drugs

DIAGNOSES = ["Type 2 diabetes mellitus", "tả", "viêm mô tế bào", "tăng huyết áp", "Gastro-esophageal reflux disease"]
DRUGS = ["aspirin 81 mg", "ASA", "paracetamol", "metformin 500 mg"]


def smoke_report(knowledge: Knowledge, config: LinkConfig = LinkConfig(), diagnoses: list[str] = DIAGNOSES, drugs: list[str] = DRUGS) -> DataFrame:
    """(kind, query, candidates) of fixed queries, and the sizes of the tables."""
    spark = knowledge.nodes.sparkSession

    def asked(texts: list[str]) -> DataFrame:
        return spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")

    none = F.array().cast("array<string>")
    parts = []
    for kind, texts, found in (("diagnosis", diagnoses, link_diagnoses(asked(diagnoses), knowledge, config)), ("drug", drugs, link_drugs(asked(drugs), knowledge.concepts, config))):
        both = asked(texts).join(found, "query_id", "left")
        parts.append(both.select(F.lit(kind).alias("kind"), F.col("query_id").alias("query"), F.coalesce("candidates", none).alias("candidates")))
    for kind, table in (("nodes", knowledge.nodes), ("concepts", knowledge.concepts)):
        parts.append(table.agg(F.count(F.lit(1)).cast("string").alias("query")).select(F.lit(kind).alias("kind"), "query", none.alias("candidates")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
