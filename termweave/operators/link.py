"""Linking mentions to codes: diagnoses to a code tree, drugs to a term list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import search
from termweave.operators.expand import expand, weighted_queries
from termweave.operators.tree import PruneConfig, prune, search_documents, tree_paths
from termweave.schema import DIAGNOSIS, DRUG
from termweave.sources.scratch import stage


@dataclass(frozen=True)
class LinkConfig:
    top_k: int = 5
    margin: float = 0.15
    least_score: float = 0.1
    most_candidates: int = 3
    drug_gate: float = 0.3
    diagnosis_gate: float = 0.0
    bm25: bool = True
    strict_rules: bool = False
    prune: PruneConfig | None = field(default_factory=PruneConfig)


@dataclass
class Knowledge:
    """``nodes`` (code, name, parent_code, level, aliases), ``concepts`` (rxcui, name, tty,
    synonyms), and optionally embeddings of the nodes with a function that adds
    ``embedding`` to (query_id, text). ``cache`` (key, expansion) has earlier replies of the
    query expander, ``model`` answers others, which are appended to the table ``keep``."""

    nodes: DataFrame
    concepts: DataFrame
    vectors: DataFrame | None = None
    encode: object | None = None
    cache: DataFrame | None = None
    model: object | None = None
    keep: str | None = None

    def __post_init__(self) -> None:
        # read by several branches of a plan
        self.documents = stage(search_documents(self.nodes), "link-documents")
        self.paths = stage(tree_paths(self.nodes), "link-paths")
        self.index = search.Bm25Index.build(self.documents)


def link_diagnoses(mentions: DataFrame, knowledge: Knowledge, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(query_id, candidates, best) of mentions (query_id, text) that have candidates."""
    # a row for each distinct mention, read by five branches: written, so that their plans are
    # short and the model is asked once
    expanded = stage(expand(mentions, knowledge.cache, knowledge.model, config.strict_rules, knowledge.keep), "link-expanded")
    asked = weighted_queries(expanded).withColumn("v_id", F.concat_ws("#", "query_id", "q_ord"))
    variants = asked.select(F.col("v_id").alias("query_id"), F.col("q_text").alias("text"))
    found = stage(search.sparse_search(variants, knowledge.documents, config.top_k, config.bm25, index=knowledge.index), "link-found")
    if knowledge.vectors is not None and knowledge.encode is not None:
        dense = search.vector_search(knowledge.encode(variants), knowledge.vectors, config.top_k)
        found = search.ensemble(found, dense.join(knowledge.documents.select("id", "text"), "id").select(*found.columns))
    else:
        # the same search stands in for the missing vectors
        found = search.ensemble(found, found.withColumn("source", F.lit("dense")))
    weights = asked.select("v_id", F.col("query_id").alias("__q"), "q_ord", "q_weight")
    of_mention = found.join(weights, F.col("query_id") == F.col("v_id")).drop("query_id").withColumnRenamed("__q", "query_id")
    merged = search.merge_variants(of_mention)
    sure = expanded.select("query_id", (F.col("expansion.confidence") == "high").alias("__sure"))
    both = merged.join(sure, "query_id")
    guarded = both.where("__sure").drop("__sure").unionByName(search.token_guard(both.where("NOT __sure").drop("__sure"), expanded.select("query_id", "text")))
    anchored = search.must_have(guarded, expanded.select("query_id", "expansion.must_have"))
    kept = search.dynamic_threshold(anchored, config.margin, config.least_score, config.most_candidates)
    kept = stage(kept, "link-kept")
    best = kept.groupBy("query_id").agg(F.max("best").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
    if config.prune is None:
        return best.select("query_id", F.transform("c", lambda x: x["id"]).alias("candidates"), "best")
    pruned = prune(kept.select("query_id", F.col("rank").alias("ord"), F.col("id").alias("code"), "score"), knowledge.paths, config.prune)
    listed = pruned.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code"))).alias("p"))
    none = F.array().cast("array<string>")
    return best.join(listed, "query_id", "left").select("query_id", F.coalesce(F.transform("p", lambda x: x["code"]), none).alias("candidates"), "best")


def link_drugs(mentions: DataFrame, concepts: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(query_id, candidates, best) of mentions (query_id, text) that have candidates."""
    found = search.term_search(mentions, concepts, config.top_k)
    kept = search.dynamic_threshold(found, config.margin, config.least_score, config.most_candidates)
    listed = kept.groupBy("query_id").agg(F.max("best").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("c"))
    return listed.select("query_id", F.transform("c", lambda x: x["id"]).alias("candidates"), "best")


def link_entities(entities: DataFrame, knowledge: Knowledge, config: LinkConfig = LinkConfig()) -> DataFrame:
    """``entities`` with ``candidates`` filled: each distinct (type, text) is linked once.
    Drugs (and diagnoses, if their gate is above 0) whose best score is under the gate are
    dropped; other types have no candidates."""
    coded = entities.where(F.col("type").isin(DIAGNOSIS, DRUG)).select("type", "text").distinct()
    coded = stage(coded, "link-mentions")
    mentions = coded.withColumn("query_id", F.col("text"))
    linked = link_diagnoses(mentions.where(F.col("type") == DIAGNOSIS).select("query_id", "text"), knowledge, config).withColumn("__type", F.lit(DIAGNOSIS))
    drugs = link_drugs(mentions.where(F.col("type") == DRUG).select("query_id", "text"), knowledge.concepts, config).withColumn("__type", F.lit(DRUG))
    found = linked.unionByName(drugs).select("__type", F.col("query_id").alias("__text"), F.col("candidates").alias("__c"), "best")
    both = entities.join(found, (F.col("type") == F.col("__type")) & (F.col("text") == F.col("__text")), "left")
    best = F.coalesce("best", F.lit(0.0))
    gate = F.when(F.col("type") == DRUG, F.lit(config.drug_gate)).when(F.col("type") == DIAGNOSIS, F.lit(config.diagnosis_gate)).otherwise(0.0)
    none = F.array().cast("array<string>")
    return both.where((gate <= 0) | (best >= gate)).withColumn("candidates", F.coalesce("__c", none)).select(*entities.columns)
