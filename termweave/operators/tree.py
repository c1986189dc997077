"""A code hierarchy: paths from the root, checks, pruning of candidates by tree distance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.scores import tree_distance, wu_palmer
from termweave.sources.scratch import stage, unstage

ROOT = "ROOT"
#: Levels of a code system; a deeper tree is refused rather than cut.
MOST_LEVELS = 60


def tree_paths(nodes: DataFrame, root: str = ROOT) -> DataFrame:
    """(code, path, depth) of the nodes that the root reaches; ``path`` runs from the root.
    Levels are joined and written one after another, so their size has no bound."""
    edges = stage(nodes.select(F.col("code").alias("below"), F.col("parent_code").alias("above")), "tree-edges")
    level = stage(edges.where(F.col("below") == root).select(F.col("below").alias("code"), F.array("below").alias("path")), "tree-level")
    levels = []
    while not level.isEmpty():
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"a tree of more than {MOST_LEVELS} levels")
        levels.append(level)
        deeper = level.join(edges, F.col("above") == F.col("code")).where(~F.array_contains("path", F.col("below")))
        level = stage(deeper.select(F.col("below").alias("code"), F.array_append("path", F.col("below")).alias("path")), "tree-level")
    unstage(edges)
    return reduce(DataFrame.unionByName, levels or [level]).withColumn("depth", F.size("path") - 1)


def tree_check(nodes: DataFrame, root: str = ROOT) -> DataFrame:
    """One row: nodes, edges, max_depth, whether each condition of a rooted tree holds, and
    ``is_tree``. Parents without a row of their own count as nodes."""
    edges = nodes.where("parent_code IS NOT NULL AND parent_code <> ''").select("parent_code", "code").distinct()
    codes = nodes.select("code").union(edges.select("parent_code")).distinct()
    known = codes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum((F.col("code") == root).cast("int")), F.lit(0)).alias("roots"))
    parents = edges.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.max("n"), F.lit(0)).alias("most_parents"))
    reached = tree_paths(nodes, root).agg(F.count_distinct("code").alias("reached"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    one = known.join(parents).join(reached)  # three single rows
    tree = (F.col("roots") == 1) & (F.col("most_parents") <= 1) & (F.col("reached") == F.col("nodes")) & (F.col("edges") == F.col("nodes") - 1)
    return one.select(*[F.col(c).cast("long").alias(c) for c in ("nodes", "edges", "roots", "most_parents", "reached", "max_depth")], tree.alias("is_tree"))


def search_documents(nodes: DataFrame, root: str = ROOT) -> DataFrame:
    """(id, text, aliases) of all nodes but the root and groupings: the text holds code,
    name and aliases, the aliases repeat name and aliases."""
    kept = nodes.where((F.col("code") != root) & ~F.startswith("code", F.lit("CHAPTER_")) & ~F.startswith("code", F.lit("SECTION_")))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return kept.select(F.col("code").alias("id"), F.concat_ws(" ", "code", "name", aliases).alias("text"), F.concat(F.array("name"), aliases).alias("aliases"))


@dataclass(frozen=True)
class PruneConfig:
    least_similarity: float = 0.5
    most_distance: int = 4
    alpha: float = 0.7
    keep_unknown: bool = False

    def __post_init__(self) -> None:
        if not (0 <= self.least_similarity <= 1 and 0 <= self.alpha <= 1):
            raise ValueError("similarity and alpha lie in 0..1")
        if self.most_distance < 0:
            raise ValueError("distance must not be negative")


def first_of_each(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, ord, code, score): codes stripped, empty ones dropped, the first
    of each code kept."""
    rows = candidates.withColumn("code", F.trim("code")).where("code <> ''").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(1.0)))
    w = W.partitionBy("query_id", "code").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prune(candidates: DataFrame, paths: DataFrame, config: PruneConfig = PruneConfig()) -> DataFrame:
    """(query_id, rank, code, score, ontology_score, final_score, distance) of the candidates
    that lie near the anchor, the first known one of the highest score."""
    rows = first_of_each(candidates.select("query_id", "ord", "code", "score")).join(paths.select("code", "path"), "code", "left")
    by_query = W.partitionBy("query_id")
    best = by_query.orderBy(F.col("path").isNull(), F.col("score").desc(), "ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"a_code": F.first(F.when(F.col("path").isNotNull(), F.col("code"))).over(best), "a_path": F.first("path").over(best)})
    anchor = F.col("code") == F.col("a_code")
    known = F.col("path").isNotNull()
    near = F.when(anchor, F.lit(1.0)).when(known, wu_palmer(F.col("a_path"), F.col("path"))).when(F.col("a_code").isNotNull(), F.lit(0.0))
    far = F.when(anchor, F.lit(0)).when(known, tree_distance(F.col("a_path"), F.col("path")))
    rows = rows.withColumns({"ontology_score": near, "distance": far.cast("int")})
    keep = (known & (anchor | ((F.col("ontology_score") >= config.least_similarity) & (F.col("distance") <= config.most_distance)))) | (~known & F.lit(config.keep_unknown))
    # where nothing is known, unknown ones keep their own score
    final = F.when(F.col("a_code").isNull(), F.col("score")).otherwise(config.alpha * F.col("score") + (1 - config.alpha) * F.col("ontology_score"))
    kept = rows.where(keep).withColumn("final_score", final)
    alone = F.col("a_code").isNull()
    order = by_query.orderBy(F.when(alone, F.lit(0.0)).otherwise(F.col("final_score")).desc(), F.when(alone, F.col("ord")), "code")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "code", "score", "ontology_score", "final_score", "distance")


def prune_entities(entities: DataFrame, paths: DataFrame, config: PruneConfig = PruneConfig()) -> DataFrame:
    """Diagnoses with candidates get them pruned, other entities pass unchanged."""
    from termweave.schema import DIAGNOSIS

    touched = (F.col("type") == DIAGNOSIS) & (F.size("candidates") > 0)
    lists = entities.where(touched).select(F.to_json(F.struct("candidates")).alias("query_id"), "candidates").distinct()
    rows = lists.select("query_id", F.posexplode("candidates").alias("ord", "code"), F.lit(1.0).alias("score"))
    done = prune(rows, paths, config).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "code"))).alias("r"))
    done = done.select(F.col("query_id").alias("__q"), F.transform("r", lambda x: x["code"]).alias("__c"))
    both = entities.withColumn("__key", F.when(touched, F.to_json(F.struct("candidates")))).join(done, F.col("__key") == F.col("__q"), "left")
    none = F.array().cast("array<string>")
    return both.withColumn("candidates", F.when(touched, F.coalesce("__c", none)).otherwise(F.col("candidates"))).select(*entities.columns)
