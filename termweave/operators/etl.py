"""Building terminology tables: merged aliases, grouped drug terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.text import casefold

# Rank of term types.
TTY_RANK = {"IN": 0, "MIN": 1, "PIN": 2, "BN": 3, "SCD": 4, "SBD": 5, "GPCK": 6, "BPCK": 7}
OTHER_RANK = 99
MOST_SYNONYMS = 100


def tty_rank(tty: Column) -> Column:
    pairs = [F.lit(x) for p in TTY_RANK.items() for x in p]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), tty), F.lit(OTHER_RANK))


def group_terms(terms: DataFrame, most: int = MOST_SYNONYMS) -> DataFrame:
    """(rxcui, name, tty, synonyms) from (rxcui, tty, term): the best term is the name, the
    others, once whatever their case, are synonyms. Best is by type rank, then length, then
    folded text, then text."""
    order = [tty_rank(F.col("tty")), F.length("term"), casefold("term"), F.col("term"), F.col("tty")]
    same = W.partitionBy("rxcui", casefold("term")).orderBy(*order)
    once = terms.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    rank = F.row_number().over(W.partitionBy("rxcui").orderBy(*order))
    listed = once.withColumn("rank", rank).where(F.col("rank") <= most + 1)
    grouped = listed.groupBy("rxcui").agg(F.array_sort(F.collect_list(F.struct("rank", "tty", "term"))).alias("l"))
    first = F.get("l", F.lit(0))
    others = F.slice(F.filter(F.transform("l", lambda x: x["term"]), lambda t: t != first["term"]), 1, most)
    return grouped.select("rxcui", first["term"].alias("name"), first["tty"].alias("tty"), others.alias("synonyms"))


def merge_aliases(nodes: DataFrame, aliases: DataFrame, fold: bool = True) -> DataFrame:
    """``nodes`` with aliases (code, alias, ord) behind their own, each once (whatever its
    case, if ``fold``), in order."""
    own = nodes.select("code", F.posexplode("aliases").alias("ord", "alias")).select("code", "alias", F.lit(0).alias("turn"), F.col("ord").cast("long").alias("ord"))
    every = own.unionByName(aliases.select("code", "alias", F.lit(1).alias("turn"), F.col("ord").cast("long").alias("ord"))).where("alias <> ''")
    key = casefold("alias") if fold else F.col("alias")
    w = W.partitionBy("code", key).orderBy("turn", "ord", "alias")
    # own aliases stay as they are, repeated ones too when folding
    once = every.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ((F.col("turn") == 0) & F.lit(fold)))
    listed = once.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("turn", "ord", "alias"))).alias("l"))
    listed = listed.select("code", F.transform("l", lambda x: x["alias"]).alias("__a"))
    return nodes.join(listed, "code", "left").withColumn("aliases", F.coalesce("__a", F.array().cast("array<string>"))).select(*nodes.columns)
