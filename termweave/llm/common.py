"""Helpers shared by the operators: tables, words, scratch tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.spans import let, running
from termweave.sources.scratch import drop_at_end, shared_dir, stage, unstage

__all__ = ["WORD", "attach", "attach_counted", "drop_at_end", "let", "n_words", "ranged", "running", "shared_dir", "stage", "table", "text_of", "unstage"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


#: A key is dealt out to several tasks from this share of all rows on, and from so many rows.
HOT_SHARE, HOT_ROWS = 20_000, 1000


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``right`` (one row per ``key``; ``weight`` = rows of ``left`` with that key)
    to ``left`` so that no key's rows meet in one task.

    A key of more than a HOT_SHARE-th of the ``total`` rows of ``left`` is salted: its rows
    are dealt to as many parts as it has such shares, and its row of ``right`` is copied to
    each. So there are at most 2 * HOT_SHARE copies; which keys are salted goes to the driver
    and back as two numbers each, HOT_SHARE of them at most. ``left`` must be a staged table
    or a narrow step from one: the salt is a row's place there, which a repeated task finds again.
    """
    hot = right.where(F.col(weight) > _part(total)).select(F.xxhash64(key).alias("__h"), F.col(weight).alias("__w"))
    return _salted(left, right.drop(weight), key, hot, total, how)


def attach_counted(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``attach`` where the rows of ``left`` by key are still to be counted."""
    total = left.count()
    hot = left.groupBy(F.xxhash64(key).alias("__h")).agg(F.count(F.lit(1)).alias("__w")).where(F.col("__w") > _part(total))
    return _salted(left, right, key, hot, total, how)


def _part(total: int) -> int:
    """Rows of one key that one task takes at most."""
    return max(HOT_ROWS, total // HOT_SHARE)


def _salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, total: int, how: str) -> DataFrame:
    spark = left.sparkSession
    names = [c for c in right.columns if c != key]
    copies: dict[int, int] = {}
    for r in hot.collect():  # HOT_SHARE rows at most
        copies[r["__h"]] = max(copies.get(r["__h"], 1), -(-r["__w"] // _part(total)))
    if not copies:
        both = left.join(right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__r_{c}") for c in names]), F.col(key) == F.col("__k"), how)
        return both.select(*left.columns, *[F.col(f"__r_{c}").alias(c) for c in names])
    few = F.broadcast(spark.createDataFrame(list(copies.items()), "__h long, __copies int"))
    n = F.coalesce("__copies", F.lit(1))
    dealt = right.withColumn("__h", F.xxhash64(key)).join(few, "__h", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    dealt = dealt.select(F.col(key).alias("__k"), F.col("__salt").alias("__s"), *[F.col(c).alias(f"__r_{c}") for c in names])
    marked = left.withColumns({"__row": F.monotonically_increasing_id(), "__h": F.xxhash64(key)}).join(few, "__h", "left")
    marked = marked.withColumn("__salt", F.pmod(F.xxhash64("__row"), n).cast("int"))
    both = marked.join(dealt, (F.col(key) == F.col("__k")) & (F.col("__salt") == F.col("__s")), how)
    return both.select(*left.columns, *[F.col(f"__r_{c}").alias(c) for c in names])


def ranged(df: DataFrame, order: list[Column], values: dict[str, Column], name: str) -> DataFrame:
    """``df``, staged, with a column for each of ``values``: its sum over all rows before, in
    the given order (``values`` are whole numbers or doubles). Rows are dealt by ranges of
    the order; each task adds its own, and only a sum for each task is put in order alone."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = stage(dealt.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()]), f"{name}-ranges")
    totals = dealt.groupBy("__part").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row per task
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in values])
    own = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(starts), "__part")
    sums = {k: F.col(f"__s_{k}") + F.coalesce(F.sum(f"__v_{k}").over(own), F.lit(0)) for k in values}
    out = stage(placed.select(*df.columns, *[v.alias(k) for k, v in sums.items()]), name)
    unstage(dealt)
    return out
