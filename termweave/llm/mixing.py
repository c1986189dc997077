"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

1. Sizes: words of each document, summed by source.
2. Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; they share the
   total size by weight, no target over ``MOST`` times its source's size, the excess
   shared again by weight. Closed form: with sources in order of cap over weight, the first
   level that no later source's cap is below.
3. Blocks: the total is cut into equal-token blocks, given to sources by the highest
   quotients target / (2 * seat - 1). A source's blocks go to its shards the same way, by
   shard size. Shards are seeded hash groups of a source's documents of about
   ``SHARD_WORDS`` words and ``SHARD_ROWS`` rows at most, so a hot source is many shards and no task holds a source.
4. Selection: a shard's documents lie in seeded order as one run of words, cut into blocks.
   Its quota takes whole passes over the run, and for the rest blocks from a seeded first
   block on, around the end. So a document is taken at most ceil(quota / run) <= ``MOST``
   times.

Apportionment looks only at seats near each exact share: a divisor that gives ``n`` seats
to ``m`` entities differs from the mean by at most m / 2 seats in sum, which bounds how far
a quota can be from its share; candidates are O(m) rows, independent of the tokens. Orders
over all sources and over all shards of a source (ranks, running sums) are dealt out by
ranges, so no task holds all sources or all shards.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, the last; equal quotients go to the earlier source (or shard); repeated
rows are separate documents, equal rows get equal or neighbouring places; a document without
doc_id is placed by its text; an empty table
gives no rows; other columns pass through unless an added one has their name. Seeds are
fixed, so reruns agree. DataFrame code only, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.llm.common import attach, n_words, ranged, stage, table

WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_WORDS = 250_000
SHARD_ROWS = 50_000
MOST_BLOCK = 1000
#: The least target is this many blocks at least, if it has the words.
LEAST_BLOCKS = 200
SEED = "mix-1"


def apportion(df: DataFrame, group: str | None, entity: str, weight: str, seats: str) -> DataFrame:
    """The staged table ``df`` with a column ``quota``: the ``seats`` of each group given to
    its entities by the highest quotients weight / (2 * seat - 1), ties to the smaller entity.
    An entity of weight 0 gets none. Groups are not null; without a group all is one."""
    of = F.col(group) if group else F.lit("")
    live = df.where((F.col(weight) > 0) & (F.col(seats) > 0)).select(of.alias("__g"), F.col(entity).alias("__e"), F.col(weight).alias("__x"), F.col(seats).alias("__n"))
    live = stage(live, "mix-live")
    sums = stage(live.groupBy("__g").agg(F.sum("__x").alias("__w"), F.count(F.lit(1)).alias("__m")), "mix-sums")
    n = live.count()
    near = attach(live, sums.withColumn("__rows", F.col("__m")), "__g", "__rows", n, "inner")
    share = F.col("__n") * F.col("__x") / F.col("__w")
    spread = F.ceil(share * F.col("__m") / (2 * F.col("__n"))) + 2
    base, top = F.greatest(F.lit(0), F.floor(share) - spread).cast("long"), (F.floor(share) + spread + 1).cast("long")
    near = stage(near.select("__g", "__e", "__x", "__n", base.alias("__base"), top.alias("__top")), "mix-near")
    tried = near.select("__g", "__e", "__x", F.explode(F.sequence(F.col("__base") + 1, F.col("__top"))).alias("__seat"))
    tried = tried.select("__g", "__e", (F.col("__x") / (2 * F.col("__seat") - 1)).alias("__q"), "__seat")
    ranked = ranged(tried, [F.col("__g"), F.col("__q").desc(), F.col("__e"), F.col("__seat")], {"__at": F.lit(1).cast("long")}, "mix-ranked")
    # places count over all groups: those of a group begin at its least one
    left = near.groupBy("__g").agg((F.first("__n") - F.sum("__base")).alias("__left"))
    firsts = stage(ranked.groupBy("__g").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")).join(left, "__g"), "mix-firsts")
    won = attach(ranked, firsts, "__g", "__rows", firsts.agg(F.sum("__rows")).first()[0] or 0, "inner").where("__at - __first < __left")
    counted = won.groupBy("__g", "__e").agg(F.count(F.lit(1)).alias("__won"))
    based = near.select("__g", "__e", "__base").join(counted, ["__g", "__e"], "left").select("__g", "__e", (F.col("__base") + F.coalesce("__won", F.lit(0))).alias("__quota"))
    both = df.join(based, (of == F.col("__g")) & (F.col(entity) == F.col("__e")), "left")
    return both.select(*df.columns, F.coalesce("__quota", F.lit(0)).cast("long").alias("quota"))


def targets(by_source: DataFrame) -> DataFrame:
    """(skey, size, n) of each source to (skey, size, n, target, block, seats, shards): the
    table has one row per source, and is sorted by ranges."""
    at = ranged(by_source, [F.col("skey")], {"place": F.lit(1).cast("long")}, "mix-places")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    at = at.withColumn("w", w).withColumn("cap", F.lit(float(MOST)) * F.col("size"))
    # in order of cap over weight: what the sources before take at most, and what they weigh
    at = ranged(at, [F.col("cap") / F.col("w"), F.col("skey")], {"before": F.col("cap"), "weight": F.col("w")}, "mix-caps")
    every = at.agg(F.sum("size").alias("total"), F.sum("w").alias("weights"))
    at = at.join(F.broadcast(every))  # one row
    at = at.withColumn("level", (F.col("total") - F.col("before")) / (F.col("weights") - F.col("weight")))
    level = at.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct((F.col("cap") / F.col("w")).alias("r"), "skey", "level"))["level"].alias("best"))
    at = stage(at.join(F.broadcast(level)).withColumn("target", F.least("cap", F.col("best") * F.col("w"))), "mix-levels")  # one row
    least = at.agg(F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"))
    block = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(F.col("least") / LEAST_BLOCKS))).cast("long")
    at = at.join(F.broadcast(least)).withColumn("block", F.coalesce(block, F.lit(1)))  # one row
    shards = F.greatest(F.ceil(F.col("size") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_ROWS)).cast("long")
    return at.select("skey", "size", "n", "target", "block", F.round(F.col("total") / F.col("block")).cast("long").alias("seats"), shards.alias("shards"))


def source_key() -> Column:
    """The source, with null behind all others."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))


def hashed(key: Column) -> Column:
    """Seeded hash text of a document's key."""
    return F.md5(F.concat(F.lit(SEED + ":"), key))


def document_key() -> Column:
    """The id, or for want of one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))))


def as_number(hex_text: Column) -> Column:
    return F.conv(F.substr(hex_text, F.lit(1), F.lit(12)), 16, 10).cast("long")


def taken_words(start: Column, size: Column, run: Column, take: Column, first: Column) -> Column:
    """Words of [start, start + size) that a take from a run of ``run`` words holds: whole
    passes, and the rest of the take from word ``first`` on, around the end."""
    passes = F.floor(take / run)
    rest = take - passes * run
    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(start + size, high) - F.greatest(start, low))
    return passes * size + overlap(first, F.least(first + rest, run)) + overlap(F.lit(0), first + rest - run)


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``. With ``carry``,
    the columns of ``docs`` come first; rows that agree in doc_id, source and size then get
    the least taken of them."""
    sized = stage(docs.select("doc_id", source_key().alias("skey"), n_words("text").alias("size"), hashed(document_key()).alias("h")), "mix-sizes")
    by_source = stage(sized.groupBy("skey").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    aims = stage(targets(by_source), "mix-targets")
    quotas = stage(apportion(aims, None, "skey", "target", "seats").select("skey", F.col("size").alias("source_size"), "n", "target", "block", "quota", "shards"), "mix-quotas")
    placed = attach(sized, quotas, "skey", "n", sized.count(), "inner")
    placed = placed.withColumn("shard", F.when(F.col("shards") > 1, as_number(F.col("h")) % F.col("shards")).otherwise(F.lit(0)).cast("long"))
    shards = stage(placed.groupBy("skey", "shard").agg(F.sum("size").alias("run"), F.first("quota").alias("seats"), F.first("block").alias("block")), "mix-shards")
    shards = apportion(shards, "skey", "shard", "run", "seats")
    first = as_number(F.md5(F.concat(F.lit(SEED + "|"), "skey", F.lit("|"), F.col("shard").cast("string")))) % F.greatest(F.lit(1), F.ceil(F.col("run") / F.col("block"))) * F.col("block")
    shards = shards.select(F.col("skey").alias("k"), F.col("shard").alias("s"), "run", F.least(F.col("quota") * F.col("block"), MOST * F.col("run")).alias("take"), first.alias("first"))
    order = W.partitionBy("skey", "shard").orderBy("h", "doc_id", "size")
    laid = placed.withColumn("start", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    both = laid.join(shards, (laid["skey"] == shards["k"]) & (laid["shard"] == shards["s"]))
    taken = F.when(F.col("run") > 0, taken_words(F.col("start"), F.col("size"), F.col("run"), F.col("take"), F.col("first"))).otherwise(F.lit(0))
    out = both.select("doc_id", "h", "skey", "size", "source_size", "target", taken.cast("long").alias("taken"))
    if not carry:
        return out.drop("h", "skey")
    once = stage(out.groupBy("h", "skey", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.min("taken").alias("taken")), "mix-taken")
    mine = once.select(F.col("h").alias("__h"), F.col("skey").alias("__k"), F.col("size").alias("__s"), "size", "source_size", "target", "taken")
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    rows = docs.withColumns({"__k2": source_key(), "__s2": n_words("text"), "__h2": hashed(document_key())}).select(*names, "__k2", "__s2", "__h2")
    both = rows.join(mine, (F.col("__h2") == F.col("__h")) & (F.col("__k2") == F.col("__k")) & (F.col("__s2") == F.col("__s")))
    return both.select(*names, "size", "source_size", "target", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))


#: Independent of the closed forms above: rounds of sharing, and every seat is ranked.
OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS size, count(*) AS n, (ARRAY[5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY skey
), r AS (
  SELECT 0 AS round, skey, size, n, w, false AS capped, (SELECT sum(size) FROM s) * w / (SELECT sum(w) FROM s) AS t FROM s
  UNION ALL
  SELECT round + 1, skey, size, n, w, t >= {MOST}.0 * size AS capped,
    CASE WHEN t >= {MOST}.0 * size THEN {MOST}.0 * size ELSE
      (sum(size) OVER () - sum(CASE WHEN t >= {MOST}.0 * size THEN {MOST}.0 * size ELSE 0 END) OVER ()) * w / sum(CASE WHEN t >= {MOST}.0 * size THEN 0 ELSE w END) OVER () END
  FROM r WHERE round < (SELECT count(*) FROM s)
), t AS (
  SELECT skey, size, n, t AS target FROM r WHERE round = (SELECT count(*) FROM s)
), b AS (
  SELECT *, CAST(greatest(1, least({MOST_BLOCK}, floor((SELECT min(target) FROM t WHERE target > 0) / {LEAST_BLOCKS}))) AS BIGINT) AS block, CAST(greatest(ceil(size / {SHARD_WORDS}.0), ceil(n / {SHARD_ROWS}.0)) AS BIGINT) AS shards FROM t
), n AS (
  SELECT CAST(round(sum(size) / min(block)) AS BIGINT) AS seats FROM b
), q AS (
  SELECT skey, count(*) AS quota FROM (
    SELECT skey, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, encode(skey), seat) AS rank
    FROM (SELECT skey, target, unnest(range(1, (SELECT seats FROM n) + 1)) AS seat FROM b WHERE target > 0))
  WHERE rank <= (SELECT seats FROM n) GROUP BY skey
), p AS (
  SELECT d.doc_id, d.skey, d.size, b.size AS source_size, b.target, b.block, coalesce(q.quota, 0) AS quota, d.h,
    CASE WHEN b.shards > 1 THEN CAST('0x' || substr(d.h, 1, 12) AS BIGINT) % b.shards ELSE 0 END AS shard
  FROM d JOIN b USING (skey) LEFT JOIN q USING (skey)
), sh AS (
  SELECT skey, shard, sum(size) AS run, min(quota) AS quota, min(block) AS block FROM p GROUP BY skey, shard
), sq AS (
  SELECT skey, shard, count(*) AS won FROM (
    SELECT skey, shard, quota, row_number() OVER (PARTITION BY skey ORDER BY run::DOUBLE / (2 * seat - 1) DESC, shard, seat) AS rank
    FROM (SELECT *, unnest(range(1, quota + 1)) AS seat FROM sh WHERE run > 0))
  WHERE rank <= quota GROUP BY skey, shard
), st AS (
  SELECT sh.skey, sh.shard, run, least(coalesce(won, 0) * block, {MOST} * run) AS take,
    CAST('0x' || substr(md5('{SEED}|' || sh.skey || '|' || sh.shard), 1, 12) AS BIGINT) % CAST(greatest(1, ceil(run / block)) AS BIGINT) * block AS first
  FROM sh LEFT JOIN sq USING (skey, shard)
), l AS (
  SELECT p.*, run, take, first, sum(p.size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id, p.size ROWS UNBOUNDED PRECEDING) - p.size AS start FROM p JOIN st USING (skey, shard)
)
SELECT doc_id, size, source_size, target, CASE WHEN run = 0 THEN 0 ELSE CAST(
    (take // run) * size
    + greatest(0, least(start + size, least(first + take % run, run)) - greatest(start, first))
    + greatest(0, least(start + size, first + take % run - run) - start) AS BIGINT) END AS taken
FROM l
"""
