"""Line dedup by content-defined line chunks (operator 7).

Lines are hashed, and a rolling hash over the hashes of ``WINDOW`` = 2 lines chooses chunk
boundaries, so they depend on content alone and fall into step again after an insertion. A
line of ``LONG`` characters or more is a paragraph whose line breaks were joined: it is
wrapped again between words, each line shorter than ``LONG``, so it has two lines or more
unless it is one word; these lines are bounded on both sides and make one chunk. A chunk
counts if it has two lines with words. Chunks that are found more than once in the corpus are
removed but for the first (by doc_id, null last, then place in the text), if their bytes are equal.

Plan: (1) counts of chunk hashes, without texts; (2) chunks whose hash is repeated, with
texts, grouped by hash and text, which compares the bytes, and summed before the shuffle;
(3) the numbers of these chunks joined to their group by shuffle, hot groups salted (texts
only where two of them have one hash); (4) the numbers of removed chunks joined to their documents. The set of repeated
hashes is broadcast in (2) if it has at most ``BROADCAST_ROWS`` rows, joined by shuffle if not.

Chunks miss short lines between long ones, long lines of one word and repeats that hold no whole chunk. ``dedup_runs``,
which the pipeline takes, removes the repeated chunks in the same way and then checks exactly
what their boundaries leave: every two successive lines with words are a unit (with the lines
without words between them), and so is every long line. A line goes if its chunk or a unit
that it is in was found before, so each repeated run of two lines goes whole, and an exact copy
of such a text becomes empty. Units that a removed chunk holds are settled with it and left out
of step (3): its first occurrence holds them too, so none is the first of its kind. The first occurrence of a line
always stays. Lines without words go with the line before them, those at the start with the
first one that has words. The plan of the check is the same, with units for chunks.

Defined results: a null text stays null, an empty one empty; a text without line feed is one
line; lines without words never count but belong to their chunk; a text that loses all its
chunks is empty; rows with the same doc_id and text are treated alike (what one keeps, the
other keeps too); an empty table gives no rows; other columns are kept, whatever their
names. DataFrame code only, no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import WORD, attach, let, running, stage, table

LONG = 120
#: Where a long line can be wrapped.
BETWEEN_WORDS = r"[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]"
#: A line with words, from its first word on.
WORD_LINE = r"[^\x20\x09-\x0D][^\n]*"
BROADCAST_ROWS = 1_000_000


def chunks(text: Column) -> Column:
    """array<struct<k,lines,counts,text>> of the chunks of a text, in order."""

    def flags(lines: Column) -> Column:
        each = F.transform(lines, lambda x: F.struct(F.md5(x).alias("h"), (F.length(x) >= LONG).alias("long")))
        return let(each, lambda e: bounds(lines, e))

    def bounds(lines: Column, e: Column) -> Column:
        n = F.size(e)

        def ends(x: Column, i: Column) -> Column:
            rolled = F.substr(F.md5(F.concat(F.get(e, i - 1)["h"], x["h"])), F.lit(1), F.lit(1)).isin("0", "4", "8", "c")
            return (i == n - 1) | x["long"] | F.get(e, i + 1)["long"] | ((i > 0) & rolled)

        at = F.filter(F.transform(e, lambda x, i: F.when(ends(x, i), i + 1)), lambda x: x.isNotNull())
        return let(at, lambda b: F.transform(b, lambda end, k: piece(lines, F.when(k == 0, F.lit(0)).otherwise(F.get(b, k - 1)), end, k)))

    def piece(lines: Column, begin: Column, end: Column, k: Column) -> Column:
        own = F.slice(lines, begin + 1, end - begin)
        full = F.aggregate(own, F.lit(0), lambda n, x: n + F.when(~x.rlike(WORD), 0).when((F.length(x) >= LONG) & x.rlike(BETWEEN_WORDS), 2).otherwise(1))
        counts = full >= 2
        return F.struct(k.cast("int").alias("k"), (end - begin).alias("lines"), counts.alias("counts"), F.array_join(own, "\n").alias("text"))

    return let(F.split(text, "\n", -1), flags)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``__d`` and ``__t``, which tell documents apart and order them."""
    return docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "__t": F.xxhash64("text")})


def word_lines(lines: Column) -> Column:
    """Places of the lines that have words."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())


def placed_chunks(text: Column) -> Column:
    """array<struct<k,n,counts,text>>: the chunks of a text by their lines with words, ``n``
    from number ``k`` on."""

    def placed(all_: Column, n: Column) -> Column:
        def one(before: Column) -> Column:
            return F.transform(all_, lambda c, i: F.struct(F.get(before, i).alias("k"), F.get(n, i).alias("n"), c["counts"].alias("counts"), c["text"].alias("text")))

        return let(running(n), one)

    return let(chunks(text), lambda all_: let(F.transform(all_, lambda c: F.regexp_count(c["text"], F.lit(WORD_LINE))), lambda n: placed(all_, n)))


def units(text: Column) -> Column:
    """array<struct<k,n,counts,text>>: each two successive lines with words (n = 2) and each
    long one (n = 1); ``k`` numbers the lines with words."""

    def made(lines: Column, at: Column) -> Column:
        def pair(i: Column, k: Column) -> Column:
            own = F.slice(lines, i + 1, F.get(at, k + 1) - i + 1)
            return F.struct(k.cast("int").alias("k"), F.lit(2).alias("n"), (k < F.size(at) - 1).alias("counts"), F.array_join(own, "\n").alias("text"))

        def single(i: Column, k: Column) -> Column:
            own = F.get(lines, i)
            return F.struct(k.cast("int").alias("k"), F.lit(1).alias("n"), (F.length(own) >= LONG).alias("counts"), own.alias("text"))

        return F.concat(F.transform(at, pair), F.transform(at, single))

    return let(F.split(text, "\n", -1), lambda lines: let(word_lines(lines), lambda at: made(lines, at)))


def number_of(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def later(docs: DataFrame, parts: Callable[[Column], Column], *extra: str, but: DataFrame | None = None) -> DataFrame:
    """(__d, __t, k, extra): the parts of texts that were found before, but for those that
    ``but`` names, which are settled."""
    rows = keyed(docs.where("text IS NOT NULL").select("doc_id", "text"))
    rows = rows.select("__d", "__t", F.explode(F.filter(parts(F.col("text")), lambda c: c["counts"])).alias("c"))
    rows = rows.select("__d", "__t", *[F.col(f"c.{x}").alias(x) for x in ("k", *extra)], F.col("c.text").alias("chunk")).withColumn("h", number_of(F.col("chunk")))
    twice = stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "line-hashes")
    one = twice.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    few = one["n"] <= BROADCAST_ROWS
    repeats = rows.join(F.broadcast(twice.select("h")), "h", "left_semi") if few else attach(rows, twice, "h", "n_rows", one["rows"], "inner")
    found = stage(repeats, "line-chunks")
    first = F.min(F.struct("__d", "__t", "k")).alias("first")
    grouped = found.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), first)
    # the bytes are compared here; where a hash has one text, its number stands for it below
    groups = stage(grouped.select("h", "n_rows", "first"), "line-groups")
    clash = stage(groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "line-clash")
    numbers = found.drop("chunk")
    if but is not None:  # by numbers, so that no texts are moved
        numbers = stage(numbers.join(but, but.columns, "left_anti"), "line-open")
    if clash.isEmpty():
        both = attach(numbers, groups.where("n_rows > 1"), "h", "n_rows", numbers.count(), "inner")
    else:
        alone = stage(numbers.join(clash, "h", "left_anti"), "line-alone")
        single = groups.join(clash, "h", "left_anti").where("n_rows > 1")
        both = attach(alone, single, "h", "n_rows", alone.count(), "inner")
        odd = stage(found.join(clash, "h", "left_semi").withColumn("__h", F.sha2("chunk", 256)), "line-odd")
        texts = stage(odd.groupBy("__h", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), first).where("n_rows > 1").withColumnRenamed("chunk", "same"), "line-texts")
        told = attach(odd, texts, "__h", "n_rows", odd.count(), "inner").where("chunk = same")
        both = both.unionByName(told.select(*both.columns))
    return both.where(F.struct("__d", "__t", "k") != F.col("first")).select("__d", "__t", "k", *extra)


def by_document(lost: DataFrame) -> DataFrame:
    return lost.groupBy(F.col("__d").alias("__d2"), F.col("__t").alias("__t2")).agg(F.collect_set("k").alias("__ks"))


def repeated(docs: DataFrame) -> DataFrame:
    """(__d2, __t2, __ks): numbers of the chunks that each document loses."""
    return by_document(later(docs, chunks))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(__d2, __t2, __ks): numbers of the lines with words that each document loses, by
    chunks first, then by the units that no removed chunk holds."""

    def lines(lost: DataFrame) -> DataFrame:
        last = (F.col("k") + F.col("n") - 1).alias("last")
        return lost.select("__d", "__t", last, F.explode(F.sequence("k", last)).alias("k"))

    by_chunks = lines(stage(later(docs, placed_chunks, "n"), "line-removed"))
    held = by_chunks.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).where("k + n - 1 <= last").drop("last")
    return by_document(by_chunks.unionByName(lines(later(docs, units, "n", but=held))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with texts freed of repeated chunks, and ``__lines`` and ``__removed``, the
    lines of each text before and those that it lost."""
    lost = repeated(docs)
    rows = keyed(docs)
    both = rows.join(lost, (rows["__d"] == lost["__d2"]) & (rows["__t"] == lost["__t2"]), "left")

    def rest(all_: Column, gone: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), gone), lambda k: F.get(all_, k))

    some = F.col("__ks").isNotNull()
    both = both.withColumn("__parts", F.when(some, let(F.struct(chunks(F.col("text")).alias("all"), F.col("__ks").alias("gone")), lambda s: rest(s["all"], s["gone"]))))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long")
    kept = F.aggregate("__parts", F.lit(0).cast("long"), lambda a, c: a + c["lines"])
    both = both.withColumns({"__lines": lines, "__removed": F.when(some, lines - kept).otherwise(F.lit(0)).cast("long")})
    text = F.when(some, F.array_join(F.transform("__parts", lambda c: c["text"]), "\n")).otherwise(F.col("text"))
    return both.withColumn("text", text).select(*docs.columns, "__lines", "__removed")


def dedup_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with texts freed of all lines of repeated runs."""
    lost = repeated_lines(docs)
    rows = keyed(docs)
    both = rows.join(lost, (rows["__d"] == lost["__d2"]) & (rows["__t"] == lost["__t2"]), "left")

    def kept(lines: Column, at: Column, ks: Column) -> Column:
        def own(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k))
            return F.array_join(F.slice(lines, begin + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - begin), "\n")

        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(at) - 1), ks), own), "\n")

    split = F.struct(F.split(F.col("text"), "\n", -1).alias("lines"), F.col("__ks").alias("ks"))
    text = let(split, lambda s: let(word_lines(s["lines"]), lambda at: kept(s["lines"], at, s["ks"])))
    return both.withColumn("text", F.when(F.col("__ks").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


OP7_SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line, len(s) AS n FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), f AS (
  SELECT *, CASE WHEN i = n OR length(line) >= {LONG} OR coalesce(lead(length(line)) OVER w, 0) >= {LONG}
      OR i > 1 AND md5(md5(lag(line) OVER w) || md5(line))[1] IN ('0', '4', '8', 'c') THEN 1 ELSE 0 END AS ends
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM f
), c AS (
  SELECT doc_id, k, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk,
    sum(CASE WHEN NOT regexp_matches(line, '[^\x20\x09-\x0D]') THEN 0 WHEN length(line) >= {LONG} AND regexp_matches(line, '{BETWEEN_WORDS}') THEN 2 ELSE 1 END) AS full_lines
  FROM g GROUP BY doc_id, k
), r AS (
  SELECT *, full_lines >= 2 AS counts FROM c
), o AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY chunk, counts ORDER BY doc_id NULLS LAST, k) > 1 AS gone FROM r
)
SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN lines ELSE 0 END) AS BIGINT) AS n_removed,
  coalesce(string_agg(CASE WHEN NOT gone THEN chunk END, chr(10) ORDER BY k), '') AS text
FROM o GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
