"""Chat formatting with a grammar round trip (operator 9).

Conversations are rendered into one template text each, parsed again by a deterministic
parser and compared with the source. A conversation whose plain rendering does not come
back identical is rendered with its control strings escaped, which always does.

Template (``<|e|>`` first only in an escaped rendering)::

    [<|e|>]<|s|>ROLE\\nTEXT<|/s|><|s|>ROLE\\nTEXT<|/s|>...

Escapes, in texts and roles of an escaped rendering: ``\\`` becomes ``\\b``, ``<|``
becomes ``<\\p`` and, in roles only, a line feed becomes ``\\n``. After the first of them
every backslash starts a two-character escape, so decoding by plain replacement is exact.

The loss mask is a list of spans of the formatted text (code points, ends exclusive): the
texts of assistant turns as they stand there, escapes included, without roles and control
strings. ``masked`` cuts them out again, in work linear in the text.

Defined results: a null role or text is empty; rows of one conversation are ordered by
turn (null first), then role, then text, so ties are settled by content and repeated rows
are repeated turns; a null conv_id is a conversation of its own; an empty table gives no
rows; other columns are ignored. All is DataFrame code without Python on the executors.
A conversation becomes one text, so its turns meet in one row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import let, running, table

#: Blocks of a formatted text out of which masked spans are cut.
BLOCK = 1024
OPEN, CLOSE, MARK = "<|s|>", "<|/s|>", "<|e|>"
CONTROL = "<|"
ESCAPED_CONTROL = "<\\p"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(CONTROL), F.lit(ESCAPED_CONTROL))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit(ESCAPED_CONTROL), F.lit(CONTROL))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>) in order."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        role, text = (escape(t["role"], role=True), escape(t["text"])) if escaped else (t["role"], t["text"])
        return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))

    body = F.array_join(F.transform(turns, one), "")
    return F.concat(F.lit(MARK), body) if escaped else body


def pieces_of(formatted: Column) -> tuple[Column, Column, Column]:
    """Whether the text is marked as escaped, the text without the mark, and the pieces of it
    between the first OPEN and the last CLOSE: a role, a line feed and a text each."""
    marked = F.startswith(formatted, F.lit(MARK))
    body = F.when(marked, F.substr(formatted, F.lit(len(MARK) + 1))).otherwise(formatted)
    inner = F.substr(body, F.lit(len(OPEN) + 1), F.length(body) - F.lit(len(OPEN) + len(CLOSE)))
    return marked, body, F.split(inner, r"<\|/s\|><\|s\|>", -1)


def parse(formatted: Column) -> Column:
    """The turns that a reader finds: pieces between OPEN and CLOSE, the role up to the
    first line feed; null if the text is not of the grammar."""
    marked, body, pieces = pieces_of(formatted)

    def one(p: Column) -> Column:
        at = F.locate("\n", p)
        role, text = F.substr(p, F.lit(1), at - 1), F.substr(p, at + 1)
        return F.struct(F.when(marked, unescape(role)).otherwise(role).alias("role"), F.when(marked, unescape(text)).otherwise(text).alias("text"))

    def clean(p: Column) -> Column:  # a control string inside a turn is against the grammar
        return (F.locate("\n", p) > 0) & ~F.contains(p, F.lit(OPEN)) & ~F.contains(p, F.lit(CLOSE)) & ~F.contains(p, F.lit(MARK))

    good = F.startswith(body, F.lit(OPEN)) & F.endswith(body, F.lit(CLOSE)) & F.forall(pieces, clean)
    return F.when(good, F.transform(pieces, one))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, mask, turns): the formatted text, whether it is escaped,
    its loss mask and the turns read back from it. A conversation that does not come back
    identical even escaped would fail the job."""
    both = turns_of(rows).withColumn("plain", render(F.col("turns"), False))
    # a plain rendering is kept if it parses to the source
    both = both.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    done = both.withColumn("formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("plain")))
    done = done.withColumn("back", parse(F.col("formatted")))
    same = F.coalesce(F.col("back") == F.col("turns"), F.lit(False))
    checked = F.when(same, F.col("back")).otherwise(F.raise_error(F.lit("round trip failed")).cast("array<struct<role:string,text:string>>"))
    return done.select("conv_id", "formatted", "escaped", loss_mask(F.col("formatted")).alias("mask"), checked.alias("turns"))


def loss_mask(formatted: Column) -> Column:
    """array<struct<start,end>> of a text of the grammar: what stands there of the texts of
    assistant turns, in order; a span of an empty text is empty."""
    marked, _, pieces = pieces_of(formatted)

    def spans(pieces: Column) -> Column:
        steps = F.transform(pieces, lambda p: F.length(p) + len(OPEN) + len(CLOSE))

        def span(p: Column, before: Column) -> Column:
            begin = F.when(marked, len(MARK)).otherwise(0) + before + len(OPEN)
            one = F.struct((begin + F.locate("\n", p)).cast("int").alias("start"), (begin + F.length(p)).cast("int").alias("end"))
            return F.when(F.startswith(p, F.lit("assistant\n")), one)

        return F.filter(let(steps, lambda s: F.zip_with(pieces, running(s), span)), lambda x: x.isNotNull())

    return let(pieces, spans)


def masked(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped."""
    marked = F.startswith(formatted, F.lit(MARK))

    def cut(blocks: Column) -> Column:
        def one(s: Column) -> Column:
            first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor(s["end"] / BLOCK).cast("int")
            own = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            text = F.substr(own, s["start"] - first * BLOCK + 1, s["end"] - s["start"])
            return F.when(marked, unescape(text)).otherwise(text)

        return F.transform(mask, one)

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ok = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ok).alias("text"))
    done = format_chats(rows.unionByName(extra))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("mask")), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT conv_id, max(CASE WHEN regexp_matches(role, '<\|(/?s|e)\|>') OR regexp_matches(text, '<\|(/?s|e)\|>') OR contains(role, chr(10)) THEN 1 ELSE 0 END) AS odd,
    sum(length(role) + length(text) + 12) AS plain_chars,
    sum(length(replace(role || chr(1) || text, '\', '\\')) + length(role || text) - length(replace(role, '<|', '!')) - length(replace(text, '<|', '!')) - 1 + length(role) - length(replace(role, chr(10), '')) + 12) AS escaped_chars
  FROM r GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS shown,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss
  FROM r GROUP BY conv_id
)
SELECT g.conv_id, n_turns, sha256(shown) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(CASE WHEN odd = 1 THEN 5 + escaped_chars ELSE plain_chars END AS BIGINT) AS formatted_chars
FROM g JOIN m ON g.conv_id IS NOT DISTINCT FROM m.conv_id
"""
