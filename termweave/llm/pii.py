"""Personal data: patterns propose, checksums confirm, context adjusts (operator 6).

Patterns propose spans, leftmost and without overlap within a kind. Validators confirm
them: Luhn for card numbers, mod 97 for account numbers, ranges of parts for addresses,
digit counts for telephone numbers. A proposal has a start score by its kind, in tenths; a
context word in the ``CONTEXT_CHARS`` characters before or after it adds ``CONTEXT_BONUS``,
and it stays from ``THRESHOLD`` on. Spans of the
base kinds (email, ip, card, phone) that pass their validator start above the threshold,
so context never drops them, only raises their score; the added kinds are

* ``iban``: an account number of the length of its country, plain or with single spaces in it,
  not inside a longer word, that passes mod 97 (countries are those of ``IBAN_LENGTHS``),
* ``ssn``: ddd-dd-dddd with possible parts, only with a context word,
* ``secret``: a run of 32 or more letters, digits, '_' and '-' that has both letters and
  digits, only with a context word.

Offsets count code points, ends are exclusive. The patterns are written so that their work
is linear in the text: runs are taken possessively and a match starts only where a run
starts or the last match ended. Offsets are running sums over blocks, and context is cut out
of a block of the text, so work stays linear in text and spans.

Defined results: a null or empty text has no spans; every row of ``documents`` is kept,
repeated ids too; ties cannot occur, as spans of a kind don't overlap; spans of different
kinds may; an empty table gives
no rows; other columns are ignored. All of the query is DataFrame code without Python on the
executors. ``redact``, which the query doesn't use, joins the pieces of a text in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import let, running, table, text_of

CONTEXT_CHARS = 40
CONTEXT_BONUS = 3
THRESHOLD = 5
#: Blocks of a text of which context is cut out.
BLOCK = 1024

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """An alternative for each length: its countries and so many signs, single spaces between."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?:[\\x20]?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items(), reverse=True)) + ")"


#: kind, pattern, start score, context words. The order is the order of results.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 9, "mail|contact|write|schreib|correo|courriel"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 6, "ip|host|server|address|adresse|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", 7, "card|visa|credit|karte|tarjeta|carte"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 7, "phone|tel|call|fax|mobile|anruf|llame|appel"),
    ("iban", iban_pattern(), 6, "iban|account|konto|cuenta|compte"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 3, "ssn|social security|tax id"),
    ("secret", r"[A-Za-z0-9_-]{32,}+", 3, "token|secret|password|passwd|pwd|key|bearer|auth"),
]
BASE = ("email", "ip", "card", "phone")


def _context(words: str) -> str:
    return f"(?i)(^|[^a-z])({words})([^a-z]|$)"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes Luhn's check."""
    points = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)),
    )
    return F.aggregate(points, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check; letters count 10 to 35."""
    bare = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        digit = F.ascii(c) - 48
        return F.when(c == "", a).when(digit <= 9, (a * 10 + digit) % 97).otherwise((a * 100 + digit - 7) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


def passes(kind: str, m: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return m.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        digits = digits_of(m)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


SPANS = "array<struct<kind:string,start:int,end:int,score:int>>"


def found(kind: str, pattern: str, score: int, context: str, text: Column, blocks: Column) -> Column:
    """array<struct<kind,start,end,score>> of confirmed spans of one kind, by start.
    ``blocks`` are the pieces of BLOCK code points of the text."""

    def around(start: Column, end: Column) -> tuple[Column, Column]:
        """The text before and after a span, cut out of two blocks each."""
        low = F.greatest(F.lit(0), start - CONTEXT_CHARS)
        first, last = F.floor(low / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")

        def two(k: Column) -> Column:
            return F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))

        return F.substr(two(first), low - first * BLOCK + 1, start - low), F.substr(two(last), end - last * BLOCK + 1, F.lit(CONTEXT_CHARS))

    def judged(begin: Column, m: Column) -> Column:
        end = begin + F.length(m)
        before, after = around(begin, end)
        total = F.lit(score) + F.when(before.rlike(_context(context)) | after.rlike(_context(context)), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0))
        good = passes(kind, m)
        if kind == "iban":
            good &= ~F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(after, F.lit(1)).rlike("[A-Za-z0-9]")
        one = F.struct(F.lit(kind).alias("kind"), begin.cast("int").alias("start"), end.cast("int").alias("end"), total.alias("score"))
        return F.when(good, one)

    def placed(matches: Column, gaps: Column) -> Column:
        # the text is gap, match, gap, match, ..., gap: running sums give the offsets
        steps = F.zip_with(gaps, matches, lambda g, m: g + F.length(m))
        begins = let(steps, lambda s: F.zip_with(running(s), gaps, lambda a, g: a + g))
        every = F.zip_with(begins, matches, judged)
        return F.filter(every, lambda x: x.isNotNull() & (x["score"] >= THRESHOLD))

    pieces = F.split(text, pattern, -1)

    def from_matches(m: Column) -> Column:
        # the last gap has no match
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(m)), F.length)
        return F.when(F.size(m) > 0, let(gaps, lambda g: placed(m, g))).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_matches)


def pii_spans(docs: DataFrame) -> DataFrame:
    """The rows with a column ``spans``: confirmed spans, by kind as listed, then start."""
    text = text_of("text")
    none = F.array().cast(SPANS)
    # a cheap test first: most texts have no trace of most kinds
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("[0-9]{3}-[0-9]{2}-"), "secret": text.rlike("[A-Za-z0-9_-]{32}")}
    digit = text.rlike("[0-9]")

    def spans(blocks: Column) -> Column:
        return F.concat(*[F.when(hints.get(k, digit), found(k, p, s, c, text, blocks)).otherwise(none) for k, p, s, c in KINDS])

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    trace = digit | F.contains(text, F.lit("@"))
    return docs.withColumn("spans", F.when(trace, let(blocks, spans)).otherwise(none))


def redact(docs: DataFrame) -> DataFrame:
    """Rows of ``pii_spans`` with each span of the text replaced by its kind in angle
    brackets. Spans that overlap are one, named by the first of them (the longer of two that
    start together). Null texts stay null."""

    def without(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += [text[at : s["start"]], f"<{s['kind']}>"]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, s = (batch.schema.names.index(n) for n in ("text", "spans"))
            made = [None if x.as_py() is None else without(x.as_py(), y.as_py()) for x, y in zip(batch.column(t), batch.column(s))]
            yield batch.set_column(t, "text", pa.array(made, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _is(kind: str):
    return lambda k: k == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kinds = F.transform("spans", lambda s: s["kind"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = {k: F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k, *_ in KINDS}
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    added = [counts[k] for k, *_ in KINDS if k not in BASE]
    return docs.select("doc_id", *[counts[k] for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))


def _sql_spans(kind: str, score: int, context: str, valid: str) -> str:
    """SQL for a list of {kind, s, e, score} of one kind; context is cut out of the text."""
    words = _context(context)
    return f"""list_filter(list_transform(list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{
        'm': m_{kind}[i], 's': CAST(coalesce(list_sum(list_transform(p_{kind}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}}),
      lambda x: {valid}), lambda x: {{'s': '{kind}:' || x.s || ':' || (x.s + length(x.m)),
        'score': {score} + CASE WHEN regexp_matches(t[greatest(1, x.s - {CONTEXT_CHARS - 1}):x.s], '{words}') OR regexp_matches(t[x.s + length(x.m) + 1:x.s + length(x.m) + {CONTEXT_CHARS}], '{words}') THEN {CONTEXT_BONUS} ELSE 0 END}}),
      lambda x: x.score >= {THRESHOLD})"""


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": r"[A-Za-z0-9_-]{32,}",
    }
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    double = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({digits})[j] AS INT) WHEN CAST(reverse({digits})[j] AS INT) > 4 THEN 2 * CAST(reverse({digits})[j] AS INT) - 9 ELSE 2 * CAST(reverse({digits})[j] AS INT) END))"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(x.m, '.'), lambda d: length(ltrim(d, '0')) > 3 OR coalesce(TRY_CAST(right(d, 6) AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {double} % 10 = 0",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    plain |= {k: p for k, p, _, _ in KINDS if k not in plain}
    bare = "replace(x.m, ' ', '')"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END"
    numbers = f"list_transform(string_split({bare}[5:] || {bare}[1:4], ''), lambda c: {value})"
    rest = f"list_reduce(list_prepend(0, {numbers}), lambda a, n: CASE WHEN n < 10 THEN (a * 10 + n) % 97 ELSE (a * 100 + n) % 97 END)"
    alone = "NOT regexp_matches(t[greatest(1, x.s):x.s], '[A-Za-z0-9]') AND NOT regexp_matches(t[x.s + length(x.m) + 1:x.s + length(x.m) + 1], '[A-Za-z0-9]')"
    valid["iban"] = f"{rest} = 1 AND {alone}"
    valid["ssn"] = "NOT regexp_matches(x.m, '^(000|666|9)|-00-|-0000$')"
    valid["secret"] = "regexp_matches(x.m, '[0-9]') AND regexp_matches(x.m, '[A-Za-z]')"
    found = ", ".join(f"regexp_extract_all(t, '{plain[k]}') AS m_{k}, regexp_split_to_array(t, '{plain[k]}') AS p_{k}" for k, *_ in KINDS)
    lists = ", ".join(f"{_sql_spans(k, s, c, valid[k])} AS s_{k}" for k, _, s, c in KINDS)
    base = f"flatten([{', '.join(f's_{k}' for k in BASE)}])"
    every = f"flatten([{', '.join(f's_{k}' for k, *_ in KINDS)}])"
    counts = ", ".join(f"CAST(len(s_{k}) AS BIGINT) AS n_{k}" for k, *_ in KINDS)
    return f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, t, {found} FROM d),
s AS (SELECT doc_id, {lists} FROM f)
SELECT doc_id, {counts}, CAST(len({every}) AS BIGINT) AS n_spans,
  sha256(array_to_string(list_transform({base}, lambda x: x.s), ',')) AS base_sha256,
  array_to_string(list_transform({every}, lambda x: x.s), ',') AS spans, array_to_string(list_transform({every}, lambda x: x.score), ',') AS scores FROM s
"""


OP6_SQL = _oracle()
