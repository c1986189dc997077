"""Column functions on spans: [start, end) offsets in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: Numbers that ``running`` adds up at once.
RUN_BLOCK = 256


def running(numbers: Column, block: int = RUN_BLOCK) -> Column:
    """array<int>: what comes before each of ``numbers`` in sum. An array that grows in a
    fold is copied at each step, so the fold goes over blocks, and over each block."""

    def sums(values: Column, start: Column) -> Column:
        none = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, none, lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def summed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v))
        return let(sums(totals, F.lit(0)), lambda starts: F.flatten(F.zip_with(blocks, starts, sums)))

    def cut(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        return F.when(F.size(v) > 0, let(blocks, summed)).otherwise(F.array().cast("array<int>"))

    return let(numbers.cast("array<int>"), cut)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, end - start)


def exact_matches(text: Column, mention: Column) -> Column:
    """All places of ``mention``, overlapping ones too; none for an empty mention. The text
    is cut before each place, and lengths are summed, so the work is linear in the text."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(mention, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))

    def places(pieces: Column) -> Column:
        def spans(begins: Column) -> Column:
            # the first piece is cut off by nothing
            at = F.when(F.startswith(text, mention), begins).otherwise(F.slice(begins, F.lit(2), F.size(begins)))
            return F.transform(at, lambda i: F.struct(i.alias("start"), (i + F.length(mention)).cast("int").alias("end")))

        return let(running(F.transform(pieces, F.length)), spans)

    # most mentions are absent: a plain search comes first
    return F.when((F.length(mention) > 0) & F.contains(text, mention), let(F.split(text, quoted, -1), places)).otherwise(F.array().cast(f"array<{SPAN}>"))


def literal_matches(text: Column, pattern: str) -> Column:
    """All places of a fixed pattern."""
    return exact_matches(text, F.lit(pattern))


def choose_match(matches: Column, predicted: Column, ambiguity: int = 0) -> Column:
    """The match whose start is nearest to ``predicted``; null if none, or if the second
    nearest is not farther by more than ``ambiguity``."""
    near = F.array_sort(F.transform(matches, lambda m: F.struct(F.abs(m["start"] - predicted).alias("far"), m["start"].alias("start"), m["end"].alias("end"))))

    def pick(n: Column) -> Column:
        first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        clear = second.isNull() | (second["far"] - first["far"] > ambiguity)
        return F.when((F.size(n) > 0) & clear, F.struct(first["start"].alias("start"), first["end"].alias("end")))

    return let(near, pick)


def valid_span(source: Column, text: Column, start: Column, end: Column) -> Column:
    """Whether the span lies in the source and holds exactly the text."""
    inside = (start >= 0) & (start < end) & (end <= F.length(source))
    return F.coalesce(inside & (slice_text(source, start, end) == text), F.lit(False))


def require_span(source: Column, text: Column, start: Column, end: Column) -> Column:
    """True; fails the job if the span is not valid."""
    return F.when(valid_span(source, text, start, end), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("span does not hold its text: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def correct_span(source: Column, text: Column, start: Column, end: Column) -> Column:
    """The span itself if valid, else the nearest clear match of the text, else null."""
    own = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    return F.when(valid_span(source, text, start, end), own).otherwise(choose_match(exact_matches(source, text), start))


def to_global(chunk_start: Column, chunk_end: Column, start: Column, end: Column) -> Column:
    """A span of a chunk as a span of its source; null if it leaves the chunk."""
    inside = (start >= 0) & (start < end) & (chunk_start + end <= chunk_end)
    return F.when(inside, F.struct((chunk_start + start).cast("int").alias("start"), (chunk_start + end).cast("int").alias("end")))
