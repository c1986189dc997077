"""Comparing two runs: rows are (file, text, type, start, end, candidates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.text import casefold, normalize_text, starts_with_any
from termweave.schema import DIAGNOSIS

KEY = ["file", "text", "type", "start", "end"]
LOOSE_KEY = ["file", "text", "type"]

# Texts and starts that look wrong as diagnoses.
GENERIC = ["gan", "cấp", "ung thư", "hội chứng", "bệnh", "viêm"]
PROCEDURES = ["phẫu thuật", "cắt bỏ", "nối ", "mổ ", "đặt stent", "sinh thiết"]


def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def type_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, before, after, delta) of all types of either run."""
    both = before.select("type", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("type", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy("type").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum(F.col("a") - F.col("b")).alias("delta"))


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose key ``before`` has not; repeated ones as often."""
    return after.join(before.select(*KEY).distinct(), KEY, "left_anti")


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    return added(after, before)


def changed(before: DataFrame, after: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of ``after`` with ``old``, the other candidates that the last row of that key had
    before."""
    last = W.partitionBy(*KEY).orderBy(F.col(order).desc())
    old = before.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*KEY, F.col("candidates").alias("old"))
    return after.join(old, KEY).where(F.col("old") != F.col("candidates"))


def suspicious(rows: DataFrame) -> DataFrame:
    """Rows with ``reason``, one for each heuristic that a row meets."""
    normal, first = normalize_text("text"), F.get("candidates", F.lit(0))
    procedure = starts_with_any(normal, PROCEDURES)
    syndrome = F.startswith(casefold("text"), F.lit("hội chứng")) & (first == "G20.C") & ~F.contains(normal, F.lit("parkinson"))
    tests = [("generic diagnosis", normal.isin(GENERIC)), ("procedure as diagnosis", procedure), ("syndrome mapped to Parkinson", syndrome), ("biliary text mapped to thyroid", F.contains(normal, F.lit("mật")) & (first == "C73"))]
    reasons = F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests])
    hit = rows.where(F.col("type") == DIAGNOSIS).withColumn("reason", F.explode(F.filter(reasons, lambda x: x.isNotNull())))
    return hit


def _cell(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def report(before: DataFrame, after: DataFrame, names: tuple[str, str] = ("before", "after"), most: int = 80) -> str:
    """A Markdown report; lists show at most ``most`` rows, whole counts are given."""
    lines = ["# Comparison of runs", "", f"- Before: `{names[0]}`", f"- After: `{names[1]}`", "", "## Types", "", "| Type | Before | After | Delta |", "|---|---:|---:|---:|"]
    counts = type_counts(before, after).orderBy("type").collect()
    lines += [f"| {r.type} | {r.before} | {r.after} | {r.delta:+d} |" for r in counts]
    lines.append(f"| **TOTAL** | **{sum(r.before for r in counts)}** | **{sum(r.after for r in counts)}** | **{sum(r.delta for r in counts):+d}** |")
    for title, frame, extra in (("Changed candidates", changed(before, after), "old"), ("Added", added(before, after), None), ("Dropped", dropped(before, after), None), ("Suspicious", suspicious(after), "reason")):
        n = frame.count()
        lines += ["", f"## {title}", ""]
        if not n:
            lines.append("None.")
            continue
        lines += [f"| File | Text | Type | Span | Candidates |{f' {extra.capitalize()} |' if extra else ''}", "|---|---|---|---:|---|" + ("---|" if extra else "")]
        for r in frame.orderBy("file", "start", "end", "type", "text").limit(most).collect():
            more = "" if not extra else f" {', '.join(r[extra]) if isinstance(r[extra], list) else r[extra]} |"
            lines.append(f"| {r.file} | {r.text} | {r.type} | [{r.start}, {r.end}) | {', '.join(r.candidates)} |{more}")
        if n > most:
            lines.append(f"\n... {n - most} more")
    return "\n".join(lines) + "\n"
