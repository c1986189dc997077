"""Checking submissions against their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.spans import let, slice_text
from termweave.schema import ASSERTION_TYPES, ASSERTIONS, CANDIDATE_TYPES, KEYS, TYPES, among

ISSUE = "struct<code:string,message:string>"


def _issue(when: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is(value: Column, kind: str) -> Column:
    return F.startswith(_kind(value), F.lit(kind))


def _shown(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def _whole(value: Column) -> Column:
    """Whole numbers; true and false count, as they do in Python."""
    return F.startswith(_kind(value), F.lit("BIGINT")) | F.startswith(_kind(value), F.lit("BOOLEAN"))


def _number(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "long"), F.try_variant_get(value, "$", "boolean").cast("long"))


def entity_issues(value: Column, source: Column) -> Column:
    """array<struct<code,message>> of one entity (a variant) of a text."""

    def of(v: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(v, f"$.{name}", "variant")

        keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
        required = F.array(*map(F.lit, KEYS))
        missing, extra = F.array_sort(F.array_except(required, keys)), F.array_sort(F.array_except(keys, required))
        text = F.when(_is(field("text"), "STRING"), F.try_variant_get(v, "$.text", "string"))
        kind = F.when(_is(field("type"), "STRING"), F.try_variant_get(v, "$.type", "string"))
        places = F.try_variant_get(v, "$.position", "array<variant>")
        two = F.coalesce((F.size(places) == 2) & F.forall(places, _whole), F.lit(False))
        start, end = (_number(F.get(places, F.lit(k))) for k in (0, 1))
        inside = two & (start >= 0) & (start < end) & (end <= F.length(source))
        marks = F.try_variant_get(v, "$.assertions", "array<variant>")
        codes = F.try_variant_get(v, "$.candidates", "array<variant>")
        good_codes = F.coalesce(F.forall(codes, lambda c: _is(c, "STRING")), F.lit(False))
        known = among(kind, TYPES)
        part = slice_text(source, start.cast("int"), end.cast("int"))
        bad_marks = F.transform(F.filter(marks, lambda m: ~(_is(m, "STRING") & among(F.try_variant_get(m, "$", "string"), ASSERTIONS))), lambda m: F.struct(F.lit("invalid_assertion").alias("code"), F.concat(F.lit("invalid assertion: "), _shown(m)).alias("message")))
        none = F.array().cast(f"array<{ISSUE}>")
        issues = F.concat(
            F.array(
                _issue(F.size(missing) > 0, "missing_keys", F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
                _issue(F.size(extra) > 0, "extra_keys", F.concat(F.lit("extra keys: "), F.array_join(extra, ", "))),
                _issue(F.coalesce(text == "", F.lit(True)), "invalid_text", "text must be a non-empty string"),
                _issue(~known, "invalid_type", F.concat(F.lit("invalid type: "), _shown(field("type")))),
                _issue(~two, "invalid_position", "position must be [int, int]"),
                _issue(two & ~inside, "position_out_of_bounds", F.concat(F.lit("span ["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit(") in a text of length "), F.length(source).cast("string"))),
                _issue(F.coalesce(inside & (part != text), F.lit(False)), "span_text_mismatch", F.concat(F.lit("the span holds '"), part, F.lit("', not '"), text, F.lit("'"))),
                _issue(marks.isNull(), "invalid_assertions", "assertions must be a list"),
            ),
            F.coalesce(bad_marks, none),
            F.array(
                _issue(known & ~among(kind, ASSERTION_TYPES) & (F.size(marks) > 0), "assertions_not_allowed", F.concat(F.lit("assertions not allowed for type "), kind)),
                _issue(~good_codes, "invalid_candidates", "candidates must be a list of strings"),
                _issue(good_codes & known & ~among(kind, CANDIDATE_TYPES) & (F.size(codes) > 0), "candidates_not_allowed", F.concat(F.lit("candidates not allowed for type "), kind)),
            ),
        )
        alone = F.array(F.struct(F.lit("entity_not_object").alias("code"), F.lit("entity must be a JSON object").alias("message")))
        return F.when(_is(v, "OBJECT"), F.filter(issues, lambda i: i.isNotNull())).otherwise(alone)

    return let(value, of)


def validate(documents: DataFrame, submissions: DataFrame, missing_inputs: DataFrame | None = None) -> DataFrame:
    """(file, entity_index, code, message): all issues of the submissions (doc_id, body) of
    the documents (doc_id, text). Submissions without a document are ignored. Documents of
    ``missing_inputs`` (doc_id) get that issue alone."""
    both = documents.join(submissions.select("doc_id", "body"), "doc_id", "left").withColumn("file", F.concat(F.col("doc_id").cast("string"), F.lit(".json")))
    value = F.try_parse_json("body")
    both = both.withColumn("v", value)
    whole = F.array(
        _issue(F.col("body").isNull(), "missing_output", "output file not found"),
        _issue(F.col("body").isNotNull() & F.col("v").isNull(), "invalid_json", "the file is not JSON"),
        _issue(F.col("v").isNotNull() & ~_is(F.col("v"), "ARRAY"), "root_not_array", "submission root must be a JSON array"),
    )
    files = both.select("file", F.lit(None).cast("int").alias("entity_index"), F.explode(F.filter(whole, lambda i: i.isNotNull())).alias("i"))
    parts = both.where(_is(F.col("v"), "ARRAY")).select("file", "text", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("entity_index", "e"))
    single = parts.select("file", "entity_index", F.explode(entity_issues(F.col("e"), F.col("text"))).alias("i"))
    out = files.unionByName(single).select("file", "entity_index", "i.code", "i.message")
    if missing_inputs is not None:
        gone = missing_inputs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file"), F.lit(None).cast("int").alias("entity_index"), F.lit("missing_input").alias("code"), F.lit("input file not found").alias("message"))
        out = out.unionByName(gone)
    return out


def summary(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: checked_files, valid_files, invalid_files, issues."""
    bad = issues.agg(F.count_distinct("file").alias("invalid_files"), F.count(F.lit(1)).alias("issues"))
    n = documents.agg(F.count(F.lit(1)).alias("checked_files"))
    one = n.join(bad)  # two single rows
    return one.select("checked_files", (F.col("checked_files") - F.col("invalid_files")).alias("valid_files"), "invalid_files", "issues")
