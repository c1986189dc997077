"""Reading the JSON that a model writes: strict, tolerant, salvaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.spans import let
from termweave.functions.text import strip
from termweave.schema import ASSERTION_TYPES, ASSERTIONS, CANDIDATE_TYPES, ENTITY, TYPES, among, entity_faults

#: Outcomes: nothing was written; the whole answer is valid; single entities were mended or
#: dropped; flat objects were taken out of broken JSON; the JSON has another shape.
EMPTY, STRICT, TOLERANT, SALVAGED, FAILED = "empty", "strict", "tolerant", "salvaged", "failed"
FLAT_OBJECT = r"\{[^{}]+\}"


FIELDS = "struct<text:variant,type:variant,position:variant,assertions:variant,candidates:variant>"


def _schema(value: Column) -> Column:
    """The JSON kind of a variant; empty for none."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _string(value: Column) -> Column:
    """A string; null if it is something else."""
    return F.when(_schema(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _all(value: Column, kind: str, item: str) -> Column:
    """A list whose items are all of one JSON kind; null if it is something else."""
    same = F.when(_schema(value).isin(f"ARRAY<{kind}>", "ARRAY<VOID>"), F.try_variant_get(value, "$", f"array<{item}>"))
    # a null has no kind of its own
    return let(same, lambda x: F.when(F.forall(x, lambda y: y.isNotNull()), x))


def fields_of(value: Column) -> Column:
    """The fields of a variant object, taken out once for both readings; ``candidates`` is null
    where the list is not one of strings."""
    none = F.array().cast("array<string>")

    def typed(f: Column) -> Column:
        assertions = F.when(f["assertions"].isNull(), none).otherwise(F.array_distinct(_all(f["assertions"], "STRING", "string")))
        candidates = F.when(f["candidates"].isNull() | F.is_variant_null(f["candidates"]), none).otherwise(F.try_variant_get(f["candidates"], "$", "array<string>"))
        return F.struct(_string(f["text"]).alias("text"), _all(f["position"], "BIGINT", "int").alias("position"), _string(f["type"]).alias("type"), assertions.alias("assertions"), candidates.alias("candidates"))

    return let(F.try_variant_get(value, "$", FIELDS), typed)


def entity_from(fields: Column, mend: bool) -> Column:
    """An entity struct from the fields of an object, null if it is not valid. ``mend`` empties
    lists that the type does not allow."""

    def judge(e: Column) -> Column:
        whole = e["text"].isNotNull() & e["position"].isNotNull() & e["type"].isNotNull() & e["assertions"].isNotNull() & e["candidates"].isNotNull()
        good = whole & (F.size(entity_faults(e["text"], e["position"], e["type"], e["assertions"], e["candidates"])) == 0)
        return F.when(F.coalesce(good, F.lit(False)), e)

    if not mend:
        return judge(fields)
    none = F.array().cast("array<string>")
    assertions = F.when(among(fields["type"], ASSERTION_TYPES), fields["assertions"]).otherwise(none)
    candidates = F.when(among(fields["type"], CANDIDATE_TYPES), fields["candidates"]).otherwise(none)
    made = F.struct(fields["text"].alias("text"), fields["position"].alias("position"), fields["type"].alias("type"), assertions.alias("assertions"), candidates.alias("candidates"))
    return let(made, judge)


def entity_of(value: Column, mend: bool) -> Column:
    """An entity struct from a variant object, null if it is not valid."""
    return let(fields_of(value), lambda f: entity_from(f, mend))


def _good(items: Column, mend: bool) -> Column:
    """The valid entities of an array of fields."""
    return F.filter(F.transform(items, lambda f: entity_from(f, mend)), lambda e: e.isNotNull())


def parse_answer(text: Column) -> Column:
    """struct<outcome, entities> of a model's answer."""
    none = F.array().cast(f"array<{ENTITY}>")
    bare = strip(F.coalesce(text, F.lit("")))
    first, last = F.locate("{", bare), F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    has = (first > 0) & (F.locate("}", bare) > 0) & (last >= first)
    body = F.when(has, F.substr(bare, first, last - first + 1))

    def flat(t: Column) -> Column:
        parsed = F.transform(F.regexp_extract_all(t, F.lit(FLAT_OBJECT), F.lit(0)), lambda o: F.try_parse_json(o))
        return let(F.transform(F.filter(parsed, lambda v: v.isNotNull()), fields_of), lambda i: _good(i, True))

    def read(v: Column) -> Column:
        field = F.try_variant_get(v, "$.entities", "variant")
        items = F.when(field.isNull(), F.array().cast("array<variant>")).otherwise(F.try_variant_get(field, "$", "array<variant>"))

        def judge(i: Column) -> Column:
            strict = _good(i, False)
            return F.when(i.isNull(), F.struct(F.lit(FAILED).alias("outcome"), none.alias("entities"))).otherwise(
                let(strict, lambda s: F.when(F.size(s) == F.size(i), F.struct(F.lit(STRICT).alias("outcome"), s.alias("entities"))).otherwise(F.struct(F.lit(TOLERANT).alias("outcome"), _good(i, True).alias("entities"))))
            )

        return let(F.transform(items, fields_of), judge)

    value = F.try_parse_json(body)
    return (
        F.when(bare == "", F.struct(F.lit(EMPTY).alias("outcome"), none.alias("entities")))
        .when(value.isNull(), F.struct(F.lit(SALVAGED).alias("outcome"), flat(bare).alias("entities")))
        .otherwise(let(value, read))
    )


def parse_answers(raw: DataFrame) -> DataFrame:
    """``raw`` with columns ``outcome`` and ``entities`` from its column ``generated``."""
    return raw.withColumn("__p", parse_answer(F.col("generated"))).select(*raw.columns, "__p.outcome", "__p.entities")


def debug_rows(parsed: DataFrame) -> DataFrame:
    """(name, body) of files on chunks that gave no entity or failed: chunk, prompt, answer."""
    rows = parsed.where((F.col("outcome") == FAILED) | (F.size("entities") == 0))
    shown = F.when(F.coalesce("generated", F.lit("")) == "", F.lit("<empty>")).otherwise(F.col("generated"))
    name = F.concat(F.regexp_replace("doc_id", "[/\\\\]", "_"), F.lit("_chunk_"), F.concat_ws("_", "chunk_index", "start", "end"), F.lit(".txt"))
    body = F.concat(F.lit("=== CHUNK ===\n"), "text", F.lit("\n\n=== PROMPT ===\n"), "prompt", F.lit("\n\n=== RAW GENERATED TEXT ===\n"), shown, F.lit("\n"))
    return rows.select(name.alias("name"), body.alias("body"))


__all__ = ["ASSERTIONS", "TYPES", "debug_rows", "entity_of", "parse_answer", "parse_answers"]
