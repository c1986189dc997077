"""From extracted entities of chunks to clean entities of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from termweave.functions.spans import correct_span, to_global
from termweave.functions.text import normalize_text, starts_with_any
from termweave.schema import DIAGNOSIS, SYMPTOM

# Texts that are no entities, for all types and for single ones.
NOISE = ["bé trai", "bé gái", "trẻ", "trẻ sơ sinh", "con", "bác sĩ", "bệnh nhân", "người bệnh", "bệnh", "thuốc", "thực phẩm", "hóa chất", "khám", "chẩn đoán", "vận động", "nhiễm sắc thể x", "xq28", "gen g6pd"]
ROLES = ["bé trai", "bé gái", "trẻ", "trẻ sơ sinh", "con", "bác sĩ", "bệnh nhân", "người bệnh"]
DIAGNOSIS_WORDS = ["bệnh", "chẩn đoán"]
DIAGNOSIS_GENERIC = ["cấp", "gan", "hội chứng", "ung thư", "bệnh lý"]
SYMPTOM_WORDS = ["hồng cầu", "sơ sinh", "biến chứng", "sàng lọc sớm", "sàng lọc sớm các bệnh bẩm sinh"]
SYMPTOM_GENES = ["men g6pd", "g6pd", "gen g6pd"]
PROCEDURE_STARTS = ["phẫu thuật", "cắt bỏ", "nối ", "mổ ", "sinh thiết", "đặt stent", "can thiệp"]
UNIT_ONLY = r"(?iu)^\d+(?:[.,]\d+)?\s*(?:kg|g|mg|mcg|microgam|[µμ]g|ug|nanogam/ml|ng/ml|w|tuần)$"


def richness(entity: Column | None = None) -> Column:
    a, c = F.col("assertions"), F.col("candidates")
    return F.coalesce(F.size(a), F.lit(0)) + F.coalesce(F.size(c), F.lit(0))


def repair(entities: DataFrame) -> DataFrame:
    """Entities of chunks, with ``chunk_start``, ``chunk_end`` and ``chunk_text``, at places
    of the document; those whose text has no clear place are dropped."""
    span = correct_span(F.col("chunk_text"), F.col("text"), F.get("position", F.lit(0)), F.get("position", F.lit(1)))
    fixed = entities.withColumn("__span", span).where("__span IS NOT NULL")
    placed = fixed.withColumn("__span", to_global(F.col("chunk_start"), F.col("chunk_end"), F.col("__span.start"), F.col("__span.end")))
    return placed.where("__span IS NOT NULL").withColumn("position", F.array("__span.start", "__span.end")).drop("__span")


def dedupe_richest(entities: DataFrame) -> DataFrame:
    """One entity for each (doc_id, type, text, position): the one with most assertions and
    candidates, the first of equal ones, at the place of the first."""
    key = W.partitionBy("doc_id", "type", "text", "position")
    ranked = entities.withColumns({"__rank": F.row_number().over(key.orderBy(richness().desc(), "ord")), "__first": F.min("ord").over(key)})
    return ranked.where("__rank = 1").withColumn("ord", F.col("__first")).drop("__rank", "__first")


def noisy(text: Column, kind: Column) -> Column:
    """Whether an entity is an obvious false find."""
    normal = normalize_text(text)
    diagnosis = normal.isin(DIAGNOSIS_WORDS + DIAGNOSIS_GENERIC) | starts_with_any(normal, PROCEDURE_STARTS)
    symptom = normal.isin(ROLES + SYMPTOM_WORDS + SYMPTOM_GENES)
    return F.coalesce(normal.isin(NOISE) | normal.rlike(UNIT_ONLY) | ((kind == DIAGNOSIS) & diagnosis) | ((kind == SYMPTOM) & symptom), F.lit(False))


def drop_noise(entities: DataFrame) -> DataFrame:
    return entities.where(~noisy(F.col("text"), F.col("type")))


def drop_nested(entities: DataFrame) -> DataFrame:
    """Without entities that lie inside a longer one of the same document and type that is
    at least as rich.

    Spans that contain an entity are found by windows, without pairs: for each richness
    level that occurs (few), the spans at least that rich are swept in order of start.
    """
    rows = entities.withColumns({"__s": F.get("position", F.lit(0)), "__e": F.get("position", F.lit(1)), "__r": richness()})
    # a longer span that contains [s, e) starts before s and reaches e, or starts at s and
    # reaches beyond e; the furthest end so far among spans as rich tells
    levels = W.partitionBy("doc_id", "type")
    rows = rows.withColumn("__levels", F.collect_set("__r").over(levels))
    marks = rows.select("*", F.explode(F.filter("__levels", lambda v: v <= F.col("__r"))).alias("__level"))
    order = W.partitionBy("doc_id", "type", "__level").orderBy("__s")
    before = F.max("__e").over(order.rangeBetween(W.unboundedPreceding, -1))
    same = F.max("__e").over(W.partitionBy("doc_id", "type", "__level", "__s"))
    judged = marks.withColumns({"__before": before, "__same": same}).where("__level = __r")
    inside = F.coalesce(F.col("__before") >= F.col("__e"), F.lit(False)) | (F.col("__same") > F.col("__e"))
    return judged.where(~inside).select(*entities.columns)


def clean(entities: DataFrame) -> DataFrame:
    return drop_nested(drop_noise(entities))
