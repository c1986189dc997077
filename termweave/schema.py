"""Schemas and constants of entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types, assertions and keys of a submission.
SYMPTOM, TEST, RESULT, DIAGNOSIS, DRUG = "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"
TYPES = [SYMPTOM, TEST, RESULT, DIAGNOSIS, DRUG]
NEGATED, FAMILY, HISTORICAL = "isNegated", "isFamily", "isHistorical"
ASSERTIONS = [NEGATED, FAMILY, HISTORICAL]
CANDIDATE_TYPES = [DIAGNOSIS, DRUG]
ASSERTION_TYPES = [SYMPTOM, DIAGNOSIS, DRUG]
KEYS = ["text", "type", "candidates", "assertions", "position"]

DOCUMENTS = "doc_id string, text string"
CHUNKS = "doc_id string, chunk_index int, start int, end int, text string"
ENTITY = "struct<text:string,position:array<int>,type:string,assertions:array<string>,candidates:array<string>>"
ENTITIES = "doc_id string, ord int, text string, position array<int>, type string, assertions array<string>, candidates array<string>"
RESULTS = "query_id string, id string, score double, text string, source string"


def among(value: Column, allowed: list[str]) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def entity_faults(text: Column, position: Column, kind: Column, assertions: Column, candidates: Column) -> Column:
    """Names of the rules that an entity breaks; none if it is valid."""
    start, end = F.get(position, F.lit(0)), F.get(position, F.lit(1))
    span = F.coalesce((F.size(position) == 2) & (start >= 0) & (start < end), F.lit(False))
    distinct = F.array_distinct(assertions)
    bad = F.array(
        F.when(F.coalesce(text == "", F.lit(True)), "text"),
        F.when(~span, "position"),
        F.when(~among(kind, TYPES), "type"),
        F.when(F.exists(assertions, lambda a: ~among(a, ASSERTIONS)) | (F.size(assertions) > 3), "assertions"),
        F.when(among(kind, TYPES) & ~among(kind, ASSERTION_TYPES) & (F.size(distinct) > 0), "assertions_not_allowed"),
        F.when(among(kind, TYPES) & ~among(kind, CANDIDATE_TYPES) & (F.size(candidates) > 0), "candidates_not_allowed"),
    )
    return F.filter(bad, lambda x: x.isNotNull())
