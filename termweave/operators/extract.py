"""Extractors: from chunks to entities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.spans import let, literal_matches
from termweave.functions.text import casefold, contains_any
from termweave.operators import chunk as chunking
from termweave.operators.model_json import FAILED, debug_rows, parse_answers
from termweave.operators.postprocess import clean, dedupe_richest, repair
from termweave.sources.scratch import stage
from termweave.sources.sinks import write_texts
from termweave.schema import ASSERTIONS, DIAGNOSIS, DRUG, ENTITY, FAMILY, HISTORICAL, NEGATED, SYMPTOM, TYPES

# Patterns of the rule extractor in order, and words that set an assertion.
PATTERNS = [("đái tháo đường tuýp 2", DIAGNOSIS), ("đái tháo đường", DIAGNOSIS), ("Type 2 diabetes mellitus", DIAGNOSIS), ("Aspirin", DRUG), ("aspirin", DRUG), ("ho", SYMPTOM), ("sốt", SYMPTOM)]
NEGATED_WORDS = ["không", "phủ nhận", "chưa ghi nhận", "âm tính"]
HISTORY_WORDS = ["tiền sử", "từng", "đã dùng", "trước nhập viện"]
FAMILY_WORDS = ["bố", "mẹ", "gia đình", "người thân"]
ASSERTION_WINDOW = 30

PROMPT = """Nhiệm vụ: trích xuất thực thể y khoa từ đoạn CHUNK và chỉ trả về một đối tượng JSON {{"entities": [...]}}.
Mỗi thực thể có năm khóa: "text" (nguyên văn trong CHUNK), "position" ([start, end) tính theo ký tự trong CHUNK), "type" (một trong: {types}), "assertions" (danh sách con của: {assertions}), "candidates" (luôn là []).
Khi không chắc chắn thì bỏ qua. Bỏ qua người, vai trò, từ chung chung và gen.

CHUNK:
{chunk}

JSON:
"""


def assertions_near(text: Column, start: Column) -> Column:
    """Assertions that words in the signs before a mention set."""
    low = F.greatest(F.lit(0), start - ASSERTION_WINDOW)
    window = casefold(F.substr(text, low + 1, start - low))

    def judge(w: Column) -> Column:
        found = F.array(
            F.when(contains_any(w, NEGATED_WORDS), NEGATED),
            F.when(contains_any(w, HISTORY_WORDS), HISTORICAL),
            F.when(contains_any(w, FAMILY_WORDS), FAMILY),
        )
        return F.filter(found, lambda x: x.isNotNull())

    return let(window, judge)


class Extractor(Protocol):
    """Adds ``entities`` (places in the chunk) to chunks; null entities mean failure."""

    def extract(self, chunks: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleExtractor:
    """Fixed patterns, found by built-in functions. Each span counts once, for the first
    pattern that has it."""

    patterns: tuple[tuple[str, str], ...] = tuple(PATTERNS)

    def entities(self, text: Column) -> Column:
        def of(pattern: str, kind: str) -> Column:
            def one(m: Column) -> Column:
                return F.struct(
                    F.lit(pattern).alias("text"),
                    F.array(m["start"], m["end"]).alias("position"),
                    F.lit(kind).alias("type"),
                    assertions_near(text, m["start"]).alias("assertions"),
                    F.array().cast("array<string>").alias("candidates"),
                )

            return F.when(F.contains(text, F.lit(pattern)), F.transform(literal_matches(text, pattern), one)).otherwise(F.array().cast(f"array<{ENTITY}>"))

        found = F.concat(*[of(p, k) for p, k in self.patterns])

        def once(all_: Column) -> Column:
            spans = F.transform(all_, lambda e: e["position"])
            return let(spans, lambda s: F.filter(all_, lambda e, i: F.array_position(s, e["position"]) == i + 1))

        return let(found, once)

    def extract(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("entities", self.entities(F.col("text")))


def prompt_for(text: Column, template: str = PROMPT) -> Column:
    head, _, tail = template.partition("{chunk}")
    fill = {"types": ", ".join(TYPES), "assertions": ", ".join(ASSERTIONS)}
    return F.concat(F.lit(head.format(**fill)), text, F.lit(tail.format(**fill)))


class Model(Protocol):
    """A language model; loaded once in each worker, on first use."""

    def load(self) -> None: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class ModelExtractor:
    """A model behind Arrow batches. A failing batch is tried chunk by chunk; a failing
    chunk gives a null answer and null entities. Chunks without an entity are written to
    ``debug_dir``, if there is one, with prompt and answer."""

    model: Model
    template: str = PROMPT
    batch_size: int = 16
    debug_dir: str | None = None

    def answers(self, chunks: DataFrame) -> DataFrame:
        model, size = self.model, self.batch_size
        prompted = chunks.withColumn("prompt", prompt_for(F.col("text"), self.template))

        def ask(prompts: list[str]) -> list[str | None]:
            try:
                return list(model.generate(prompts))
            except Exception:
                return [None] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model.load()
            for batch in batches:
                prompts = batch["prompt"].tolist()
                yield batch.assign(generated=[a for k in range(0, len(prompts), size) for a in ask(prompts[k : k + size])])

        fields = ", ".join(f"`{n}` {t}" for n, t in prompted.dtypes)
        return prompted.mapInPandas(run, f"{fields}, generated string")

    def extract(self, chunks: DataFrame) -> DataFrame:
        parsed = parse_answers(self.answers(chunks))
        if self.debug_dir:
            parsed = stage(parsed, "answers")
            write_texts(debug_rows(parsed), self.debug_dir)
        failed = F.col("generated").isNull() | (F.col("outcome") == FAILED)
        return parsed.withColumn("entities", F.when(~failed, F.col("entities"))).drop("prompt", "generated", "outcome")


def extract_entities(documents: DataFrame, extractor: Extractor, config: chunking.ChunkConfig = chunking.NOTES, skip_failed: bool = True) -> DataFrame:
    """(doc_id, ord, text, position, type, assertions, candidates) of whole documents:
    chunked, extracted, repaired, without repeats, noise and nested spans. A failed chunk is
    skipped, or fails the job if ``skip_failed`` is off."""
    found = extractor.extract(chunking.chunks(documents, config))
    entities = F.col("entities") if skip_failed else F.coalesce("entities", F.raise_error(F.lit("extraction failed")).cast(f"array<{ENTITY}>"))
    rows = found.select("doc_id", "chunk_index", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), F.col("text").alias("chunk_text"), F.posexplode(entities).alias("k", "e"))
    # chunks come in order, entities in order within a chunk
    order = F.col("chunk_index").cast("long") * (1 << 32) + F.col("k")
    rows = rows.select("doc_id", order.alias("ord"), "chunk_start", "chunk_end", "chunk_text", "e.*")
    done = clean(dedupe_richest(repair(rows).drop("chunk_start", "chunk_end", "chunk_text")))
    return done.select("doc_id", "ord", "text", "position", "type", "assertions", "candidates")
