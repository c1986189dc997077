"""The whole batch: texts to linked entities to submissions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.chunk import NOTES, ChunkConfig
from termweave.operators.extract import Extractor, RuleExtractor, extract_entities
from termweave.operators.link import Knowledge, LinkConfig, link_entities
from termweave.sources import sinks
from termweave.sources.scratch import scope, stage


@dataclass(frozen=True)
class BatchConfig:
    chunks: ChunkConfig = NOTES
    link: LinkConfig = field(default_factory=LinkConfig)
    skip_failed: bool = True


def linked(documents: DataFrame, extractor: Extractor, knowledge: Knowledge, config: BatchConfig = BatchConfig()) -> DataFrame:
    """(doc_id, ord, text, position, type, assertions, candidates) of documents (doc_id,
    text). The entities are read twice, for the distinct mentions and for the join, so they
    are written; a model is asked once."""
    entities = stage(extract_entities(documents, extractor, config.chunks, config.skip_failed), "entities")
    return link_entities(entities, knowledge, config.link)


def link_batch(documents: DataFrame, knowledge: Knowledge, extractor: Extractor | None = None, config: BatchConfig = BatchConfig()) -> DataFrame:
    """(doc_id, body): the submission of each document."""
    entities = linked(documents, extractor or RuleExtractor(), knowledge, config)
    return sinks.submissions(documents, entities)


#: Bits of the hash of an id by which documents are parted.
MOST_BITS = 40


def link_files(documents: DataFrame, knowledge: Knowledge, extractor: Extractor | None, folder: str, safe: bool = False, config: BatchConfig = BatchConfig()) -> tuple[int, list[tuple[str, str]]]:
    """Write the submissions of documents into ``folder``: the number of files, and the
    documents that failed with the reason.

    With ``safe``, a batch that fails is parted by hashes of the ids until single documents
    fail; these get an empty list and the others their results. If an empty document fails
    too, documents are not the cause, and the error is raised."""
    spark = documents.sparkSession
    placed = documents.select("doc_id", "text", F.xxhash64("doc_id").alias("__h"))

    def attempt(bits: int, value: int) -> tuple[int, list[tuple[str, str]]]:
        part = placed.where(F.pmod("__h", F.lit(1 << bits)) == value).drop("__h") if bits else documents
        try:
            with scope():
                return sinks.write_submissions(link_batch(part, knowledge, extractor, config), folder), []
        except Exception as bad:
            if not safe:
                raise
            if not bits:
                with scope():
                    link_batch(spark.createDataFrame([("", "")], "doc_id string, text string"), knowledge, extractor, config).collect()
            ids = [r.doc_id for r in part.select("doc_id").limit(2).collect()]
            if len(ids) > 1 and bits < MOST_BITS:
                (a, lost), (b, more) = attempt(bits + 1, value), attempt(bits + 1, value + (1 << bits))
                return a + b, lost + more
            n = sinks.write_submissions(part.select("doc_id", F.lit("[]").alias("body")), folder) if ids else 0
            return n, [(i, str(bad).strip().split("\n")[0]) for i in ids]

    return attempt(0, 0)
