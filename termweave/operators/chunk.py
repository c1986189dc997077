"""Chunking of documents at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boundaries by preference; each pattern ends where a chunk may end. The last place in
#: the window counts.
SENTENCE = re.compile(r"(?s:.*)[.!?;](?=\s)")
CLAUSE = re.compile(r"(?s:.*)[,:](?=\s)")
BLANK = re.compile(r"(?s:.*)\s")
WORD_EDGE = re.compile(r"(?<=\s)|(?=\s)")
CHUNK = "chunk_index int, start int, end int, text string"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in code points. A text up to ``no_split`` stays whole."""

    target: int = 200
    least: int = 150
    most: int = 250
    overlap: int = 0
    no_split: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("sizes must hold 0 < least <= target <= most")
        if not 0 <= self.overlap < self.least:
            raise ValueError("overlap must be at least 0 and less than the least size")
        if self.no_split is not None and self.no_split < 0:
            raise ValueError("no_split must not be negative")


#: For whole notes.
NOTES = ChunkConfig(600, 300, 800, 0, 1500)


def chunk_end(text: str, start: int, config: ChunkConfig) -> int:
    if len(text) - start <= config.most:
        return len(text)
    low, high = start + config.least, start + config.most
    # a blank line may begin at the last place and end one behind it
    if (at := text.rfind("\n\n", low, high + 1)) >= 0:
        return at + 2
    if (at := text.rfind("\n", low, high)) >= 0:
        return at + 1
    for pattern in (SENTENCE, CLAUSE):
        if found := pattern.match(text, low, high + 1):
            return found.end()
    if found := BLANK.match(text, low, high):
        return found.end()
    return start + config.target


def split_text(text: str | None, config: ChunkConfig) -> list[tuple[int, int]]:
    """[start, end) of the chunks of a text."""
    if not text:
        return []
    if config.no_split is not None and len(text) <= config.no_split:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = chunk_end(text, start, config)
        out.append((start, end))
        if end >= len(text):
            return out
        start = end if not config.overlap else next_start(text, start, end, config.overlap)


def next_start(text: str, start: int, end: int, overlap: int) -> int:
    """The first edge of a word in the last ``overlap`` code points, at most ``end``."""
    found = WORD_EDGE.search(text, max(start + 1, end - overlap), end)
    return found.start() if found else end


#: Code points of the texts whose chunks a worker holds at once (one text at least).
HELD_CHARS = 1 << 20


def chunk_batches(batches: Iterator[pa.RecordBatch], config: ChunkConfig) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of (doc_id, text), in batches of the chunks of HELD_CHARS."""

    def made(ids: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        row, *columns = zip(*held)
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.string()
        cut = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *cut], ["doc_id", "chunk_index", "start", "end", "text"])

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        held, size = [], 0
        for row in range(len(texts)):
            text = texts[row].as_py()
            held += [(row, k, a, b, text[a:b]) for k, (a, b) in enumerate(split_text(text, config))]
            size += len(text or "")
            if held and size >= HELD_CHARS:
                yield made(ids, held)
                held, size = [], 0
        if held:
            yield made(ids, held)


def chunks(documents: DataFrame, config: ChunkConfig = NOTES) -> DataFrame:
    """(doc_id, chunk_index, start, end, text) of each chunk; an empty or null text has
    none. ``text`` of the source from start to end is the chunk's text. Chunks leave a worker
    in small batches, however many documents come in at once."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: chunk_batches(batches, config), f"doc_id {kind}, {CHUNK}")
