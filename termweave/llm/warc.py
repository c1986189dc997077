"""WARC archives: writing, reading and segment reassembly (operator 4).

Writing renders one WARC/1.1 record per page as text: an HTTP message whose body is in
chunked transfer framing, inside a ``response`` record; a payload equal to an earlier one
becomes a ``revisit`` record that names the record of the earlier one. A record block longer
than ``SEGMENT`` code points is cut: the first part stays in the record with
``WARC-Segment-Number: 1``, each later part is a ``continuation`` record that names the first
by ``WARC-Segment-Origin-ID``; the last one carries ``WARC-Segment-Total-Length``. Records end
with two CRLFs, which Spark's text writer puts between rows, so archives go through any file
system that Spark writes to. There are no ``warcinfo`` records.

Reading streams compressed archives of any size through Spark's text reader, which cuts them
where a record may begin; the pieces are put together again by Content-Length, so a task
holds one record (and a file that is not compressed, which is read whole). Continuations are
grouped by origin, ordered by segment number, numbers and total length are verified, the
parts are joined once, and the chunked framing is decoded. Parts of one record may lie in
different files. The payload of a revisit is that of the record it names: its length and
digest are taken from there and held against those that its header states.

Defined results: a null html has an empty payload; payloads under ``LEAST_REVISIT`` bytes
are never revisits; equal payloads refer to the row of least page_id (repeated rows with
that least id: all but one revisit it; a null page_id orders last); records with a missing segment, a
wrong total length or broken framing come back with ``error`` set and no payload; a revisit
whose record is missing or has another digest is an error; an archive cut short or with bytes
between records fails the job; an archive without records gives no rows; an empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import attach, attach_counted, drop_at_end, shared_dir, stage, table

LEAST_REVISIT = 100
SEGMENT = 16_000
CHUNK = 4_000
CRLF = "\r\n"
#: Rows of one archive file at most.
FILE_ROWS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def byte_len(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def pieces(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points; most texts are one."""
    return F.when(F.length(text) <= size, F.filter(F.array(text), lambda t: t != "")).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def chunked(payload: Column) -> Column:
    """The payload in chunked transfer framing: chunks of CHUNK code points."""

    def one(part: Column) -> Column:
        return F.concat(F.lower(F.hex(byte_len(part))), F.lit(CRLF), part, F.lit(CRLF))

    return F.concat(F.array_join(F.transform(pieces(payload, CHUNK), one), ""), F.lit("0" + CRLF + CRLF))


def record_id(page_id: Column, tag: Column) -> Column:
    """A record's name: a UUID of the page's id and of its place in the table."""
    h = F.md5(F.concat_ws(":", page_id.cast("string"), tag.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substr(h, F.lit(at), F.lit(n)) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, bytes, tag (the row's number), record_type and
    refers_to (the name of the record that has the payload) of each page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"), byte_len(html).alias("bytes"))
    # seen: which of the rows with this digest is the first; by id alone it can be several
    rows = rows.withColumn("tag", F.monotonically_increasing_id())
    # written once: the tags must not change between the two readings
    rows = stage(rows, "warc-pages")
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "tag"))
    counted = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).where("n > 1")
    firsts = stage(counted.select("digest", "n", F.col("f.page_id").alias("first_id"), F.col("f.tag").alias("first_tag")), "warc-firsts")
    both = attach(rows, firsts, "digest", "n", rows.count())
    again = F.col("first_tag").isNotNull() & (F.col("first_tag") != F.col("tag"))
    return both.select("page_id", "url", "payload", "digest", "bytes", "tag", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, record_id(F.col("first_id"), F.col("first_tag"))).alias("refers_to"))


def records(decided: DataFrame) -> DataFrame:
    """One row of text per record or segment, without the two CRLFs at its end."""
    name = record_id(F.col("page_id"), F.col("tag"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + CRLF + CRLF), chunked(F.col("payload")))
    # a revisit keeps the head alone; its payload is that of the record it refers to
    block = F.when(F.col("record_type") == "revisit", F.lit("HTTP/1.1 200 OK" + CRLF + CRLF)).otherwise(http)
    # the url goes into one header line
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    rows = decided.select("page_id", "digest", "bytes", "record_type", "refers_to", url.alias("url"), name.alias("name"), block.alias("block"))
    rows = rows.withColumns({"cut": pieces(F.col("block"), SEGMENT), "total": byte_len(F.col("block"))}).drop("block")
    rows = rows.select("*", F.size("cut").alias("parts"), F.posexplode("cut").alias("k", "part")).drop("cut").withColumn("k", F.col("k") + 1)
    none = F.lit("")

    def line(key: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))).otherwise(none)

    head, single = F.col("k") == 1, F.col("parts") == 1
    own = F.when(head, F.col("name")).otherwise(record_id(F.col("name"), F.col("k")))
    fields = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(head, F.col("record_type")).otherwise("continuation"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), own, F.lit(CRLF + "WARC-Date: 2024-01-01T00:00:00Z" + CRLF + "Content-Type: application/http; msgtype=response" + CRLF),
        line("WARC-Target-URI", F.col("url"), head),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), head),
        line("X-Payload-Length", F.col("bytes").cast("string"), head),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), head),
        line("WARC-Profile", F.lit(PROFILE), head & (F.col("record_type") == "revisit")),
        line("WARC-Refers-To", F.col("refers_to"), head & (F.col("record_type") == "revisit")),
        line("WARC-Segment-Number", F.col("k").cast("string"), ~single),
        line("WARC-Segment-Origin-ID", F.col("name"), ~head),
        line("WARC-Segment-Total-Length", F.col("total").cast("string"), ~single & (F.col("k") == F.col("parts"))),
        F.lit("Content-Length: "), byte_len(F.col("part")).cast("string"), F.lit(CRLF + CRLF),
    )
    return rows.select(F.concat(fields, "part").alias("value"))


def write_archives(record_rows: DataFrame, path: str) -> None:
    record_rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
#: A record begins with this; payloads may hold it too.
BEGIN = b"WARC/1."


class Walker:
    """Records from the pieces of an archive between the places where BEGIN stands."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.size, self.need, self.fields = 0, None, {}

    def feed(self, piece: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
        """The record that ``piece`` completes."""
        self.held += [BEGIN, piece] if self.held else [piece]
        self.size += len(piece) + (len(BEGIN) if len(self.held) > 1 else 0)
        if self.need is None:
            data = b"".join(self.held)
            if (stop := data.find(b"\r\n\r\n")) < 0:
                return None
            self.fields = {k.strip().lower(): v.strip() for k, v in FIELD.findall(data, data.index(b"\r\n") + 2, stop + 2)}
            self.need = int(self.fields[b"content-length"])
            self.held, self.size = [data[stop + 4 :]], len(data) - stop - 4
        if self.size < self.need:
            return None
        data, fields, need = b"".join(self.held), self.fields, self.need
        if data[need:].strip(b"\r\n"):
            raise ValueError("bytes between records")
        self.__init__()
        return fields, data[:need]

    def end(self) -> None:
        if self.held:
            raise ValueError("a record is cut short")


def dechunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        at = stop + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than its length")
        out.append(body[stop + 2 : at])
        at += 2


SEGMENTS = "origin string, number int, total long, type string, fields map<string,string>, block binary"


SEGMENT_ROWS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
WHOLE = "origin string, type string, fields map<string,string>, block binary, error string"
WHOLE_ROWS = pa.schema([("origin", pa.string()), ("type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])
BATCH_BYTES = 8_000_000


def in_batches(rows: Iterator[tuple], schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES; ``block`` is the place of the large column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[block] or b"")
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def segment(fields: dict[bytes, bytes], block: bytes) -> tuple:
    text = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in fields.items()}
    total = text.get("warc-segment-total-length")
    return text.get("warc-segment-origin-id") or text.get("warc-record-id"), int(text.get("warc-segment-number", 1)), int(total) if total else None, text.get("warc-type"), list(text.items()), block


def read_segments(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """The records of all archive files under ``path`` (of names in .gz, or not compressed);
    one row per record or segment."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, walker = None, Walker()
        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = piece.as_py()
                if file != last:
                    walker.end()
                    last = file
                    if data.strip(b"\r\n"):
                        raise ValueError("an archive does not begin with a record")
                elif found := walker.feed(data):
                    yield segment(*found)
        walker.end()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, content in enumerate(c for batch in batches for c in batch.column(0)):
            for piece in content.as_py().split(BEGIN):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([piece], pa.binary())], ["file", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(walk(batches if compressed else split(batches)), SEGMENT_ROWS, 5)

    if compressed:
        read = spark.read.option("lineSep", BEGIN.decode()).text(path)
        rows = read.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    else:
        rows = spark.read.format("binaryFile").load(path).select("content")
    return rows.mapInArrow(run, SEGMENTS)


def reassemble(segments: DataFrame) -> DataFrame:
    """origin, type, fields, block, error: records whole again. Only records of several
    segments are shuffled; whole ones pass by. Of repeated segments (an archive read twice)
    one is taken."""
    alone = (F.col("number") == 1) & ~F.map_contains_key("fields", "warc-segment-number")
    whole = segments.where(alone).select("origin", "type", "fields", "block", F.lit(None).cast("string").alias("error"))

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        for origin, group in groupby(rows, key=lambda r: r[0]):
            parts: list[bytes] = []
            first = total = None
            last, gap = 0, False
            for _, number, stated, kind, fields, block in group:
                if number == last:
                    continue
                first = first or (kind, fields)
                gap |= number != last + 1
                last, total = number, stated
                parts.append(block)
            size = sum(map(len, parts))
            error = "missing segment" if gap else "wrong total length" if total != size else None
            yield origin, *first, None if error else b"".join(parts), error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*head, block.as_py()) for batch in batches for *head, block in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)))
        return in_batches(joined(rows), WHOLE_ROWS, 3)

    parts = segments.where(~alone).repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(parts.mapInArrow(run, WHOLE))


PAYLOADS = "record_id string, page_id long, record_type string, refers_to string, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string, error string"


def payloads(whole: DataFrame) -> DataFrame:
    """Length and digest of each payload, computed from the decoded bytes; a revisit has
    none of its own."""

    def read(name: str, kind: str, fields: dict[str, str], block: bytes | None, error: str | None) -> tuple:
        page = fields.get("x-page-id", "null")
        refers = fields.get("warc-refers-to")
        stated = fields.get("x-payload-length"), (fields.get("warc-payload-digest") or "").removeprefix("sha256:")
        size = digest = None
        if error is None and kind == "response":
            try:
                head, _, body = block.partition(b"\r\n\r\n")
                payload = dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            except ValueError as bad:
                error = f"broken framing: {bad}"
        return name, (None if page == "null" else int(page)), kind, refers, (int(stated[0]) if stated[0] else None), stated[1], size, digest, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in PAYLOADS.split(", ")]
        for batch in batches:
            rows = [read(o.as_py(), t.as_py(), dict(f.as_py()), b.as_py(), e.as_py()) for o, t, f, b, e in zip(*(batch.column(k) for k in range(5)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return whole.select("origin", "type", "fields", "block", "error").mapInArrow(run, PAYLOADS)


def resolved(read: DataFrame) -> DataFrame:
    """Staged rows of ``payloads`` with ``refers_to_page``: revisits get length and digest
    of the response that they name. ``error`` is set where stated and found ones differ."""
    held = read.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.col("error").alias("e"))
    own = read.where("record_type <> 'revisit'").withColumn("refers_to_page", F.lit(None).cast("long"))
    again = attach_counted(read.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest"), held, "refers_to")
    again = again.withColumn("error", F.coalesce("error", "e", F.when(F.col("d").isNull(), "no record for a revisit"))).withColumns({"payload_bytes": F.col("b"), "payload_digest": F.col("d")})
    every = own.unionByName(again.select(*own.columns))
    same = (F.col("payload_digest") == F.col("stated_digest")) & (F.col("payload_bytes") == F.col("stated_bytes"))
    return every.withColumn("error", F.coalesce("error", F.when(~F.coalesce(same, F.lit(False)), "digest differs from the stated one")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/termweave/warc-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    write_archives(records(decide(table(spark, sf_dir, "pages"))), path)
    got = resolved(stage(payloads(reassemble(read_segments(spark, path))), "warc-payloads"))
    broken = F.raise_error(F.concat(F.lit("archive broken: "), "error")).cast("string")
    checked = got.withColumn("payload_digest", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("payload_digest")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


OP4_SQL = f"""
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND n > 1 THEN first END AS refers_to
FROM f
"""
