"""Token counts as delta-maintained rollups (operator 1).

A store holds one additive table: documents and tokens by source, language and tokenizer
version. Changes come in batches of signed rows: an insert adds a document and its tokens,
a delete takes both away, a revision adds the new count minus the old one and no document.
A batch is summed to one delta row per group and written to a folder of its own; it is
committed by its claim, a small file under its id that names the folder and holds a content
mark. Claims are made by a rename that fails if the id is taken, so of writers that race one
wins and a batch counts once or not at all. A batch committed twice (a retry, a replayed
stream) finds its id taken and changes nothing; the same id with other content is an error,
also after compaction, as claims stay. Totals are the sum of all claimed deltas. ``compact``
sums the batches of one listing into a snapshot that keeps their ids; a batch that is
committed meanwhile is not in it and counts beside it.

Claims need a file system whose rename is atomic and can refuse to overwrite (HDFS and
local ones; object stores only with a layer that has it). The driver lists ids, not rows;
it reads the claims of the batches since the last snapshot.

Tokenizers are named with a version: ``words-1`` counts runs of anything but ASCII white
space, ``pieces-1`` counts runs of letters, runs of digits and other single signs of
the ASCII range apart (all other code points count as letters). ``bpe_counts`` counts with
a public vocabulary file at a given path.

Defined results: null source, language or version is a group of its own; a null text has 0
tokens; a null count is 0; repeated change rows of a batch count as often as they stand; a
batch without rows is committed and adds nothing; groups whose documents and tokens are
both 0 are left out of the totals; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import WORD, drop_at_end, shared_dir, stage, table, text_of

GROUP = ["source", "lang", "tokenizer"]
#: Runs of letters (anything beyond ASCII too), runs of digits, other single signs.
PIECE = r"[A-Za-z\x80-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x80-\x{10FFFF}\x20\x09-\x0D]"
NATIVE = {"words-1": WORD, "pieces-1": PIECE}
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
DELTA = f"{TOTALS}, n_rows long, content long"


def count_tokens(text: Column, tokenizer: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(NATIVE[tokenizer])).cast("long")


def bpe_counts(docs: DataFrame, vocabulary: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) with a tokenizer file of the
    ``tokenizers`` library that every executor can read at ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary)
        for batch in batches:
            n = [len(e.ids) for e in model.encode_batch(batch.column(3).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["doc_id", *GROUP, "n_tokens"])

    texts = docs.select("doc_id", "source", "lang", text_of("text").alias("text"))
    return texts.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return _changes(counts, F.lit(1), F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return _changes(counts, F.lit(-1), -F.col("n_tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    return _changes(counts, F.lit(0), F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


def _changes(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*GROUP, docs.cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


class Rollup:
    """A store of committed deltas under ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(n for s in self._fs.listStatus(at) if not (n := s.getPath().getName()).startswith((".", "_"))) if self._fs.exists(at) else []

    def _claim(self, name: str, value: dict) -> bool:
        """Make the file ``name``; False if there is one."""
        temp, final = self._at(f"pending/{uuid.uuid4().hex}"), self._at(name)
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            # Java's local rename overwrites; a hard link never does
            source, target = (self._hadoop(p.toUri().getPath()).toString() for p in (temp, final))
            try:
                os.link(source, target)
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(temp, False)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        never = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        never[0] = jvm.Options.Rename.NONE
        try:
            jvm.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, final, never)
            return True
        except Py4JJavaError as bad:
            self._fs.delete(temp, False)
            if "FileAlreadyExists" in bad.java_exception.getClass().getName():
                return False
            raise

    def _read(self, name: str) -> dict | None:
        at = self._at(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def snapshots(self) -> list[str]:
        return self._names("snapshots")

    def _latest(self) -> tuple[DataFrame | None, set[str]]:
        """The totals of the latest snapshot and the ids of its batches."""
        if not (names := self.snapshots()):
            return None, set()
        folder = f"{self.path}/{self._read(f'snapshots/{names[-1]}')['data']}"
        ids = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{folder}/batches").toLocalIterator()}
        return self.spark.read.schema(TOTALS).parquet(f"{folder}/totals"), ids

    def batches(self) -> list[str]:
        """Ids of all committed batches."""
        return self._names("claims")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        each = F.xxhash64(*GROUP, "n_docs", "n_tokens").cast("decimal(38,0)")
        delta = changes.groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"),
            F.pmod(F.sum(each), F.lit(1 << 62).cast("decimal(38,0)")).cast("long").alias("content"),
        )
        data = f"data/{batch}-{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.path}/{data}")
        mark = self._mark(self.spark.read.schema(DELTA).parquet(f"{self.path}/{data}"))
        if self._claim(f"claims/{batch}", {"data": data, "mark": mark}):
            return True
        self._fs.delete(self._at(data), True)
        if self._read(f"claims/{batch}")["mark"] != mark:
            raise ValueError(f"batch {batch} was committed with other content")
        return False

    @staticmethod
    def _mark(delta: DataFrame) -> list[str]:
        sums = delta.agg(F.sum("n_docs"), F.sum("n_tokens"), F.sum("n_rows"), F.sum(F.col("content").cast("decimal(38,0)"))).first()
        return [str(x) for x in sums]

    def _sum(self, listed: list[str]) -> tuple[DataFrame, set[str], list[str]]:
        """Totals over the listed batches, the ids that a snapshot had of them, the folders
        of the others."""
        totals, held = self._latest()
        folders = [f"{self.path}/{self._read(f'claims/{b}')['data']}" for b in listed if b not in held]
        parts = [*filter(None, [totals]), *([self.spark.read.schema(TOTALS).parquet(*folders)] if folders else [])] or [self.spark.createDataFrame([], TOTALS)]
        summed = reduce(DataFrame.unionByName, parts).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0"), held, folders

    def totals(self) -> DataFrame:
        return self._sum(self.batches())[0]

    def compact(self) -> None:
        """Sum the batches that are committed now into a new snapshot. Of two that compact at
        once one fails. The folders that an older snapshot covers are deleted; readers of the
        latest one need them no longer."""
        older, number = self.snapshots(), len(self.snapshots())
        names = self.batches()
        totals, held, _ = self._sum(names)
        data = f"data/snapshot-{uuid.uuid4().hex}"
        totals.write.parquet(f"{self.path}/{data}/totals")
        self.spark.createDataFrame([(b,) for b in names], "batch string").write.parquet(f"{self.path}/{data}/batches")
        if not self._claim(f"snapshots/{number:08d}", {"data": data}):
            self._fs.delete(self._at(data), True)
            raise RuntimeError(f"snapshot {number} was written by another")
        before = set()
        if len(older) > 1:
            last = self._read(f"snapshots/{older[-2]}")["data"]
            before = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{last}/batches").toLocalIterator()} if self._fs.exists(self._at(last)) else set()
            self._fs.delete(self._at(last), True)
        for b in held - before:
            self._fs.delete(self._at(self._read(f"claims/{b}")["data"]), True)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches over all documents: estimates (a token per four characters) for both
    tokenizers, revisions to exact counts, deletes of documents labelled toxic and inserts
    that take them back. The revisions are delivered twice, as by a retry. ``n_toxic_docs``
    and ``n_toxic_tokens`` are what the deletes took away meanwhile."""
    docs = table(spark, sf_dir, "documents")
    exact = F.array(*[F.struct(F.lit(t).alias("tokenizer"), count_tokens(F.col("text"), t).alias("n_tokens")) for t in NATIVE])
    estimate = F.floor(F.length(text_of("text")) / 4).cast("long")
    counts = docs.select("doc_id", "source", "lang", estimate.alias("old_tokens"), F.explode(exact).alias("x"))
    counts = stage(counts.select("doc_id", "source", "lang", "x.*", "old_tokens"), "token-counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    path = f"{shared_dir(spark)}/termweave/token-rollup-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    store = Rollup(spark, path)
    store.commit("0-load", inserts(counts.withColumn("n_tokens", F.col("old_tokens"))))
    store.commit("1-exact", revisions(counts))
    store.compact()
    store.commit("1-exact", revisions(counts))
    marked = stage(counts.join(toxic, "doc_id", "left_semi"), "token-toxic")
    store.commit("2-toxic", deletes(marked))
    without = stage(store.totals(), "token-clean")
    store.commit("3-back", inserts(marked))
    every = store.totals()
    gone = without.select(*[F.col(g).alias(f"w_{g}") for g in GROUP], F.col("n_docs").alias("w_docs"), F.col("n_tokens").alias("w_tokens"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"w_{g}")) for g in GROUP])
    lost = [(F.col(f"n_{x}") - F.coalesce(f"w_{x}", F.lit(0))).alias(f"n_toxic_{x}") for x in ("docs", "tokens")]
    return every.join(gone, same, "left").select(*GROUP, "n_docs", "n_tokens", *lost)


OP1_SQL = r"""
WITH c AS (
  SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) THEN 1 ELSE 0 END AS bad, unnest([
    {'tokenizer': 'words-1', 'n': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))},
    {'tokenizer': 'pieces-1', 'n': len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]'))}]) AS x
  FROM documents
)
SELECT source, lang, x.tokenizer AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(x.n) AS BIGINT) AS n_tokens,
  CAST(sum(bad) AS BIGINT) AS n_toxic_docs, CAST(sum(bad * x.n) AS BIGINT) AS n_toxic_tokens
FROM c GROUP BY source, lang, x.tokenizer
"""
