"""Linking of files as they arrive: the batch plan on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.operators.extract import Extractor
from termweave.operators.link import Knowledge
from termweave.plans.linking import BatchConfig, link_batch
from termweave.sources.files import unix_lines
from termweave.sources.scratch import scope


def arriving_documents(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, text) of the ``*.txt`` files that appear in a folder."""
    read = spark.readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return read.select(F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.txt$", "").alias("doc_id"), unix_lines(F.col("value")).alias("text"))


def link_stream(documents: DataFrame, knowledge: Knowledge, out: str, checkpoint: str, extractor: Extractor | None = None, config: BatchConfig = BatchConfig(), once: bool = True) -> StreamingQuery:
    """Write submissions (doc_id, body) under ``out/batch=N``. A batch that is run again
    after a failure overwrites its own folder, so each is there once."""

    def write(batch: DataFrame, number: int) -> None:
        with scope():
            link_batch(batch, knowledge, extractor, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
