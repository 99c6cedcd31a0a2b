"""A stream over a folder of documents that parses what is new into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.index import _SCHEMA, _parsed
from docloom.schema import MAX_INPUT_BYTES
from docloom.sources.snapshot import Snapshot

_FILES = r"\.(md|markdown|[0-9][a-z0-9]*)$"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parse new Markdown and manual files of folder into the snapshot out, a version a batch; a file is read exactly once a checkpoint."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    kind = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), "markdown").otherwise("roff")
    rows = files.where((F.col("length") <= MAX_INPUT_BYTES) & F.lower("path").rlike(_FILES)).select(F.col("path").alias("doc_key"), kind.alias("format"), "content")

    def add(batch: DataFrame, number: int) -> None:
        parsed = batch.select("doc_key", "format", "content").mapInArrow(_parsed, _SCHEMA).withColumn("batch", F.lit(number))
        Snapshot(batch.sparkSession, out).upsert(parsed, (checkpoint, number))

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def forget_deleted(spark: SparkSession, folder: str, out: str) -> int:
    """Take documents out of the snapshot whose files are gone; only names are listed."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("doc_key"))
    return Snapshot(spark, out).forget_missing(there)


def current(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """The documents of a version, or of the last one."""
    return Snapshot(spark, out).read(version)
