"""Indexing as compiler output arrives: a stream of files, decoded, and kept by source file.

Beyond batch builds: each trigger replaces the documents of the source files that it brings, so the kept table holds one row
for each uri and module, and :func:`quillspark.operators.build.build_index` runs over it as over any documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.semanticdb import good, read_documents

_FILES = "path string, modificationTime timestamp, length long, content binary"


def files_stream(spark: SparkSession, folder: str, module: Callable | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, content, module_segments) of compiler output below a folder. ``module``: a column of the path."""
    glob = "*.[sS][eE][mM][aA][nN][tT][iI][cC][dD][bB]"
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select("path", "content", (module(F.col("path")) if module else F.lit("")).alias("module_segments"), F.col("modificationTime").alias("changed"))


def upsert(batch: DataFrame, table: str, batch_id: int) -> None:
    """Write a batch of documents as its own part of the table: a batch that is tried again replaces what it wrote before."""
    batch.withColumn("added", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def compact(spark: SparkSession, table: str, into: str) -> None:
    """Write the latest document of each uri and module as batch -1 of a new table, to go on from."""
    latest(spark, table).withColumn("added", F.lit(-1)).write.mode("overwrite").parquet(f"{into}/batch=-1")


def latest(spark: SparkSession, table: str) -> DataFrame:
    """One document for each uri and module: that added last."""
    rows = spark.read.parquet(table)
    fields = [c for c in rows.columns if c not in ("uri", "module_segments", "batch")]
    newest = rows.groupBy("uri", "module_segments").agg(F.max_by(F.struct(*fields), "added").alias("d"))
    return newest.select("uri", "module_segments", "d.symbols", "d.occurrences")


def follow(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Decode a stream of files into the table; batches that were written are not written again after a restart."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(good(read_documents(batch.sparkSession, batch)), table, batch_id)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
