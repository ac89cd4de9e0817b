"""Watching a directory as a stream.

The file source tells of new and changed files; it never tells of deletions. So each micro-batch lists the directory anew and
compares the listing with the table of compiled files, which catches all three in one full outer join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinspark.operators.merge import dirty_set
from skeinspark.sources.files import scan

FACTS = ("sha256", "size_bytes", "options_hash")


def poll_once(spark: SparkSession, root: str, project: str, cache: DataFrame) -> DataFrame:
    """artifact_id, state of the files that aren't clean."""
    return dirty_set(cache, scan(spark, root, project), FACTS).filter("state <> 'clean'")


def watch(spark: SparkSession, root: str, project: str, state: str, compile_batch: Callable[[DataFrame, DataFrame], None], every: str | None = None) -> StreamingQuery:
    """Runs compile_batch(scanned files, their states) whenever the directory changes. state: a folder for the cache table and the stream's progress.

    With `every` it polls at that interval, which also gathers bursts of changes; without, it handles what is there and ends.
    """
    table = f"{state}/cache"

    def handle(_: DataFrame, epoch: int) -> None:
        files = scan(spark, root, project)
        try:
            last = spark.read.text(f"{state}/LAST").first()[0]
            cache = spark.read.parquet(f"{table}/{last}")
        except Exception as problem:  # noqa: BLE001  the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            cache = files.limit(0).select("artifact_id", *FACTS).withColumn("status", F.lit("active"))
        states = dirty_set(cache, files, FACTS).filter("state <> 'clean'")
        if not states.isEmpty():
            compile_batch(files, states)
        files.select("artifact_id", *FACTS, F.lit("active").alias("status")).write.mode("overwrite").parquet(f"{table}/{epoch}")
        spark.createDataFrame([(str(epoch),)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}/LAST")

    shape = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{state}/progress")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
