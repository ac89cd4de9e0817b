"""Usage of nodes by retrieval: an append-only journal, and the overlay read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.operators.merge import fold_usage

EVENTS = "query string, id string, score double, activation double, ts string"


class UsageJournal:
    """Events as Parquet files under one folder; each request appends its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._there = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, query: str, ranked: DataFrame, now: str) -> None:
        """ranked: id and score, and activation if it has one. Rows without an id are left out."""
        activation = F.col("activation") if "activation" in ranked.columns else F.lit(0.0)
        rows = ranked.filter("id IS NOT NULL").select(F.lit(query).alias("query"), "id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), activation.cast("double").alias("activation"), F.lit(now).alias("ts"))
        rows.write.mode("append").parquet(self.folder)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.folder) if self._there() else self.spark.createDataFrame([], EVENTS)

    def overlay(self, ids: DataFrame | None = None) -> DataFrame:
        """id, uses, last_used_at, utility_delta, activation of all nodes that were used, or of those in ids."""
        rows = self.events()
        return fold_usage(rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi"))

    def applied(self, nodes: DataFrame) -> DataFrame:
        """nodes with their usage counted in."""
        use = self.overlay().select(F.col("id").alias("__id"), "uses", F.col("last_used_at").alias("__at"), "utility_delta")
        met = nodes.join(use, F.col("id") == F.col("__id"), "left")
        new = {
            "usage_count": F.col("usage_count") + F.coalesce("uses", F.lit(0)), "last_used_at": F.greatest("last_used_at", "__at"),
            "utility": F.least(F.lit(1.0), F.col("utility") + F.coalesce("utility_delta", F.lit(0.0))),
        }
        return met.withColumns(new).select(*nodes.columns)
