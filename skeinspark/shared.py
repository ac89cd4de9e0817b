"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in local tests, one that is set here. A cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where


#: What this process has written; release() deletes it.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: the lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skein-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that materialize() has written; results that still read them are no longer usable."""
    conf, jvm, n = spark._jsc.hadoopConfiguration(), spark._jvm, len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
