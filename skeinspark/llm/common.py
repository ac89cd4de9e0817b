"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.tokens import pieces
from skeinspark.shared import materialize as materialize
from skeinspark.shared import shared_dir as shared_dir

#: ASCII white space, as in `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. `lower` agrees with that on pure ASCII, where it is much the faster of the two."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(text: Column) -> Column:
    """Tells rows of one id apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in gone (doc_id, rk); ids are compared null-safe."""
    i, k = free_name(docs, "gone_id"), free_name(docs, "gone_rk")
    marks = gone.select(F.col("doc_id").alias(i), F.col("rk").alias(k))
    return docs.join(marks, docs[id_col].eqNullSafe(F.col(i)) & (row_key(docs[text_col]) == F.col(k)), "left_anti")


def keep_once(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row only of each id and text in repeated (doc_id, rk, no nulls). Only those rows are moved."""
    if repeated.isEmpty():
        return docs
    i, k = free_name(docs, "once_id"), free_name(docs, "once_rk")
    marks = repeated.select(F.col("doc_id").alias(i), F.col("rk").alias(k))
    both = docs.join(marks, (docs[id_col] == F.col(i)) & (row_key(docs[text_col]) == F.col(k)), "left_semi").withColumn(k, row_key(F.col(text_col)))
    return drop_rows(docs, repeated, id_col, text_col).unionByName(both.dropDuplicates([id_col, k]).drop(k))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it holds one row in HOT_SHARE; so there are HOT_SHARE hot keys at most, whatever the size of the table.
HOT_SHARE, HOT_LEAST = 1000, 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, count: str = "rows", how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, whose column `count` has the key's rows (it is dropped).

    The rows of hot keys meet their table row by broadcast, which HOT_SHARE bounds, and are never dealt by key; the others by
    whatever join suits. total: the number of rows. Both sides are read twice, so they should be written tables.
    """
    hot = (F.col(count) >= HOT_LEAST) & (F.col(count) * HOT_SHARE >= total)
    few = F.broadcast(table.filter(hot).drop(count))
    rest = rows.join(few.select(key), key, "left_anti").join(table.filter(~hot).drop(count), key, how)
    return rows.join(few, key).unionByName(rest)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() has written, when nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets the driver find out which shuffles nothing refers to any more, so that their files go before the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(c.cast("string")), F.lit(n))


def map_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Runs a function over Arrow batches of texts, of bounded bytes. make() is called once a task and gives f(texts) -> a list of columns, which follow doc_id; null texts come as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in pieces(batches, 1):
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *f(texts)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *[part.strip().split(" ")[0] for part in schema.split(",")]]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")
