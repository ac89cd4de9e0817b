"""Exact deduplication by skew-safe combining.

Rows are grouped by digest *and* full normalised content at every stage, so two texts never meet by digest alone:

1. each map task combines its own equal rows (partial aggregation keyed on digest, salt and content);
2. rows of one digest and salt meet after the first shuffle; the salt is the map task's, so a content that fills a third of
   the table arrives as at most one row per map task, spread over `salts` reducers;
3. the winners of the salts of a digest meet after the second shuffle: at most `salts` rows for each content and length.

Documents then look their winner up by digest. Digests that stand for more than one content (counted in stage 3) are resolved
by a join on the content itself; that branch exists only if such a digest was found.

Defined cases: a null text counts as empty; an empty table gives an empty result; rows that share a doc_id each count in
group_size and get the same flags; a null doc_id never wins against a document with an id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.common import SPACE_CLASS, materialize, read


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """digest, content, keep_id, group_size: one row per content, hash-partitioned by digest alone."""
    salted = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "content", "length").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")
    )
    met = salted.repartition("digest").groupBy("digest", "content", "length").agg(F.min("doc_id").alias("doc_id"), F.sum("rows").alias("rows"))
    # one row per length is left, so max_by has no ties but those of null ids
    ordered = F.when(F.col("doc_id").isNotNull(), F.col("length"))
    return met.groupBy("digest", "content").agg(F.max_by("doc_id", ordered).alias("keep_id"), F.sum("rows").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda content: F.unhex(F.sha2(content, 256)),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Of texts that are equal without ASCII white space, the one with the most code points stays, then the smallest id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, f"{SPACE_CLASS}+", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), F.char_length(text).cast("long").alias("length"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    slim = F.when(F.col("contents") == 1, F.col("keep_id")).alias("keep_id"), F.when(F.col("contents") == 1, F.col("group_size")).alias("group_size")
    groups = materialize(
        _winners(rows, salts)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
        .select("digest", "contents", *slim)
    )
    shared = groups.filter("contents > 1").select("digest")
    one = rows.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")).join(groups.filter("contents = 1"), "digest")
    cols = "doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"
    out = one.select(*cols)
    if not shared.isEmpty():
        among = rows.join(shared, "digest", "left_semi")
        by_content = _winners(among, salts)
        more = among.join(by_content, ["digest", "content"]).withColumn("text_sha256", F.sha2("content", 256))
        out = out.unionByName(more.select(*cols))
    return out


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
