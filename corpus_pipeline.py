"""From documents to token ids: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. All but
the last return the columns of documents; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm import bpe, decontaminate, line_dedup, near_dup, quality
from skeinspark.llm.common import drop_rows, free_name, keep_once, materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each judged by its own text; a null text counts as empty. It learns from the labels that op5 may learn from."""
    return quality.keep_good(docs, quality.fit(docs, quality.learnable(read(spark, sf_dir, "labels"))))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only; n_chars follows the text. Rows all stay.

    A row without an id keeps all its lines and counts for none.
    """
    kept, dropped = free_name(docs, "kept"), free_name(docs, "dropped")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), kept=kept, dropped=dropped)
    text = F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text"))
    chars = F.when(F.col(dropped) > 0, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).withColumn("text", text).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays: that of the smallest id and, of one id, of the smallest text hash.

    Of rows that repeat both, one stays. Rows without words or without an id are in no group and stay; rows of one id and different
    texts are judged each by its own text.
    """
    found = materialize(near_dup.near_duplicates(docs))
    grouped = found.filter("doc_id IS NOT NULL AND n_shingles > 0")
    extra = grouped.filter("component_id <> doc_id OR first_rk <> rk").select("doc_id", "rk").distinct()
    firsts = grouped.filter("component_id = doc_id AND first_rk = rk").groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n"))
    return keep_once(drop_rows(docs, extra), materialize(firsts.filter("n > 1").select("doc_id", "rk")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of any benchmark item go; null texts hold none, and rows of one id, or of none, are judged each by its own text."""
    windows = decontaminate.item_windows(read(spark, sf_dir, "benchmark"), 8)
    hits = decontaminate.window_hits(docs, windows)
    return drop_rows(docs, hits.select("doc_id", "rk").distinct())


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row that is left; a null text has none."""
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", bpe_encoding),
]

#: A trained classifier and a connected-components stage are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
