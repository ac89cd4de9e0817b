"""Line deduplication by range-partitioned hashes, native operations only.

The occurrences of long enough lines (hash, document, position) are range-partitioned by hash and a slice of the documents,
and sorted by document and position within a hash; a lag over that order streams the first occurrence of a line in each
document. The slice lets a line that a third of all documents hold cross several partitions; the counts of its slices are
combined map-side before they meet. Lines found in enough documents go back to their occurrences (those that hold a thousandth
of all occurrences or more, a thousand lines at most, by broadcast), and what has to go is returned as a bitmap per document: 64 lines a word, words after the last dropped line elided.

Defined cases: a null or empty text is one empty line; repeated rows (same id and text) count as one document and share a
bitmap; rows with a null id keep all lines and count for no line; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinspark.llm.common import SPACES, ascii_lower, free_name, join_hot, materialize, read, row_key

WORD = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """h, doc_id, rk, pos: lines whose key has min_chars code points at least. rk tells rows of one id apart."""
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("rk"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line")
    )
    rows = rows.filter(F.char_length("line") >= min_chars).withColumn("line", F.btrim("line", F.lit(SPACES))).filter(F.char_length("line") >= min_chars)
    return rows.select(F.unhex(F.substring(F.sha2(ascii_lower(F.col("line")), 256), 1, 32)).alias("h"), "doc_id", "rk", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, slices: int = 32) -> DataFrame:
    """doc_id, rk, keep array<bigint>, n_dropped: only documents that lose lines. Bit i % 64 of word i / 64 is set if line i stays; later lines stay."""
    # written once: the sampling of the ranges, the sort and the way back to the occurrences all read it
    found = materialize(line_occurrences(docs, id_col, text_col, min_chars)).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    ranged = found.repartitionByRange("h", "slice")
    order = Window.partitionBy("h", "slice").orderBy(F.col("doc_id").desc(), "rk", "pos")
    before = F.lag("doc_id").over(order)
    firsts = ranged.select("h", "doc_id", (before.isNull() | (before != F.col("doc_id"))).alias("first"))
    repeated = firsts.groupBy("h").agg(F.count_if("first").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keeper"))
    repeated = materialize(repeated.filter(F.col("n") >= min_docs).select("h", "rows", "keeper"))
    gone = join_hot(found.select("h", "doc_id", "rk", "pos"), repeated, "h", found.count()).filter(F.col("doc_id") != F.col("keeper"))
    words = gone.groupBy("doc_id", "rk", F.floor(F.col("pos") / WORD).cast("int").alias("no")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")).alias("drop")
    )
    return (
        words.groupBy("doc_id", "rk")
        .agg(F.sort_array(F.collect_list(F.struct("no", "drop"))).alias("w"), F.sum(F.bit_count("drop")).alias("n_dropped"))
        .select("doc_id", "rk", "n_dropped", F.expr("flatten(transform(w, (x, i) -> concat(array_repeat(-1L, x.no - coalesce(get(w, i - 1).no, -1) - 1), array(~x.drop))))").alias("keep"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept", dropped: str = "dropped") -> DataFrame:
    """docs with two columns added, whose names must be free: the text of the lines that stay, and how many don't."""
    names = [free_name(docs, n) for n in ("mark_id", "mark_rk", "mark_keep", "mark_dropped")]
    i, k, keep, n = names
    marks = bitmaps.select(*[F.col(c).alias(name) for c, name in zip(("doc_id", "rk", "keep", "n_dropped"), names, strict=True)])
    rows = docs.join(marks, (docs[id_col] == F.col(i)) & (row_key(docs[text_col]) == F.col(k)), "left")
    stays = F.filter(
        _lines(F.col(text_col)),
        lambda line, j: (F.floor(j / WORD) >= F.size(keep)) | (F.getbit(F.get(keep, F.floor(j / WORD).cast("int")), F.pmod(j, F.lit(WORD))) == 1),
    )
    text = F.when(F.col(keep).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    return rows.withColumn(kept, text).withColumn(dropped, F.coalesce(n, F.lit(0).cast("long"))).drop(*names)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
