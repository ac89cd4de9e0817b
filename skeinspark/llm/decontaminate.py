"""Benchmark decontamination by a prefix-filtered set join, native operations only.

An item's words are cut into windows of consecutive words, and a window into shingles of up to three. A document contains a
window only if it contains every shingle of it, so a necessary prefix of one is enough: shingles are ordered by rarity, counted
over all documents, and the rarest of a window, its anchor, gives the fewest candidates. The anchor's place bounds where the
window must start, the window's length and the document's where it must end, and a candidate is verified by all shingles of the
window in their places; they overlap, so that is every word of it, in order.

Texts are split once to find the occurrences of the benchmark's shingles, which are few and are written; everything else works on
these. The shingles are broadcast if they take `broadcast_bytes` at most, and are shuffled to otherwise.

Defined cases: a null text has no words; items without words or without an id have no windows; rows of one id are told apart by a
hash of their text; repeated rows of a document or an item change nothing in another row's result; an empty benchmark leaves
every document clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.common import ascii_lower, materialize, read, row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
LONGEST = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def item_windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, win: the windows of every item; an item of fewer words is one window."""
    items = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    span = f"least({size}, size(w))"
    return items.select("item_id", F.explode(F.expr(f"transform(sequence(0, size(w) - {span}), i -> slice(w, i + 1, {span}))")).alias("win")).distinct()


def shingles(w: Column, k: int) -> Column:
    """array<struct<a, b, c>>: what stands at each place and after it, up to k words; null past the end, '' past k."""
    return F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))).alias(name) for i, name in enumerate("abc"[:k])])


def of_windows(windows: DataFrame) -> DataFrame:
    """win, n, k, off, a, b, c: the shingles of every distinct window; k is their length."""
    each = windows.select("win").distinct().withColumn("n", F.size("win")).withColumn("k", F.least("n", F.lit(LONGEST)))
    pick = lambda i: F.when(F.col("k") > i, F.get("win", F.col("off") + i)).otherwise("")
    return each.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k")))).select("win", "n", "k", "off", *[pick(i).alias(name) for i, name in enumerate("abc")])


def occurrences(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """doc_id, rk, n_words, pos, k, a, b, c: where shingles of the vocabulary stand in documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("rk"), words(F.col(text_col)).alias("w"))
    found = None
    for k in [r.k for r in vocabulary.select("k").distinct().collect()]:  # three at most
        each = rows.select("doc_id", "rk", F.size("w").alias("n_words"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "s"))
        each = each.select("doc_id", "rk", "n_words", "pos", F.lit(k).alias("k"), *[(F.col(f"s.{name}") if i < k else F.lit("")).alias(name) for i, name in enumerate("abc")])
        of_k = vocabulary.filter(F.col("k") == k).select("a", "b", "c")
        one = each.join(F.broadcast(of_k) if small else of_k, ["a", "b", "c"])
        found = one if found is None else found.unionByName(one)
    return found if found is None else found.distinct()


def window_hits(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, rk, start, win: every occurrence of a window. rk tells rows of one id apart."""
    key = ["k", "a", "b", "c"]
    each = materialize(of_windows(windows))
    vocabulary = each.select(*key).distinct()
    size = vocabulary.agg(F.sum(F.octet_length("a") + F.octet_length("b") + F.octet_length("c") + 64)).first()[0] or 0
    found = occurrences(docs, vocabulary, id_col, text_col, size <= broadcast_bytes)
    if found is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("rk"), F.lit(0).alias("start"), F.array(F.lit("")).alias("win")).limit(0)
    found = materialize(found)
    counts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    rated = each.join(counts, key, "left").groupBy("win", "n").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "off", *key)).alias("x"))
    rare = rated.filter("x.rows > 0").select("win", "n", "x.off", *[f"x.{c}" for c in key])
    start = F.col("pos") - F.col("off")
    near = found.join(rare, key).filter((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "rk", start.alias("start"), "win", "n")
    asked = near.join(each.select("win", "off", *key), "win").withColumn("pos", F.col("start") + F.col("off"))
    there = found.select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), "pos", *key)
    same = [F.col("doc_id").eqNullSafe(F.col("d")), F.col("rk") == F.col("r"), *[asked[c] == there[c] for c in ("pos", *key)]]
    agreed = asked.join(there, same, "left_semi").groupBy("doc_id", "rk", "start", "win", "n").agg(F.count(F.lit(1)).alias("agree"))
    return agreed.filter(F.col("agree") == F.col("n") - F.least("n", F.lit(LONGEST)) + 1).select("doc_id", "rk", "start", "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 8, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, rk, n_words, n_hit, items (sorted ids as text), spans (start and length in words, ascending): one row per row of docs."""
    windows = item_windows(benchmark, size)
    hits = materialize(window_hits(docs, windows, id_col, text_col, broadcast_bytes))
    spans = hits.groupBy("doc_id", "rk").agg(F.sort_array(F.collect_set(F.struct("start", F.size("win").alias("length")))).alias("spans"))
    items = (
        hits.select("doc_id", "rk", "win").distinct().join(windows, "win").select("doc_id", "rk", F.col("item_id").cast("string").alias("item"))
        .groupBy("doc_id", "rk").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    rows = docs.select(F.col(id_col).alias("d"), row_key(F.col(text_col)).alias("k"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    for side in (spans, items):
        names = [c for c in side.columns if c not in ("doc_id", "rk")]
        rows = rows.join(side, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("rk")), "left").select(*[c for c in rows.columns], *names)
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))))
    return rows.select(
        F.col("d").alias("doc_id"), F.col("k").alias("rk"), "n_words",
        F.when(F.col("spans").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS l, unnest(list_transform(range(0, len(w) - least(8, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(8, len(w))], ' '))) AS win FROM b WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, unnest(range(0, len(w) - l + 1)) AS s, unnest(list_transform(range(0, len(w) - l + 1), lambda i: array_to_string(w[i + 1 : i + l], ' '))) AS win FROM d, ls WHERE len(w) >= l),
h AS (SELECT DISTINCT doc_id, s, dw.l, item_id FROM dw JOIN bw USING (win, l)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
