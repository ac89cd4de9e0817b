"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents of one set are one node from the start.

Sketch. In a band of set sizes every shingle flips one bit of a wide sketch; the sketch is cut into blocks, of which the set
bits are kept as one XOR-hash. Flipped bits can only cancel, so the Hamming distance of two sketches is at most the size of
the symmetric difference. If two sets are similar enough and the smaller one has at most `a` shingles, they differ in
d = (1 - t) / t * a shingles at most, so of n blocks n - d agree. With n = d + 1 + spare, two documents that each offer d + 1
blocks, first in one common order, share one they both offer. That order puts blocks that are common in the corpus last (all blocks of
all documents are counted in a table of fixed size, by hash) and blocks of few bits behind those of many, so common lines and passages, and empty blocks, seldom make candidates. A document is offered to its own band, and to
the next lower one if a partner there can be similar enough.

Candidates. Documents that offer the same block are not paired with each other but, first, with one of them: the one that
shares most blocks with most others, as the original of many copies does. (A window over each block, salted if the block is
common, finds who shares it at all.) These pairs are verified: by size, by the Hamming distance of fixed sketches, then exactly
on the sets. Links give components. Then pairs of documents that share a block but are not connected yet, and those alone, are
verified in the same way, and components are final: every two documents that share a block were either compared or are
connected, so no component misses a link.

Disk. What grows faster than the corpus is who shares a block with whom, so of these only numbers and sketches are kept; sets are
read again for the pairs alone that the sketches allow. Pairs are compared in slices of bounded bytes, SLICES_MOST at most, and
each slice's shuffles are let go before the next.

Defined cases: null, empty and wordless texts have no shingles and no links; texts of fewer words than a shingle have one; rows
without an id link nothing and have no component (null); repeated rows share theirs, rows of one id and different texts are
judged by their own texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinspark.llm.common import discard, join_hot, materialize, read, row_key, tidy
from skeinspark.llm.tokens import M1, WordHasher, mix, pieces
from skeinspark.operators.components import components

SEEN = 200_000
SALTS = 64
#: Cells of the table that counts blocks, and the slices in which its parts are added up.
CELLS, SLICES = 1 << 20, 64
FIXED_BITS = 1024
#: Words of 64 bits of the filter of wanted documents: the least and the most.
FILTER_WORDS = 1 << 17, 1 << 20
#: Bytes of sets, or of sketches, that are joined at once, and the most slices that they are cut into.
SLICE_BYTES, SLICES_MOST = 2 << 30, 8
#: Rows of a batch that are worked on at once; their blocks, hundreds each, are held in memory together.
AT_ONCE = 1000


class Shingler:
    """The shingles of many texts: for each the sorted hashes of the distinct ones."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, WordHasher()

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        words, counts = self.words(texts)
        ends = np.cumsum(counts)
        whole = self._runs(words, self.size)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= self.size:
                out.append(np.unique(whole[end - n : end - self.size + 1]))
            else:
                out.append(self._runs(words[end - n : end], n) if n else np.zeros(0, np.uint64))
        return out

    @staticmethod
    def _runs(words: np.ndarray, k: int) -> np.ndarray:
        n = max(0, len(words) - k + 1)
        acc = np.full(n, k, np.uint64)
        for j in range(k):
            acc = mix(acc * M1 + words[j : n + j])
        return acc


def signature(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


class Bands:
    """Bands of set sizes; in band g the smaller of two sets has low(g) to low(g + 1) - 1 shingles."""

    def __init__(self, percent: int) -> None:
        self.percent, self.ratio = percent, max(1.5, 100 / percent)

    def band(self, n: int) -> int:
        g = int(math.log(n) / math.log(self.ratio))
        while self.low(g + 1) <= n:
            g += 1
        while self.low(g) > n:
            g -= 1
        return g

    def low(self, g: int) -> int:
        return math.ceil(self.ratio**g)

    def differ(self, g: int) -> int:
        return (100 - self.percent) * (self.low(g + 1) - 1) // self.percent

    def of(self, n: int) -> list[int]:
        g = self.band(n)
        return [g] + [g - 1] * (g > 0 and 100 * (self.low(g) - 1) >= self.percent * n)

    def blocks(self, s: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of all blocks of the sketch, their numbers of set bits, and how many blocks to offer."""
        offer = self.differ(g) + 1
        n = offer + offer // 2
        at = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        # the bit of a shingle in its block, of 2 ** 32; equal bits cancel in the XOR
        bits = mix((s & np.uint64(0xFFFFFFFF)) + M1)
        count = np.bincount(at.astype(np.int64), minlength=n)
        value = np.zeros(n, np.uint64)
        full = np.flatnonzero(count)
        value[full] = np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(count[full])[:-1]]))
        return mix(value + mix(np.arange(n, dtype=np.uint64) * M1 + np.uint64(g + 1))).view(np.int64), count, offer


class Common:
    """How common a block is: its cell in a table of counts, or 0 below a few times the mean cell. Blocks that share a cell count together; the order of blocks needs no more."""

    def __init__(self, cells: np.ndarray) -> None:
        low = 4 * cells.mean() + 32
        self.cells = np.where(cells >= low, cells, 0)

    @staticmethod
    def cell(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (CELLS - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.cells[self.cell(keys)]


def describe(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """doc_id, rk, n, sig of every row (sig is null for empty sets), and for each task the slices of its table of blocks: n is the slice, cells its counts."""

    def run(batches):
        shingle, cells, seen = Shingler(size), np.zeros(CELLS, np.int32), set()
        for batch in pieces(batches, 2, AT_ONCE):
            n, sig, keys = [], [], []
            for s in shingle(batch.column(2)):
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
                if len(s) and sig[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sig[-1])
                    keys += [bands.blocks(s, g)[0] for g in bands.of(len(s))]
            if keys:
                cells += np.bincount(Common.cell(np.concatenate(keys)), minlength=CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
        if cells.any():
            empty = [pa.nulls(SLICES, kind_of[0]), pa.nulls(SLICES, pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array([x.tobytes() for x in cells.reshape(SLICES, -1)], pa.binary())], names=names)

    names = ["doc_id", "rk", "n", "sig", "cells"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind_of = [to_arrow_type(docs.schema["doc_id"].dataType)]
    return docs.select("doc_id", row_key(F.col("text")).alias("rk"), "text").mapInArrow(run, f"doc_id {kind}, rk bigint, n bigint, sig bigint, cells binary")


def count_blocks(seen: DataFrame) -> np.ndarray:
    """The tables of all tasks, added up slice by slice."""

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // SLICES, np.int64)
        for blob in table.column("cells"):
            total += np.frombuffer(blob.as_buffer(), np.int32)
        return pa.table([pa.array([table.column("n")[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "cells"])

    got = seen.filter("cells IS NOT NULL").select("n", "cells").groupBy("n").applyInArrow(add_up, "n bigint, cells binary").toPandas()
    cells = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for n, blob in zip(got["n"], got["cells"], strict=True):
        cells[n] = np.frombuffer(blob, np.int64)
    return cells.ravel()


def offered(docs: DataFrame, size: int, bands: Bands, common: Common) -> DataFrame:
    """key, salt, sig: the blocks that each set offers; a set that a task meets again isn't repeated. Only common blocks have a salt, from 1 on."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        shingle, common, seen = Shingler(size), shared.value, set()
        for batch in pieces(batches, 0, AT_ONCE):
            keys, salts, sigs = [], [], []
            for s in shingle(batch.column(0)):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sig)
                for g in bands.of(len(s)):
                    key, bits, offer = bands.blocks(s, g)
                    often = common(key)
                    pick = np.lexsort((key, -bits, often))[:offer]
                    keys.append(key[pick])
                    salts.append(np.where(often[pick] > 0, 1 + sig % SALTS, 0))
                    sigs.append(np.full(offer, sig, np.int64))
            parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, salts, sigs)]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1].astype(np.int32)), pa.array(parts[2])], names=["key", "salt", "sig"])

    return docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(run, "key bigint, salt int, sig bigint")


def sharers(rows: DataFrame) -> DataFrame:
    """key, sig, leader: sets that share a block, each with the smallest of its salt; those, if salted, with the smallest of all."""
    order = Window.partitionBy("key", "salt").orderBy("sig")
    led = rows.select("key", "salt", "sig", F.first("sig").over(order).alias("leader"), F.lag("sig").over(order).alias("before"))
    led = led.filter((F.col("sig") != F.col("leader")) & (F.col("sig") != F.col("before")) | (F.col("salt") > 0) & F.col("before").isNull())
    led = materialize(led.select("key", "salt", "sig", "leader"))
    heads = led.filter((F.col("salt") > 0) & (F.col("sig") == F.col("leader")))
    first = heads.groupBy("key").agg(F.min("sig").alias("leader"))
    heads = heads.select("key", "sig").join(first, "key").filter("sig <> leader").select("key", "sig", "leader")
    return led.filter("sig <> leader").select("key", "sig", "leader").union(heads)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int, whole: bool) -> DataFrame:
    """Of the sets in wanted (node, h: the hash of one row that has it) node and shingles or, unless whole, node, n and sketch. A bit filter keeps most other rows from being read again."""
    least, most = FILTER_WORDS
    words, n = least, wanted.count()
    while words < most and 4 * words < n:
        words *= 2
    word = F.shiftright("h", 6).bitwiseAND(F.lit(words - 1)).cast("int")
    got = wanted.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    table = np.zeros(words, np.int64)
    table[got["w"].to_numpy(int)] = got["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        shingle, table = Shingler(size), shared.value
        for batch in batches:
            h = batch.column(1).to_numpy()
            hit = pa.array(((table[(h >> 6) & (len(table) - 1)] >> (h & 63)) & 1).astype(bool))
            for part in pieces([batch.filter(hit)], 0, AT_ONCE):
                found = [s for s in shingle(part.column(0)) if len(s)]
                node = pa.array([signature(s) for s in found], pa.int64())
                if whole:
                    yield pa.RecordBatch.from_arrays([node, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"])
                    continue
                fixed = [np.packbits(np.bincount((s & np.uint64(FIXED_BITS - 1)).astype(np.int64), minlength=FIXED_BITS) & 1).view(np.int64) for s in found]
                yield pa.RecordBatch.from_arrays([node, pa.array([len(s) for s in found], pa.int64()), pa.array(fixed, pa.list_(pa.int64()))], names=["node", "n", "sketch"])

    rows = docs.filter("doc_id IS NOT NULL").select("text", row_hash(F.col("doc_id"), row_key(F.col("text"))).alias("h"))
    rows = rows.mapInArrow(run, "node bigint, shingles array<bigint>" if whole else "node bigint, n bigint, sketch array<bigint>")
    return rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def row_hash(doc_id: Column, rk: Column) -> Column:
    return F.xxhash64(doc_id, rk)


def may_link(percent: int) -> Column:
    """Of na, sketcha, nb, sketchb: sizes and the Hamming distance of the fixed sketches allow the similarity."""
    # written out word by word, this is compiled into the join; a lambda would be interpreted for every pair
    words = [F.bit_count(F.get("sketcha", F.lit(i)).bitwiseXOR(F.get("sketchb", F.lit(i)))) for i in range(FIXED_BITS // 64)]
    apart = reduce(add, words)
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sizes & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))


def cut(table: DataFrame, key: str, size: int) -> list[DataFrame]:
    """A written table in slices by a key; size: the bytes that all of it brings together."""
    n = min(SLICES_MOST, 1 + size // SLICE_BYTES)
    return [table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, slim: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: the pairs whose sets are similar enough. nodes: node, h; slim: node, n, sketch. All are written tables, as the result is."""
    spark = docs.sparkSession
    ends = [slim.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}")) for x in "ab"]
    near = materialize(pairs.join(ends[0], "a").join(ends[1], "b").filter(may_link(percent)).select("a", "b", (F.col("na") + F.col("nb")).alias("n")))
    tidy(spark)
    out = []
    for some in cut(near, "a", 8 * (near.agg(F.sum("n")).first()[0] or 0)):
        some = some.select("a", "b")
        wanted = materialize(nodes.join(some.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
        sets = materialize(sets_of(docs, wanted, size, True))
        tidy(spark)
        full = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
        both = F.size(F.array_intersect("sa", "sb"))
        checked = some.join(full[0], "a").join(full[1], "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("all"))
        out.append(materialize(checked.filter(100 * F.col("both") >= percent * F.col("all")).select("a", "b")))
        del checked
        discard(sets)
        tidy(spark)
    return reduce(DataFrame.union, out)


def unlike_sharers(holds: DataFrame, roots: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """a, b: sets that share a block and are in different components, if sizes and sketches allow a link."""
    spark = holds.sparkSession
    apart = holds.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = apart.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    apart = materialize(apart.join(split, "key", "left_semi"))
    tidy(spark)
    out = []
    for some in cut(apart, "key", (FIXED_BITS // 8 + 32) * apart.count()):
        some = some.join(slim, "node")
        left, right = (some.select("key", F.col("node").alias(x), F.col("root").alias(f"root{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}")) for x in "ab")
        other = left.join(right, (left["key"] == right["key"]) & (F.col("roota") < F.col("rootb")) & may_link(percent))
        out.append(materialize(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        del some, left, right, other
        tidy(spark)
    return reduce(DataFrame.union, out).distinct()


def clusters(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Two written tables: doc_id, rk, n, sig of every row; and sig, rows, one, root of every set that a row with an id has: how many rows have it, the first of them (doc_id, rk), and the smallest sig that links reach."""
    spark, bands = docs.sparkSession, Bands(percent)
    seen = materialize(describe(docs, size, bands))
    rows = seen.filter("cells IS NULL").select("doc_id", "rk", "n", "sig")
    nodes = rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "rk")).alias("one"))
    nodes = materialize(nodes.select(F.col("sig").alias("node"), "rows", "one", row_hash(F.col("one.doc_id"), F.col("one.rk")).alias("h")))
    member = materialize(sharers(offered(docs, size, bands, Common(count_blocks(seen)))))
    tidy(spark)
    # who shares a block: the original of many copies shares most, with most, and so leads its blocks
    holds = materialize(member.select("key", F.col("sig").alias("node")).union(member.select("key", "leader")).distinct())
    discard(member)
    crowd = holds.join(holds.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    weight = crowd.groupBy("node").agg(F.sum("size").alias("weight"))
    lead = holds.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("head"))
    pairs = holds.join(lead, "key").filter("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    pairs = materialize(pairs)
    held = materialize(nodes.join(holds.select("node").distinct(), "node", "left_semi").select("node", "h"))
    slim = materialize(sets_of(docs, held, size, False))
    tidy(spark)

    links = verified(docs, pairs, held, slim, size, percent)
    roots = components(links)
    tidy(spark)

    # who shares a block with somebody of another component
    other = unlike_sharers(holds, roots, slim, percent)
    more = verified(docs, materialize(other.join(pairs, ["a", "b"], "left_anti")), held, slim, size, percent)
    for old in (holds, pairs, slim):
        discard(old)
    if not more.isEmpty():
        roots = components(links.union(more))
    return rows, materialize(nodes.join(roots, "node", "left").select(F.col("node").alias("sig"), "rows", "one", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rk, n_shingles, component_id (the smallest id that links reach), first_rk: one row per row of docs.

    rk, a hash of the text, tells rows of one id apart; component_id and first_rk name the first row of the component. A row belongs to the component of its own text: rows of one id and different texts can be in different ones.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, groups = clusters(docs, size, percent)
    by_root = materialize(groups.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.min("one").alias("first")))
    by_sig = materialize(join_hot(groups.select("sig", "rows", "root"), by_root, "root", groups.count(), "sets"))
    with_id = rows.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    out = join_hot(with_id, by_sig.select("sig", "rows", F.col("first.doc_id").alias("component"), F.col("first.rk").alias("first_rk")), "sig", rows.count())
    alone = rows.filter("sig IS NULL OR doc_id IS NULL").withColumn("component", F.col("doc_id")).withColumn("first_rk", F.col("rk"))
    out = out.unionByName(alone)
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "first_rk")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=90).drop("rk", "first_rk")


#: The join of all shingles with themselves, for small tables.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(0, len(w) - least(3, len(w)) + 1), lambda i: array_to_string(w[i + 1 : i + least(3, len(w))], ' '))) AS g FROM d WHERE len(w) > 0),
one AS MATERIALIZED (SELECT g, min(doc_id) AS doc_id, len(g) AS n FROM s GROUP BY g),
e AS MATERIALIZED (SELECT doc_id, n, unnest(g) AS x FROM one),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON b.x = a.x AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM one UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT d.doc_id, coalesce(len(s.g), 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN one ON one.g = s.g LEFT JOIN c ON c.a = one.doc_id
"""
