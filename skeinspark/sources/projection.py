"""The supplied tables as a property graph: one branch per node and edge type, put together by union.

A filter on a type folds the other branches away before anything is read, and only the columns that a query names are scanned.
Rows of one key are aggregated where the table's key isn't the edge's (orders of a part, events of a pair of users).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinspark.operators.graph import Graph
from skeinspark.schema import EDGE_DEFAULTS, EPOCH, NODE_DEFAULTS


def _nodes(rows: DataFrame, kind: str, key: Column, k: Column, **more: Column) -> DataFrame:
    status = F.when(k % 10 == 0, "archived").when(k % 10 == 1, "candidate").otherwise("active")
    values = {
        "type": F.lit(kind), "id": F.concat(F.lit(kind.lower() + ":"), key.cast("string")), "salience": (k % 100) / F.lit(100.0), "confidence": F.lit(1.0) - (k % 5) / F.lit(10.0),
        "usage_count": (k % 20).cast("long"), "evidence_count": (k % 6).cast("long"), "status": status, "created_at": F.lit(EPOCH), "updated_at": F.lit(EPOCH),
    } | more
    core = [values.get(c, F.lit(d)).cast(t).alias(c) for c, (t, d) in NODE_DEFAULTS.items()]
    return rows.select(*core, *[v.alias(c) for c, v in values.items() if c not in NODE_DEFAULTS])


def _edges(rows: DataFrame, kind: str, source: Column, target: Column, **more: Column) -> DataFrame:
    values = {"from_id": source, "to_id": target, "type": F.lit(kind), "created_at": F.lit(EPOCH), "updated_at": F.lit(EPOCH)} | more
    values["id"] = F.concat_ws("|", values["type"], source, target)
    return rows.select(*[values.get(c, F.lit(d)).cast(t).alias(c) for c, (t, d) in EDGE_DEFAULTS.items()])


def _ref(kind: str, *cols: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in cols])


def fragments(documents: DataFrame) -> DataFrame:
    """doc_id, i (from 0), line: the lines of each document that aren't empty; i counts all lines."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.filter(F.trim("line") != "")


#: Plans, not data, of the graphs bound last, by application, folder and the state of the folder's files.
_bound: dict[tuple, Graph] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and time of all files of the tables, as they are now."""
    jvm, found = spark._jvm, []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        todo = [path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)]
        while todo:
            status = todo.pop()
            if status.isDirectory():
                todo += list(status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(status.getPath()))
            else:
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables in a folder. Its plan is kept as long as the files are the same ones, so that later queries don't analyse it anew."""
    key = (spark.sparkContext.applicationId, sf_dir, _listing(spark, sf_dir))
    if key not in _bound:
        if len(_bound) >= 8:
            _bound.clear()
        _bound[key] = _graph(spark, sf_dir)
    return _bound[key]


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES}
    c = F.col
    lines = fragments(t["documents"])
    nodes = [
        _nodes(t["region"], "Region", c("r_regionkey"), c("r_regionkey"), label=c("r_name"), name=c("r_name")),
        _nodes(t["nation"], "Nation", c("n_nationkey"), c("n_nationkey"), label=c("n_name"), name=c("n_name")),
        _nodes(t["customer"], "Customer", c("c_custkey"), c("c_custkey"), label=c("c_name"), name=c("c_name"), acctbal=c("c_acctbal"), segment=c("c_mktsegment")),
        _nodes(t["supplier"], "Supplier", c("s_suppkey"), c("s_suppkey"), label=c("s_name"), name=c("s_name"), acctbal=c("s_acctbal")),
        _nodes(t["part"], "Part", c("p_partkey"), c("p_partkey"), label=c("p_name"), name=c("p_name"), brand=c("p_brand"), ptype=c("p_type"), size=c("p_size").cast("long"), retailprice=c("p_retailprice")),
        _nodes(t["orders"], "Order", c("o_orderkey"), c("o_orderkey"), label=c("o_orderpriority"), order_status=c("o_orderstatus"), totalprice=c("o_totalprice"), order_date=F.date_format("o_orderdate", "yyyy-MM-dd")),
        _nodes(t["events"].select("user_id").distinct(), "User", c("user_id"), c("user_id")),
        _nodes(t["documents"], "Document", c("doc_id"), c("doc_id"), text=c("text"), language=c("lang"), source=c("source"), n_chars=c("n_chars")),
        _nodes(
            lines, "Fragment", F.concat_ws(":", c("doc_id").cast("string"), c("i").cast("string")), c("doc_id") * 1000 + c("i"), text=c("line"),
            document_id=c("doc_id"), line_start=(c("i") + 1).cast("long"), line_end=(c("i") + 1).cast("long"), relative_path=F.concat_ws("/", "source", c("doc_id").cast("string")),
        ),
        _nodes(t["pages"], "Page", c("page_id"), c("page_id"), label=c("url"), url=c("url")),
        _nodes(t["conversations"], "Turn", F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string")), c("conv_id") * 100 + c("turn"), label=c("role"), text=c("text"), role=c("role")),
    ]
    items = t["lineitem"]
    bought = items.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min(c("l_returnflag") == "R").alias("back"))
    supplied = items.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    by_conv = Window.partitionBy("conv_id").orderBy("turn")
    turns = t["conversations"].select("conv_id", "turn", F.lead("turn").over(by_conv).alias("next")).filter("next IS NOT NULL")
    edges = [
        _edges(t["nation"], "IN_REGION", _ref("nation", "n_nationkey"), _ref("region", "n_regionkey")),
        _edges(t["customer"], "IN_NATION", _ref("customer", "c_custkey"), _ref("nation", "c_nationkey")),
        _edges(t["supplier"], "IN_NATION", _ref("supplier", "s_suppkey"), _ref("nation", "s_nationkey")),
        _edges(t["orders"], "PLACED", _ref("customer", "o_custkey"), _ref("order", "o_orderkey")),
        _edges(bought, "CONTAINS", _ref("order", "l_orderkey"), _ref("part", "l_partkey"), weight=c("q") / 50, confidence=1 - c("d"), polarity=F.when(c("back"), -1).otherwise(1)),
        _edges(supplied, "SUPPLIED_BY", _ref("part", "l_partkey"), _ref("supplier", "l_suppkey"), weight=F.least(F.lit(1.0), c("n") / 10)),
        _edges(lines, "HAS_FRAGMENT", _ref("document", "doc_id"), _ref("fragment", "doc_id", "i")),
        _edges(turns, "NEXT", _ref("turn", "conv_id", "turn"), _ref("turn", "conv_id", "next")),
        _edges(_handovers(t["events"]), "EVENT_AFTER", _ref("user", "user_id"), _ref("user", "next"), weight=F.least(F.lit(1.0), c("n") / 10)),
    ]
    put = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Graph(put(nodes), put(edges))


def _handovers(events: DataFrame) -> DataFrame:
    """user_id, next, n: how often the next event, by time and id, is another user's.

    The order is global, so it is cut into days; each day's last event meets the next day's first through one row per day.
    """
    day = F.date_trunc("day", "ts")
    rows = events.select(day.alias("day"), "ts", "event_id", "user_id")
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = rows.withColumn("next", F.lead("user_id").over(within)).filter("next IS NOT NULL")
    at = F.struct("ts", "event_id", "user_id")
    ends = rows.groupBy("day").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    # one row per day in a constant partition: its size is the calendar's, not the data's
    across = ends.withColumn("next", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("day"))).filter("next IS NOT NULL")
    pairs = inside.select("user_id", "next").union(across.select("last.user_id", "next.user_id"))
    return pairs.filter("user_id <> next").groupBy("user_id", "next").agg(F.count(F.lit(1)).alias("n"))


#: The same graph for DuckDB: views `nodes` (core and promoted columns) and `edges`, as common table expressions.
def graph_sql() -> str:
    def node(kind: str, key: str, k: str, table: str, **more: str) -> str:
        values = {
            "type": f"'{kind}'", "id": f"'{kind.lower()}:' || {key}", "label": "CAST(NULL AS VARCHAR)", "text": "CAST(NULL AS VARCHAR)", "salience": f"({k} % 100) / 100.0::DOUBLE", "confidence": f"1.0::DOUBLE - ({k} % 5) / 10.0::DOUBLE",
            "usage_count": f"{k} % 20", "evidence_count": f"{k} % 6", "status": f"CASE WHEN {k} % 10 = 0 THEN 'archived' WHEN {k} % 10 = 1 THEN 'candidate' ELSE 'active' END",
            "activation": "0.0::DOUBLE", "volatility": "0.5::DOUBLE", "utility": "0.0::DOUBLE", "canonical_key": "CAST(NULL AS VARCHAR)", "updated_at": f"'{EPOCH}'",
        } | more
        return "SELECT " + ", ".join(f"{v} AS {c}" for c, v in values.items()) + f" FROM {table}"

    nodes = [
        node("Region", "r_regionkey", "r_regionkey", "region", label="r_name", name="r_name"),
        node("Nation", "n_nationkey", "n_nationkey", "nation", label="n_name", name="n_name"),
        node("Customer", "c_custkey", "c_custkey", "customer", label="c_name", name="c_name", acctbal="c_acctbal", segment="c_mktsegment"),
        node("Supplier", "s_suppkey", "s_suppkey", "supplier", label="s_name", name="s_name", acctbal="s_acctbal"),
        node("Part", "p_partkey", "p_partkey", "part", label="p_name", name="p_name", brand="p_brand", ptype="p_type", size="p_size", retailprice="p_retailprice"),
        node("Order", "o_orderkey", "o_orderkey", "orders", label="o_orderpriority", order_status="o_orderstatus", totalprice="o_totalprice", order_date="strftime(o_orderdate, '%Y-%m-%d')"),
        node("User", "user_id", "user_id", "(SELECT DISTINCT user_id FROM events)"),
        node("Document", "doc_id", "doc_id", "documents", text="text", language="lang", source="source", n_chars="n_chars"),
        node("Fragment", "doc_id || ':' || i", "(doc_id * 1000 + i)", "lines", text="line", document_id="doc_id", line_start="i + 1", line_end="i + 1", relative_path="source || '/' || doc_id"),
        node("Page", "page_id", "page_id", "pages", label="url", url="url"),
        node("Turn", "conv_id || ':' || turn", "(conv_id * 100 + turn)", "conversations", label="role", text="text", role="role"),
    ]

    def edge(kind: str, source: str, target: str, table: str, weight: str = "1.0::DOUBLE", confidence: str = "1.0::DOUBLE", polarity: str = "1") -> str:
        return f"SELECT '{kind}' AS type, {source} AS from_id, {target} AS to_id, '{kind}|' || {source} || '|' || {target} AS id, {weight} AS weight, {confidence} AS confidence, {polarity} AS polarity, 'deterministic' AS origin, '{EPOCH}' AS updated_at FROM {table}"

    edges = [
        edge("IN_REGION", "'nation:' || n_nationkey", "'region:' || n_regionkey", "nation"),
        edge("IN_NATION", "'customer:' || c_custkey", "'nation:' || c_nationkey", "customer"),
        edge("IN_NATION", "'supplier:' || s_suppkey", "'nation:' || s_nationkey", "supplier"),
        edge("PLACED", "'customer:' || o_custkey", "'order:' || o_orderkey", "orders"),
        edge("CONTAINS", "'order:' || l_orderkey", "'part:' || l_partkey", "(SELECT l_orderkey, l_partkey, max(l_quantity) AS q, min(l_discount) AS d, bool_and(l_returnflag = 'R') AS back FROM lineitem GROUP BY ALL)", "q / 50", "1 - d", "CASE WHEN back THEN -1 ELSE 1 END"),
        edge("SUPPLIED_BY", "'part:' || l_partkey", "'supplier:' || l_suppkey", "(SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)", "least(1.0::DOUBLE, n / 10.0::DOUBLE)"),
        edge("HAS_FRAGMENT", "'document:' || doc_id", "'fragment:' || doc_id || ':' || i", "lines"),
        edge("NEXT", "'turn:' || conv_id || ':' || turn", "'turn:' || conv_id || ':' || nxt", "(SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL"),
        edge("EVENT_AFTER", "'user:' || user_id", "'user:' || nxt", "(SELECT user_id, nxt, count(*) AS n FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> user_id GROUP BY ALL)", "least(1.0::DOUBLE, n / 10.0::DOUBLE)"),
    ]
    lines = "SELECT doc_id, source, i - 1 AS i, line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> ''"
    return f"WITH RECURSIVE lines AS ({lines}),\nnodes AS ({' UNION ALL BY NAME '.join(nodes)}),\nedges AS ({' UNION ALL BY NAME '.join(edges)})"
