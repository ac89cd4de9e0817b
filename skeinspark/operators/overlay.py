"""A private graph derived from a standard one: what the owner adds stays, what was derived follows its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinspark.functions.text import stable_id
from skeinspark.operators.graph import Graph
from skeinspark.schema import ACTIVE
from skeinspark.shared import materialize

#: The relations that items of an overlay may have.
RELATIONS = ("touches", "depends_on", "blocks", "implements", "documents", "tests", "relates_to", "decides", "finds")
KINDS = {"File": "AgentFile", "SourceArtifact": "AgentFile", "Function": "AgentSymbol", "Method": "AgentSymbol", "Class": "AgentSymbol", "Interface": "AgentSymbol", "Module": "AgentSymbol"}


def derive(standard: Graph) -> Graph:
    """Files and symbols of the standard graph under the overlay's types, and the edges between them."""
    kind = F.lit(None).cast("string")
    for source, target in KINDS.items():
        kind = F.when(F.col("type") == source, target).otherwise(kind)
    nodes = standard.nodes.filter(F.col("status").isin(*ACTIVE)).withColumn("type", kind).filter("type IS NOT NULL").withColumn("origin", F.lit("standard"))
    ids = nodes.select(F.col("id").alias("__id"))
    edges = standard.edges.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi")
    return Graph(nodes, edges.withColumn("origin", F.lit("standard")))


def sync(overlay: Graph, standard: Graph) -> tuple[Graph, DataFrame]:
    """The overlay brought up to date, and (id, change): new, changed and stale derived nodes. The owner's own rows stay."""
    fresh = derive(standard)
    own = overlay.nodes.filter("origin <> 'standard'")
    old = overlay.nodes.filter("origin = 'standard'")
    cols = [c for c in fresh.nodes.columns if c in old.columns and c not in ("id", "created_at", "updated_at")]
    a = old.select("id", F.xxhash64(*cols).alias("a"))
    b = fresh.nodes.select("id", F.xxhash64(*cols).alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "stale").when(F.col("a") != F.col("b"), "changed")
    changes = a.join(b, "id", "full_outer").select("id", change.alias("change")).filter("change IS NOT NULL")
    edges = overlay.edges.filter("origin <> 'standard'").unionByName(fresh.edges, allowMissingColumns=True)
    return Graph(own.unionByName(fresh.nodes, allowMissingColumns=True), edges), changes


def item(graph: Graph, kind: str, title: str, now: str, status: str = "active", session: str | None = None) -> DataFrame:
    """One node row of the owner's: a task, decision, finding, note or session."""
    spark = graph.nodes.sparkSession
    row = spark.createDataFrame([(kind, title, status, now, session)], "type string, label string, status string, created_at string, session string")
    key = stable_id(kind.lower(), F.col("label"), F.col("created_at"))
    return row.withColumns({"id": key, "updated_at": F.col("created_at"), "origin": F.lit("agent")})


def add(graph: Graph, rows: DataFrame) -> Graph:
    """All rows or none: the result is one new graph, which one snapshot commits."""
    return Graph(graph.nodes.unionByName(rows, allowMissingColumns=True), graph.edges)


def link(graph: Graph, pairs: DataFrame, relation: str, now: str) -> Graph:
    """pairs: from_id, and to_id or path; a path is looked up among the files."""
    if relation not in RELATIONS:
        raise ValueError(f"no relation {relation!r}; there are {', '.join(RELATIONS)}")
    if "path" in pairs.columns:
        files = graph.nodes.filter("type = 'AgentFile'").select(F.col("relative_path").alias("path"), F.col("id").alias("to_id"))
        pairs = pairs.join(files, "path").select("from_id", "to_id")
    rows = pairs.select("from_id", "to_id", F.lit(relation).alias("type"), F.concat_ws("|", F.lit(relation), "from_id", "to_id").alias("id"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit(1).alias("polarity"), F.lit("agent").alias("origin"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return Graph(graph.nodes, graph.edges.unionByName(rows, allowMissingColumns=True).dropDuplicates(["id"]))


def complete(graph: Graph, item_id: str, now: str) -> Graph:
    done = F.col("id") == item_id
    return Graph(graph.nodes.withColumns({"status": F.when(done, "done").otherwise(F.col("status")), "updated_at": F.when(done, F.lit(now)).otherwise(F.col("updated_at"))}), graph.edges)


def items(graph: Graph, kind: str | None = None, status: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    rows = graph.nodes.filter("origin = 'agent'")
    for name, value in (("type", kind), ("status", status)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if since is not None:
        rows = rows.filter(F.col("updated_at") >= since)
    return rows.orderBy(F.col("updated_at").desc(), "id").limit(limit)


def closure(graph: Graph, start: str, relations: tuple[str, ...] = RELATIONS, most: int = 12) -> DataFrame:
    """id, depth of all that is reached from one item along these relations, level by level."""
    steps = graph.edges.filter(F.col("type").isin(*relations)).select("from_id", "to_id")
    seen = materialize(graph.nodes.filter(F.col("id") == start).select("id", F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, most + 1):
        new = steps.join(frontier.select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id")).distinct()
        frontier = materialize(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen
