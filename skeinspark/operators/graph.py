"""A property graph as two DataFrames, and the store's read operators over them.

nodes: core columns, promoted properties as columns of their own, and optionally `properties`, a JSON text for the rest.
edges: core columns likewise. Every sort ends with the id, so that results don't depend on partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinspark.schema import ACTIVE
from skeinspark.shared import materialize

#: The columns by which nodes can be listed; others fall back to salience.
NODE_ORDERS = ("salience", "activation", "created_at", "updated_at", "last_used_at", "usage_count")


def resolver(df: DataFrame, prefix: str = ""):
    """Finds a field among the columns of df whose names start with prefix; deeper names are looked up in the JSON column `properties`."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def find(name: str) -> tuple[Column, T.DataType] | None:
        name = name.removeprefix("properties.")
        if prefix + name in kinds:
            return F.col(f"`{prefix}{name}`"), kinds[prefix + name]
        if prefix + "properties" in kinds:
            return F.get_json_object(F.col(f"`{prefix}properties`"), "$." + name), T.StringType()
        return None

    return find


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # -- lookups --------------------------------------------------------------
    def all_nodes(self) -> DataFrame:
        return self.nodes.orderBy("created_at", "id")

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("created_at", "id")

    def get_node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def get_nodes(self, ids: list[str]) -> DataFrame:
        """In the order of the request; what isn't there is left out."""
        spark = self.nodes.sparkSession
        wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id string")
        return self.nodes.join(F.broadcast(wanted), "id").orderBy("pos").drop("pos")

    def get_node_by_key(self, kind: str, key: str) -> DataFrame:
        return self.nodes.filter((F.col("type") == kind) & (F.col("canonical_key") == key))

    def get_edge(self, edge_id: str) -> DataFrame:
        return self.edges.filter(F.col("id") == edge_id)

    def get_edge_by_pattern(self, from_id: str, to_id: str, kind: str) -> DataFrame:
        return self.edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("type") == kind))

    def find_nodes(self, kind: str | None = None, status: list[str] | None = None, limit: int = 100, order_by: str = "salience", descending: bool = True) -> DataFrame:
        rows = self.nodes
        if kind:
            rows = rows.filter(F.col("type") == kind)
        if status:
            rows = rows.filter(F.col("status").isin(status))
        c = F.col(order_by if order_by in NODE_ORDERS else "salience")
        return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "id").limit(limit)

    def find_nodes_by_property(self, name: str, value: object, kind: str | None = None, status: list[str] | None = None, limit: int = 100) -> DataFrame:
        """Strict equality: no folding of case, no coercion between text and numbers."""
        found = resolver(self.nodes)(name)
        same_kind = found is not None and isinstance(value, str) == isinstance(found[1], T.StringType)
        rows = self.nodes.filter(found[0] == value if same_kind else F.lit(False))
        if kind:
            rows = rows.filter(F.col("type") == kind)
        if status:
            rows = rows.filter(F.col("status").isin(status))
        return rows.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit)

    def find_edges_by_property(self, name: str, value: object, kind: str | None = None, limit: int = 100) -> DataFrame:
        found = resolver(self.edges)(name)
        rows = self.edges.filter(found[0] == value if found else F.lit(False))
        if kind:
            rows = rows.filter(F.col("type") == kind)
        return rows.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(limit)

    def get_edges(self, from_id: str | None = None, to_id: str | None = None, kinds: list[str] | None = None, limit: int = 1000) -> DataFrame:
        rows = self.edges
        for name, value in (("from_id", from_id), ("to_id", to_id)):
            if value is not None:
                rows = rows.filter(F.col(name) == value)
        if kinds:
            rows = rows.filter(F.col("type").isin(kinds))
        return rows.orderBy(F.col("weight").desc(), "id").limit(limit)

    def incident_edges(self, ids: DataFrame, kinds: list[str] | None = None, ignored: list[str] | None = None, limit: int | None = 10_000) -> DataFrame:
        """Edges that touch any id of ids (column id), strongest first."""
        rows = self.edges
        if kinds:
            rows = rows.filter(F.col("type").isin(kinds))
        if ignored:
            rows = rows.filter(~F.col("type").isin(ignored))
        ids = ids.select(F.col("id").alias("__id")).distinct()
        touched = rows.join(ids, rows["from_id"] == F.col("__id"), "left_semi").unionByName(rows.join(ids, rows["to_id"] == F.col("__id"), "left_semi")).dropDuplicates(["id"])
        touched = touched.orderBy(F.col("weight").desc(), F.col("updated_at").desc_nulls_last(), "id")
        return touched if limit is None else touched.limit(limit)

    # -- neighbourhoods -------------------------------------------------------
    def ends(self, kinds: list[str] | None = None, ignored: list[str] | None = None, least_weight: float | None = None) -> DataFrame:
        """node, neighbour, direction and the edge's columns: both orientations of each edge; a self-loop comes once, as out."""
        rows = self.edges
        if kinds:
            rows = rows.filter(F.lower("type").isin([k.lower() for k in kinds]))
        if ignored:
            rows = rows.filter(~F.col("type").isin(ignored))
        if least_weight is not None:
            rows = rows.filter(F.col("weight") >= least_weight)
        cols = [F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), "weight", "confidence", "polarity"]
        out = rows.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), F.lit("out").alias("direction"), *cols)
        back = rows.filter("from_id <> to_id").select(F.col("to_id").alias("node"), F.col("from_id").alias("neighbour"), F.lit("in").alias("direction"), *cols)
        return out.union(back)

    def neighbours(self, ids: DataFrame | None = None, per_node: int | None = 500, direction: str = "both", kinds: list[str] | None = None, least_weight: float = 0.0) -> DataFrame:
        """The strongest edges of every node (or of those in ids), at most per_node in each direction, out before in. Without per_node all edges, and no rank."""
        rows = self.ends(kinds, least_weight=least_weight)
        if direction != "both":
            rows = rows.filter(F.col("direction") == direction)
        if ids is not None:
            rows = rows.join(ids.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
        known = self.nodes.select(F.col("id").alias("neighbour"))
        rows = rows.join(known, "neighbour", "left_semi")
        if per_node is None:
            return rows
        one = Window.partitionBy("node", "direction").orderBy(F.col("weight").desc(), "edge_id")
        rows = rows.withColumn("rank", F.row_number().over(one)).filter(F.col("rank") <= per_node)
        both = Window.partitionBy("node").orderBy(F.col("direction").desc(), "rank")
        return rows.withColumn("rank", F.row_number().over(both)).filter(F.col("rank") <= per_node)

    def degrees(self, kinds: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
        """id, degree (incident edges; a self-loop counts once), weighted (sum of weight times confidence): nodes with edges only."""
        return self.ends(kinds, ignored).groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.col("weight") * F.col("confidence")).alias("weighted"))

    def top_by_degree(self, limit: int = 100, kinds: list[str] | None = None, excluded: list[str] | None = None, ignored: list[str] | None = None, statuses: tuple[str, ...] = ACTIVE) -> DataFrame:
        rows = self.nodes.filter(F.col("status").isin(*statuses))
        if kinds:
            rows = rows.filter(F.lower("type").isin([k.lower() for k in kinds]))
        if excluded:
            rows = rows.filter(~F.col("type").isin(excluded))
        rows = rows.join(self.degrees(ignored=ignored), "id", "left").fillna({"degree": 0, "weighted": 0.0})
        # equal sums differ by the order in which they were added up, which must not rank them
        return rows.orderBy(F.col("degree").desc(), F.round("weighted", 9).desc(), F.col("salience").desc(), F.col("updated_at").desc_nulls_last(), "id").limit(limit)

    def neighbourhood(self, node_id: str, depth: int = 2, kinds: list[str] | None = None, limit: int | None = 1000) -> DataFrame:
        """id, depth of the nodes within `depth` steps: level by level, nearest first, at most limit; None: all of them, along all edges."""
        seen = materialize(self.get_node(node_id).select("id", F.lit(0).alias("depth")))
        frontier = seen
        for step in range(1, depth + 1):
            new = self.neighbours(frontier, limit, kinds=kinds).select(F.col("neighbour").alias("id")).distinct()
            frontier = materialize(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)))
            seen = seen.union(frontier)
        seen = seen.orderBy("depth", "id")
        return seen if limit is None else seen.limit(limit)

    # -- counts ---------------------------------------------------------------
    def node_type_counts(self) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy("type")

    def count_nodes(self, kinds: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
        rows = self.nodes
        if kinds:
            rows = rows.filter(F.col("type").isin(kinds))
        if statuses:
            rows = rows.filter(F.col("status").isin(statuses))
        return rows.agg(F.count(F.lit(1)).alias("nodes"))

    def count_edges(self, kinds: list[str] | None = None, project: str | None = None, with_global: bool = True) -> DataFrame:
        """Edges of these types; of a project, and with those of no project, if edges have project_id."""
        rows = self.edges.filter(F.col("type").isin(kinds)) if kinds else self.edges
        if project is not None:
            own = F.col("project_id") if "project_id" in self.edges.columns else F.lit(None).cast("string")
            rows = rows.filter((own == project) | (own.isNull() & F.lit(with_global)))
        return rows.agg(F.count(F.lit(1)).alias("edges"))

    def layer_counts(self) -> DataFrame:
        """nodes, edges (those of which both ends are there) and loose_edges."""
        nodes, edges, whole = (df.agg(F.count(F.lit(1)).alias("n")) for df in (self.nodes, self.edges, self.whole_edges()))
        row = nodes.select(F.col("n").alias("nodes")).crossJoin(whole.select(F.col("n").alias("edges"))).crossJoin(edges.select(F.col("n").alias("every")))
        return row.select("nodes", "edges", (F.col("every") - F.col("edges")).alias("loose_edges"))

    def project_status(self, project: str) -> DataFrame:
        """what (artifact_type or status), value, n over the project's artifacts, in one pass."""
        rows = self.nodes.filter((F.col("type") == "SourceArtifact") & (F.col("project_id") == project))
        each = F.explode(F.array(F.struct(F.lit("artifact_type").alias("what"), F.coalesce("artifact_type", F.lit("unknown")).alias("value")), F.struct(F.lit("status").alias("what"), F.col("status").alias("value"))))
        return rows.select(each.alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))

    def with_relation(self, ids: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Of ids those that an edge of these types touches at either end."""
        touched = self.edges.filter(F.col("type").isin(*kinds)).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
        return ids.join(touched, "id", "left_semi")

    def whole_edges(self) -> DataFrame:
        """Edges of which both ends are there."""
        ids = self.nodes.select(F.col("id").alias("__id"))
        return self.edges.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi")

    def export_json(self) -> DataFrame:
        """kind, json: all nodes, then the edges whose ends are there."""
        pack = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("json"))
        return pack(self.nodes, "node").union(pack(self.whole_edges(), "edge"))
