"""Statements bound to a graph: each becomes one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinspark.functions.text import analyse
from skeinspark.operators import analysis, findings, retrieval
from skeinspark.operators.activation import activate
from skeinspark.operators.graph import Graph, resolver
from skeinspark.operators.paths import simple_paths
from skeinspark.plans.language import LISTS, EvaluationProblem, Statement, parse
from skeinspark.plans.predicates import Resolver, predicate, sort_columns
from skeinspark.schema import ACTIVE

#: The columns that a statement shows if it doesn't say.
DEFAULTS = {
    "FIND NODES": ("id", "type", "label", "text", "status", "salience", "confidence", "activation"),
    "FIND EDGES": ("id", "type", "from_id", "to_id", "weight", "confidence", "polarity", "origin"),
    "SEARCH": ("rank", "score", "id", "type", "label", "text", "salience", "confidence", "activation"),
    "RETRIEVE": ("rank", "score", "id", "type", "label", "text", "source_for", "relation", "direction", "relative_path", "line_start", "line_end"),
    "ACTIVATE": ("id", "type", "label", "text", "activation", "salience", "confidence"),
    "PATH": ("length", "score", "node_ids", "node_labels", "edge_types", "edge_ids"),
    "PROJECTS": ("id", "name", "root_path", "status", "updated_at"),
    "ARTIFACTS": ("id", "relative_path", "path", "artifact_type", "language", "status", "size_bytes", "sha256"),
    "FRAGMENTS": ("id", "artifact_id", "fragment_type", "section_path", "start_line", "end_line", "status", "text"),
    "SYMBOLS": ("id", "type", "name", "qualified_name", "relative_path", "start_line", "end_line", "status"),
    "FINDINGS": ("id", "finding_type", "severity", "symbol_type", "symbol_name", "qualified_name", "relative_path", "directory", "file_count", "files", "line_start", "cleanup_priority", "cleanup_rank", "evidence_scope", "confidence", "reason", "status"),
    "DELTAS": ("id", "run_id", "project_id", "artifact_id", "created_at", "added_nodes", "updated_nodes", "archived_nodes"),
}
LIST_ORDER = {"DELTAS": "created_at", "FINDINGS": "cleanup_rank"}
PRIORITY = {"high": 3, "medium": 2, "low": 1}


def _pick(df: DataFrame, resolve: Resolver, columns: list[str]) -> DataFrame:
    out = []
    for name in columns:
        found = resolve(name)
        out.append((found[0] if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def _of_types(df: DataFrame, kinds: list[str], column: str = "type") -> DataFrame:
    return df.filter(F.lower(F.col(column)).isin([k.lower() for k in kinds])) if kinds else df


def _desc(*names: str) -> list[Column]:
    return [F.col(f"`{n}`").desc_nulls_last() for n in names]


class Engine:
    """Runs statements. Analytics don't write; what they find is returned."""

    def __init__(self, graph: Graph, index: DataFrame | None = None) -> None:
        self.graph, self.index = graph, index

    def run(self, source: str | Statement) -> DataFrame:
        st = parse(source) if isinstance(source, str) else source
        names: dict[str, Callable[[Statement], DataFrame]] = {
            "FIND NODES": self.find_nodes, "FIND EDGES": self.find_edges, "MATCH": self.match, "PATH": self.path, "SEARCH": self.search, "RETRIEVE": self.retrieve,
            "ACTIVATE": self.activate, "EXPLAIN NODE": self.explain_node, "EXPLAIN SEARCH": self.explain_search, "EXPLAIN HUB": self.explain_hub, "STATS": self.stats,
            "COMMUNITIES": self.communities, "HUBS": self.hubs, "CACHE STATUS": self.cache_status, "VERIFY FINDING": self.verify,
        }
        return names.get(st.kind, self.listing)(st)

    def columns(self, st: Statement) -> list[str]:
        return st.columns or list(DEFAULTS[st.kind])

    # -- scans ----------------------------------------------------------------
    def find_nodes(self, st: Statement) -> DataFrame:
        rows = _of_types(self.graph.nodes, st.types)
        if not st.archived:
            rows = rows.filter(F.col("status").isin(*ACTIVE))
        base = resolver(rows)
        find = lambda name: base(name.removeprefix("node."))
        if st.where is not None:
            rows = rows.filter(predicate(st.where, find))
        order = sort_columns(find(st.order.field), st.order.descending) if st.order else _desc("salience", "activation", "updated_at")
        return _pick(rows.orderBy(*order, "id").limit(st.limit), find, self.columns(st))

    def find_edges(self, st: Statement) -> DataFrame:
        rows = self._with_ends(_of_types(self.graph.edges, st.types), "from", "to", "")
        find = self._aliases(rows, {"from": "from.", "to": "to.", "edge": ""}, "")
        if st.where is not None:
            rows = rows.filter(predicate(st.where, find))
        order = sort_columns(find(st.order.field), st.order.descending) if st.order else _desc("weight", "confidence", "updated_at")
        return _pick(rows.orderBy(*order, "id").limit(st.limit), find, self.columns(st))

    def _with_ends(self, edges: DataFrame, left: str, right: str, edge: str, left_type: str | None = None, right_type: str | None = None) -> DataFrame:
        """Edges with the columns of both ends under prefixes; edges whose ends aren't there drop out. Columns that nobody names are pruned."""
        put = lambda df, p: df.select(*[F.col(f"`{c}`").alias(f"{p}.{c}" if p else c) for c in df.columns])
        ends = [_of_types(self.graph.nodes, [t] if t else []) for t in (left_type, right_type)]
        e = put(edges, edge)
        key = lambda c: F.col(f"`{edge}.{c}`" if edge else c)
        return e.join(put(ends[0], left), key("from_id") == F.col(f"`{left}.id`")).join(put(ends[1], right), key("to_id") == F.col(f"`{right}.id`"))

    @staticmethod
    def _aliases(rows: DataFrame, prefixes: dict[str, str], default: str) -> Resolver:
        subjects = {alias.lower(): resolver(rows, prefix) for alias, prefix in prefixes.items()}
        plain = resolver(rows, default)

        def find(name: str):
            head, _, rest = name.partition(".")
            return subjects[head.lower()](rest.lower()) if rest and head.lower() in subjects else plain(name.lower())

        return find

    # -- patterns and paths -----------------------------------------------------
    def match(self, st: Statement) -> DataFrame:
        (a, left), (b, right), r = st.options["left"], st.options["right"], st.options["edge"]
        edges = _of_types(self.graph.edges, st.types)
        parts = []
        if st.options["direction"] in ("out", "both"):
            parts.append(self._with_ends(edges, a, b, r, left, right))
        if st.options["direction"] in ("in", "both"):
            turned = edges.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})
            back = self._with_ends(turned, a, b, r, left, right)
            parts.append(back.withColumns({f"{r}.from_id": F.col(f"`{r}.to_id`"), f"{r}.to_id": F.col(f"`{r}.from_id`")}))
        rows = reduce(DataFrame.unionByName, parts)
        find = self._aliases(rows, {a: f"{a}.", r: f"{r}.", b: f"{b}."}, f"{a}.")
        if st.where is not None:
            rows = rows.filter(predicate(st.where, find))
        order = sort_columns(find(st.order.field), st.order.descending) if st.order else _desc(f"{r}.weight", f"{a}.salience", f"{b}.salience")
        columns = st.columns or [f"{a}.id", f"{a}.type", f"{a}.label", f"{r}.type", f"{r}.weight", f"{b}.id", f"{b}.type", f"{b}.label"]
        return _pick(rows.orderBy(*order, F.col(f"`{r}.id`"), F.col(f"`{a}.id`")).limit(st.limit), find, columns)

    def selected(self, selector: tuple[str, str, str | None]) -> DataFrame:
        mode, value, kind = selector
        if mode == "id":
            found = self.graph.get_node(value).select("id")
        elif mode == "key":
            found = self.graph.get_node_by_key(kind or "", analyse(self.graph.nodes.sparkSession, value).key).select("id")
        else:
            found = retrieval.retrieve(self.graph, value, 5, 1, index=self.index).select("id")
        if found.isEmpty():
            raise EvaluationProblem(f"the selector {value!r} matches no node")
        return found.limit(5)

    def path(self, st: Statement) -> DataFrame:
        rows = simple_paths(self.graph, self.selected(st.options["start"]), self.selected(st.options["end"]), st.options["depth"], st.types or None)
        best = rows.orderBy(F.col("score").desc(), "length", F.col("node_ids")).limit(st.limit)
        return _pick(best, resolver(best), self.columns(st))

    # -- retrieval --------------------------------------------------------------
    def search(self, st: Statement) -> DataFrame:
        ranked = retrieval.retrieve(self.graph, st.options["text"], st.limit, st.options["depth"], st.types or None, st.archived, index=self.index)
        rows = ranked.select("id", "score", "depth_penalty").join(self.graph.nodes, "id")
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "depth_penalty", "id")
        rows = rows.withColumn("rank", F.row_number().over(order)).orderBy("rank")
        if st.options.get("context") and st.columns is None:
            line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.coalesce("label", "text", "id"))
            return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("context"), F.count(F.lit(1)).alias("ranked_nodes")).withColumn("trace_id", F.lit(None).cast("string"))
        return _pick(rows, resolver(rows), self.columns(st))

    def retrieve(self, st: Statement) -> DataFrame:
        o = st.options
        rows = retrieval.memories(self.graph, o["text"], st.limit, o["top"], o["depth"], st.types or None, st.archived, o["sources"], o["filter"], o["max_text"], self.index).orderBy("rank")
        return _pick(rows, resolver(rows), self.columns(st))

    def activate(self, st: Statement) -> DataFrame:
        got = activate(self.graph, st.options["seeds"], st.options["depth"], st.options["min"])
        rows = self.graph.nodes.drop("activation").join(got, "id").orderBy(F.col("activation").desc(), "id").limit(st.limit)
        return _pick(rows, resolver(rows), self.columns(st))

    # -- explanations and counts --------------------------------------------------
    def explain_node(self, st: Statement) -> DataFrame:
        node = self.graph.get_node(st.options["id"])
        if node.isEmpty():
            raise EvaluationProblem(f"there is no node {st.options['id']!r}")
        ids = node.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
        ways = [("out", "from_id", "to_id"), ("in", "to_id", "from_id")]
        parts = []
        for way, here, there in ways:
            near = self.graph.edges.filter(F.col(here) == st.options["id"]).orderBy(F.col("weight").desc(), "id").limit(st.limit)
            parts.append(near.select(F.lit(way).alias("direction"), F.col("type").alias("edge_type"), "weight", "confidence", F.col(there).alias("neighbor_id"), "id", F.col(here).alias("node")))
        other = self.graph.nodes.select(F.col("id").alias("neighbor_id"), F.col("type").alias("neighbor_type"), F.col("label").alias("neighbor_label"))
        rows = parts[0].union(parts[1]).join(F.broadcast(ids), "node").join(other, "neighbor_id").orderBy(F.col("weight").desc(), F.col("confidence").desc(), "id", "direction").limit(st.limit)
        return rows.select(F.col("node").alias("node_id"), "node_type", "direction", "edge_type", "weight", "confidence", "neighbor_id", "neighbor_type", "neighbor_label")

    def explain_search(self, st: Statement) -> DataFrame:
        ranked = retrieval.retrieve(self.graph, st.options["text"], st.limit, st.options["depth"], index=self.index)
        rows = ranked.join(self.graph.nodes.select("id", "type", "label", "text"), "id")
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "depth_penalty", "id")
        return rows.select(F.row_number().over(order).alias("rank"), "score", "id", "type", "label", "text", F.struct(*retrieval.REASONS).alias("reasons")).orderBy("rank")

    def explain_hub(self, st: Statement) -> DataFrame:
        """The node among the hub candidates; one that isn't among them is measured against the whole graph and has no rank."""
        found = analysis.hubs(self.graph, 1000).filter(F.col("id") == st.options["id"])
        if found.isEmpty():
            one = self.graph.get_node(st.options["id"])
            if one.isEmpty():
                raise EvaluationProblem(f"there is no node {st.options['id']!r}")
            found = analysis.score_hubs(self.graph, one, None, analysis.centrality(self.graph)).withColumn("rank", F.lit(None).cast("int"))
        return found.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), "label", "hub_score", F.col("rank").alias("hub_rank"), "is_hub", F.split("reason", "; ").alias("reasons"))

    def stats(self, st: Statement) -> DataFrame:
        rows = _of_types(self.graph.nodes, st.types)
        if not st.options["by"]:
            nodes = rows.agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("long").alias("edges"))
            edges = self.graph.whole_edges().agg(F.lit(0).cast("long").alias("nodes"), F.count(F.lit(1)).alias("edges"))
            return nodes.union(edges).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))
        find, keys = resolver(rows), []
        for name in st.options["by"]:
            found = find(name.removeprefix("node."))
            c = found[0] if found else F.lit(None).cast("string")
            if found and isinstance(found[1], (T.ArrayType, T.MapType, T.StructType)):
                c = F.to_json(c)
            keys.append(c.alias(name))
        order = [F.col(f"`{name}`").asc_nulls_first() for name in st.options["by"]]
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), *order)

    # -- lists ----------------------------------------------------------------
    def listing(self, st: Statement) -> DataFrame:
        rows = _of_types(self.graph.nodes, st.types or LISTS[st.kind]).filter(F.col("status").isin(*ACTIVE))
        find = resolver(rows)
        if st.kind == "DELTAS":
            kind = find("kind")
            if kind:
                rows = rows.filter(kind[0].isNull() | (kind[0] == "compilation"))
        if st.where is not None:
            rows = rows.filter(predicate(st.where, find))
        field = st.order.field if st.order else LIST_ORDER.get(st.kind, "updated_at")
        found = find(field)
        if found and field == "cleanup_priority":
            rank = F.lit(0)
            for word, value in PRIORITY.items():
                rank = F.when(F.lower(found[0]) == word, value).otherwise(rank)
            found = (rank, T.IntegerType())
        order = sort_columns(found, st.order.descending if st.order else True)
        return _pick(rows.orderBy(*order, "id").limit(st.limit), find, self.columns(st))

    def cache_status(self, st: Statement) -> DataFrame:
        rows = self.graph.nodes.filter(F.col("type") == "ArtifactCacheEntry")
        find = resolver(rows)
        project, compiled = ((find(n) or (F.lit(None).cast("string"),))[0].cast("string") for n in ("project_id", "compiled_at"))
        rows = rows.select(project.alias("project_id"), F.coalesce(compiled, F.lit("")).alias("compiled_at"), "status").filter("project_id <> ''")
        active, gone = F.count_if(F.col("status") == "active"), F.count_if(F.col("status") == "archived")
        out = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_entries"), active.alias("active_entries"), gone.alias("archived_entries"), active.alias("cached_artifacts"), F.max("compiled_at").alias("latest_compiled_at"))
        return out.orderBy(F.col("latest_compiled_at").desc(), F.col("project_id").desc()).limit(st.limit)

    def communities(self, st: Statement) -> DataFrame:
        """All communities; the limit comes after the filter and the order."""
        return self._ranked(analysis.communities(self.graph)[0], st, "salience")

    def hubs(self, st: Statement) -> DataFrame:
        """All scored candidates; the limit comes after the filter and the order."""
        rows = analysis.hubs(self.graph, max(5 * st.limit, 100), st.types or None, every=True)
        return self._ranked(rows, st, "hub_score").select("rank", "id", "type", "label", "hub_score", "specificity", "generic_penalty", "reason")

    @staticmethod
    def _ranked(rows: DataFrame, st: Statement, default: str) -> DataFrame:
        find = resolver(rows)
        if st.where is not None:
            rows = rows.filter(predicate(st.where, find))
        order = sort_columns(find(st.order.field if st.order else default), st.order.descending if st.order else True)
        return rows.orderBy(*order, "id").limit(st.limit)

    def verify(self, st: Statement) -> DataFrame:
        found = self.graph.get_node(st.options["id"]).select("type").first()
        if found is None:
            raise EvaluationProblem(f"there is no finding {st.options['id']!r}")
        if found.type != "StaticAnalysisFinding":
            raise EvaluationProblem(f"{st.options['id']!r} is a {found.type}, not a finding")
        return findings.verify(self.graph, st.options["id"])
