"""Static-analysis findings: unused symbols and orphan directories by anti-join, and the bundle that verifies one finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinspark.operators.graph import Graph, resolver
from skeinspark.schema import ACTIVE

#: Edges that count as a use of a symbol.
USAGE_EDGES = (
    "CALLS", "DECORATED_BY", "DEPENDS_ON", "EMITS", "EXTENDS", "HANDLES_ROUTE", "IMPLEMENTS", "IMPORTS", "IMPORTS_FROM", "INHERITS",
    "INSTANTIATES", "OVERRIDES", "RAISES", "READS", "REFERENCES", "RETURNS", "RE_EXPORTS", "USES", "WRITES",
)


def unused(symbols: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = USAGE_EDGES) -> DataFrame:
    """The symbols (id) that no edge of these kinds points to. Used ids are made distinct map-side before they meet the symbols."""
    used = edges.filter(F.col("type").isin(*kinds)).select(F.col("to_id").alias("id")).distinct()
    return symbols.join(used, "id", "left_anti")


def finding_priority(kind: Column, confidence: Column, scope: Column) -> Column:
    local = ~scope.startswith("public_api")
    return F.when(kind.isin("unused_import", "unused_variable") & (confidence >= 0.75) & local, "high").when(local, "medium").otherwise("low")


def removal_safety(priority: Column, signals: Column) -> Column:
    risky = F.arrays_overlap(signals, F.array(*[F.lit(x) for x in ("public_api", "entrypoint", "framework_lifecycle")]))
    return F.when((priority == "high") & (F.size(signals) == 0), "safe").when(risky, "risky").otherwise("validate")


def orphan_directories(files: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """directory, file_count, files of directories of code files that nothing outside links into; a directory within an equal set of files gives way to the shallower one.

    files: path. links: source, target (paths). Files go to all their ancestors; a link counts against the ancestors of its
    target that aren't ancestors of its source.
    """
    above = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '/')) - 1), i -> array_join(slice(split({c}, '/'), 1, i), '/'))")
    nested = files.filter(F.contains("path", F.lit("/")))
    owned = nested.select("path", F.explode(above("path")).alias("directory"))
    groups = owned.groupBy("directory").agg(F.count_distinct("path").alias("file_count"), F.sort_array(F.collect_set("path")).alias("files")).filter(F.col("file_count") >= least)
    deep = links.filter(F.contains("target", F.lit("/")))
    source_above = F.when(F.contains("source", F.lit("/")), above("source")).otherwise(F.array().cast("array<string>"))
    entered = deep.select(F.explode(F.array_except(above("target"), source_above)).alias("directory")).distinct()
    lonely = groups.join(entered, "directory", "left_anti")
    first = lonely.groupBy("files").agg(F.min_by("directory", F.struct(F.size(F.split("directory", "/")), "directory")).alias("directory"))
    return first.join(lonely.drop("files"), "directory").select("directory", "file_count", "files")


def locate(fragments: DataFrame, points: DataFrame) -> DataFrame:
    """points with the id of the smallest fragment whose span holds their line: an equi-join on the path with a range condition, then a rank.

    fragments: id, relative_path, line_start, line_end; points: id, relative_path, line.
    """
    f = fragments.select(F.col("id").alias("fragment_id"), "relative_path", "line_start", "line_end")
    met = points.join(f, "relative_path").filter((F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end")))
    return met.groupBy("id", "relative_path", "line").agg(F.min_by("fragment_id", F.struct(F.col("line_end") - F.col("line_start"), "line_start", "fragment_id")).alias("fragment_id"))


def _get(find, *names: str) -> Column:
    found = [f[0].cast("string") for f in map(find, names) if f]
    return F.coalesce(*found, F.lit(None).cast("string"))


def _place(find) -> Column:
    """Location columns, with those of the nested metadata where the node has none."""
    return F.struct(
        _get(find, "relative_path", "metadata.relative_path").alias("relative_path"), _get(find, "path", "metadata.source_path").alias("path"),
        _get(find, "line_start", "start_line", "metadata.start_line").alias("line_start"), _get(find, "line_end", "end_line", "metadata.end_line").alias("line_end"),
    )


def verify(graph: Graph, finding_id: str) -> DataFrame:
    """One row: the finding, a snippet, the usage edges of its symbol, the scopes checked, the risks, and what to do."""
    node = graph.get_node(finding_id)
    find = resolver(node)
    edges = graph.edges
    owners = edges.filter((F.col("to_id") == finding_id) & (F.col("type") == "HAS_FINDING")).select(F.col("from_id").alias("id"))
    by_edge = graph.nodes.join(owners, "id", "left_semi").filter(~F.col("type").isin("SourceArtifact", "File")).agg(F.min(F.struct("type", "id")).alias("x")).select(F.col("x.id").alias("by_edge"))
    named = _get(find, "symbol_id")
    head = node.select(
        "id", "status", F.col("confidence").cast("double").alias("confidence"), *[_get(find, c).alias(c) for c in ("finding_type", "severity", "reason", "cleanup_priority", "cleanup_rank", "removal_safety", "validation_reason", "symbol_name", "qualified_name", "artifact_id", "evidence_scope", "context_scope", "relative_path")],
        _get(find, "line_start").cast("long").alias("line"), _place(find).alias("location"), F.coalesce(_get(find, "blocking_signals"), F.lit("[]")).alias("signals"), F.col("text").alias("finding_text"), "label", named.alias("named"),
    )
    symbol_id = head.join(by_edge, F.lit(True), "left").select(F.coalesce("named", "by_edge").alias("symbol_id")).first().symbol_id
    touching = edges.filter(F.col("type").isin(*USAGE_EDGES) & ((F.col("from_id") == symbol_id) | (F.col("to_id") == symbol_id)))
    out_way = F.col("from_id") == symbol_id
    uses = touching.select(F.when(out_way, "outgoing").otherwise("incoming").alias("direction"), F.col("type").alias("edge_type"), F.when(out_way, F.col("to_id")).otherwise(F.col("from_id")).alias("other_id"), F.col("id").alias("edge_id"))
    other = graph.nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"), F.col("label").alias("other_label"))
    use = F.struct("direction", "edge_type", "other_id", "edge_id", "other_type", "other_label")
    uses = uses.join(other, "other_id", "left").agg(F.sort_array(F.collect_list(use)).alias("uses_found"))
    evidence = edges.filter((F.col("type") == "EVIDENCED_BY") & (F.col("from_id") == symbol_id)).select(F.col("to_id").alias("id"))
    fragments = graph.nodes.filter((F.col("type") == "SourceFragment") & F.col("status").isin(*ACTIVE))
    ffind = resolver(fragments)
    start, end = _get(ffind, "line_start", "start_line").cast("long"), _get(ffind, "line_end", "end_line").cast("long")
    shown = fragments.select("id", "text", F.coalesce(end - start, F.lit(10**9)).alias("span"), start.alias("start"), end.alias("end"), _get(ffind, "relative_path").alias("path"), _get(ffind, "artifact_id").alias("artifact"))
    spot = head.select("relative_path", "artifact_id", "line").first()
    near = shown.join(evidence.withColumn("linked", F.lit(True)), "id", "left")
    fits = F.lit(True)
    if spot.artifact_id:
        fits = fits & (F.col("artifact") == spot.artifact_id)
    if spot.relative_path:
        fits = fits & (F.col("path") == spot.relative_path)
    if spot.line is not None:
        fits = fits & (F.col("start") <= spot.line) & (F.col("end") >= spot.line)
    near = near.filter(F.coalesce("linked", fits)).agg(F.min(F.struct(F.col("linked").isNull(), "span", "start", "id", "text")).alias("f"))
    row = head.join(uses, F.lit(True)).join(near, F.lit(True), "left").withColumn("symbol_id", F.lit(symbol_id))
    used = F.exists("uses_found", lambda u: u["direction"] == "incoming")
    listed = F.from_json("signals", "array<string>")
    note = lambda test, text: F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))
    risks = F.array_distinct(F.concat(
        note(F.col("status") != "active", F.concat(F.lit("finding_status_"), "status")), F.coalesce(listed, F.array().cast("array<string>")), note(used, F.lit("deterministic_incoming_usage_edges_present")),
        note(F.col("removal_safety").isin("validate", "risky"), F.concat(F.lit("removal_safety_"), "removal_safety")), note(F.col("validation_reason").isNotNull(), F.col("validation_reason")),
    ))
    row = row.withColumn("risks", risks)
    action = (
        F.when(F.col("status") != "active", "none: the finding is not active").when(used, "keep: the symbol has incoming uses")
        .when((F.col("removal_safety") == "safe") & (F.size("risks") == 0), "remove").when(F.col("removal_safety") == "safe", "remove after checking the risks")
        .when(F.coalesce("removal_safety", F.lit("validate")) == "validate", "validate, then remove").otherwise("review")
    )
    snippet = F.coalesce("f.text", "finding_text", "reason", F.lit(""))
    return row.select(
        F.struct("id", "status", "finding_type", "severity", F.coalesce("reason", "finding_text").alias("reason"), "confidence", "cleanup_priority", "cleanup_rank", "removal_safety", "symbol_id", "symbol_name", "qualified_name", "location").alias("finding"),
        F.struct(F.col("f.id").alias("source_node_id"), F.substring(snippet, 1, 800).alias("text"), (F.char_length(snippet) > 800).alias("truncated")).alias("minimal_snippet"),
        "uses_found", F.struct("artifact_id", "relative_path", "context_scope", "evidence_scope", "symbol_id", F.size("uses_found").alias("found")).alias("scopes_checked"), "risks", action.alias("recommended_action"),
    )
