"""Further registered queries: writes, documents, overlay, reports and retrieval over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.functions import guards
from skeinspark.functions import text as tx
from skeinspark.operators import analysis, findings, merge, overlay, reports, retrieval
from skeinspark.operators import compile as compiling
from skeinspark.operators.graph import Graph
from skeinspark.plans.execute import Engine
from skeinspark.queries import LIVE, _part, plain
from skeinspark.shared import materialize
from skeinspark.sources import documents
from skeinspark.sources.projection import fragments, graph_of, graph_sql

NOW = "2024-03-01T00:00:00+00:00"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return fragments(_documents(spark, d)).select(F.col("doc_id").cast("string").alias("artifact_id"), F.col("i").alias("no"), F.col("line").alias("text"))


def _count_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).count_nodes(["Customer", "Part"], ["active", "candidate"])


def _type_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).node_type_counts()


def _edge_property(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).find_edges_by_property("polarity", -1, "CONTAINS", limit=60).select("id", "polarity")


def _edge_pattern(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).get_edge_by_pattern("nation:3", "region:3", "IN_REGION").select("id", "weight")


def _find_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).find_nodes("Supplier", ["active"], 25, "usage_count", descending=False).select("id", "usage_count")


def _merge_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _part(graph_of(spark, d), "Part", "Supplier", edges=("SUPPLIED_BY",))
    k = F.regexp_extract("from_id", r"(\d+)$", 1).cast("long")
    batch = g.edges.filter(k % 4 == 0).withColumns({"weight": F.lit(0.35), "confidence": F.lit(0.2), "polarity": F.lit(-1), "origin": F.lit("model"), "seq": F.lit(1).cast("long")})
    lost = batch.limit(3).withColumn("to_id", F.lit("nowhere"))
    out, _ = merge.upsert_edges(g, batch.union(lost))
    return out.edges.select("id", F.round("weight", 9).alias("weight"), F.round("confidence", 9).alias("confidence"), "polarity", "origin")


def _archive(spark: SparkSession, d: str) -> DataFrame:
    out = merge.archive(_part(graph_of(spark, d), "Fragment"), F.col("document_id") % 3 == 0, NOW)
    return out.nodes.groupBy("status", "updated_at").agg(F.count(F.lit(1)).alias("n"))


def _patch(spark: SparkSession, d: str) -> DataFrame:
    g = _part(graph_of(spark, d), "Customer")
    patches = g.nodes.filter("segment = 'BUILDING'").select("id", F.lit(0.125).alias("salience"), F.lit("patched").alias("label"), F.lit("x").alias("type"))
    return merge.update_fields(g.nodes, patches, ("salience", "label"), NOW).select("id", "type", "label", "salience", "updated_at")


def _remove(spark: SparkSession, d: str) -> DataFrame:
    g = _part(graph_of(spark, d), "Customer", "Nation", edges=("IN_NATION",))
    left = merge.remove_nodes(g, g.nodes.filter("type = 'Nation' AND salience < 0.1").select("id"))
    return left.whole_edges().select("id")


def _recoverable(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("artifact_id"), F.col("p_name").alias("relative_path"), F.col("p_size").alias("size_bytes"), F.col("p_brand").alias("sha256"))
    scan = parts.withColumn("sha256", F.when(F.col("artifact_id") % 5 == 0, "other").otherwise(F.col("sha256")))
    return merge.recoverable(parts, parts.filter("artifact_id % 2 = 0"), scan)


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    got = documents.paragraphs(docs, "doc_id", "text", 100_000_000)
    return got.select(F.col("id").alias("doc_id"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.sha2("text", 256).alias("text_sha256"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", tx.split_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return tx.entities(_documents(spark, d), "doc_id", F.col("text")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_terms(_lines(spark, d)).select("artifact_id", "term", F.round("rank_score", 9).alias("rank_score"), "rank")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return documents.term_relations(lines, materialize(documents.document_terms(lines))).select("artifact_id", "a", "b", F.round("score", 9).alias("score"))


def _code_links(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat(F.lit("symbol:"), "item_id").alias("id"), F.concat(F.lit("pkg."), F.regexp_extract("text", r"([A-Za-z_][A-Za-z0-9_]{5,})", 1)).alias("name"))
    return documents.link_to_code(_lines(spark, d), names.filter("name <> 'pkg.'"))


def _standard(spark: SparkSession, d: str) -> Graph:
    """Parts as functions in files named by supplier, for operators that ask for code graphs."""
    g = graph_of(spark, d)
    kinds = F.when(F.col("type") == "Part", "Function").otherwise("File")
    nodes = g.nodes.filter("type IN ('Part', 'Supplier')").withColumn("type", kinds).withColumn("relative_path", F.concat(F.lit("src/"), F.coalesce("label", "id")))
    return Graph(materialize(nodes), materialize(g.edges.filter("type = 'SUPPLIED_BY'").withColumn("type", F.lit("CALLS"))))


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    g = _standard(spark, d)
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    new = Graph(g.nodes.filter(k % 7 != 0).withColumn("label", F.when(k % 13 == 0, "renamed").otherwise(F.col("label"))), g.edges)
    return overlay.sync(overlay.derive(g), new)[1]


def _verify(spark: SparkSession, d: str) -> DataFrame:
    g = _standard(spark, d)
    row = g.nodes.filter("type = 'File'").orderBy("id").limit(1).withColumns({"id": F.lit("finding:1"), "type": F.lit("StaticAnalysisFinding"), "removal_safety": F.lit("safe"), "symbol_id": F.lit("supplier:1"), "status": F.lit("active")})
    got = Engine(Graph(g.nodes.unionByName(row, allowMissingColumns=True), g.edges)).run("VERIFY FINDING 'finding:1'")
    return got.select(F.col("finding.id").alias("id"), F.col("finding.symbol_id").alias("symbol_id"), F.size("uses_found").alias("uses"), F.array_join("risks", ",").alias("risks"), "recommended_action")


def _explore(spark: SparkSession, d: str) -> DataFrame:
    g = _standard(spark, d)
    return retrieval.explore(g, g.nodes.select("id").filter("id IN ('supplier:1', 'supplier:2')"), "callers", 40)


def _query_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = retrieval.query_graph(graph_of(spark, d), "thanea eriner", max_nodes=30, top_k=5, depth=1)
    return nodes.select("id", "type", F.round("score", 6).alias("score"))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    return reports.stale_nodes(graph_of(spark, d))


def _generic(spark: SparkSession, d: str) -> DataFrame:
    return reports.generic_high_degree(_part(graph_of(spark, d), "Nation", "Supplier", edges=("IN_NATION",)), penalty=0.0).select("id", "label", "degree")


def _export(spark: SparkSession, d: str) -> DataFrame:
    g = _part(graph_of(spark, d), "Nation", "Region", edges=("IN_REGION",))
    return g.export_json().select("kind", F.get_json_object("json", "$.id").alias("id"))


def _priority(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet")
    kind = F.when(F.col("p_partkey") % 3 == 0, "unused_import").otherwise("possibly_unused_function")
    scope = F.when(F.col("p_partkey") % 4 == 0, "public_api_local_artifact").otherwise("local")
    rows = parts.select("p_partkey", findings.finding_priority(kind, F.when(F.col("p_partkey") % 2 == 0, 0.8).otherwise(0.4), scope).alias("priority"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("entrypoint"))).otherwise(F.array().cast("array<string>")).alias("signals"))
    return rows.select("p_partkey", "priority", findings.removal_safety(F.col("priority"), F.col("signals")).alias("safety"))


def _count_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(spark, d).count_edges(["CONTAINS", "PLACED"])


def _layers(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d)
    return Graph(g.nodes.filter("type <> 'Region'"), g.edges).layer_counts()


def _project_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 10 == 0, "archived").otherwise("active")
    nodes = _documents(spark, d).select(F.concat(F.lit("artifact:"), F.col("doc_id")).alias("id"), F.lit("SourceArtifact").alias("type"), status.alias("status"), F.lit("p").alias("project_id"), F.when(F.col("lang") != "fr", F.col("lang")).alias("artifact_type"))
    return Graph(nodes, graph_of(spark, d).edges).project_status("p")


def _persist(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d)
    g = Graph(materialize(g.nodes), materialize(g.edges))
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    seq = F.lit(1).cast("long")
    nodes = g.nodes.filter("type = 'Supplier'").withColumn("id", F.when(k % 3 == 0, F.concat(F.lit("new:"), "id")).otherwise(F.col("id"))).withColumn("seq", seq)
    edges = g.edges.filter("type = 'IN_NATION' AND from_id LIKE 'supplier:%'").withColumn("type", F.when(F.regexp_extract("from_id", r"(\d+)$", 1).cast("long") % 4 == 0, "BASED_IN").otherwise(F.col("type"))).withColumn("seq", seq)
    return merge.persist(g, nodes, edges)[1]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2(guards.sanitize_label(F.col("text"), 200), 256).alias("label_sha256"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("normalized_tokens"), F.array("p_brand").alias("main_topics"))
    return tx.signature_vector(rows, "p_partkey").withColumnRenamed("id", "p_partkey")


def _recompute(spark: SparkSession, d: str) -> DataFrame:
    g = graph_of(spark, d)
    g = Graph(materialize(g.nodes), materialize(g.edges))
    return analysis.recompute_salience(g, "2024-01-15 00:00:00", g.nodes.filter("type = 'Supplier'").select("id")).nodes.filter("type IN ('Supplier', 'Nation')").select("id", F.round("salience", 9).alias("salience"))


def _path_by_id(spark: SparkSession, d: str) -> DataFrame:
    got = Engine(_standard(spark, d)).run("PATH FROM ID supplier:1 TO ID supplier:2 VIA CALLS DEPTH 2 LIMIT 5")
    return got.select("length", F.round("score", 9).alias("score"), *[F.array_join(c, ">").alias(c) for c in ("node_ids", "node_labels", "edge_types", "edge_ids")])


def _scan_of_documents(spark: SparkSession, d: str, day: int = 1) -> DataFrame:
    """The documents as scanned text files; on the second day some are gone, some changed and some new."""
    rows = _documents(spark, d)
    if day == 1:
        rows = rows.filter("doc_id % 11 <> 3")
    else:
        rows = rows.filter("doc_id % 7 <> 2").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    path = F.concat_ws("/", "source", F.concat("doc_id", F.lit(".txt")))
    return rows.select(
        tx.stable_id("artifact", F.lit("docs"), path).alias("artifact_id"), F.lit("docs").alias("project_id"), path.alias("relative_path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("sha256"),
        F.lit("text").alias("artifact_type"), F.lit(None).cast("string").alias("language"), F.lit("docs").alias("context_scope"), F.lit("x").alias("options_hash"), "text",
    )


def _compile(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what the compiled documents hold, after two runs."""
    first = compiling.compile_scan(compiling.empty_graph(spark), _scan_of_documents(spark, d, 1), "docs", NOW)
    second = compiling.compile_scan(first.graph, _scan_of_documents(spark, d, 2), "docs", NOW.replace("03-01", "03-02"))
    nodes = second.graph.nodes.filter("type IN ('SourceArtifact', 'DocumentFragment', 'ArtifactCacheEntry', 'Directory', 'Project')").groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))
    edges = second.graph.edges.filter("type IN ('CONTAINS', 'CONTAINS_FRAGMENT')").groupBy("type", F.lit("edge").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.union(edges)


def _compile_states(spark: SparkSession, d: str) -> DataFrame:
    """What the plan of the second run says of every file, and the changes by kind."""
    first = compiling.compile_scan(compiling.empty_graph(spark), _scan_of_documents(spark, d, 1), "docs", NOW)
    scan = _scan_of_documents(spark, d, 2).withColumns({"parser_version": F.lit(compiling.PARSER_VERSION), "chunk_version": F.lit(compiling.CHUNK_VERSION)})
    return compiling.plan(first.graph, scan, "docs").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _on_standard(source: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: plain(Engine(_standard(spark, d)).run(source))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "count_nodes": _count_nodes, "node_type_counts": _type_counts, "find_edges_by_property": _edge_property, "edge_by_pattern": _edge_pattern, "find_nodes_scan": _find_nodes, "merge_edges": _merge_edges, "archive_nodes": _archive,
    "update_fields": _patch, "remove_nodes": _remove, "recoverable": _recoverable, "paragraphs": _paragraphs, "split_sentences": _sentences, "entities": _entities, "document_terms": _terms, "term_relations": _relations,
    "code_links": _code_links, "overlay_sync": _overlay, "verify_finding": _verify, "explore_callers": _explore, "query_graph": _query_graph, "stale_nodes": _stale, "generic_high_degree": _generic, "export_json": _export,
    "finding_priority": _priority, "list_symbols": _on_standard("SYMBOLS TYPE Function WHERE relative_path STARTS WITH 'src/red' RETURN id, relative_path ORDER BY relative_path ASC LIMIT 60"),
    "hubs_of_files": _on_standard("HUBS TYPE File LIMIT 10"), "explain_search": _on_standard("EXPLAIN SEARCH 'red gear' TOP 5 DEPTH 1"), "path_by_id": _path_by_id, "compile_documents": _compile, "compile_states": _compile_states,
    "count_edges": _count_edges, "layer_counts": _layers, "project_status": _project_status, "persist_counts": _persist, "sanitize_labels": _labels, "signature_vectors": _signatures, "recompute_salience": _recompute,
}


def _sql() -> dict[str, str]:
    g = graph_sql()
    key = "CAST(regexp_extract(from_id, '(\\d+)$', 1) AS BIGINT)"
    return {
        "count_nodes": f"{g}\nSELECT count(*) AS nodes FROM nodes WHERE type IN ('Customer', 'Part') AND status IN ('active', 'candidate')",
        "node_type_counts": f"{g}\nSELECT type, count(*) AS count FROM nodes GROUP BY type",
        "find_edges_by_property": f"{g}\nSELECT id, polarity FROM edges WHERE type = 'CONTAINS' AND polarity = -1 ORDER BY updated_at DESC, id LIMIT 60",
        "edge_by_pattern": f"{g}\nSELECT id, weight FROM edges WHERE from_id = 'nation:3' AND to_id = 'region:3' AND type = 'IN_REGION'",
        "find_nodes_scan": f"{g}\nSELECT id, usage_count FROM nodes WHERE type = 'Supplier' AND status = 'active' ORDER BY usage_count, id LIMIT 25",
        "merge_edges": f"{g}\nSELECT id, round(CASE WHEN {key} % 4 = 0 THEN greatest(weight, 0.35) ELSE weight END, 9) AS weight, round(CASE WHEN {key} % 4 = 0 THEN (confidence + 0.2) / 2 ELSE confidence END, 9) AS confidence, CASE WHEN {key} % 4 = 0 THEN -1 ELSE polarity END AS polarity, origin FROM edges WHERE type = 'SUPPLIED_BY'",
        "archive_nodes": f"{g}, f AS (SELECT document_id % 3 = 0 AND status <> 'archived' AS hit, status, updated_at FROM nodes WHERE type = 'Fragment')\nSELECT CASE WHEN hit THEN 'archived' ELSE status END AS status, CASE WHEN hit THEN '{NOW}' ELSE updated_at END AS updated_at, count(*) AS n FROM f GROUP BY ALL",
        "update_fields": f"{g}\nSELECT id, type, CASE WHEN segment = 'BUILDING' THEN 'patched' ELSE label END AS label, CASE WHEN segment = 'BUILDING' THEN 0.125 ELSE salience END AS salience, CASE WHEN segment = 'BUILDING' THEN '{NOW}' ELSE updated_at END AS updated_at FROM nodes WHERE type = 'Customer'",
        "remove_nodes": f"{g}\nSELECT e.id FROM edges e JOIN nodes c ON c.id = e.from_id AND c.type = 'Customer' JOIN nodes n ON n.id = e.to_id AND n.type = 'Nation' AND n.salience >= 0.1 WHERE e.type = 'IN_NATION'",
        "recoverable": "SELECT p_partkey AS artifact_id FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 5 <> 0",
        "paragraphs": "WITH l AS (SELECT doc_id, line, i, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 2 AS p0 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) SELECT doc_id, p0 AS start_at, p0 + length(line) AS end_at, sha256(line) AS text_sha256 FROM l WHERE trim(line) <> ''",
        "split_sentences": "WITH t AS (SELECT doc_id, trim(regexp_replace(translate(text, '‘’“”', QUOTES), '\\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS p FROM t), c AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(p, lambda x: CASE WHEN length(x) > 260 AND contains(x, ';') THEN string_split(x, ';') ELSE [x] END)), lambda x: trim(x)), lambda x: x <> '') AS s FROM p) SELECT doc_id, len(s) AS n, sha256(array_to_string(s, '|')) AS sentences_sha256 FROM c".replace("QUOTES", "chr(39) || chr(39) || chr(34) || chr(34)"),
        "path_by_id": f"""{g}, e AS (SELECT from_id AS a, to_id AS b, id, weight, confidence FROM edges WHERE type = 'SUPPLIED_BY' UNION ALL SELECT to_id, from_id, id, weight, confidence FROM edges WHERE type = 'SUPPLIED_BY'),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY weight DESC, id) <= 80),
p AS (SELECT x.b AS mid, (x.weight * x.confidence + y.weight * y.confidence) / 2 AS w, x.id AS e1, y.id AS e2 FROM k x JOIN k y ON y.a = x.b AND y.b = 'supplier:2' WHERE x.a = 'supplier:1'),
s AS (SELECT p.*, least(1.0::DOUBLE, w * 0.85 + 0.15 * (a.salience + m.salience + b.salience) / 3) AS score, a.label AS la, m.label AS lm, b.label AS lb FROM p JOIN nodes a ON a.id = 'supplier:1' JOIN nodes m ON m.id = mid JOIN nodes b ON b.id = 'supplier:2')
SELECT 2 AS length, round(score, 9) AS score, 'supplier:1>' || mid || '>supplier:2' AS node_ids, la || '>' || lm || '>' || lb AS node_labels, 'CALLS>CALLS' AS edge_types, e1 || '>' || e2 AS edge_ids FROM s ORDER BY s.score DESC, mid LIMIT 5""",
        "compile_documents": """WITH one AS (SELECT doc_id, source, length(text) AS n FROM documents WHERE doc_id % 11 <> 3 AND trim(text, ' ' || chr(9) || chr(10)) <> ''),
two AS (SELECT doc_id, source, length(text) + CASE WHEN doc_id % 5 = 0 THEN 8 ELSE 0 END AS n FROM documents WHERE doc_id % 7 <> 2 AND (trim(text, ' ' || chr(9) || chr(10)) <> '' OR doc_id % 5 = 0)),
all_one AS (SELECT doc_id, source FROM documents WHERE doc_id % 11 <> 3), all_two AS (SELECT doc_id, source FROM documents WHERE doc_id % 7 <> 2),
f1 AS (SELECT doc_id, unnest(range(0, (n - 1) // 3000 + 1)) AS k FROM one), f2 AS (SELECT doc_id, unnest(range(0, (n - 1) // 3000 + 1)) AS k FROM two),
a AS (SELECT doc_id FROM all_one WHERE doc_id % 7 = 2)
SELECT 'SourceArtifact' AS type, 'active' AS status, count(*) AS n FROM all_two UNION ALL SELECT 'SourceArtifact', 'archived', count(*) FROM a
UNION ALL SELECT 'ArtifactCacheEntry', 'active', count(*) FROM all_two UNION ALL SELECT 'ArtifactCacheEntry', 'archived', count(*) FROM a
UNION ALL SELECT 'DocumentFragment', 'active', count(*) FROM f2 UNION ALL SELECT 'DocumentFragment', 'archived', count(*) FROM (SELECT * FROM f1 EXCEPT SELECT * FROM f2)
UNION ALL SELECT 'Directory', 'active', count(DISTINCT source) FROM documents UNION ALL SELECT 'Project', 'active', 1
UNION ALL SELECT 'CONTAINS', 'edge', (SELECT count(DISTINCT source) FROM documents) + (SELECT count(*) FROM (SELECT doc_id FROM all_one UNION SELECT doc_id FROM all_two))
UNION ALL SELECT 'CONTAINS_FRAGMENT', 'edge', count(*) FROM f2""",
        "compile_states": "SELECT CASE WHEN doc_id % 7 = 2 THEN 'deleted' WHEN doc_id % 11 = 3 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'clean' END AS state, count(*) AS n FROM documents WHERE NOT (doc_id % 7 = 2 AND doc_id % 11 = 3) GROUP BY 1",
        "count_edges": f"{g}\nSELECT count(*) AS edges FROM edges WHERE type IN ('CONTAINS', 'PLACED')",
        "layer_counts": f"""{g}, n AS (SELECT id FROM nodes WHERE type <> 'Region'), w AS (SELECT count(*) AS n FROM edges WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n))
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT n FROM w) AS edges, (SELECT count(*) FROM edges) - (SELECT n FROM w) AS loose_edges""",
        "project_status": "SELECT 'artifact_type' AS what, CASE WHEN lang = 'fr' THEN 'unknown' ELSE lang END AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'status', CASE WHEN doc_id % 10 = 0 THEN 'archived' ELSE 'active' END, count(*) FROM documents GROUP BY 2",
        "persist_counts": """SELECT 'node' AS kind, count(*) FILTER (WHERE s_suppkey % 3 = 0) AS created, count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS updated FROM supplier
UNION ALL SELECT 'edge', count(*) FILTER (WHERE s_suppkey % 4 = 0), count(*) FILTER (WHERE s_suppkey % 4 <> 0) FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
        "sanitize_labels": """WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(t[1:197]) || '...' ELSE t END AS t FROM l)
SELECT doc_id, sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')) AS label_sha256 FROM c""",
        "signature_vectors": "SELECT p_partkey, feature, count(*) AS n FROM (SELECT p_partkey, 'tok:' || unnest(string_split(p_name, ' ')) AS feature FROM part UNION ALL SELECT p_partkey, 'topic:' || p_brand FROM part) GROUP BY ALL",
        "recompute_salience": f"""{g}, b AS (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges WHERE from_id <> to_id), d AS (SELECT id, count(*) AS degree FROM b GROUP BY id),
r AS (SELECT n.id, n.type, n.status, n.salience, 0.16 / (usage_count + 1) + 0.06 + 0.24 * least(1.0, coalesce(degree, 0) / 12.0) + 0.12 * least(1.0, evidence_count / 5.0) + 0.18 * confidence AS raw FROM nodes n LEFT JOIN d ON d.id = n.id WHERE n.type IN ('Supplier', 'Nation'))
SELECT id, round(CASE WHEN type = 'Nation' THEN salience ELSE greatest(0, least(1, 0.04 + 0.82 * raw * CASE WHEN status = 'archived' THEN 0.25 ELSE 1 END - 0.04)) END, 9) AS salience FROM r""",
        "finding_priority": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0 THEN 'high' WHEN p_partkey % 4 <> 0 THEN 'medium' ELSE 'low' END AS priority FROM part) SELECT p_partkey, priority, CASE WHEN priority = 'high' AND p_partkey % 5 <> 0 THEN 'safe' WHEN p_partkey % 5 = 0 THEN 'risky' ELSE 'validate' END AS safety FROM p",
        "generic_high_degree": f"{g}, e2 AS (SELECT * FROM edges WHERE type = 'IN_NATION'), d AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM e2 UNION ALL SELECT to_id FROM e2) GROUP BY id HAVING count(*) >= 3)\nSELECT n.id, n.label, degree FROM nodes n JOIN d ON d.id = n.id WHERE n.type IN ('Nation', 'Supplier') ORDER BY degree DESC, n.id LIMIT 10",
        "export_json": f"{g}\nSELECT 'node' AS kind, id FROM nodes WHERE type IN ('Nation', 'Region') UNION ALL SELECT 'edge', id FROM edges WHERE type = 'IN_REGION'",
        "stale_nodes": f"{g}\nSELECT id, type, label, CAST(NULL AS VARCHAR) AS last_used_at, updated_at FROM nodes ORDER BY id LIMIT 20",
        "overlay_sync": f"{g}, p AS (SELECT id, CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS k FROM nodes WHERE type IN ('Part', 'Supplier') AND {LIVE})\nSELECT id, CASE WHEN k % 7 = 0 THEN 'stale' ELSE 'changed' END AS change FROM p WHERE k % 7 = 0 OR k % 13 = 0",
        "explore_callers": f"{g}\nSELECT e.to_id AS seed, n.id, 'Function' AS type, n.label, 'CALLS' AS relation, e.weight FROM edges e JOIN nodes n ON n.id = e.from_id AND n.type = 'Part' AND n.status <> 'archived' WHERE e.type = 'SUPPLIED_BY' AND e.to_id IN ('supplier:1', 'supplier:2') ORDER BY e.weight DESC, n.id, e.to_id LIMIT 40",
        "list_symbols": f"{g}\nSELECT id, 'src/' || label AS relative_path FROM nodes WHERE type = 'Part' AND {LIVE} AND starts_with(lower('src/' || label), 'src/red') ORDER BY lower('src/' || label), id LIMIT 60",
    }


SQL = _sql()
