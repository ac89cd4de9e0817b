"""Retrieval: lexical seeds, seed cut, bounded expansion, scores, and the rows and views made of them.

All of it is joins and column expressions. The expansion goes level by level: the nodes first reached in a level go on from the
best way by which they were reached, at most `per_node` edges each, and every node keeps the best score that any way offers it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinspark.functions.text import clamp
from skeinspark.operators.graph import Graph
from skeinspark.operators.search import Profile, lexical_search, match_metrics, type_bonus, weak_match
from skeinspark.schema import INACTIVE
from skeinspark.shared import materialize

#: Sets of node and edge types that retrieval tells apart.
TECHNICAL_NODES = ("RetrievalTrace", "System", "Session", "Debug", "Log", "Comment", "Docstring", "Import")
TECHNICAL_EDGES = ("GENERATED_BY_QUERY", "USED_IN_CONTEXT", "COMPILED_IN", "AFFECTED_BY_DELTA", "ASSOCIATED_WITH")
SOURCE_NODES = ("SourceFragment", "DocumentFragment")
SOURCE_EDGES = ("EVIDENCED_BY", "DERIVED_FROM", "SUPPORTED_BY", "CONTAINS_FRAGMENT", "HAS_SECTION", "HAS_DOCSTRING", "HAS_COMMENT")
CODE_NODES = ("Function", "Method", "Class", "Interface", "Module", "File", "Endpoint", "CodeSymbol")
VIEWS = {
    "owners": (("CONTAINS", "DEFINES", "EVIDENCED_BY", "HAS_FINDING", "METHOD"), "in"),
    "callers": (("CALLS", "INSTANTIATES"), "in"),
    "public_surface": (("HANDLES_ROUTE", "IMPLEMENTS", "IMPORTS", "IMPORTS_FROM", "RE_EXPORTS"), None),
    "serialization_paths": (("READS", "WRITES", "RETURNS", "RAISES", "REFERENCES", "EVIDENCED_BY", "DEPENDS_ON", "IMPORTS_FROM"), None),
    "docs_mentions": (("MENTIONS", "EXPLAINS", "REFERENCES", "HAS_SECTION", "CONTAINS_FRAGMENT"), "in"),
}


def seeds(graph: Graph, profile: Profile, text: str, top_k: int, kinds: list[str] | None, archived: bool, index: DataFrame | None) -> DataFrame:
    """id, seed: lexical hits raised to their match score, cut at a fifth of the best."""
    hits = materialize(lexical_search(graph, text, max(3 * top_k, 30), kinds, archived, index))
    rows = match_metrics(hits.join(graph.nodes, "id").filter(~F.col("type").isin(*TECHNICAL_NODES)), profile)
    rows = rows.filter(~weak_match(profile, F.col("match_score"))).select("id", F.greatest("score", "match_score").alias("seed"))
    rows = materialize(rows)
    best = rows.agg(F.max("seed").alias("best")).first().best
    return rows.filter(F.col("seed") >= 0.2 * (best or 0.0)).orderBy(F.col("seed").desc(), "id").limit(max(2 * top_k, 20))


REASONS = ("match_score", "coverage", "path_score", "type_bonus", "seed_score", "depth_penalty")


def _allowed(graph: Graph, kinds: list[str] | None, archived: bool) -> DataFrame:
    """Nodes that may be returned and walked over."""
    rows = graph.nodes.filter(~F.col("type").isin(*TECHNICAL_NODES))
    if not archived:
        rows = rows.filter(~F.col("status").isin(*INACTIVE))
    return _of_kinds(rows, kinds)


def _of_kinds(rows: DataFrame, kinds: list[str] | None) -> DataFrame:
    return rows.filter(F.lower("type").isin([k.lower() for k in kinds])) if kinds else rows


def _share(words: Column, n: int) -> Column:
    return F.least(F.lit(1.0), F.size(words) / n) if n else F.lit(0.0)


def _facts(nodes: DataFrame, ids: DataFrame, profile: Profile) -> DataFrame:
    """id and what its text says about the query, of the nodes in ids."""
    rows = match_metrics(nodes.join(ids.distinct(), "id", "left_semi"), profile)
    return rows.select("id", "match_score", "coverage", type_bonus(F.col("match_score")).alias("type_bonus"), F.col("overlap").alias("own_words"), F.col("type").isin(*SOURCE_NODES).alias("is_source"))


def _offer(rows: DataFrame, level: int, n: int) -> DataFrame:
    """id, offer (score and its parts): what a way of this level is worth. rows: facts of the node, and seed, words, reach of the way."""
    along = F.greatest(F.col("coverage"), _share(F.col("words"), n))
    way = clamp(0.60 * F.col("reach") + 0.40 * along)
    penalty = min(0.30, 0.08 * level)
    score = clamp(0.52 * F.col("match_score") + 0.28 * along + 0.14 * way + 0.06 * F.col("seed") + F.col("type_bonus") - penalty)
    score = F.when(F.col("is_source"), clamp(score - (0.08 if level else 0.16))).otherwise(score)
    hopeless = (F.col("match_score") < 0.10) & (along < 0.35) if n >= 4 else F.lit(False)
    parts = (F.col("match_score"), F.col("coverage"), way, F.col("type_bonus"), F.col("seed"), F.lit(penalty))
    return rows.filter(~hopeless).select("id", F.struct(score.alias("score"), *[c.alias(name) for c, name in zip(parts, REASONS, strict=True)]).alias("offer"))


def expand(graph: Graph, nodes: DataFrame, first: DataFrame, profile: Profile, depth: int, kinds: list[str] | None, per_node: int) -> DataFrame:
    """id, score and its parts of the best way to every node within reach of first (id, seed)."""
    n = len(profile.informative)
    at = first.join(_facts(nodes, first.select("id"), profile), "id").withColumn("words", F.col("own_words"))
    at = materialize(at.withColumn("reach", F.lit(1.0)))
    offers = [_offer(at, 0, n)]
    seen = at.select("id")
    frontier = at.select("id", "seed", "words", F.col("seed").alias("reach"))
    for level in range(1, depth + 1):
        ways = graph.neighbours(frontier.select("id"), per_node, kinds=kinds, least_weight=0.01).filter(~F.col("edge_type").isin(*TECHNICAL_EDGES))
        signal = clamp(F.col("weight") * F.col("confidence") * F.greatest(F.col("polarity"), F.lit(0)))
        ways = materialize(ways.select("node", F.col("neighbour").alias("id"), signal.alias("signal")))
        met = ways.join(frontier.withColumnRenamed("id", "node"), "node").join(_facts(nodes, ways.select("id"), profile), "id")
        met = met.withColumnRenamed("words", "before").withColumn("words", F.array_union("before", "own_words"))
        if level > 1:  # far from the seeds only what matches, or adds a word to its way
            met = met.filter((F.col("match_score") > 0) | (F.size("words") > F.size("before")))
        met = met.withColumn("reach", clamp(0.55 * F.col("reach") + 0.25 * _share(F.col("words"), n) + 0.20 * F.col("signal")))
        met = materialize(met.select("id", "seed", F.array_sort("words").alias("words"), "reach", "match_score", "coverage", "type_bonus", "is_source"))
        offers.append(_offer(met, level, n))
        new = met.join(seen, "id", "left_anti").groupBy("id").agg(F.max(F.struct("reach", "seed", "words")).alias("best"))
        frontier = materialize(new.select("id", "best.seed", "best.words", "best.reach"))
        seen = seen.union(frontier.select("id"))
    best = reduce(DataFrame.unionByName, offers).groupBy("id").agg(F.max_by("offer", F.struct("offer.score", -F.col("offer.depth_penalty"), "offer")).alias("offer"))
    return best.select("id", "offer.*")


def retrieve(graph: Graph, text: str, top_k: int = 20, depth: int = 3, kinds: list[str] | None = None, archived: bool = False, edge_types: list[str] | None = None, index: DataFrame | None = None, per_node: int = 120) -> DataFrame:
    """id, score and its parts, best first."""
    profile = Profile(graph.nodes.sparkSession, text)
    first = materialize(seeds(graph, profile, text, top_k, kinds, archived, index))
    got = materialize(expand(graph, _allowed(graph, kinds, archived), first, profile, depth, edge_types, per_node))
    return got.filter("score > 0 OR match_score > 0").orderBy(F.col("score").desc(), "depth_penalty", "id").limit(top_k)


def memories(graph: Graph, text: str, limit: int = 12, top_k: int = 12, depth: int = 2, kinds: list[str] | None = None, archived: bool = False, sources: bool = False, generic_filter: bool = True, max_text: int = 600, index: DataFrame | None = None) -> DataFrame:
    """Ranked rows, each text once, optionally with the sources that back them at .95 of the score."""
    ranked = retrieve(graph, text, top_k, depth, kinds, archived, index=index)
    rows = ranked.select("id", "score", "match_score").join(graph.nodes, "id").filter(~F.col("type").isin(*TECHNICAL_NODES))
    if generic_filter:
        rows = rows.filter(~F.col("type").isin("Topic", "Entity", "Fact") | (F.col("match_score") >= 0.65))
    base = rows.withColumns({"source_for": F.lit(None).cast("string"), "relation": F.lit(None).cast("string"), "direction": F.lit(None).cast("string")})
    if sources:
        ways = graph.ends(list(SOURCE_EDGES)).join(rows.select(F.col("id").alias("node"), F.col("score").alias("s")), "node")
        linked = ways.join(graph.nodes.filter(F.col("type").isin(*SOURCE_NODES)).withColumnRenamed("id", "neighbour"), "neighbour")
        linked = linked.withColumns({"id": F.col("neighbour"), "score": F.col("s") * 0.95, "match_score": F.lit(0.0), "source_for": F.col("node"), "relation": F.col("edge_type")})
        base = base.unionByName(linked.select(base.columns))
    cut = F.when(F.char_length("text") > max_text, F.concat(F.rtrim(F.substring("text", 1, max_text - 3)), F.lit("..."))).otherwise(F.col("text"))
    base = base.withColumn("text", cut).withColumn("__key", F.lower(F.coalesce("text", "label", "id")))
    once = Window.partitionBy("__key").orderBy(F.col("score").desc(), "id")
    base = base.withColumn("__no", F.row_number().over(once)).filter("__no = 1").drop("__no", "__key").orderBy(F.col("score").desc(), "id").limit(limit)
    return base.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")))


#: Other names of the views.
VIEW_NAMES = {
    "owner": "owners", "owners_only": "owners", "caller": "callers", "callers_only": "callers", "surface": "public_surface", "public": "public_surface", "public_only": "public_surface",
    "public_surface_only": "public_surface", "serialization": "serialization_paths", "serialization_only": "serialization_paths", "serialization_paths_only": "serialization_paths", "docs": "docs_mentions",
    "docs_only": "docs_mentions", "docs_mentions_only": "docs_mentions",
}


def views(names: list[str] | None) -> list[str]:
    """The views that these names mean, each once; none or `all` mean all of them."""
    keys = [n.strip().lower().replace("-", "_") for n in names or [] if n.strip()]
    found = list(dict.fromkeys(VIEW_NAMES.get(k, k) for k in keys))
    if not found or "all" in found:
        return list(VIEWS)
    if wrong := [k for k in found if k not in VIEWS]:
        raise ValueError(f"no such view: {wrong[0]}; there are {', '.join(VIEWS)}")
    return found


def relevant_sources(graph: Graph, sources: DataFrame, seed_ids: DataFrame, text: str) -> DataFrame:
    """Of sources (id) those that answer the request themselves, or back a seed that does, or a seed of code as its evidence."""
    profile = Profile(graph.nodes.sparkSession, text)
    own = match_metrics(graph.nodes.join(sources.select("id"), "id", "left_semi"), profile).filter(~F.col("type").isin(*TECHNICAL_NODES))
    rated = match_metrics(graph.nodes.join(seed_ids.select("id"), "id", "left_semi"), profile).filter(~F.col("type").isin(*TECHNICAL_NODES))
    seeds_ = rated.select(F.col("id").alias("neighbour"), F.col("match_score").alias("relevance"), F.col("type").isin(*CODE_NODES).alias("is_code"))
    ways = graph.ends(ignored=list(TECHNICAL_EDGES)).join(own.select(F.col("id").alias("node")), "node", "left_semi").join(seeds_, "neighbour")
    backed = ways.filter(((F.col("edge_type") == "EVIDENCED_BY") & F.col("is_code")) | (F.col("relevance") >= 0.65)).select(F.col("node").alias("id"))
    return own.filter("match_score >= 0.85").select("id").union(backed).distinct()


def explore(graph: Graph, seed_ids: DataFrame, view: str, limit: int = 18) -> DataFrame:
    """seed, id, type, label, relation, weight: one view of the edges around the seeds."""
    kinds, way = VIEWS[view]
    ends = graph.ends(list(kinds)).join(seed_ids.select(F.col("id").alias("node")), "node", "left_semi")
    if way:
        ends = ends.filter(F.col("direction") == way)
    rows = ends.join(graph.nodes.select(F.col("id").alias("neighbour"), "type", "label", "status"), "neighbour").filter(~F.col("status").isin(*INACTIVE))
    return rows.select(F.col("node").alias("seed"), F.col("neighbour").alias("id"), "type", "label", F.col("edge_type").alias("relation"), "weight").orderBy(F.col("weight").desc(), "id", "seed", "relation").limit(limit)


def query_graph(graph: Graph, text: str, max_nodes: int = 80, max_edges: int = 160, top_k: int = 20, depth: int = 2, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around the ranked hits, bounded: hits first, then their strongest neighbours."""
    ranked = retrieve(graph, text, top_k, depth, index=index).select("id", "score")
    near = graph.neighbours(ranked, 80).filter(~F.col("edge_type").isin(*TECHNICAL_EDGES)).groupBy(F.col("neighbour").alias("id")).agg(F.max("weight").alias("weight"))
    all_ = ranked.select("id", "score", F.lit(1.0).alias("weight")).unionByName(near.join(ranked, "id", "left_anti").withColumn("score", F.lit(0.0)))
    nodes = all_.join(graph.nodes, "id").filter(~F.col("type").isin(*TECHNICAL_NODES)).orderBy(F.col("score").desc(), all_["weight"].desc(), "id").limit(max_nodes)
    ids = nodes.select("id")
    edges = graph.edges.filter(~F.col("type").isin(*TECHNICAL_EDGES)).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, edges.orderBy(F.col("weight").desc(), "id").limit(max_edges)
