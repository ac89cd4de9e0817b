"""Graph analytics as DataFrame operators; none of them writes to the graph.

Communities: the label propagation sweeps nodes in the order of their ids, so a sweep depends on the one before; but components
don't touch each other, and each is swept by itself in one pandas group. Components of more than `at_most` nodes would be an
unbounded group: the same sweep is worked out in joins instead.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinspark.functions.text import clamp, stable_id
from skeinspark.operators.components import components
from skeinspark.operators.graph import Graph
from skeinspark.schema import ACTIVE, ANALYTIC_EDGES, BOOKKEEPING
from skeinspark.shared import materialize

GONE = ("archived", "deleted", "rejected")
#: Node types that are specific or generic by themselves, and priors and weights of salience.
GENERIC_TYPES = ("GraphDelta", "ArtifactCacheEntry", "SourceFragment", "URI")
SPECIFIC_TYPES = ("Function", "Class", "Method", "Module", "SourceArtifact", "Concept", "File", "StaticAnalysisFinding")
TYPE_PRIOR = {
    "Topic": 0.03, "Entity": 0.02, "Project": 0.05, "Directory": 0.04, "File": 0.08, "SourceArtifact": 0.08, "Module": 0.10, "Class": 0.11, "Interface": 0.10,
    "Function": 0.12, "Method": 0.12, "Endpoint": 0.12, "Schema": 0.10, "StaticAnalysisFinding": 0.12,
}


def candidates(graph: Graph, excluded: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    return graph.nodes.filter(~F.col("status").isin(*GONE) & ~F.col("type").isin(*excluded))


def inner_edges(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes, without those that analytics wrote."""
    ids = nodes.select(F.col("id").alias("__id"))
    rows = graph.edges.filter(~F.col("type").isin(*ANALYTIC_EDGES))
    return rows.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi")


def adjacency(graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """node, neighbour, weight: undirected; weights times confidences, summed over parallel edges. A self-loop counts twice."""
    rows = inner_edges(graph, candidates(graph) if nodes is None else nodes)
    w = F.greatest(F.lit(0.0), F.col("weight") * F.col("confidence")).alias("weight")
    both = rows.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), w).union(rows.select("to_id", "from_id", w))
    return both.groupBy("node", "neighbour").agg(F.sum("weight").alias("weight"))


def sweep(edges: dict[str, dict[str, float]], rounds: int) -> dict[str, str]:
    """Labels after the propagation: nodes in the order of ids, the heaviest label among the neighbours, the smallest of equals."""
    labels = {n: n for n in edges}
    for _ in range(rounds):
        moved = False
        for n in sorted(edges):
            weight: dict[str, float] = defaultdict(float)
            for m, w in edges[n].items():
                weight[labels[m]] += w
            if weight:
                best = min(weight, key=lambda k: (-weight[k], k))
                moved |= best != labels[n]
                labels[n] = best
        if not moved:
            break
    return labels


def propagate(adj: DataFrame, rounds: int = 12, at_most: int = 100_000) -> DataFrame:
    """node, label."""
    adj = materialize(adj)
    roots = components(adj.select(F.col("node").alias("a"), F.col("neighbour").alias("b")))
    sized = roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    adj = adj.join(sized, "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edges: dict[str, dict[str, float]] = defaultdict(dict)
        for n, m, w in zip(rows["node"], rows["neighbour"], rows["weight"], strict=True):
            edges[n][m] = w
        labels = sweep(edges, rounds)
        return pd.DataFrame({"node": list(labels), "label": list(labels.values())})

    small = adj.filter(F.col("size") <= at_most).groupBy("root").applyInPandas(run, "node string, label string")
    giant = adj.filter(F.col("size") > at_most).select("node", "neighbour", "weight")
    if giant.isEmpty():
        return small
    return small.union(sweep_by_joins(giant, rounds))


def sweep_by_joins(adj: DataFrame, rounds: int) -> DataFrame:
    """node, label: the same as sweep(), for components of any size.

    In a round a node sees this round's labels of smaller ids and the last round's of the others, itself among them. Starting
    from the last round's labels, all nodes are set again until none changes: after i times those are right whose chains of
    ever smaller neighbours are shorter than i, so the end is the sequential sweep's, in as many joins as the longest chain.
    """
    last = materialize(adj.select("node").distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        now = last
        while True:
            seen = last.join(now.withColumnRenamed("label", "new"), "node").withColumnRenamed("node", "neighbour")
            votes = adj.join(seen, "neighbour").select("node", F.when(F.col("neighbour") < F.col("node"), F.col("new")).otherwise(F.col("label")).alias("label"), "weight")
            votes = votes.groupBy("node", "label").agg(F.sum("weight").alias("weight"))
            after = materialize(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("weight"), "label")).alias("label")))
            settled = _same(now, after)
            now = after
            if settled:
                break
        moved = not _same(last, now)
        last = now
        if not moved:
            break
    return last


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.join(b.withColumnRenamed("label", "other"), "node").filter("label <> other").isEmpty()


def communities(graph: Graph, nodes: DataFrame | None = None, rounds: int = 12, least: int = 2, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, label, size, density, salience, rank) of each community, largest first, and (node, community) of its members."""
    nodes = candidates(graph) if nodes is None else nodes
    adj = materialize(adjacency(graph, nodes))
    labels = materialize(propagate(adj, rounds))
    members = labels.join(nodes.select(F.col("id").alias("node"), F.coalesce("label", "text", "canonical_key").alias("name"), "salience"), "node")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.avg("salience").alias("salience"), F.min("node").alias("first"), F.sort_array(F.collect_list("node")).alias("ids")).filter(F.col("size") >= least)
    sizes = sizes.withColumn("id", stable_id("community", F.lit("global"), F.array_join("ids", ",")))
    other = labels.withColumnsRenamed({"node": "neighbour", "label": "theirs"})
    inside = adj.join(labels, "node").join(other, "neighbour").filter("label = theirs").groupBy("label").agg(F.count(F.lit(1)).alias("links"))
    order = Window.partitionBy("label").orderBy("node")
    firsts = members.filter("name IS NOT NULL AND name <> ''").withColumn("no", F.row_number().over(order)).filter("no <= 3")
    names = firsts.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", F.substring(F.split("name", "\n")[0], 1, 40).alias("t")))), lambda x: x["t"]), " / ").alias("name"))
    out = sizes.join(inside, "label", "left").join(names, "label", "left")
    pairs = F.col("size") * (F.col("size") - 1) / 2
    out = out.select("label", "id", F.col("name"), "size", F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / 2 / pairs).alias("density"), "salience", "first").orderBy(F.col("size").desc(), "first")
    out = materialize(out.limit(limit) if limit else out)
    who = labels.join(out.select("label", F.col("id").alias("community")), "label").select("node", "community")
    return out.select("id", F.col("name").alias("label"), "size", "density", "salience"), who


def bridge_marks(adj: DataFrame, members: DataFrame) -> DataFrame:
    """node, community: each community, other than its own, that a node has a neighbour in."""
    near = adj.join(members.withColumnsRenamed({"node": "neighbour"}), "neighbour").select("node", "community").distinct()
    own = members.withColumnsRenamed({"community": "own"})
    return near.join(own, "node", "left").filter(~F.col("community").eqNullSafe(F.col("own"))).select("node", "community")


def centrality(graph: Graph, nodes: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """id, degree, degree_centrality, weighted_degree, in_degree, out_degree, open_triads, community_bridge, activation_frequency, usefulness.

    The ends of the edges are gathered once, by node and neighbour, and written; all measures are aggregates of that table.
    """
    nodes = candidates(graph, tuple(t for t in BOOKKEEPING if t != "Community")) if nodes is None else nodes
    rows = inner_edges(graph, nodes)
    ends = rows.select(F.col("from_id").alias("id"), F.col("to_id").alias("near"), "weight", F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.union(rows.select("to_id", "from_id", "weight", F.lit(0), F.lit(1)))
    near = materialize(ends.groupBy("id", "near").agg(F.sum("weight").alias("weight"), F.sum("out").alias("out"), F.sum("in").alias("in")))
    sums = materialize(near.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"), F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree")))
    said = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("retrieval_usefulness", "usage_success") if c in nodes.columns]
    fired = F.coalesce(F.col("activation_count").cast("double"), F.lit(0.0)) if "activation_count" in nodes.columns else F.lit(0.0)
    out = nodes.select("id", (F.col("usage_count") + fired).alias("usage_count"), clamp(F.coalesce(*said, F.lit(0.0))).alias("usefulness")).join(sums, "id", "left").join(open_triads(near.select("id", "near"), sums), "id", "left")
    if members is not None:
        crossing = near.join(members.withColumnsRenamed({"node": "near"}), "near").groupBy("id").agg(F.countDistinct("community").alias("k"))
        out = out.join(crossing, "id", "left").withColumn("community_bridge", F.when(F.col("k").isNull(), 0.0).otherwise(F.least(F.lit(1.0), (F.col("k") - 1) / 3))).drop("k")
    else:
        out = out.withColumn("community_bridge", F.lit(0.0))
    out = out.fillna({"degree": 0, "weighted": 0.0, "out_degree": 0, "in_degree": 0, "open_triads": 0.0})
    top = sums.agg(F.max("degree").alias("d"), F.max("weighted").alias("w")).first()
    most, heaviest = float(top.d or 1) or 1.0, float(top.w or 1.0) or 1.0
    return out.select(
        "id", "degree", (F.col("degree") / most).alias("degree_centrality"), (F.col("weighted") / heaviest).alias("weighted_degree"), "in_degree", "out_degree", "open_triads",
        "community_bridge", F.least(F.lit(1.0), F.col("usage_count") / 20.0).alias("activation_frequency"), "usefulness",
    )


def open_triads(near: DataFrame, degree: DataFrame) -> DataFrame:
    """id, open_triads: the share of pairs of neighbours that aren't neighbours of each other.

    Closed pairs are counted from the edges' side: for each edge the common neighbours of its ends, never all pairs of a node's
    neighbours. An edge points from its end of smaller degree, so that a node points to few others, at a hub too; what a node
    points to goes along its edges as one list, and is met with what the other end points to. Each triangle is met once.
    """
    d = degree.select("id", "degree")
    edge = near.filter("id < near").join(d, "id").join(d.select(F.col("id").alias("near"), F.col("degree").alias("d2")), "near")
    low_first = (F.col("degree") < F.col("d2")) | ((F.col("degree") == F.col("d2")) & (F.col("id") < F.col("near")))
    turned = edge.select(F.when(low_first, F.col("id")).otherwise(F.col("near")).alias("a"), F.when(low_first, F.col("near")).otherwise(F.col("id")).alias("b"))
    outs = materialize(turned.groupBy("a").agg(F.collect_list("b").alias("out")))
    # of one list that has a single end no triangle comes
    along = outs.filter(F.size("out") > 1).select("a", F.explode("out").alias("b"), "out")
    met = along.join(outs.select(F.col("a").alias("b"), F.col("out").alias("out2")), "b").select("a", "b", F.array_intersect("out", "out2").alias("c")).filter(F.size("c") > 0)
    n = F.size("c").cast("long")
    ends = F.concat(F.array(F.struct(F.col("a").alias("id"), n.alias("n")), F.struct(F.col("b").alias("id"), n.alias("n"))), F.transform("c", lambda x: F.struct(x.alias("id"), F.lit(1).cast("long").alias("n"))))
    corners = met.select(F.explode(ends).alias("x")).groupBy(F.col("x.id").alias("id")).agg(F.sum("x.n").alias("closed"))
    loops = near.filter("id = near").select("id", F.lit(1).alias("loop"))
    out = d.join(corners, "id", "left").join(loops, "id", "left").fillna(0, ["closed", "loop"])
    # a node that is its own neighbour is joined to each of its other neighbours
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    shut = F.col("closed") + F.col("loop") * (F.col("degree") - 1)
    return out.select("id", F.when(F.col("degree") < 2, 0.0).otherwise((pairs - shut) / pairs).alias("open_triads"))


def neighbour_types(graph: Graph, per_direction: int = 200) -> DataFrame:
    """id, type, n: how many of a node's strongest edges in each direction lead to nodes of each type; a self-loop counts in both."""
    rows = graph.edges.select("from_id", "to_id", "weight", F.col("id").alias("edge"))
    ends = rows.select(F.col("from_id").alias("id"), F.col("to_id").alias("near"), F.lit("o").alias("way"), "weight", "edge").union(rows.select("to_id", "from_id", F.lit("i"), "weight", "edge"))
    order = Window.partitionBy("id", "way").orderBy(F.col("weight").desc(), "edge")
    top = ends.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= per_direction)
    kinds = graph.nodes.select(F.col("id").alias("near"), F.col("type"))
    return top.join(kinds, "near").groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """id, degree, entropy (base 2) of the neighbour types."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("id"))
    return counts.withColumn("h", -p * F.log2(p)).groupBy("id").agg(F.sum("n").alias("degree"), F.sum("h").alias("entropy"))


def specificity(graph: Graph, nodes: DataFrame) -> DataFrame:
    """id, specificity, generic_penalty: additive rules over tokens, type and the neighbours' types."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("label", "text", "canonical_key", "name", "qualified_name") if c in nodes.columns])
    rows = nodes.withColumn("w", F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)).join(entropy(neighbour_types(graph)), "id", "left")
    n = F.size("w")
    weak = lambda t: (F.char_length(t) <= 3) & ~t.rlike("[0-9_]")
    telling = lambda t: (F.char_length(t) >= 6) | t.rlike("[0-9_]")
    concise = (n >= 2) & (n <= 8)
    spec = F.lit(0.35) + F.when(concise, 0.2).when((n == 1) & (F.char_length(F.get("w", F.lit(0))) >= 5), 0.05).otherwise(0.0)
    spec = spec + F.when(F.exists("w", telling), 0.15).otherwise(0.0) + F.when(F.col("type").isin(*SPECIFIC_TYPES), 0.15).otherwise(0.0)
    pen = F.when(n > 14, 0.1).otherwise(0.0) + F.when(n > 0, F.size(F.filter("w", weak)) / F.greatest(n, F.lit(1)) * 0.35).otherwise(0.0)
    pen = pen + F.when(F.col("type").isin(*GENERIC_TYPES), 0.25).otherwise(0.0)
    if "external" in nodes.columns:
        pen = pen + F.when((F.col("type") == "CodeSymbol") & F.coalesce(F.col("external"), F.lit(False)), 0.45).otherwise(0.0)
    mixed = F.coalesce("entropy", F.lit(0.0)) > 1.5
    spec = spec + F.when(~mixed & (F.coalesce("degree", F.lit(0)) > 0), 0.08).otherwise(0.0)
    pen = pen + F.when(mixed, 0.12).otherwise(0.0)
    rows = rows.withColumn("spec", spec).withColumn("pen", pen)
    crowded = (F.coalesce("degree", F.lit(0)) > 8) & (F.col("spec") < 0.55)
    pen2 = F.col("pen") + F.when(crowded, F.least(F.lit(0.25), F.col("degree") / 80)).otherwise(0.0)
    spec2 = F.col("spec")
    if "artifact_type" in nodes.columns:
        pen2 = pen2 + F.when(F.col("artifact_type").isin("binary", "unknown"), 0.08).otherwise(0.0)
        spec2 = spec2 + F.when(F.col("artifact_type").isin("code", "markdown", "text"), 0.04).otherwise(0.0)
    return rows.select("id", clamp(spec2).alias("specificity"), clamp(pen2).alias("generic_penalty"))


#: Weights of a hub's score, and what makes a hub.
HUB_WEIGHTS = {
    "degree_centrality": 0.20, "weighted_degree": 0.15, "activation_frequency": 0.15, "usefulness": 0.15, "salience": 0.10, "community_bridge": 0.10, "specificity": 0.10, "confidence": 0.05,
    "generic_penalty": -0.20,
}
HUB_LEAST, HUB_GENERIC = 0.18, 0.65
MEANINGLESS = ("none", "null", "undefined", "unknown", "nan", "")


def stored_members(graph: Graph) -> DataFrame:
    """node, community: the membership that the graph's own edges say."""
    return graph.edges.filter("type = 'BELONGS_TO_COMMUNITY'").select(F.col("from_id").alias("node"), F.col("to_id").alias("community"))


def score_hubs(graph: Graph, rows: DataFrame, members: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """id, type, label, hub_score, centrality, specificity, community_bridge, generic_penalty, is_hub, reason of nodes that have something to be called by and aren't symbols from outside."""
    measured = centrality(graph, rows, stored_members(graph) if members is None else members) if measured is None else measured
    meaning = [F.when(~F.lower(F.trim(c)).isin(*MEANINGLESS), F.trim(c)) for c in (F.col(x) for x in ("label", "text", "qualified_name", "name", "canonical_key") if x in rows.columns)]
    scored = rows.join(measured, "id").join(specificity(graph, rows), "id").withColumn("label", F.coalesce(*meaning)).filter("label IS NOT NULL")
    if "external" in rows.columns:
        scored = scored.filter(~((F.col("type") == "CodeSymbol") & F.coalesce(F.col("external").cast("boolean"), F.lit(False))))
    total = sum((w * F.col(c) for c, w in HUB_WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumn("hub_score", F.round(clamp(total), 12)).withColumn("centrality", (F.col("degree_centrality") + F.col("weighted_degree")) / 2)
    reason = F.format_string("degree=%.2f; weighted_degree=%.2f; specificity=%.2f; generic_penalty=%.2f; score=%.2f", "degree_centrality", "weighted_degree", "specificity", "generic_penalty", "hub_score")
    is_hub = (F.col("hub_score") >= HUB_LEAST) & (F.col("generic_penalty") < HUB_GENERIC)
    return scored.select("id", "type", "label", "hub_score", "centrality", "specificity", "community_bridge", "generic_penalty", is_hub.alias("is_hub"), reason.alias("reason"))


def hubs(graph: Graph, limit: int = 20, kinds: list[str] | None = None, members: DataFrame | None = None, every: bool = False) -> DataFrame:
    """rank and score_hubs() of the best of the candidates, which are the max(12 limit, 120) nodes of highest degree; every: of all of them."""
    top = graph.top_by_degree(max(12 * limit, 120), kinds, list(BOOKKEEPING), list(ANALYTIC_EDGES)).drop("degree", "weighted")
    rows = score_hubs(graph, materialize(top), members)
    order = [F.col("hub_score").desc(), F.col("specificity").desc(), F.col("centrality").desc(), F.col("id")]
    rows = rows if every else rows.orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def recency(updated: Column, now: Column, half_life_days: float = 14.0) -> Column:
    elapsed = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp(updated))
    return clamp(F.pow(F.lit(0.5), elapsed / (half_life_days * 86400.0)))


def salience(graph: Graph, nodes: DataFrame, now: str) -> DataFrame:
    """id, signal, salience: from novelty, recency, degree, evidence and confidence, with a prior of the type. `now` is given, so runs repeat."""
    rows = nodes.join(graph.degrees().select("id", "degree"), "id", "left").fillna({"degree": 0})
    novelty = clamp(1.0 / F.greatest(F.lit(1), F.col("usage_count") + 1))
    priority = clamp(F.coalesce(F.col("cleanup_rank"), F.lit(0.0)) / 3.0) if "cleanup_rank" in nodes.columns else F.lit(0.0)
    fresh = recency(F.col("updated_at"), F.to_timestamp(F.lit(now)))
    raw = clamp(0.16 * novelty + 0.12 * fresh + 0.24 * clamp(F.col("degree") / 12.0) + 0.18 * priority + 0.12 * clamp(F.col("evidence_count") / 5.0) + 0.18 * clamp(F.col("confidence")))
    raw = F.when(F.col("status").isin("archived", "deleted", "rejected", "dismissed"), raw * 0.25).otherwise(raw)
    prior = F.lit(0.04)
    for kind, value in TYPE_PRIOR.items():
        prior = F.when(F.col("type") == kind, value).otherwise(prior)
    return rows.select("id", raw.alias("signal"), clamp(prior + 0.82 * raw - 0.08 * clamp(F.col("volatility"))).alias("salience"))


def recompute_salience(graph: Graph, now: str, ids: DataFrame | None = None) -> Graph:
    """The graph with the salience of all nodes, or of those in ids, worked out anew."""
    rows = graph.nodes if ids is None else graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    new = salience(graph, rows, now).select(F.col("id").alias("__id"), F.col("salience").alias("__salience"))
    met = graph.nodes.join(new, F.col("id") == F.col("__id"), "left")
    return Graph(met.withColumn("salience", F.coalesce("__salience", "salience")).select(*graph.nodes.columns), graph.edges)


def bridge_candidates(graph: Graph, members: DataFrame, limit: int = 50) -> DataFrame:
    """Nodes next to two communities or more, scored; least score 0.30. All active nodes are candidates, of whatever degree."""
    top = materialize(graph.nodes.filter(F.col("status").isin(*ACTIVE) & ~F.col("type").isin(*BOOKKEEPING)))
    ends = graph.ends(ignored=list(ANALYTIC_EDGES)).filter("node <> neighbour").join(top.select(F.col("id").alias("node")), "node", "left_semi")
    alive = graph.nodes.filter(~F.col("status").isin(*GONE)).select(F.col("id").alias("neighbour"), F.col("salience").alias("near_salience"))
    strength = clamp(F.col("weight") * F.col("confidence"))
    near = ends.join(alive, "neighbour").groupBy("node", "neighbour", "near_salience").agg(F.max(strength).alias("strength"))
    incident = near.groupBy("node").agg(F.count(F.lit(1)).alias("incident"))
    by = near.join(members.withColumnsRenamed({"node": "neighbour"}), "neighbour")
    best = Window.partitionBy("node", "community").orderBy(F.col("strength").desc(), F.col("near_salience").desc(), "neighbour")
    one = by.withColumn("no", F.row_number().over(best)).filter("no = 1")
    again = Window.partitionBy("node").orderBy(F.col("strength").desc(), F.col("near_salience").desc(), "neighbour")
    six = one.withColumn("no", F.row_number().over(again)).filter("no <= 6").groupBy("node").agg(F.avg("strength").alias("evidence"), F.count(F.lit(1)).alias("pieces"), F.sort_array(F.collect_list("neighbour")).alias("evidence_ids"))
    touching = by.groupBy("node").agg(F.sort_array(F.collect_set("community")).alias("communities")).filter(F.size("communities") >= 2)
    # strength between two communities, and the part of it that runs over the node itself
    who = members.withColumnsRenamed({"node": "n", "community": "c"})
    links = graph.edges.filter(~F.col("type").isin(*ANALYTIC_EDGES)).select("from_id", "to_id", F.greatest(F.lit(0.0), F.col("weight") * F.col("confidence")).alias("w"))
    links = links.join(who.withColumnsRenamed({"n": "from_id", "c": "ca"}), "from_id").join(who.withColumnsRenamed({"n": "to_id", "c": "cb"}), "to_id").filter("ca <> cb")
    links = links.select("from_id", "to_id", "w", F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"))
    total = links.groupBy("c1", "c2").agg(F.sum("w").alias("w"))
    own = links.select(F.explode(F.array("from_id", "to_id")).alias("node"), "c1", "c2", "w").groupBy("node", "c1", "c2").agg(F.sum("w").alias("own"))
    rows = touching.join(incident, "node").join(six, "node").join(top.withColumnRenamed("id", "node"), "node").join(specificity(graph, top).withColumnRenamed("id", "node"), "node")
    rows = materialize(rows.filter(~((F.col("pieces") < 2) & (F.col("evidence") < 0.9)) & (F.col("generic_penalty") < 0.45)))
    k = F.size("communities")
    # the mean over all pairs of a node's communities; pairs without an edge between them count nothing, so only linked ones are met
    marks = rows.select("node", F.explode("communities").alias("c1"))
    pairs = marks.join(total, "c1").join(marks.withColumnRenamed("c1", "c2"), ["node", "c2"]).join(own, ["node", "c1", "c2"], "left")
    met = pairs.groupBy("node").agg(F.sum(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w") - F.coalesce("own", F.lit(0.0))))).alias("linked"))
    rows = rows.join(met, "node", "left").withColumn("obvious", F.coalesce("linked", F.lit(0.0)) / (k * (k - 1) / 2))
    rows = rows.withColumn("distance", clamp(1 - F.least(F.lit(1.0), F.col("obvious"))))
    central = F.least(F.lit(1.0), k / 3 * 0.55 + F.least(F.lit(1.0), F.col("incident") / 12) * 0.45)
    novelty = F.least(F.lit(1.0), F.col("distance") * 0.75 + F.least(F.lit(1.0), k / 4) * 0.25)
    use = clamp(F.greatest(F.col("utility"), F.col("salience") * 0.35 + F.col("specificity") * 0.40 + F.col("evidence") * 0.25))
    random = F.when(F.col("pieces") < 2, 0.35).otherwise(0.0) + F.when(F.col("evidence") < 0.45, 0.25).otherwise(0.0) + F.when(F.col("specificity") < 0.35, 0.2).otherwise(0.0) + F.when(F.col("distance") < 0.25, 0.2).otherwise(0.0)
    score = clamp(0.25 * F.col("distance") + 0.20 * novelty + 0.20 * use + 0.15 * F.col("evidence") + 0.10 * central + 0.10 * F.col("specificity") - 0.25 * clamp(random) - 0.15 * F.col("generic_penalty"))
    out = rows.withColumn("bridge_score", F.round(score, 12)).filter("bridge_score >= 0.30")
    return out.select(F.col("node").alias("id"), "type", "communities", "evidence_ids", "distance", "evidence", "specificity", "generic_penalty", "bridge_score").orderBy(F.col("bridge_score").desc(), F.col("specificity").desc(), F.col("evidence").desc(), "id").limit(limit)
