"""Bounded search for simple paths, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinspark.operators.graph import Graph
from skeinspark.shared import materialize

PER_HOP = 80


def simple_paths(graph: Graph, start: DataFrame, end: DataFrame, depth: int = 4, kinds: list[str] | None = None, per_hop: int = PER_HOP) -> DataFrame:
    """length, score, node_ids, node_types, node_labels, edge_ids, edge_types: paths that end at their first end node.

    start and end hold ids. Both directions are walked along each node's `per_hop` strongest edges; a level is one join of the
    open paths with their last nodes' edges, and nodes on the path are cut by an array test.
    """
    ends = materialize(end.select(F.col("id").alias("goal")).distinct())
    open_ = start.select(F.col("id").alias("last"), F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("edge_ids"), F.array().cast("array<string>").alias("edge_types"), F.lit(0.0).alias("sum")).distinct()
    open_ = materialize(open_)
    nodes = graph.nodes.select("id", "type", F.coalesce("label", "text", "canonical_key", "id").alias("name"), "salience", "status")
    done = None
    for _ in range(depth):
        step = graph.neighbours(open_.select(F.col("last").alias("id")), per_hop, kinds=kinds)
        step = step.join(nodes.filter(~F.col("status").isin("deleted", "rejected")).select(F.col("id").alias("neighbour")), "neighbour", "left_semi")
        grown = open_.join(step, open_["last"] == step["node"]).filter(~F.array_contains("node_ids", F.col("neighbour")))
        value = F.col("weight") * F.col("confidence") * F.greatest(F.col("polarity"), F.lit(0))
        # written level by level: else each level's plan holds the one before several times
        grown = grown.select(
            F.col("neighbour").alias("last"), F.concat("node_ids", F.array("neighbour")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"),
            F.concat("edge_types", F.array("edge_type")).alias("edge_types"), (F.col("sum") + value).alias("sum"),
        )
        grown = materialize(grown)
        hit = grown.join(ends, F.col("last") == F.col("goal"), "left_semi")
        done = hit if done is None else done.union(hit)
        open_ = grown.join(ends, F.col("last") == F.col("goal"), "left_anti")
    if done is None:
        done = open_.limit(0)
    # a path of several parallel edges counts once, by its best edges
    done = done.groupBy("node_ids").agg(F.max_by(F.struct("edge_ids", "edge_types", "sum"), F.struct("sum", "edge_ids")).alias("x")).select("node_ids", "x.*")
    each = done.select("node_ids", F.posexplode("node_ids").alias("pos", "id")).join(nodes, "id")
    facts = each.groupBy("node_ids").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "name"))).alias("f"), F.avg("salience").alias("mean"))
    n = F.size("edge_ids")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sum") / F.greatest(n, F.lit(1)) * 0.85 + 0.15 * F.col("mean")))
    return done.join(facts, "node_ids").select(
        n.alias("length"), score.alias("score"), "node_ids", F.col("f.type").alias("node_types"), F.col("f.name").alias("node_labels"), "edge_ids", "edge_types"
    )
