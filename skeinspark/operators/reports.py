"""Report aggregates and their Markdown; only bounded results are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinspark.operators import analysis
from skeinspark.operators.graph import Graph


def stale_nodes(graph: Graph, limit: int = 20) -> DataFrame:
    return graph.nodes.orderBy(F.col("last_used_at").asc_nulls_first(), F.col("updated_at").asc_nulls_first(), "id").limit(limit).select("id", "type", "label", "last_used_at", "updated_at")


def generic_high_degree(graph: Graph, least: int = 3, penalty: float = 0.35, limit: int = 10) -> DataFrame:
    busy = graph.nodes.join(graph.degrees().filter(F.col("degree") >= least), "id").drop("weighted")
    rated = busy.select("id", "label", F.col("degree").alias("degree")).join(analysis.specificity(graph, busy.drop("degree")), "id")
    return rated.filter(F.col("generic_penalty") >= penalty).orderBy(F.col("degree").desc(), "id").limit(limit)


def table(rows: DataFrame, most: int = 50) -> str:
    """A Markdown table of at most so many rows."""
    got = rows.limit(most).collect()
    clean = lambda v: str(v if v is not None else "").replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return "\n".join([head, *("| " + " | ".join(clean(v) for v in r) + " |" for r in got)])


def graph_report(graph: Graph, title: str) -> str:
    parts = [f"# {title}", "## Node types", table(graph.node_type_counts()), "## Best connected", table(graph.top_by_degree(10).select("id", "type", "label", "degree")), "## Unused for longest", table(stale_nodes(graph))]
    return "\n\n".join(parts) + "\n"


def delta_report(changes: DataFrame) -> str:
    return "# Changes\n\n" + table(changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).orderBy("change")) + "\n"


def cache_report(cache: DataFrame) -> str:
    return "# Cache\n\n" + table(cache.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")) + "\n"


def html_graph(graph: Graph, most_nodes: int = 500, most_edges: int = 2000) -> str:
    """A page that needs nothing else: the best connected nodes and their edges, as data and a small drawing script."""
    nodes = graph.top_by_degree(most_nodes).select("id", "type", F.substring(F.coalesce("label", "text", "id"), 1, 80).alias("label"), F.round("salience", 3).alias("salience"))
    ids = nodes.select(F.col("id").alias("__id"))
    edges = graph.edges.join(ids, F.col("from_id") == F.col("__id"), "left_semi").join(ids, F.col("to_id") == F.col("__id"), "left_semi").orderBy(F.col("weight").desc(), "id").limit(most_edges)
    pack = lambda df: "[" + ",".join(df.toJSON().collect()) + "]"
    data = f'{{"nodes":{pack(nodes)},"edges":{pack(edges.select("from_id", "to_id", "type", F.round("weight", 3).alias("weight")))}}}'.replace("<", "\\u003c")
    script = (
        "const c=document.querySelector('canvas'),x=c.getContext('2d'),n=new Map(G.nodes.map((v,i)=>[v.id,[c.width/2+300*Math.cos(i*2.4)*Math.sqrt((i+1)/G.nodes.length),c.height/2+300*Math.sin(i*2.4)*Math.sqrt((i+1)/G.nodes.length),v]]));"
        "x.strokeStyle='#bbb';for(const e of G.edges){const a=n.get(e.from_id),b=n.get(e.to_id);x.beginPath();x.moveTo(a[0],a[1]);x.lineTo(b[0],b[1]);x.stroke()}"
        "for(const [a,b,v] of n.values()){x.fillStyle='#246';x.beginPath();x.arc(a,b,3+4*v.salience,0,7);x.fill();x.fillText(v.label,a+6,b)}"
    )
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><canvas width="900" height="700"></canvas><script>const G={data};{script}</script>\n'
