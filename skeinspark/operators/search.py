"""Lexical search over postings, and the match metrics of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.functions.text import analyse, canonicalize, keyword_table, signal, tokenize
from skeinspark.operators.graph import Graph
from skeinspark.schema import ACTIVE
from skeinspark.shared import materialize

TEXT_BUDGET, TERMS_PER_NODE = 4096, 80
#: Properties whose text is indexed.
INDEXED = (
    "artifact_id", "artifact_type", "compiled_at", "finding_type", "fragment_type", "kind", "language", "module", "name", "project_id", "qualified_name", "relative_path", "root_path", "severity", "sha256",
    "symbol_name", "symbol_type",
)
#: Characters of a property once the budget is spent.
LEAST_PART = 128
#: Type classes and what they add to a match.
TYPE_BONUS = {
    0.10: ("Function", "Method", "Class", "Interface", "Module"), 0.07: ("SourceArtifact", "File", "Endpoint", "Schema", "Config", "Test"),
    0.04: ("Variable", "Import", "Dependency", "StaticAnalysisFinding"), 0.02: ("SourceFragment", "DocumentFragment"),
}


def indexed_text(nodes: DataFrame) -> Column:
    """Type, label and key whole; then the text and the indexed properties that the nodes have, by name, which share a budget."""
    parts, left = [F.substring("text", 1, TEXT_BUDGET)], F.greatest(F.lit(0), TEXT_BUDGET - F.coalesce(F.char_length("text"), F.lit(0)))
    for name in sorted({*INDEXED} & {*nodes.columns}):
        item = F.col(name).cast("string")
        parts.append(F.substr(item, F.lit(1), F.when(left > 0, left).otherwise(LEAST_PART)))
        left = F.greatest(F.lit(0), left - F.coalesce(F.char_length(item), F.lit(0)))
    return F.concat_ws(" ", "type", "label", "canonical_key", *parts)


def postings(graph: Graph, tokens: tuple[str, ...] | None = None) -> DataFrame:
    """id, term, score, rank: the best terms of each node; written once by whoever searches often. tokens: of nodes only that hold one of these."""
    nodes = graph.nodes
    if tokens is not None:
        # a token is a word of the canonical text without `_` and `-` at its ends
        held = f"(?<![^ ])[_-]*(?:{'|'.join(sorted({*tokens}))})[_-]*(?![^ ])"
        # plain ASCII that doesn't name a token as it stands needs no canonical form
        whole = F.lower(indexed_text(nodes))
        maybe = F.octet_length(whole) != F.char_length(whole)
        for token in sorted({*tokens}):
            maybe = maybe | F.contains(whole, F.lit(token))
        nodes = nodes.filter(maybe & canonicalize(indexed_text(nodes)).rlike(held) if tokens else F.lit(False))
    return keyword_table(nodes, "id", indexed_text(nodes), TERMS_PER_NODE)


def lexical_search(graph: Graph, text: str, top_k: int = 20, kinds: list[str] | None = None, archived: bool = False, index: DataFrame | None = None) -> DataFrame:
    """id, score of the best nodes. The query's terms, a handful, are broadcast; without an index only nodes that hold one of its tokens are looked into."""
    spark = graph.nodes.sparkSession
    request = analyse(spark, text)
    tokens = request.tokens
    weights = dict.fromkeys(tokens, 1.0) | dict.fromkeys(request.pairs, 1.35)
    wanted = spark.createDataFrame(list(weights.items()) or [("", 0.0)], "term string, weight double")
    index = postings(graph, tokens) if index is None else index
    found = materialize(index.join(F.broadcast(wanted), "term"))
    total = F.lit(float(max(1, graph.nodes.count())))
    rarity = F.least(F.lit(1.0), F.log1p(total / F.col("df")) / F.log1p(total))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (0.2 + 0.8 * rarity).alias("rarity"))
    raw = found.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(F.col("score") * F.col("rarity") * F.col("weight")).alias("raw"), F.count(F.lit(1)).alias("matched"))
    nodes = graph.nodes.select("id", "type", "status", "salience")
    if kinds:
        nodes = nodes.filter(F.lower("type").isin([k.lower() for k in kinds]))
    if not archived:
        nodes = nodes.filter(F.col("status").isin(*ACTIVE))
    norm = F.least(F.lit(1.0), F.log1p("raw") / F.log1p(F.lit(float(len(set(tokens)) + 2))))
    score = F.least(F.lit(1.0), 0.85 * norm + 0.15 * F.col("salience") + 0.02 * F.col("matched"))
    return raw.join(nodes, "id").select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(top_k)


class Profile:
    """What a query's text is matched by."""

    def __init__(self, spark: SparkSession, text: str) -> None:
        request = analyse(spark, text)
        self.key, self.tokens = request.key, list(request.tokens)
        self.informative = sorted({*request.telling} or {*request.tokens})
        self.phrases = sorted({*request.pairs})


def _strong(t: Column) -> Column:
    return (signal(t) >= 0.85) & t.rlike("[0-9_-]")


def match_metrics(nodes: DataFrame, profile: Profile) -> DataFrame:
    """nodes with match_score, coverage and overlap (the informative tokens found): the first tier that applies, by one CASE."""
    whole = F.concat_ws(" ", "text", "label", "canonical_key")
    rows = nodes.withColumn("__key", canonicalize(whole)).withColumn("__parts", F.transform(F.array_compact(F.array("canonical_key", "label", "text")), canonicalize))
    words = F.array(*[F.lit(t) for t in profile.informative]).cast("array<string>")
    rows = rows.withColumn("overlap", F.array_intersect(words, tokenize(whole)))
    n = max(len(profile.informative), 1)
    hay = F.concat(F.lit(" "), F.col("__key"), F.lit(" "))
    hits = F.lit(0)
    for phrase in profile.phrases:
        hits = hits + F.contains(hay, F.lit(f" {phrase} ")).cast("int")
    phrase = hits / len(profile.phrases) if profile.phrases else F.lit(0.0)
    rows = rows.withColumn("__phrase", phrase).withColumn("__cov", F.greatest(F.size("overlap") / n, F.col("__phrase")))
    cov, phr = F.col("__cov"), F.col("__phrase")
    path = F.col("relative_path") if "relative_path" in nodes.columns else F.lit(None).cast("string")
    on_path = F.coalesce(F.size(F.array_intersect(words, tokenize(F.regexp_replace(path, r"[\\/.]", " ")))) / n, F.lit(0.0))
    on_path = F.when(path.isNull(), 0.0).otherwise(on_path)
    starts = F.startswith("__key", F.lit(profile.key)) | F.exists("__parts", lambda p: F.startswith(p, F.lit(profile.key)))
    tiers = [
        (F.array_contains("__parts", profile.key), F.when(F.col("type") == "Topic", 0.98).otherwise(0.94), F.lit(1.0)),
        (F.contains(hay, F.lit(f" {profile.key} ")), F.lit(0.86), F.greatest(cov, F.lit(0.9))),
        (starts, F.lit(0.78), F.greatest(cov, F.lit(0.8))),
        ((F.size("overlap") == n) & F.lit(bool(profile.informative)), F.when(phr >= 0.5, 0.76).otherwise(0.7), F.lit(1.0)),
        ((phr >= 0.75) & (cov >= 0.5), F.lit(0.68), cov), ((phr >= 0.5) & (cov >= 0.4), F.lit(0.58), cov),
        (F.exists("overlap", _strong), F.lit(0.64), F.greatest(cov, F.lit(0.55))),
        (cov >= 0.75, F.lit(0.56), cov), (cov >= 0.5, F.lit(0.40), cov), (cov > 0, F.least(F.lit(0.38), 0.16 * cov + 0.18 * phr), cov),
        (on_path >= 0.5, 0.3 * on_path, on_path),
    ]
    usable = F.lit(bool(profile.key))
    score, cover = F.when(~usable | (F.col("__key") == ""), 0.0), F.when(~usable | (F.col("__key") == ""), 0.0)
    if not profile.key:
        tiers = []
    for test, s, k in tiers:
        score, cover = score.when(test, s), cover.when(test, k)
    return rows.withColumn("match_score", score.otherwise(0.0)).withColumn("coverage", cover.otherwise(0.0)).drop("__key", "__parts", "__phrase", "__cov")


def direct_relevance(nodes: DataFrame, profile: Profile) -> DataFrame:
    """id, relevance: how well each node's own text answers the request."""
    return match_metrics(nodes, profile).select("id", F.col("match_score").alias("relevance"))


def scoped_search(graph: Graph, text: str, scopes: tuple[str, ...], top_k: int = 20, kinds: list[str] | None = None, archived: bool = False, technical: tuple[str, ...] = ()) -> DataFrame:
    """id, score of the best nodes within context scopes (nodes without one count as code): matched by their text, without the index."""
    profile = Profile(graph.nodes.sparkSession, text)
    scope = F.col("context_scope") if "context_scope" in graph.nodes.columns else F.lit(None).cast("string")
    rows = graph.nodes.filter(F.coalesce(scope, F.lit("code")).isin(*scopes) & ~F.col("type").isin(*technical))
    if kinds:
        rows = rows.filter(F.lower("type").isin([k.lower() for k in kinds]))
    if not archived:
        rows = rows.filter(F.col("status").isin(*ACTIVE))
    rows = match_metrics(rows, profile).filter("match_score > 0").filter(~weak_match(profile, F.col("match_score")))
    return rows.orderBy(F.col("match_score").desc(), type_bonus(F.col("match_score")).desc(), F.col("salience").desc(), "id").limit(top_k).select("id", F.col("match_score").alias("score"))


def type_bonus(match: Column) -> Column:
    out = F.when(match <= 0, 0.0)
    for bonus, kinds in TYPE_BONUS.items():
        out = out.when(F.col("type").isin(*kinds), bonus)
    return out.otherwise(0.0)


def weak_match(profile: Profile, match: Column) -> Column:
    """A multi-term query that a node touches with hardly any term."""
    n = len(profile.informative)
    if n < 4:
        return F.lit(False)
    few = (F.size("overlap") <= 1) | (F.size("overlap") / n < 0.25)
    return (match < 0.10) & ~F.exists("overlap", _strong) & few


__all__ = ["Profile", "indexed_text", "lexical_search", "match_metrics", "postings", "type_bonus", "weak_match"]
