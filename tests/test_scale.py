"""Work that grows with the input: whole neighbourhoods and candidates, few exchanges, cheap character classes."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from skeinspark.functions import text as tx
from skeinspark.operators import analysis, search
from skeinspark.operators.graph import Graph
from skeinspark.sources import documents

NODE = "id string, type string, label string, text string, canonical_key string, status string, salience double, utility double, updated_at string"
EDGE = "id string, type string, from_id string, to_id string, weight double, confidence double, polarity int"


def _graph(spark, links, texts=None, weight=1.0) -> Graph:
    ids = sorted({x for pair in links for x in pair} | {*(texts or {})})
    nodes = spark.createDataFrame([(i, "Concept", f"label_{i}", (texts or {}).get(i), None, "active", 0.5, 0.0, None) for i in ids], NODE)
    return Graph(nodes, spark.createDataFrame([(f"{a}|{b}", "LINK", a, b, weight, 1.0, 1) for a, b in links], EDGE))


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_accented_text_costs_no_more_than_its_length(spark):
    rows = spark.createDataFrame([("größe café naïve žluťoučký " * 10_000,)], "t string")
    get = lambda: rows.select(F.length(tx.canonicalize(F.col("t")))).first()[0]
    get()
    began = time.time()
    assert get() > 200_000
    assert time.time() - began < 3


def test_character_classes_hold_just_their_code_points(spark):
    several = tx.accent_tables()[2]
    rows = spark.createDataFrame([(chr(c), c) for c in range(1, 0x3500)], "t string, c int")
    got = {r.c for r in rows.filter(F.col("t").rlike(tx.several_class())).collect()}
    assert got == {ord(x) for x in several if ord(x) < 0x3500}


def test_a_text_s_terms_need_one_exchange(spark):
    rows = spark.createDataFrame([("a", 1, "alpha beta gamma alpha"), ("b", 1, "delta")], "artifact_id string, no int, text string")
    assert _exchanges(tx.keyword_table(rows, "artifact_id", F.col("text"), 5)) == 1
    assert _exchanges(documents.document_terms(rows)) == 1


def test_terms_that_share_a_fragment_of_a_repeated_number(spark):
    rows = spark.createDataFrame([("a", 1, "alpha"), ("a", 1, "beta"), ("a", 2, "gamma")], "artifact_id string, no int, text string")
    terms = spark.createDataFrame([("a", t, 0.9) for t in ("alpha", "beta", "gamma")], "artifact_id string, term string, rank_score double")
    assert [(r.a, r.b) for r in documents.term_relations(rows, terms).collect()] == [("alpha", "beta")]


def test_search_looks_only_into_nodes_that_hold_a_token(spark):
    g = _graph(spark, [], {"a": "_Gear- box", "b": "gearbox", "c": "a red-gear", "d": "gêar", "e": "gear_ red"})
    assert {r.id for r in search.postings(g, ("gear",)).select("id").collect()} == {"a", "d", "e"}
    whole = search.lexical_search(g, "gear red", index=search.postings(g)).collect()
    assert whole and search.lexical_search(g, "gear red").collect() == whole


def test_neighbourhood_without_a_limit_is_whole(spark):
    g = _graph(spark, [("hub", f"n{i}") for i in range(1100)])
    assert g.neighbourhood("hub", 1, limit=None).count() == 1101


def test_open_triads_match_all_pairs_without_rows_of_two_edges(spark):
    rnd = random.Random(3)
    links = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(45)} | {(0, i) for i in range(1, 14)}
    both = [(str(a), str(b)) for a, b in links] + [(str(b), str(a)) for a, b in links]
    near = spark.createDataFrame([*both, ("3", "3")], "id string, near string")
    out = analysis.open_triads(near, near.groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    assert "array_intersect" in out._jdf.queryExecution().optimizedPlan().toString()
    of = {}
    for a, b in [*both, ("3", "3")]:
        of.setdefault(a, set()).add(b)
    for r in out.collect():
        pairs = list(itertools.combinations(sorted(of[r.id]), 2))
        assert abs(r.open_triads - (sum(b not in of[a] for a, b in pairs) / len(pairs) if pairs else 0.0)) < 1e-12


def test_a_bridge_may_have_a_low_degree(spark):
    links = [("x", "a"), ("x", "b")] + [(f"n{i}", f"m{k}") for i in range(510) for k in range(3)]
    members = spark.createDataFrame([("a", "A"), ("b", "B"), ("m0", "A"), ("m1", "A"), ("m2", "A")], "node string, community string")
    assert [r.id for r in analysis.bridge_candidates(_graph(spark, links), members).select("id").collect()] == ["x"]


def test_equal_sums_of_weights_are_ranked_by_salience(spark):
    nodes = spark.createDataFrame([("a", "Concept", None, None, None, "active", 0.1, 0.0, None), ("b", "Concept", None, None, None, "active", 0.9, 0.0, None)], NODE)
    rows = [(f"{n}{i}", "LINK", n, f"x{i}", w, 1.0, 1) for n, ws in (("a", (0.1, 0.2, 0.3)), ("b", (0.6, 0.0, 0.0))) for i, w in enumerate(ws)]
    got = Graph(nodes, spark.createDataFrame(rows, EDGE).coalesce(1)).top_by_degree(2)
    assert [r.id for r in got.select("id").collect()] == ["b", "a"]
