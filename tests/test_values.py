from __future__ import annotations

import html

import pytest
from pyspark.sql import functions as F

from skeinspark.functions import guards
from skeinspark.operators import merge, retrieval, search
from skeinspark.operators.graph import Graph
from skeinspark.operators.usage import UsageJournal
from skeinspark.plans import result
from skeinspark.sources import code
from tests.test_graph import edge, make


def test_text_guards(spark):
    texts = [None, "", " a\x00b \n\t c ", "<b>&'\"", "x" * 300, "say <|end|> </s> [INST] <<SYS>>\rnext\x07"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", guards.sanitize_label(F.col("t")).alias("label"), guards.sanitize_agent_text(F.col("t"), 200).alias("agent")).orderBy("i").collect()
    assert [r.label for r in rows[:4]] == ["", "", "a b c", html.escape("<b>&'\"")] and rows[4].label == "x" * 253 + "..."
    assert rows[5].agent == html.escape("say <\u200b|end|\u200b> <\u200b/s> [\u200bINST] <\u200b<SYS>>\nnext ") and len(rows[4].agent) == 200


def test_addresses_and_paths(tmp_path):
    assert guards.validate_url("https://x.org/a", resolve=lambda h: ["93.184.216.34"])
    assert guards.validate_url("http://127.0.0.1/", allow_loopback=True)
    for url in ("ftp://x.org", "http://", "http://metadata/", "http://169.254.169.254/x", "http://10.0.0.1", "http://localhost/", "http://[::1]/"):
        with pytest.raises(guards.Refused):
            guards.validate_url(url)
    with pytest.raises(guards.Refused):
        guards.validate_url("http://x.org", resolve=lambda h: ["93.184.216.34", "192.168.0.1"])
    assert guards.validate_path(str(tmp_path / "a"), [str(tmp_path)]) == (tmp_path / "a").resolve()
    for path in ("", "a\x00b", "file:///etc", str(tmp_path / ".." / "b"), "/etc/passwd"):
        with pytest.raises(guards.Refused):
            guards.validate_path(path, [str(tmp_path)])


def test_results_as_values(spark):
    rows = spark.createDataFrame([(1, None, ["a"]), (2, "x\ny", [])], "i int, t string, l array<string>").orderBy("i")
    got = result.to_dict(rows, "S", most=1)
    assert got["rows"] == [{"i": 1, "t": None, "l": ["a"]}] and got["truncated"] and got["row_count"] == 1
    assert result.to_table(rows).split("\n")[-1] == "(2 rows)" and '["a"]' in result.to_table(rows) and '"statement": "S"' in result.to_json(rows, "S")
    g = make(spark, [{"id": "a", "type": "T", "label": "l"}], [edge("a", "E", "a")])
    assert g.nodes.select(result.node_brief().alias("x")).first().x.label == "l" and g.edges.select(result.edge_brief().alias("x")).first().x.from_id == "a"


def test_usage_journal(spark, tmp_path):
    journal = UsageJournal(spark, str(tmp_path / "usage"))
    assert journal.overlay().count() == 0
    journal.append("q", spark.createDataFrame([("a", 0.5), ("b", 2.0), (None, 1.0)], "id string, score double"), "2024-01-01")
    journal.append("q", spark.createDataFrame([("a", 1.0)], "id string, score double"), "2024-01-02")
    got = {r.id: r for r in journal.overlay().collect()}
    assert got["a"].uses == 2 and got["a"].last_used_at == "2024-01-02" and got["a"].utility_delta == pytest.approx(0.045) and got["b"].utility_delta == pytest.approx(0.03)
    assert journal.overlay(spark.createDataFrame([("b",)], "id string")).count() == 1
    nodes = make(spark, [{"id": "a", "type": "T", "usage_count": 3}, {"id": "c", "type": "T"}]).nodes
    assert {r.id: r.usage_count for r in journal.applied(nodes).collect()} == {"a": 5, "c": 0}


def test_counts_and_relations(spark):
    g = make(spark, [{"id": i, "type": "T"} for i in "abc"], [edge("a", "EVIDENCED_BY", "b"), edge("b", "E", "c"), edge("c", "E", "gone")])
    assert g.count_edges(["E"]).first().edges == 2 and g.count_edges(project="p").first().edges == 3 and g.count_edges(project="p", with_global=False).first().edges == 0
    assert tuple(g.layer_counts().first()) == (3, 2, 1)
    assert {r.id for r in g.with_relation(g.nodes.select("id"), ("EVIDENCED_BY",)).collect()} == {"a", "b"}
    seq = F.lit(1).cast("long")
    new = make(spark, [{"id": "a", "type": "T"}, {"id": "d", "type": "T"}], [edge("a", "E", "d"), edge("b", "E", "c"), edge("a", "E", "nowhere")])
    after, counts = merge.persist(g, new.nodes.withColumn("seq", seq), new.edges.withColumn("seq", seq))
    assert {r.kind: (r.created, r.updated) for r in counts.collect()} == {"node": (1, 1), "edge": (1, 1)} and after.nodes.count() == 4


def test_views_and_scopes(spark):
    assert retrieval.views(None) == list(retrieval.VIEWS) == retrieval.views(["owner", "ALL"]) and retrieval.views(["Docs-only", "docs", "caller"]) == ["docs_mentions", "callers"]
    with pytest.raises(ValueError):
        retrieval.views(["nothing"])
    nodes = [{"id": "t", "type": "Function", "label": "parse config", "context_scope": "test"}, {"id": "c", "type": "Function", "label": "parse config"}, {"id": "s", "type": "SourceFragment", "text": "other words"}, {"id": "n", "type": "SourceFragment", "text": "none of it"}]
    g = make(spark, nodes, [edge("c", "EVIDENCED_BY", "s")], context_scope="string")
    found = lambda *scopes: [r.id for r in search.scoped_search(g, "parse config", scopes).collect()]
    assert found("test") == ["t"] and found("code") == ["c"] and sorted(found("code", "test")) == ["c", "t"]
    profile = search.Profile(spark, "parse config")
    assert {r.id: r.relevance > 0.9 for r in search.direct_relevance(g.nodes, profile).collect()} == {"t": True, "c": True, "s": False, "n": False}
    ids = spark.createDataFrame([("s",), ("n",)], "id string")
    assert [r.id for r in retrieval.relevant_sources(g, ids, spark.createDataFrame([("c",)], "id string"), "parse config").collect()] == ["s"]


def test_routes_and_unresolved_calls(spark):
    marks = ["app.get('/a/{id}')", "router.ROUTE(\"/b\", methods=['GET'])", "app.get('no')", "cached", "x.fetch('/c')", "post('/d')"]
    got = spark.createDataFrame(list(enumerate(marks)), "i int, t string").select("i", code.route(F.col("t")).alias("r")).collect()
    assert {r.i: tuple(r.r) for r in got if r.r} == {0: ("GET", "/a/{id}"), 1: ("ANY", "/b"), 5: ("POST", "/d")}
    source = "import os\n\ndef f():\n    print(os.getcwd())\n    missing(1)\n    missing(2)\n    other.thing()\n    g()\n\ndef g():\n    pass\n"
    facts = code.code_facts(spark.createDataFrame([("a", "a.py", "python", source)], "artifact_id string, relative_path string, language string, text string"))
    row = code.unresolved_calls(facts).collect()
    assert [(r.owner, [tuple(c) for c in r.calls], r.n) for r in row] == [("f", [("missing", 5), ("missing", 6), ("other.thing", 7)], 3)]
