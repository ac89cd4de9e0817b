from __future__ import annotations

import random
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skeinspark.functions import text as tx
from skeinspark.operators import analysis, findings, merge, overlay, reports, retrieval
from skeinspark.operators.activation import activate
from skeinspark.operators.components import components
from skeinspark.operators.graph import Graph
from skeinspark.operators.paths import simple_paths
from skeinspark.plans.execute import Engine
from skeinspark.plans.language import EvaluationProblem
from skeinspark.schema import EDGE_DEFAULTS, NODE_DEFAULTS
from skeinspark.session import GraphSession

NOW = "2024-02-01T00:00:00+00:00"


def make(spark, nodes, edges=(), **more):
    """Graph of dicts; absent fields take their defaults."""
    cols = {c: t.simpleString() for c, (t, _) in NODE_DEFAULTS.items()} | more
    rows = [tuple(n.get(c, NODE_DEFAULTS[c][1] if c in NODE_DEFAULTS else None) for c in cols) for n in nodes]
    ecols = {c: t.simpleString() for c, (t, _) in EDGE_DEFAULTS.items()} | {"properties": "string"}
    erows = [tuple(e.get(c, EDGE_DEFAULTS[c][1] if c in EDGE_DEFAULTS else None) if c != "id" else e.get("id", f"{e['type']}|{e['from_id']}|{e['to_id']}") for c in ecols) for e in edges]
    ddl = lambda d: ", ".join(f"{k} {v}" for k, v in d.items())
    return Graph(spark.createDataFrame(rows, ddl(cols)), spark.createDataFrame(erows, ddl(ecols)))


def edge(a, kind, b, **more):
    return {"from_id": a, "type": kind, "to_id": b} | more


@pytest.fixture(scope="module")
def small(spark):
    nodes = [
        {"id": "n1", "type": "Fact", "label": "Alpha", "text": "one\ntwo", "salience": 0.74, "owner": None, "relative_path": "src/a.py", "line_start": 5},
        {"id": "n2", "type": "Fact", "label": "beta", "text": "Three", "salience": 0.25, "owner": "ann", "relative_path": "src/b.py", "line_start": 50},
    ]
    return Engine(make(spark, nodes, owner="string", relative_path="string", line_start="int"))


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("label = 'ALPHA'", {"n1"}), ("owner != 'bob'", {"n1", "n2"}), ("NOT owner = 'ann'", {"n1"}), ("owner IS NULL", {"n1"}), ("owner EXISTS", {"n2"}), ("nothing EXISTS", set()), ("nothing != 3", {"n1", "n2"}),
        ("text LIKE 'one%'", set()), ("text LIKE 'T_ree'", {"n2"}), ("text LIKE 't%'", set()), ("text ILIKE 't%'", {"n2"}), ("text REGEX '^t.o$'", set()), ("text REGEX 'tw'", {"n1"}), ("text REGEX '('", set()),
        ("salience BETWEEN 0.2 AND 0.5", {"n2"}), ("line_start > '7'", {"n2"}), ("line_start > 'x'", set()), ("label > 'B'", {"n2"}), ("owner < 'z'", {"n2"}), ("relative_path ENDS WITH 'A.PY'", {"n1"}), ("relative_path STARTS 'SRC/'", {"n1", "n2"}),
        ("line_start IN [5, 'x']", {"n1"}), ("text CONTAINS 'THR'", {"n2"}), ("text ~= 'thr'", {"n2"}),
    ],
)
def test_where(small, where, want):
    assert {r.id for r in small.run(f"FIND NODES WHERE {where} RETURN id").collect()} == want


def test_order_puts_null_lowest(small):
    assert [r.id for r in small.run("FIND NODES ORDER BY owner RETURN id").collect()] == ["n2", "n1"]
    assert [r.id for r in small.run("FIND NODES ORDER BY owner ASC RETURN id").collect()] == ["n1", "n2"]
    assert small.run("FIND NODES LIMIT 0").count() == 0


def test_verify_finding(spark):
    nodes = [
        {"id": "s", "type": "Function", "label": "f"}, {"id": "caller", "type": "Function", "label": "g"}, {"id": "frag", "type": "SourceFragment", "text": "def f(): ..."},
        {"id": "x", "type": "StaticAnalysisFinding", "text": "unused", "removal_safety": "safe", "blocking_signals": '["public_api"]', "symbol_name": "f"},
    ]
    edges = [edge("s", "EVIDENCED_BY", "frag"), edge("s", "HAS_FINDING", "x"), edge("caller", "CALLS", "s")]
    engine = Engine(make(spark, nodes, edges, removal_safety="string", blocking_signals="string", symbol_name="string"))
    row = engine.run("VERIFY FINDING x").first()
    assert row.finding.symbol_id == "s" and row.minimal_snippet.source_node_id == "frag" and [u.other_id for u in row.uses_found] == ["caller"]
    assert row.risks == ["public_api", "deterministic_incoming_usage_edges_present"] and row.recommended_action.startswith("keep")
    for bad in ("nope", "s"):
        with pytest.raises(EvaluationProblem):
            engine.run(f"VERIFY FINDING {bad}")


def test_paths_against_enumeration(spark):
    rng = random.Random(1)
    nodes = [{"id": f"v{i}", "type": "T", "salience": i / 10} for i in range(8)]
    pairs = {(a, b) for a in range(8) for b in range(8) if a != b and rng.random() < 0.25}
    g = make(spark, nodes, [edge(f"v{a}", "E", f"v{b}", weight=0.5) for a, b in pairs])
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(8)}
    want = set()

    def walk(path):
        if path[-1] == 7 and len(path) > 1:
            want.add(tuple(f"v{i}" for i in path))
        elif len(path) <= 3:
            for j in near[path[-1]] - {*path}:
                walk([*path, j])

    walk([0])
    ids = g.nodes.select("id")
    got = {tuple(r.node_ids) for r in simple_paths(g, ids.filter("id = 'v0'"), ids.filter("id = 'v7'"), 3).collect()}
    assert got == want


def test_communities_and_bridges(spark):
    nodes = [{"id": x, "type": "T", "label": x.upper(), "salience": 0.5} for x in ("a1", "a2", "a3", "b1", "b2", "b3", "m")]
    edges = [edge(x + i, "RELATED_TO", x + j, weight=0.9) for x in "ab" for i, j in (("1", "2"), ("2", "3"), ("1", "3"))] + [edge("m", "RELATED_TO", "a1", weight=0.95), edge("m", "RELATED_TO", "b1", weight=0.95)]
    g = make(spark, nodes, edges)
    found, members = analysis.communities(g)
    sizes = sorted(r["size"] for r in found.collect())
    assert sum(sizes) == 7 and len(sizes) == 2
    marks = analysis.bridge_marks(analysis.adjacency(g), members).collect()
    assert {r.node for r in marks} >= {"m"}
    bridges = analysis.bridge_candidates(g, members).collect()
    assert {r.id for r in bridges} & {"m", "a1", "b1"}


def test_sweep_per_component_is_the_global_sweep(spark):
    rng = random.Random(4)
    for giant in (100_000, 0):
        pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.randrange(1, 4) / 2) for _ in range(25)]
        g = make(spark, [{"id": f"n{i:02d}", "type": "T"} for i in range(30)], [edge(a, "E", b, weight=w, id=str(k)) for k, (a, b, w) in enumerate(pairs)])
        adj = analysis.adjacency(g)
        table = {}
        for r in adj.collect():
            table.setdefault(r.node, {})[r.neighbour] = r.weight
        got = {r.node: r.label for r in analysis.propagate(adj, at_most=giant).collect()}
        assert got.keys() == table.keys()
        if giant:
            assert got == analysis.sweep(table, 12)


def test_giant_components_are_swept_like_small_ones(spark):
    pairs = [(f"l{i}", f"r{j}", 1.0) for i in range(3) for j in range(3)] + [("l0", "a", 0.5), ("a", "z", 2.0), ("z", "r2", 0.5), ("a", "a", 1.0)]
    adj = spark.createDataFrame([(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs if a != b], "node string, neighbour string, weight double")
    table = {}
    for r in adj.collect():
        table.setdefault(r.node, {})[r.neighbour] = r.weight
    want = analysis.sweep(table, 12)
    assert len({want[n] for n in want if n[0] in "lr"}) == 1
    for giant in (0, 100_000):
        assert {r.node: r.label for r in analysis.propagate(adj, at_most=giant).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in got} and got.keys() == root.keys()


def test_activation_by_hand(spark):
    nodes = [{"id": "a", "type": "T"}, {"id": "b", "type": "T"}, {"id": "c", "type": "T", "status": "latent"}, {"id": "d", "type": "T", "status": "archived"}, {"id": "e", "type": "T"}]
    g = make(spark, nodes, [edge("a", "E", "b", weight=0.8, confidence=0.5), edge("b", "E", "c"), edge("a", "E", "d"), edge("a", "INHIBITS", "e")])
    got = {r.id: round(r.activation, 9) for r in activate(g, ["a"], depth=2).collect()}
    b = 0.8 * 0.5 * 0.55
    # what an inhibiting edge touches is there, but never rises
    assert got == {"a": 1.0, "b": round(b, 9), "c": round(b * 0.55**2 * 0.35, 9), "e": 0.0}


def test_retrieval_ranks_what_matches(spark):
    nodes = [
        {"id": "f1", "type": "Function", "label": "parse_config_file", "text": "parse the config file of a project", "salience": 0.01},
        {"id": "f2", "type": "Function", "label": "config", "text": "the project has a file and later a parse step of config", "salience": 0.99},
        {"id": "f3", "type": "Function", "label": "unrelated", "text": "nothing to see"}, {"id": "gone", "type": "Function", "label": "parse config file", "status": "archived"},
    ]
    g = make(spark, nodes, [edge("f1", "CALLS", "f3")])
    ranked = [r.id for r in retrieval.retrieve(g, "parse config file", depth=1).collect()]
    assert ranked[0] == "f1" and "gone" not in ranked
    rows = Engine(g).run("RETRIEVE 'parse config file' LIMIT 2").collect()
    assert rows[0].id == "f1" and [r.rank for r in rows] == [1, 2]
    view = retrieval.explore(g, g.nodes.select("id").filter("id = 'f3'"), "callers").collect()
    assert [(r.id, r.relation) for r in view] == [("f1", "CALLS")]


def test_text_functions(spark):
    words = ["a", "abc", "abcd", "abcdef", "1234", "abc123", "a_b", "api-error"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.signal(F.col("w")).alias("s"))
    assert {r.w: round(r.s, 6) for r in df.collect()} == {"a": 0, "abc": 0.25, "abcd": 0.5, "abcdef": 0.75, "1234": 0.65, "abc123": 0.9, "a_b": 0.45, "api-error": 0.95}
    texts = ["Ünïcode ﬀ  “quoted”\n-dash_ __x__ É2", "", "API-error: x2 in /src/Main.java!", "naïve façade — déjà-vu"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.tokenize(F.col("t")).alias("w"), tx.canonicalize(F.col("t")).alias("c")).collect()
    for r in rows:
        if "ﬀ" not in texts[r.i]:
            assert r.w == plain_tokens(texts[r.i]) and r.c == plain_canonical(texts[r.i])


def test_merge_is_ordered(spark):
    g = make(spark, [{"id": "k", "type": "T", "canonical_key": "key", "confidence": 1.0, "label": "old", "status": "archived"}, {"id": "z", "type": "T"}])
    again = lambda i, c, seq, **more: make(spark, [{"id": i, "type": "T", "canonical_key": "key", "confidence": c} | more]).nodes.withColumn("seq", F.lit(seq).cast("long"))
    out = merge.upsert_nodes(g, again("new-id", 0.0, 1, usage_count=4).union(again("k", 0.4, 2, label="new", status="candidate")))
    rows = {r.id: r for r in out.nodes.collect()}
    assert rows.keys() == {"k", "z"} and rows["k"].confidence == pytest.approx((0.5 + 0.4) / 2) and rows["k"].label == "new" and rows["k"].usage_count == 4 and rows["k"].status == "active"
    batch = make(spark, [], [edge("k", "E", "z", weight=0.3), edge("k", "E", "missing")]).edges.withColumn("seq", F.lit(0).cast("long"))
    more, refused = merge.upsert_edges(out, batch)
    assert more.edges.count() == 1 and [r.to_id for r in refused.collect()] == ["missing"]


def test_snapshots_commit_or_keep(spark, tmp_path):
    g = make(spark, [{"id": "a", "type": "T"}, {"id": "b", "type": "T"}], [edge("a", "E", "b")])
    s = GraphSession(spark, str(tmp_path / "store"), g)
    new = make(spark, [{"id": "c", "type": "T"}]).nodes.withColumn("seq", F.lit(0).cast("long"))
    bad = make(spark, [], [edge("a", "E", "nowhere")]).edges.withColumn("seq", F.lit(0).cast("long"))
    with pytest.raises(EvaluationProblem):
        s.upsert(new, bad)
    assert s.snapshots.read().nodes.count() == 2
    assert [(r.id, r.change) for r in s.upsert(new).collect()] == [("c", "added")]
    s.compact()
    assert s.graph.nodes.count() == 3 and {r.kind for r in s.snapshots.inspect().collect()} == {"nodes", "edges"}
    back = merge.import_json(s.graph.export_json(), s.graph.nodes.schema, s.graph.edges.schema)
    assert back.nodes.count() == 3 and back.edges.count() == 1
    assert "## Node types" in s.report() and "<canvas" in reports.html_graph(s.graph)


def test_findings(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x/1.py", "a/x/2.py", "b/1.py", "b/2.py", "c/1.py")], "path string")
    links = spark.createDataFrame([("c/1.py", "b/1.py"), ("a/x/1.py", "a/x/2.py")], "source string, target string")
    assert [(r.directory, r.file_count) for r in findings.orphan_directories(files, links).collect()] == [("a", 2)]


def test_unused_symbols_reads_every_edge(spark, sf):
    from skeinspark.queries import QUERIES

    used = {r.l_partkey for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().collect()}
    parts = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    assert {r.id for r in QUERIES["unused_symbols"](spark, sf).collect()} == {f"part:{k}" for k in parts - used}


def test_overlay(spark):
    std = make(spark, [{"id": "f", "type": "Function", "label": "f"}, {"id": "file", "type": "File", "label": "x", "relative_path": "src/x.py"}, {"id": "t", "type": "Topic"}], [edge("file", "DEFINES", "f")], relative_path="string")
    mine = overlay.derive(std)
    task = overlay.item(mine, "Task", "fix it", NOW)
    mine = overlay.add(mine, task)
    task_id = task.first().id
    mine = overlay.link(mine, spark.createDataFrame([(task_id, "src/x.py")], "from_id string, path string"), "touches", NOW)
    assert {r.id: r.depth for r in overlay.closure(mine, task_id).collect()} == {task_id: 0, "file": 1}
    fewer = Graph(std.nodes.filter("id <> 'f'").withColumn("label", F.lit("y")), std.edges)
    new, changes = overlay.sync(mine, fewer)
    assert {(r.id, r.change) for r in changes.collect()} == {("f", "stale"), ("file", "changed")}
    assert new.nodes.filter("origin = 'agent'").count() == 1
    assert overlay.items(overlay.complete(new, task_id, NOW), status="done").count() == 1


def test_release(spark):
    from skeinspark.shared import materialize, release

    kept = materialize(spark.range(3))
    assert kept.count() == 3 and release(spark) >= 1
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_guarded_session(spark, tmp_path):
    s = GraphSession(spark, str(tmp_path / "g"), make(spark, [{"id": "a", "type": "T"}]), guarded=True)
    with pytest.raises(EvaluationProblem):
        s.query("HUBS")
    assert s.query("FIND NODES LIMIT 9999").count() == 1


def plain_canonical(text):
    """The rule spelt out: quotes, white space, lower case, decomposition without marks, then letters, digits, `_` and `-` only."""
    for a, b in zip("‘’“”", "''\"\"", strict=True):
        text = text.replace(a, b)
    low = re.sub(r"\s+", " ", text).strip().lower()
    bare = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9_-]", " ", bare).split())


def plain_tokens(text):
    return [t for t in (m.strip("_-") for m in re.findall("[a-z0-9_][a-z0-9_-]+", plain_canonical(text))) if len(t) >= 2]


def test_one_canonical_form_for_all_code_points(spark):
    """Every code point of the basic plane between two words, in columns and for a request's text alike."""
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    rows = spark.createDataFrame([(c, f"ab{chr(c)}cd {chr(c)}") for c in codes], "i int, t string")
    wrong = [r.i for r in rows.select("i", tx.canonicalize(F.col("t")).alias("c")).collect() if r.c != plain_canonical(f"ab{chr(r.i)}cd {chr(r.i)}")]
    assert not wrong, [hex(c) for c in wrong[:40]] + [len(wrong)]
    got = tx.analyse(spark, "ﬁle ﬂow ½ Ⅳ Ünïcode")
    assert got.key == "file flow 1 2 iv unicode" and got.tokens == ("file", "flow", "iv", "unicode")


def test_a_graph_is_bound_to_the_files_as_they_are(spark, sf, tmp_path):
    """Rows added to a table are in the graph of the next call."""
    import shutil

    from skeinspark.sources.projection import TABLES, graph_of

    for name in TABLES:
        shutil.copytree(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet") if (Path(sf) / f"{name}.parquet").is_dir() else shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    more = spark.read.parquet(f"{sf}/region.parquet")
    n = more.count()
    (tmp_path / "region.parquet").unlink() if (tmp_path / "region.parquet").is_file() else None
    more.write.mode("overwrite").parquet(str(tmp_path / "region.parquet"))
    count = lambda: graph_of(spark, str(tmp_path)).nodes.filter("type = 'Region'").count()
    assert count() == n
    more.withColumn("r_regionkey", F.col("r_regionkey") + 100).write.mode("append").parquet(str(tmp_path / "region.parquet"))
    assert count() == 2 * n
