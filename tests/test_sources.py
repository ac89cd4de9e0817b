from __future__ import annotations

from pyspark.sql import functions as F

from skeinspark.sources import code, documents, files
from skeinspark.streaming import watch


def project(tmp_path):
    root = tmp_path / "proj"
    for name, body in {
        "README.md": "# Title\n\nIntro with [a link](http://x.y).\n\n## Part\n\n- one\n- two\n\n```py\ncode()\n```\n\n| a | b |\n|---|---|\n", "notes.txt": "first\n\nsecond part\n", "src/app.py": "import os\nimport sys\n\ndef used():\n    x = 1\n    return os.getcwd()\n\nclass A:\n    def m(self):\n        used()\n",
        "src/ui.js": "import { x } from './lib'\nexport function go() {}\nclass B {}\n", "data.json": '{"a": 1}', "tests/test_app.py": "from src.app import used\nused()\n", "node_modules/dep.js": "x", "run": "#!/usr/bin/env python\nprint(1)\n", "logo.png": "not really", "big.txt": "x" * 5000,
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (root / "blob.xyz").write_bytes(b"a\x00b")
    return root


def test_scan(spark, tmp_path):
    rows = {r.relative_path: r for r in files.scan(spark, str(project(tmp_path)), "p", rules=("*.json", "!data.json"), exclude=("notes.*",), max_bytes=4000).collect()}
    assert {p: (r.artifact_type, r.language, r.context_scope) for p, r in rows.items()} == {
        "README.md": ("markdown", None, "docs"), "src/app.py": ("code", "python", "code"), "src/ui.js": ("code", "javascript", "code"), "data.json": ("data", None, "code"),
        "tests/test_app.py": ("code", "python", "test"), "run": ("code", "python", "code"), "blob.xyz": ("binary", None, "code"),
    }


def test_markdown_and_paragraphs(spark, tmp_path):
    text = (project(tmp_path) / "README.md").read_text()
    got = documents.markdown(spark.createDataFrame([("a", text), ("b", None)], "artifact_id string, text string")).orderBy("no").collect()
    assert [(r.fragment_type, r.line_start, r.section_path) for r in got] == [("heading", 1, "Title"), ("paragraph", 3, "Title"), ("heading", 5, "Title > Part"), ("list", 7, "Title > Part"), ("code_block", 10, "Title > Part"), ("table", 14, "Title > Part")]
    assert got[1].links == ["http://x.y"]
    t = "one\ntwo\n \n\nthrée\n\n" + "x" * 7000
    rows = documents.paragraphs(spark.createDataFrame([(1, t), (2, None)], "id int, t string"), "id", "t").collect()
    assert all(t[r.start : r.end] == r.text for r in rows) and sorted(len(r.text) for r in rows) == [5, 7, 1000, 3000, 3000]


def test_terms(spark):
    frag = spark.createDataFrame([("d", 0, "graph engine plans a graph query"), ("d", 1, "the graph engine runs")], "artifact_id string, no int, text string")
    terms = documents.document_terms(frag)
    assert "graph engine" in {r.term for r in terms.collect()}
    assert documents.term_relations(frag, terms).filter("a = 'engine' AND b = 'graph engine'").count() == 1


def test_code_facts(spark, tmp_path):
    found = files.scan(spark, str(project(tmp_path)), "p").filter("artifact_type = 'code'").withColumn("text", F.decode("content", "UTF-8"))
    facts = code.code_facts(found).cache()
    names = {(r.relative_path, r.kind, r.qualified_name) for r in facts.filter("fact = 'symbol'").collect()}
    assert {("src/app.py", "Function", "used"), ("src/app.py", "Class", "A"), ("src/app.py", "Method", "A.m"), ("src/app.py", "Variable", "used.x"), ("src/ui.js", "Function", "go"), ("src/ui.js", "Class", "B")} <= names
    assert ("A.m", "used") in {(r.owner, r.symbol) for r in code.resolve(facts).collect()}
    unused = {(r.finding_type, r.name) for r in code.unused_in_file(facts).collect()}
    assert ("unused_import", "sys") in unused and ("unused_variable", "x") in unused and ("unused_import", "os") not in unused and ("possibly_unused_function", "used") not in unused


def test_watch(spark, tmp_path):
    root, seen = project(tmp_path), []

    def compile_batch(found, states):
        paths = {r.artifact_id: r.relative_path for r in found.select("artifact_id", "relative_path").collect()}
        seen.append({(paths.get(r.artifact_id), r.state) for r in states.collect()})

    run = lambda: watch.watch(spark, str(root), "p", str(tmp_path / "state"), compile_batch).awaitTermination()
    run()
    assert ("src/app.py", "new") in seen[-1]
    (root / "notes.txt").unlink()
    (root / "src/app.py").write_text("x = 2\n")
    (root / "src/new.py").write_text("y = 2\n")
    run()
    assert seen[-1] == {(None, "deleted"), ("src/app.py", "changed"), ("src/new.py", "new")}
