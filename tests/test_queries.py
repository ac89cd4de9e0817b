"""Registered queries against their SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from skeinspark import more_queries, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each kind; the driver compares them all.
CHOSEN = (
    "find_and_or", "find_like", "find_regex", "edges_polarity", "match_both", "match_fragments", "stats_by_two", "explain_node", "degree_topk", "paths", "keyword_scores", "open_triads", "centrality", "salience",
    "merge_nodes", "merge_edges", "dirty_set", "overlay_sync", "paragraphs", "finding_priority",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return float(f"{value:.9g}") + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sf, duck, name):
    everything = queries.QUERIES | more_queries.QUERIES
    df = everything[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute((queries.SQL | more_queries.SQL)[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["c_name", "n_name"]
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are gone."""
    root = Path(__spark_entry__.__file__).parent
    (tmp_path / "__spark_entry__.py").write_text(Path(__spark_entry__.__file__).read_text())
    for p in (root / "skeinspark").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)})
