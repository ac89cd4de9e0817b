"""Results of statements as values: briefs of nodes and edges, and bounded renderings for people and programs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a brief.
NODE_BRIEF = ("id", "type", "label", "text", "canonical_key", "status", "salience", "confidence", "activation")
EDGE_BRIEF = ("id", "type", "from_id", "to_id", "weight", "confidence", "polarity", "origin")


def node_brief(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"`{prefix}{c}`").alias(c) for c in NODE_BRIEF])


def edge_brief(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"`{prefix}{c}`").alias(c) for c in EDGE_BRIEF])


def to_dict(rows: DataFrame, statement: str, most: int = 1000) -> dict:
    """At most so many rows, and whether there were more."""
    found = [json.loads(x) for x in rows.limit(most + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]
    return {"statement": statement, "columns": rows.columns, "rows": found[:most], "row_count": min(len(found), most), "truncated": len(found) > most}


def to_json(rows: DataFrame, statement: str, most: int = 1000) -> str:
    return json.dumps(to_dict(rows, statement, most), ensure_ascii=False, indent=2, sort_keys=True)


def to_table(rows: DataFrame, most: int = 1000, width: int = 96) -> str:
    """Columns of text, each as wide as its widest value up to a bound."""
    got = to_dict(rows, "", most)
    if not got["columns"]:
        return f"{got['row_count']} row(s)"
    shown = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, dict | list) else str(v)
    cells = [[shown(r.get(c)).replace("\n", " ") for c in got["columns"]] for r in got["rows"]]
    cells = [[v if len(v) <= width else v[: width - 3] + "..." for v in r] for r in cells]
    wide = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(got["columns"])]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, wide, strict=True))
    return "\n".join([line(got["columns"]), line(["-" * w for w in wide]), *map(line, cells), f"({len(cells)} rows)"])
