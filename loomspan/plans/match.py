"""A small pattern language over vertex and edge tables, compiled to DataFrame plans (Q1, Q2).

    MATCH (a)[-[r:KIND]->(b)] [WHERE a.x OP value [AND ...]] [RETURN [DISTINCT] a.x, ...] [LIMIT n]

As in the language it follows: conditions look at the first vertex only, one on
another variable finds no field; ``=`` compares texts; CONTAINS on a list asks
any element; the limit cuts before projection and DISTINCT; unknown fields are
null. Rows are in order of their ids, so that a limit is well defined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_]\w*"
_HEAD = re.compile(rf"\s*MATCH\s*\(\s*({_NAME})\s*\)\s*(?:-\[\s*({_NAME})?\s*(?::\s*({_NAME}))?\s*\]->\s*\(\s*({_NAME})\s*\)\s*)?", re.I)
_CLAUSE = re.compile(r"\b(WHERE|RETURN|LIMIT)\b", re.I)
_TEST = re.compile(rf"({_NAME}(?:\.{_NAME})?)\s*(ENDS\s+WITH|STARTS\s+WITH|CONTAINS|!=|=)\s*(.+)", re.I)
VERTEX_FIELDS = ("id", "kind", "defines", "variables", "calls", "config_keys")
EDGE_FIELDS = ("kind", "source", "target", "weight")


def parse(query: str) -> dict:
    """Parts of a query; an unreadable one is an error that names the place."""
    head = _HEAD.match(query)
    if not head:
        raise ValueError(f"expected MATCH (name) at 0: {query[:40]!r}")
    parts = _CLAUSE.split(query[head.end() :])
    if parts[0].strip():
        raise ValueError(f"unexpected {parts[0].strip()[:20]!r} after the pattern")
    clauses = {}
    for name, body in zip(parts[1::2], parts[2::2], strict=True):
        clauses[name.upper()] = body.strip()
    tests = []
    for t in re.split(r"\s+AND\s+", clauses.get("WHERE", ""), flags=re.I):
        m = _TEST.fullmatch(t.strip()) if t.strip() else None
        if m:
            value = m.group(3).strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            tests.append((m.group(1), re.sub(r"\s+", " ", m.group(2).upper()), value))
        elif t.strip():
            raise ValueError(f"unreadable condition {t.strip()!r}")
    back = clauses.get("RETURN", "")
    distinct = back[:9].upper() == "DISTINCT "
    return {
        "a": head.group(1), "r": head.group(2), "kind": head.group(3), "b": head.group(4), "tests": tests, "distinct": distinct,
        "fields": [f.strip() for f in (back[9:] if distinct else back).split(",") if f.strip()], "limit": int(clauses.get("LIMIT") or 1000),
    }


def _test(field: str, op: str, value: str, columns: dict[str, str], var: str) -> Column:
    name = field[len(var) + 1 :] if field.startswith(var + ".") else field
    if name not in columns:
        # A field that is not there reads as the text of nothing.
        text = "None"
        return F.lit({"=": text == value, "!=": text != value, "CONTAINS": False, "ENDS WITH": text.endswith(value), "STARTS WITH": text.startswith(value)}[op])
    c = F.col(f"_a.{name}")
    listed = columns[name].startswith("array")
    if op == "CONTAINS":
        return F.exists(c, lambda x: x.cast("string").contains(value)) if listed else F.coalesce(c.cast("string").contains(value), F.lit(False))
    text = F.coalesce(c.cast("string"), F.lit("None"))
    return {"=": text == value, "!=": text != value, "ENDS WITH": text.endswith(value), "STARTS WITH": text.startswith(value)}[op]


def run(query: str, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a query; columns are named var_field."""
    p = parse(query)
    columns = {c: t for c, t in vertices.dtypes}
    seen = [c for c in VERTEX_FIELDS if c in columns]
    v = vertices.select(F.struct(*columns).alias("_a"))
    where = F.lit(True)
    for t in p["tests"]:
        where = where & _test(*t, columns, p["a"])
    if p["b"]:
        e = edges if not p["kind"] else edges.filter(F.lower("kind") == p["kind"].lower())
        e = e.select(F.struct(F.col("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("weight") if "weight" in edges.columns else F.lit(1.0).alias("weight")).alias("_r"))
        rows = e.join(v.filter(where), F.col("_r.source") == F.col("_a.id")).join(vertices.select(F.struct(*columns).alias("_b")), F.col("_r.target") == F.col("_b.id"))
        rows = rows.orderBy("_a.id", "_b.id", "_r.kind")
    else:
        rows = v.filter(where).orderBy("_a.id")
    rows = rows.limit(p["limit"])
    scope = {p["a"]: ("_a", seen), **({p["b"]: ("_b", seen)} if p["b"] else {}), **({p["r"]: ("_r", list(EDGE_FIELDS))} if p["b"] and p["r"] else {})}
    out = []
    for f in p["fields"] or [f"{p['a']}.{c}" for c in seen]:
        var, _, name = f.partition(".")
        side, known = scope.get(var, (None, []))
        if not name:
            out.append((F.col(side) if side else F.lit(None).cast("string")).alias(var))
        else:
            out.append((F.col(f"{side}.{name}") if name in known else F.lit(None).cast("string")).alias(f"{var}_{name}"))
    got = rows.select(*out)
    return got.distinct() if p["distinct"] else got
