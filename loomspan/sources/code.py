"""Source files as entities and relations, parsed with the standard library over batches."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "file string, sha string, kind string, name string, parent string, line int, bases array<string>, calls array<string>, imports array<string>"


def _called(node: ast.AST) -> list[str]:
    """Names that are called below a node, each once in order of first sight."""
    out: dict[str, None] = {}
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.setdefault(name)
    return list(out)


def _imported(tree: ast.Module) -> list[str]:
    out: dict[str, None] = {}
    for n in tree.body:
        if isinstance(n, ast.Import):
            out.update((a.name, None) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            out.update((f"{n.module}.{a.name}" if n.module else a.name, None) for a in n.names)
            if n.module:
                out.setdefault(n.module)
    return list(out)


def parse(file: str, source: str) -> list[tuple]:
    """(kind, name, parent, line, bases, calls, imports) of the module, its classes, functions and methods."""
    tree = ast.parse(source)
    module = file.rsplit("/", 1)[-1].removesuffix(".py")
    rows = [("module", module, None, 1, [], _called(tree), _imported(tree))]

    def visit(body: list[ast.stmt], parent: str | None, inside: str) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                rows.append(("class", n.name, parent, n.lineno, [b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, ast.Name | ast.Attribute)], [], []))
                visit(n.body, n.name, "class")
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                rows.append(("method" if inside == "class" else "function", n.name, parent, n.lineno, [], _called(n), []))

    visit(tree.body, None, "module")
    return rows


def entities(files: DataFrame, file: str = "file", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Entities of Python files (S17, S18): file, sha, kind, name, parent, line, bases, calls, imports.

    Files that cannot be parsed, null ones included, are one row of kind ``unreadable``. With ``known`` (file, sha of
    an earlier scan) files that have not changed are left out, so a scan costs what is new.
    """
    f = files.select(F.col(file).alias("file"), F.coalesce(text, F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    if known is not None:
        f = f.join(known.select("file", "sha").distinct(), ["file", "sha"], "left_anti")

    def run(batches):
        for pdf in batches:
            out = []
            for name, source, sha in zip(pdf["file"], pdf["text"], pdf["sha"], strict=True):
                try:
                    rows = parse(name, source)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows = [("unreadable", name, None, 0, [], [], [])]
                out += [(name, sha, *r) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return f.select("file", "text", "sha").mapInPandas(run, ENTITIES)


def import_edges(found: DataFrame) -> DataFrame:
    """src, dst, kind: imports led to the files they name (J13): a module's path, or its folder's ``__init__``."""
    wanted = found.filter("kind = 'module'").select(F.col("file").alias("src"), F.explode("imports").alias("m"))
    path = F.replace("m", F.lit("."), F.lit("/"))
    wanted = wanted.select("src", F.explode(F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))).alias("dst"))
    files = found.select(F.col("file").alias("dst")).distinct()
    return wanted.join(files, "dst").filter("src <> dst").select("src", "dst", F.lit("import").alias("kind")).distinct()


def call_edges(found: DataFrame) -> DataFrame:
    """src, dst, kind: calls led to the one other file that defines the name as a function (J13); ambiguous names are none."""
    calls = found.filter("kind = 'module'").select(F.col("file").alias("src"), F.explode("calls").alias("name"))
    defs = found.filter("kind = 'function'").select("name", F.col("file").alias("dst")).distinct()
    j = calls.join(defs, "name").filter("src <> dst")
    one = j.groupBy("src", "name").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1")
    return one.select("src", "dst", F.lit("call").alias("kind")).distinct()


def relations(found: DataFrame) -> DataFrame:
    """kind, src, dst, confidence among entities of all files (J14): contains, inherits, calls by name, imports as written."""
    ident = F.concat_ws(":", "file", "parent", "name")
    e = found.filter("kind <> 'unreadable'").withColumn("id", ident)
    module = e.filter("kind = 'module'").select("file", F.col("id").alias("src"))
    contains = e.filter("kind <> 'module'").select("file", F.col("id").alias("dst")).join(module, "file").select(F.lit("contains").alias("kind"), "src", "dst", F.lit(1.0).alias("confidence"))
    # A name stands for its last entity in order of file and line.
    named = e.filter("kind <> 'module'").groupBy("name").agg(F.max_by("id", F.struct("file", "line")).alias("dst"))
    by = lambda column, kind, sure, of: e.filter(F.col("kind").isin(*of)).select("id", F.col("name").alias("own"), F.explode(column).alias("name")).join(named, "name").filter("own <> name").select(F.lit(kind), F.col("id"), "dst", F.lit(sure))
    imports = e.filter("kind = 'module'").select(F.lit("imports"), "id", F.explode("imports"), F.lit(1.0))
    return contains.union(by("bases", "inherits", 1.0, ["class"])).union(by("calls", "calls", 0.8, ["function", "method"])).union(imports).distinct()
