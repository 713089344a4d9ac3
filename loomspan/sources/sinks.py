"""Sinks: JSON lines, run artifacts, idempotent upserts, graph exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line (K1)."""
    df.write.mode("overwrite").json(path)


def run_artifacts(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each row set of a run as Parquet, with a manifest of row counts (K2)."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(counts.items()), "artifact string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return counts


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be appended so that the first write of each key stays (K3, K4)."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The table after an upsert in which the last writer wins (K5)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(seq))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def with_endpoints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with UNKNOWN ones for the ends of edges that are missing (K5)."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    missing = ends.join(vertices, "id", "left_anti").select("id", F.lit("UNKNOWN").alias("type"))
    return vertices.select("id", "type").union(missing)


def fan_out(df: DataFrame, targets: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Hands a batch to every target and tells how each fared; one failure stops no other."""
    receipt = {}
    for name, apply in targets.items():
        try:
            apply(df)
            receipt[name] = "ok"
        except Exception as e:  # noqa: BLE001 - a target's failure is its own
            receipt[name] = f"failed: {type(e).__name__}: {str(e)[:200]}"
    return receipt


def dot(edges: DataFrame, limit: int = 120) -> str:
    """The heaviest edges as a Graphviz text (K9, K11); a bounded export."""
    rows = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "src", "dst").limit(limit).collect()
    return "digraph g {\n" + "".join(f'  "{r["src"]}" -> "{r["dst"]}";\n' for r in rows) + "}\n"


def mermaid(edges: DataFrame, limit: int = 120) -> str:
    rows = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "src", "dst").limit(limit).collect()
    return "graph TD\n" + "".join(f"  n{r['src']} --> n{r['dst']}\n" for r in rows)


def content_manifest(df: DataFrame, key: str) -> DataFrame:
    """key, sha of each row's canonical JSON (K12): what an export is verified against."""
    cols = sorted(df.columns)
    return df.select(key, F.sha2(F.to_json(F.struct(*cols)), 256).alias("sha"))


def graph_map(vertices: DataFrame, edges: DataFrame, nodes: int = 40, links: int = 120) -> str:
    """The weightiest vertices and the links among them as a Mermaid text (K11); a bounded export.

    ``vertices``: id, label, weight; ``edges``: src, dst, kind, weight. Of the ``links``
    weightiest links those between listed vertices are drawn.
    """
    top = vertices.orderBy(F.desc("weight"), "id").limit(nodes).select("id", "label").collect()
    listed = {r["id"] for r in top}
    name = lambda x: "n" + str(x).replace("-", "_")
    lines = [f'  {name(r["id"])}["{str(r["label"]).replace(chr(34), chr(39))}"]' for r in top]
    for r in edges.orderBy(F.desc("weight"), "src", "dst", "kind").limit(links).collect():
        if r["src"] in listed and r["dst"] in listed:
            lines.append(f"  {name(r['src'])} -->|{r['kind']}| {name(r['dst'])}")
    return "graph TD\n" + "\n".join(lines) + "\n"


def learning_export(vertices: DataFrame, edges: DataFrame, features: DataFrame, path: str) -> None:
    """nodes and edges as CSV with a header, features as JSON lines."""
    vertices.select("id", "label", "kind", "weight").write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind", "weight").write.mode("overwrite").option("header", True).csv(f"{path}/edges")
    features.write.mode("overwrite").json(f"{path}/features")


def cache_put(stored: DataFrame, new: DataFrame, content: str = "content") -> DataFrame:
    """What a content cache has to take up (K13): hash, content and size of contents it does not hold yet."""
    hashed = new.withColumn("hash", F.sha2(F.col(content), 256)).withColumn("bytes", F.octet_length(F.col(content)))
    return insert_ignore(stored, hashed, ["hash"])


def cache_get(stored: DataFrame, wanted: DataFrame, content: str = "content") -> DataFrame:
    """hash, content of wanted hashes; contents that no longer match their hash are not given out."""
    return stored.join(wanted.select("hash").distinct(), "hash", "left_semi").filter(F.sha2(F.col(content), 256) == F.col("hash")).select("hash", content)


def append_chained(log: DataFrame, new: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """A chained log with new bodies at its end; a log whose chain is broken takes none.

    ``log``: keys, order, body, sequence, prev_hash, entry_hash as ``events.chain``
    gives them; ``new``: keys, order, body, later than what is there.
    """
    from loomspan.operators import events as ev

    bad = ev.verify_chain(log, keys, body).filter("failed_at is not null")
    if not bad.isEmpty():
        raise ValueError(f"the chain is broken: {bad.first().asDict()}")
    return ev.chain(log.select(*keys, order, body).unionByName(new.select(*keys, order, body)), keys, order, body)
