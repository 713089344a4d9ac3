"""The flagship query and queries over the pipeline language and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import ranking, text
from loomspan.plans import pipeline
from loomspan.plans.registry import query
from loomspan.plans.text_queries import DOCS, _score_sql
from loomspan.sources.tables import table, texts

FLAGSHIP = "Which threshold applies before the transfer, and what must be required when the limit of the form is reached?"


@query()
def ranked_pack(spark, sf):
    return ranking.ranked_pack(texts(spark, sf, "documents").select("doc_id", "source", "text"), FLAGSHIP)


@query(f"SELECT doc_id, fact_score FROM (SELECT doc_id, round({_score_sql('text')}, 6) AS fact_score FROM ({DOCS.replace('FROM documents', 'FROM documents WHERE contains(lower(text), ' + chr(39) + 'limit' + chr(39) + ')')})) WHERE fact_score >= 1.0 ORDER BY fact_score DESC, doc_id LIMIT 25")
def expression_pipeline(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return pipeline.execute('text.contains[query: "limit"] | text.score | rows.keep[least: 1.0] | rows.top[by: fact_score, n: 25]', docs, pipeline.standard()).select("doc_id", "fact_score")


@query("SELECT document_id AS pack_id, count(*) AS injected, count(CASE WHEN used THEN 1 END) AS used, round(1 - count(CASE WHEN used THEN 1 END) / count(*), 6) AS waste FROM (SELECT document_id, handle, bool_or(said) AS used FROM (SELECT i.document_id, i.handle, s.w IS NOT NULL AS said FROM (SELECT DISTINCT document_id, handle FROM (SELECT document_id, unnest(string_split_regex(trim(text), '\\s+')[1:5]) AS handle FROM chunks WHERE position = 1)) i LEFT JOIN (SELECT DISTINCT document_id, unnest(string_split_regex(text, '\\s+')) AS w FROM chunks WHERE position < 1) s ON s.document_id = i.document_id AND s.w = i.handle) GROUP BY 1, 2) GROUP BY 1")
def waste_ledger(spark, sf):
    """Words a second chunk begins with, counted as used where the first chunk has them."""
    c = table(spark, sf, "chunks")
    injected = c.filter("position = 1").select(F.col("document_id").alias("pack_id"), F.explode(F.slice(F.split(F.trim("text"), r"\s+"), 1, 5)).alias("handle")).distinct()
    turns = c.select(F.col("document_id").alias("pack_id"), F.col("position").alias("turn"), "text")
    return ranking.waste(injected, turns, first=1)


@query("SELECT axis, verb, count(*) AS n FROM (SELECT unnest(['north', 'south', 'east']) AS axis) CROSS JOIN (SELECT unnest(['read', 'rank']) AS verb) GROUP BY 1, 2")
def geometric_expression(spark, sf):
    """Every combination of a plan's axes."""
    return text.brace_product({"axis": ["north", "south", "east"], "verb": ["read", "rank", "read"]}, spark).groupBy("axis", "verb").agg(F.count("*").alias("n"))


@query("SELECT source_id, y::INT AS year FROM (SELECT source_id, unnest(range(2000 + depth, 2000 + depth - 4, -1)) AS y FROM sources)")
def year_span_queries(spark, sf):
    s = table(spark, sf, "sources").select("source_id", (2000 + F.col("depth")).alias("high"), (2000 + F.col("depth") - 3).alias("low"))
    return text.year_span(s, "source_id", "low", "high")


@query("SELECT discovered_by, count(*) AS n, max(depth) AS deepest FROM (SELECT coalesce(discovered_by, 'unknown') AS discovered_by, depth FROM crawl_pages) GROUP BY 1")
def frontier_counts(spark, sf):
    """Frontier by how it was found, null as unknown."""
    return table(spark, sf, "crawl_pages").groupBy(F.coalesce("discovered_by", F.lit("unknown")).alias("discovered_by")).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("SELECT tenant, space_id, cid FROM (SELECT *, row_number() OVER (PARTITION BY tenant, space_id ORDER BY norm DESC NULLS LAST, cid) AS n FROM (SELECT DISTINCT tenant, space_id, cid, norm FROM vector_records WHERE tenant IS NOT NULL)) WHERE n = 1")
def loudest_by_tenant(spark, sf):
    """Best record of each tenant and space in a total order."""
    from loomspan.operators.chunking import first_of

    r = table(spark, sf, "vector_records").filter("tenant is not null").select("tenant", "space_id", "cid", "norm").distinct()
    return first_of(r, ["tenant", "space_id"], [F.desc_nulls_last("norm"), F.col("cid")]).select("tenant", "space_id", "cid")
