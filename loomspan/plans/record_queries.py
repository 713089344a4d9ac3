"""Queries over filters, lookups and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import encoding
from loomspan.operators import records as rc
from loomspan.operators import vectors as vc
from loomspan.plans import graph_queries as gq
from loomspan.plans.registry import query
from loomspan.sources.tables import table, texts


@query("SELECT cid FROM (SELECT DISTINCT cid, tenant, space_id FROM vector_records) WHERE tenant IS NULL OR tenant IN ('world', 'tenant-b')")
def tier_scope(spark, sf):
    r = table(spark, sf, "vector_records").select("cid", "tenant", "space_id").distinct()
    return r.filter(rc.tier_visible(F.col("tenant"), "tenant-b")).select("cid")


@query("SELECT p_partkey AS id FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda d: contains(d, 'e'))) > 0")
def find_by_symbol(spark, sf):
    return rc.defines(gq.code_vertices(spark, sf), "e").select("id")


@query("SELECT DISTINCT s.chunk_id FROM chunks s WHERE s.document_id IN (SELECT document_id FROM documents WHERE doc_kind = 'spec')")
def visible_chunks(spark, sf):
    """Chunks of the documents in a set."""
    members = texts(spark, sf, "documents").filter("doc_kind = 'spec'").select("document_id").distinct()
    return rc.visible(table(spark, sf, "chunks").select("chunk_id", "document_id"), members, "document_id").select("chunk_id").distinct()


@query("SELECT doc_id, list_aggregate(list_distinct(list_transform(list_concat(regexp_extract_all(t, '\\[[^\\]]{0,240}\\]\\((https?://[^)\\s]+)\\)', 1), regexp_extract_all(regexp_replace(t, '\\]\\(https?://[^)\\s]+\\)', '] ', 'g'), 'https?://[^\\s<>\\]\\)\"''`]+')), lambda u: regexp_replace(u, '[.,;:)''\">\\]`]+$', ''))), 'count') AS links FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def document_links(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.size(rc.text_links(F.col("text"))).cast("long").alias("links"))


@query("""WITH b AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda b: trim(b, ' ') <> '') AS b FROM documents), h AS (SELECT doc_id, b, list_filter(b, lambda x: contains(lower(x), 'limit') OR contains(lower(x), 'cookie')) AS h FROM b)
    SELECT doc_id, length(array_to_string(CASE WHEN len(h) > 0 THEN h ELSE b END, chr(10) || chr(10))) AS n_chars FROM h""")
def query_focused_blocks(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", F.length(rc.query_blocks(F.col("text"), ["limit", "cookie"])).cast("long").alias("n_chars"))


@query("""SELECT doc_id, CAST(i - 1 AS INT) AS line_no, name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) CROSS JOIN (VALUES ('raise', 'raise \\w+Error'), ('load', '= load\\(')) p(name, pat) WHERE regexp_matches(line, pat)""")
def pattern_scan(spark, sf):
    return rc.pattern_lines(texts(spark, sf, "documents"), "doc_id", "text", {"raise": r"raise \w+Error", "load": r"= load\("})


@query("SELECT doc_id, CASE WHEN contains(text, 'refused') THEN 'refusal' WHEN contains(text, 'limit') THEN 'limit' ELSE 'other' END AS rule, CASE WHEN contains(text, 'refused') THEN 3 WHEN contains(text, 'limit') THEN 2 END AS severity FROM documents WHERE contains(text, 'refused') OR contains(text, 'limit')")
def policy_matches(spark, sf):
    return rc.policy_hits(texts(spark, sf, "documents"), "doc_id", "text", [("refusal", "refused", 3), ("limit", "limit", 2)])


@query("SELECT doc_id, CASE WHEN contains(doc_kind, 'spec') THEN 'review' WHEN contains(doc_kind, 'log') THEN 'archive' ELSE 'index' END AS step FROM documents")
def routed_documents(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", rc.route(F.coalesce("doc_kind", F.lit("")), [("spec", "review"), ("log", "archive")], "index").alias("step"))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'grounded' WHEN 'click' THEN 'inferred' ELSE 'invented' END AS o FROM events) SELECT user_id, count(*) AS claims, CAST(sum(CASE WHEN o = 'invented' THEN 1 ELSE 0 END) AS BIGINT) AS invented, round(avg(CASE WHEN o = 'invented' THEN 1 ELSE 0 END), 6) AS ratio FROM e GROUP BY 1""")
def provenance_ratios(spark, sf):
    origin = F.when(F.col("event_type") == "view", "grounded").when(F.col("event_type") == "click", "inferred").otherwise("invented")
    return rc.provenance_ratio(table(spark, sf, "events").select("user_id", F.array(origin).alias("evidence")), "user_id")


@query("SELECT event_id, 2 AS version, CASE event_type WHEN 'view' THEN 'screen' WHEN 'error' THEN 'system' ELSE 'text' END AS source, CASE event_type WHEN 'purchase' THEN 'deterministic' ELSE 'model_proposed' END AS trust FROM events")
def upgraded_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.lit(1).alias("version"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("trust"))
    return rc.upgrade_events(e, {"view": "screen", "error": "system"}, {"purchase": "deterministic"}).select("event_id", "version", "source", "trust")


@query("""WITH b AS (SELECT page_id, any_value(title) AS title, any_value(url) AS url FROM crawl_pages GROUP BY 1), g AS (SELECT page_id, url, lower(concat_ws(' ', title, '', url)) AS bag FROM b),
    s AS (SELECT page_id, url, coalesce(list_max(list_transform(regexp_extract_all(bag, '\\b((?:19|20)\\d{2})\\b', 1), lambda y: CAST(y AS INT))), 0) AS year, CAST(contains(bag, 'notes') AS INT) + CAST(contains(bag, 'docs') AS INT) AS found FROM g)
    SELECT page_id, year, found FROM s""")
def ordered_hits(spark, sf):
    p = table(spark, sf, "crawl_pages").groupBy("page_id").agg(F.first("title").alias("title"), F.first("url").alias("url")).withColumn("snippet", F.lit(""))
    return rc.order_hits(p, ["notes", "docs"], False).select("page_id", "year", "found")


@query("SELECT event_id AS item_id, value AS priority FROM events WHERE event_type = 'purchase' ORDER BY value DESC, ts, event_id LIMIT 50")
def work_dequeue(spark, sf):
    q = table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.col("value").alias("priority"), F.col("ts").alias("enqueued_at"), F.when(F.col("event_type") == "purchase", "queued").otherwise("done").alias("status"))
    return rc.dequeue(q, 50).select("item_id", "priority")


@query("""WITH s AS (SELECT a.vec_id AS k, b.vec_id AS o, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, o) AS u, row_number() OVER (PARTITION BY k ORDER BY s, o) AS d FROM s)
    SELECT k, round(greatest(0.0, least(1.0, avg(s) FILTER (u <= 5))), 6) AS idiom, string_agg(CAST(o AS VARCHAR), ',' ORDER BY u) FILTER (u <= 3) AS nearest, string_agg(CAST(o AS VARCHAR), ',' ORDER BY d) FILTER (d <= 3) AS farthest FROM r GROUP BY 1""")
def idiom_scores(spark, sf):
    """Every record whose id is divisible by 20 against the whole corpus, in blocks."""
    e = table(spark, sf, "embeddings")
    scored = vc.against_corpus(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, 3)
    return rc.idiom_scores(scored.withColumnRenamed("key", "k"), "k")


@query("""WITH c AS (SELECT event_type AS slug, count(*) AS n FROM events GROUP BY 1) SELECT q AS query, q AS slug, 1 AS rung FROM (SELECT unnest(['view', 'click']) AS q) WHERE q IN (SELECT slug FROM c) UNION ALL SELECT 'rchas', 'purchase', 4 FROM c WHERE slug = 'purchase'""")
def concept_resolution(spark, sf):
    """Two kinds by their own name, one by a part of it, one that stands for nothing."""
    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("slug")).agg(F.count("*").alias("occurrences")).select("slug", F.col("slug").alias("label"), F.array().cast("array<string>").alias("aliases"), "occurrences")
    return rc.concept_ladder(c, spark.createDataFrame([("view",), ("click",), ("rchas",), ("nothing",)], "query string"))


@query()
def record_identities(spark, sf):
    """Canonical identities of facts (V7, ids)."""
    f = table(spark, sf, "global_facts").select("fact_hash", F.lower("modality").alias("modality"), "fact_text").distinct()
    return f.select("fact_hash", encoding.record_cid(F.col("modality"), F.col("fact_text")).alias("cid"), encoding.blake_id(F.col("fact_text"), 16).alias("blake"))


@query("""WITH RECURSIVE e AS (SELECT src, min(dst) AS dst FROM """ + gq._E + """ GROUP BY 1), r AS (SELECT s AS start, 0 AS depth, s AS id FROM (SELECT unnest([1, 2, 3, 5, 8]) AS s) UNION ALL SELECT start, depth + 1, e.dst FROM r JOIN e ON e.src = r.id WHERE depth < 3) SELECT start, depth, id FROM r""")
def logical_spine(spark, sf):
    calls = gq.edges(spark, sf).select("src", "dst", F.lit(0).alias("position"))
    return rc.spine(calls, spark.createDataFrame([(s,) for s in (1, 2, 3, 5, 8)], "id long"), 3)
