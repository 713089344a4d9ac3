"""Queries over the small scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.columns import beside

from loomspan.operators import graph as g
from loomspan.operators import scoring as sc
from loomspan.operators import text as tx
from loomspan.plans import graph_queries as gq
from loomspan.plans.registry import query
from loomspan.session import cut
from loomspan.sources.tables import table, texts


@query("""WITH n AS (SELECT page_id, any_value(title) AS title, any_value(host) AS host FROM crawl_pages GROUP BY 1), t AS (SELECT page_id, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(host, '')), '[a-z0-9]+') AS b FROM n)
    SELECT page_id, round((3 * len(list_intersect(['notes', 'docs', 'limits'], a)) + len(list_intersect(['notes', 'docs', 'limits'], b))) / 3, 6) AS score FROM t""")
def page_overlap_score(spark, sf):
    p = table(spark, sf, "crawl_pages").groupBy("page_id").agg(F.first("title").alias("title"), F.first("host").alias("host"))
    return p.select("page_id", sc.overlap_score(["notes", "docs", "limits"], tx.tokens(F.col("title")), tx.tokens(F.col("host"))).alias("score"))



@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: round(abs(x)::DOUBLE, 4)) AS s FROM embeddings), e AS (SELECT vec_id, s, list_transform(s, lambda x: exp((x - list_max(s)) / 0.05)) AS e FROM v)
    SELECT vec_id, round(list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2], 6) AS decisive, CASE WHEN list_min(s) <= 0 THEN 0.0 ELSE round(exp(list_avg(list_transform(s, lambda x: ln(x)))), 6) END AS geometric, round(list_max(e) / list_sum(e), 6) AS top_share FROM e""")
def score_shapes(spark, sf):
    """Decisiveness, geometric mean and softmax share of four scores per record."""
    s = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(F.abs(x.cast("double")), 4))
    v = table(spark, sf, "embeddings").select("vec_id", s.alias("s"))
    return v.select("vec_id", F.round(sc.decisiveness(F.col("s")), 6).alias("decisive"), F.round(sc.geometric_mean(F.col("s")), 6).alias("geometric"), F.round(F.array_max(sc.softmax(F.col("s"))), 6).alias("top_share"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c), q AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS q FROM events GROUP BY 1)
    SELECT user_id, round(sum(p * log2(p / q)), 6) AS bits FROM p JOIN q USING (event_type) GROUP BY 1""")
def event_mix_divergence(spark, sf):
    """How far a user's mix of events is from everyone's."""
    e = table(spark, sf, "events")
    n = e.groupBy("user_id", F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))
    totals = n.groupBy("user_id").agg(F.sum("n").alias("t"))
    p = n.join(totals, "user_id").select("user_id", "outcome", (F.col("n") / F.col("t")).alias("p"))
    every = e.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))
    share = every.transform(beside, e.agg(F.count("*").alias("t"))).select("outcome", (F.col("n") / F.col("t")).alias("p"))
    q = p.select("user_id", "outcome").join(share, "outcome").select("user_id", "outcome", "p")
    return sc.divergence(p, q, ["user_id"])


@query("""SELECT supplier, round(greatest(0.0, least(1.0, base + 0.2 * reach + CASE WHEN nation = 0 THEN 0.1 ELSE 0.0 END - least(0.2, 0.1 * d))), 6) AS risk,
    CASE WHEN round(greatest(0.0, least(1.0, base + 0.2 * reach + CASE WHEN nation = 0 THEN 0.1 ELSE 0.0 END - least(0.2, 0.1 * d))), 6) >= 0.9 THEN 'critical' WHEN round(greatest(0.0, least(1.0, base + 0.2 * reach + CASE WHEN nation = 0 THEN 0.1 ELSE 0.0 END - least(0.2, 0.1 * d))), 6) >= 0.7 THEN 'high' WHEN round(greatest(0.0, least(1.0, base + 0.2 * reach + CASE WHEN nation = 0 THEN 0.1 ELSE 0.0 END - least(0.2, 0.1 * d))), 6) >= 0.4 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT s_suppkey AS supplier, s_nationkey AS nation, (s_suppkey % 10) / 10.0 AS base, ((s_suppkey * 7) % 10) / 10.0 AS reach, s_suppkey % 4 AS d FROM supplier)""")
def composite_risks(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    r = sc.composite_risk((key % 10) / 10.0, ((key * 7) % 10) / 10.0, F.when(F.col("s_nationkey") == 0, 0.1).otherwise(0.0), key % 4)
    return s.select(key.alias("supplier"), r.alias("risk")).select("supplier", "risk", sc.severity(F.col("risk")).alias("severity"))


@query("SELECT doc_id, list_has_any(['limit', 'threshold', 'cookie'], regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS related FROM documents")
def relatedness_gate(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", sc.related(["limit", "threshold", "cookie", "of"], tx.tokens(F.col("text"))).alias("related"))


@query("SELECT prefix, count(*) AS members FROM (SELECT DISTINCT string_split(t, '_')[1] AS prefix, t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+_[a-z0-9_]+')) AS t FROM documents)) GROUP BY 1 HAVING count(*) >= 2")
def symbol_clusters(spark, sf):
    t = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+_[a-z0-9_]+"), F.lit(0))).alias("t")
    return sc.prefix_clusters(texts(spark, sf, "documents").select(t), "t")


@query("""WITH m AS (SELECT doc_id, kind, node, min(i) AS pos FROM (SELECT doc_id, substr(t, 1, 3) AS kind, t AS node, i FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:run|cfg)_[0-9a-f]{5}') AS x FROM documents))) GROUP BY 1, 2, 3)
    SELECT a.node AS src, b.node AS dst, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.kind <> b.kind AND a.pos < b.pos GROUP BY 1, 2""")
def entity_cooccurrence_edges(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"(?:run|cfg)_[0-9a-f]{5}"), F.lit(0))
    m = texts(spark, sf, "documents").select("doc_id", F.posexplode(found).alias("at", "node")).withColumn("kind", F.substring("node", 1, 3))
    return sc.cooccurrence(m, "doc_id", "at", "kind", "node")


@query("""WITH a AS (SELECT url, 'documents' AS arm FROM documents WHERE url <> '' UNION ALL SELECT url, 'pages' FROM crawl_pages WHERE url <> '' UNION ALL SELECT canonical_url, 'canonical' FROM crawl_pages WHERE canonical_url <> '')
    SELECT regexp_replace(regexp_replace(url, '\\?.*$', ''), '/+$', '') AS key, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms, count(*) AS hits FROM a GROUP BY 1""")
def merged_arms(spark, sf):
    d, p = texts(spark, sf, "documents"), table(spark, sf, "crawl_pages")
    return sc.merge_arms({"documents": d.select("url").filter("url <> ''"), "pages": p.select("url").filter("url <> ''"), "canonical": p.select(F.col("canonical_url").alias("url")).filter("url <> ''")})


@query("""WITH g AS (SELECT user_id, event_type = 'view' AS f, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n FROM g WHERE f GROUP BY 1, 2)
    SELECT u.user_id, coalesce(max(n), 0) AS streak FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1""")
def event_streaks(spark, sf):
    e = table(spark, sf, "events").withColumn("f", F.col("event_type") == "view")
    return sc.islands(e, ["user_id"], "event_id", "f")


@query("""WITH t AS (SELECT id, any_value(domain) AS domain, lower(coalesce(any_value(source_text), '')) AS low FROM translation_feedback GROUP BY 1), c AS (SELECT domain, CASE WHEN contains(low, 'refused') OR contains(low, 'lost') THEN 'recovery' WHEN contains(low, 'rebuilt') OR contains(low, 'merge') THEN 'invention' ELSE 'noise' END AS class, sum(CASE WHEN starts_with(low, '/') THEN 0.3 ELSE 1.0 END) AS w FROM t GROUP BY 1, 2)
    SELECT domain, class, CAST(round(w / sum(w) OVER (PARTITION BY domain), 6) AS DOUBLE) AS share FROM c""")
def work_mix_meter(spark, sf):
    t = table(spark, sf, "translation_feedback").groupBy("id").agg(F.first("domain").alias("domain"), F.first("source_text").alias("text"))
    return sc.work_mix(t, ["domain"], "text", {"recovery": ["refused", "lost"], "invention": ["rebuilt", "merge"]}, "noise")


@query("""SELECT user_id AS tx, CASE WHEN bool_or(event_type = 'error') THEN 'superseded' WHEN bool_or(event_type = 'signup') THEN 'abandoned' WHEN bool_or(event_type = 'purchase') THEN 'committed' ELSE 'pending' END AS status FROM (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS user_id, event_type FROM events) GROUP BY 1""")
def transaction_status(spark, sf):
    op = F.create_map(*(F.lit(x) for x in ("error", "supersede", "signup", "abandon", "purchase", "commit", "view", "propose", "click", "propose")))
    e = table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("tx"), F.element_at(op, F.col("event_type")).alias("op"))
    return sc.next_state(e, "tx")


@query("SELECT user_id, round(least(60.0, 0.5 * pow(2, least(count(*) FILTER (event_type = 'error'), 6))) + (user_id % 125) / 1000.0, 6) AS wait FROM events GROUP BY 1")
def backoff_times(spark, sf):
    n = F.count_if(F.col("event_type") == "error")
    e = table(spark, sf, "events").groupBy("user_id").agg(n.alias("errors"))
    return e.select("user_id", F.round(sc.backoff(F.col("errors"), 0.5, F.col("user_id")), 6).alias("wait"))


@query("""WITH p AS (SELECT page_id, any_value(url) AS url, any_value(depth) AS depth, any_value(links) AS links FROM crawl_pages GROUP BY 1), f AS (SELECT l.url AS url, min(depth + 1) AS depth FROM (SELECT depth, unnest(links) AS l FROM p) WHERE l.url IS NOT NULL AND depth + 1 <= 3 GROUP BY 1)
    SELECT url, depth FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.url = f.url)""")
def next_frontier(spark, sf):
    p = table(spark, sf, "crawl_pages").groupBy("page_id").agg(F.first("url").alias("url"), F.first("depth").alias("depth"), F.first("links").alias("links"))
    found = p.select((F.col("depth") + 1).alias("depth"), F.explode("links.url").alias("url")).filter("url is not null")
    return sc.fold_frontier(p, found, 3)


_REACHED = gq._REACH.format(f="dst", t="src", d=3)


@query(f"""WITH b AS ({gq._between_sql(8)}), p AS ({gq._pagerank_sql()}), i AS ({_REACHED})
    SELECT id, round(max(pow(distance + 1, -1.5) * (1 + 5 * betweenness) * (1 + 10 * rank)), 6) AS score FROM i JOIN b USING (id) JOIN p USING (id) GROUP BY 1""")
def change_propagation(spark, sf):
    """Impact of changes to five parts within three steps."""
    # The join that makes the edges is run once, not in each step and measure.
    v, e = gq.vertices(spark, sf), cut(gq.edges(spark, sf).select("src", "dst"))
    starts = spark.createDataFrame([(s,) for s in (1, 2, 3, 5, 8)], "id long")
    impacted = g.reach(e, starts, 3, reverse=True).select("id", "distance")
    return sc.propagation(impacted, g.betweenness(v, e), g.pagerank(v, e))


@query("""WITH w AS (SELECT o_custkey AS node, l_suppkey AS other, sum(l_quantity) / 100.0 AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT node, other, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS place FROM w WHERE weight > 0.2) WHERE place <= 5""")
def activation_map(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    w = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("node"), F.col("l_suppkey").alias("other")).agg((F.sum("l_quantity") / 100.0).alias("weight"))
    return sc.activation(w, "node", "other", "weight").select("node", "other", "place")


@query(f"""WITH e AS {gq._E}, d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS o, (SELECT count(*) FROM e WHERE dst = id) AS i FROM {gq._VX}), m AS (SELECT avg(o + i) AS mean FROM d)
    SELECT id, pattern FROM (SELECT id, CASE WHEN o + i = 0 THEN 'orphan' WHEN o + i > 3 * mean THEN 'hub' WHEN round(i / (o + i), 6) > 0.8 AND i >= 3 THEN 'unstable' END AS pattern FROM d CROSS JOIN m) WHERE pattern IS NOT NULL""")
def graph_patterns(spark, sf):
    return sc.patterns(g.degrees(gq.vertices(spark, sf), gq.edges(spark, sf)))
