"""Queries over graphs made from the star schema, replicated state and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import crdt, dedup
from loomspan.operators import graph as g
from loomspan.plans import match
from loomspan.plans.registry import query
from loomspan.sources.tables import table, texts

_E = "(SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_returnflag AS kind, CAST(1.0 AS DOUBLE) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
_VX = "(SELECT p_partkey AS id FROM part)"


def edges(spark, sf):
    """Part to part: all consecutive lines of an order."""
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.col("l_returnflag").alias("kind"))
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("src", "dst", "kind", F.lit(1.0).alias("weight"))


def vertices(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


@query(f"""WITH e AS {_E}, d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM {_VX})
    SELECT id, out_degree, in_degree, CASE WHEN in_degree + out_degree > 0 THEN round(in_degree / (in_degree + out_degree), 6) ELSE 0.0 END AS instability, in_degree + out_degree = 0 AS orphan FROM d""")
def graph_degree_instability(spark, sf):
    return g.degrees(vertices(spark, sf), edges(spark, sf))


@query(f"SELECT n AS nodes, m AS edges, round(m / (n * (n - 1)), 6) AS density, round(m / n, 2) AS avg_out_degree FROM (SELECT count(*) AS n FROM part) CROSS JOIN (SELECT count(*) AS m FROM {_E})")
def graph_density(spark, sf):
    return g.density(vertices(spark, sf), edges(spark, sf))


def _pagerank_sql(steps: int = 30) -> str:
    parts = [f"e AS MATERIALIZED {_E}", "o AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY 1)", "w AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / out AS w FROM e JOIN o USING (src))", "r0 AS (SELECT p_partkey AS id, 1.0::DOUBLE / (SELECT count(*) FROM part) AS r FROM part)"]
    for i in range(1, steps + 1):
        parts.append(f"r{i} AS MATERIALIZED (SELECT p.id, coalesce(s, 0.0) * 0.85 + 0.15 / (SELECT count(*) FROM part) AS r FROM r0 p LEFT JOIN (SELECT dst, sum(r * w) AS s FROM w JOIN r{i - 1} ON id = src GROUP BY 1) x ON x.dst = p.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(r, 6) AS rank FROM r{steps}"


@query(_pagerank_sql())
def graph_pagerank(spark, sf):
    return g.pagerank(vertices(spark, sf), edges(spark, sf))


_STARTS = [1, 2, 3, 5, 8]
_REACH = "WITH RECURSIVE e AS (SELECT DISTINCT {f} AS f, {t} AS t FROM " + _E + "), r AS (SELECT s AS start, s AS id, 0 AS distance FROM (SELECT unnest([1, 2, 3, 5, 8]) AS s) UNION SELECT start, e.t, distance + 1 FROM r JOIN e ON e.f = r.id WHERE distance < {d}) SELECT start, id, min(distance)::INT AS distance FROM r GROUP BY 1, 2 HAVING min(distance) > 0"


@query(_REACH.format(f="src", t="dst", d=3))
def graph_forward_reach(spark, sf):
    starts = spark.createDataFrame([(s,) for s in _STARTS], "id long")
    return g.reach(edges(spark, sf), starts, 3)


@query(_REACH.format(f="dst", t="src", d=2))
def graph_bfs_impact(spark, sf):
    starts = spark.createDataFrame([(s,) for s in _STARTS], "id long")
    return g.reach(edges(spark, sf), starts, 2, reverse=True)


def _path_sql(source: int, target: int, hops: int) -> str:
    parts = [f"e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_E})", f"l0 AS (SELECT {source}::BIGINT AS id, [{source}::BIGINT] AS path)", "s0 AS (SELECT id FROM l0)"]
    for i in range(1, hops + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT dst AS id, min(list_append(path, dst)) AS path FROM l{i - 1} JOIN e ON src = id WHERE dst NOT IN (SELECT id FROM s{i - 1}) GROUP BY 1)")
        parts.append(f"s{i} AS MATERIALIZED (SELECT id FROM s{i - 1} UNION SELECT id FROM l{i})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT path, {i} AS hops FROM l{i} WHERE id = {target}" for i in range(hops + 1))


@query(_path_sql(1, 100, 8))
def graph_shortest_path(spark, sf):
    return g.shortest_path(edges(spark, sf), 1, 100, hops=8)


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM {_E}), nb AS (SELECT src AS id, dst AS n FROM e UNION SELECT dst, src FROM e), k AS (SELECT id, count(*) AS k FROM nb GROUP BY 1),
    c AS (SELECT a.id, count(*) AS c FROM nb a JOIN nb b ON a.id = b.id AND a.n <> b.n JOIN e ON e.src = a.n AND e.dst = b.n GROUP BY 1)
    SELECT v.id, CASE WHEN k >= 2 THEN round(coalesce(c, 0) / (k * (k - 1)), 6) ELSE 0.0 END AS clustering FROM {_VX} v LEFT JOIN k USING (id) LEFT JOIN c USING (id)""")
def graph_clustering(spark, sf):
    return g.clustering(vertices(spark, sf), edges(spark, sf))


def _between_sql(levels: int) -> str:
    """Brandes' sums by levels: shortest path counts outwards, shares of them back."""
    parts = [f"e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS m FROM {_E} GROUP BY 1, 2)", "g0 AS MATERIALIZED (SELECT p_partkey AS s, p_partkey AS id, 1.0::DOUBLE AS sigma FROM part)", "a0 AS MATERIALIZED (SELECT s, id FROM g0)"]
    for i in range(1, levels + 1):
        parts.append(f"g{i} AS MATERIALIZED (SELECT s, dst AS id, sum(sigma * m) AS sigma FROM g{i - 1} JOIN e ON src = id WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.s = g{i - 1}.s AND a.id = dst) GROUP BY 1, 2)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT s, id FROM a{i - 1} UNION ALL SELECT s, id FROM g{i})")
    parts.append(f"d{levels} AS MATERIALIZED (SELECT s, id, 0.0::DOUBLE AS delta FROM g{levels})")
    for i in range(levels - 1, -1, -1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT u.s, u.id, coalesce(sum(m * u.sigma / w.sigma * (1 + delta)), 0.0) AS delta FROM g{i} u LEFT JOIN (SELECT src, dst, m, g.s, g.sigma, d.delta FROM e JOIN g{i + 1} g ON g.id = dst JOIN d{i + 1} d ON d.s = g.s AND d.id = g.id) w ON w.src = u.id AND w.s = u.s GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT id, delta FROM d{i} WHERE s <> id" for i in range(1, levels + 1))
    return f"WITH {', '.join(parts)}, t AS (SELECT id, sum(delta) AS b FROM ({every}) GROUP BY 1) SELECT p_partkey AS id, round(coalesce(b, 0.0) / (((SELECT count(*) FROM part) - 1) * ((SELECT count(*) FROM part) - 2)), 6) AS betweenness FROM part LEFT JOIN t ON t.id = p_partkey"


@query(_between_sql(8))
def graph_betweenness(spark, sf):
    """Every vertex is a source, as in the reference feature without a sample."""
    return g.betweenness(vertices(spark, sf), edges(spark, sf))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {_E}), r AS (SELECT id AS a, id AS b FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def graph_strong_components(spark, sf):
    return g.components(edges(spark, sf), directed=True)


WEIGHTS = {"R": 1.0, "A": 0.6, "N": 0.3}


@query()
def tensor_rank_delta(spark, sf):
    links = edges(spark, sf).withColumnRenamed("kind", "relation").withColumn("confidence", F.lit(1.0))
    v = vertices(spark, sf)
    t = g.tensor_edges(links, WEIGHTS)
    c = g.centralities(t, v, [WEIGHTS, dict.fromkeys(WEIGHTS, 1.0)])
    return g.rank_delta(*(c.select("id", F.col(x).alias("centrality")) for x in ("c0", "c1")))


def code_vertices(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_type", " ")[0].alias("kind"), F.split("p_name", " ").alias("defines"))


_CODE = "(SELECT p_partkey AS id, string_split(p_type, ' ')[1] AS kind, string_split(p_name, ' ') AS defines FROM part)"


@query(f"""SELECT DISTINCT a_kind, b_kind, r_kind FROM (SELECT a.kind AS a_kind, b.kind AS b_kind, e.kind AS r_kind FROM {_E} e JOIN {_CODE} a ON a.id = e.src JOIN {_CODE} b ON b.id = e.dst
    WHERE e.kind = 'R' AND a.kind <> 'none' ORDER BY a.id, b.id, e.kind LIMIT 1000)""")
def match_edges(spark, sf):
    """The language's own limit of 1,000 rows holds, as for any query without one."""
    return match.run("MATCH (a)-[r:r]->(b) WHERE a.kind != 'none' RETURN DISTINCT a.kind, b.kind, r.kind", code_vertices(spark, sf), edges(spark, sf))


@query(f"SELECT n_id, n_kind, CAST(NULL AS VARCHAR) AS n_pagerank FROM (SELECT id AS n_id, kind AS n_kind FROM {_CODE} WHERE len(list_filter(defines, lambda d: contains(d, 'a'))) > 0 AND kind <> 'none' ORDER BY id LIMIT 1000)")
def match_vertices(spark, sf):
    return match.run("MATCH (n) WHERE n.defines CONTAINS 'a' AND n.kind != 'none' RETURN n.id, n.kind, n.pagerank", code_vertices(spark, sf), edges(spark, sf))


@query(f"""WITH d AS (SELECT DISTINCT a.kind AS src_kind, e.kind, b.kind AS dst_kind, src, dst FROM {_E} e JOIN {_CODE} a ON a.id = e.src JOIN {_CODE} b ON b.id = e.dst), c AS (SELECT src_kind, kind, dst_kind, count(*) AS edges, count(*) / count(DISTINCT src) AS s, count(*) / count(DISTINCT dst) AS t FROM d GROUP BY 1, 2, 3)
    SELECT src_kind, kind, dst_kind, edges, CASE WHEN s > 1.1 AND t > 1.1 THEN 'N:M' WHEN s > 1.1 THEN '1:N' WHEN t > 1.1 THEN 'N:1' ELSE '1:1' END AS cardinality FROM c""")
def schema_infer_cardinality(spark, sf):
    return g.schema_of(edges(spark, sf), code_vertices(spark, sf))


def _tagged(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("elem"), F.col("event_id").alias("seq"))


@query("""WITH t AS (SELECT user_id AS key, event_type AS kind, json_extract_string(props, '$.k') AS elem FROM events), a AS (SELECT DISTINCT key, elem, CASE WHEN kind = 'purchase' THEN 'p' ELSE 'v' END AS tag FROM t WHERE kind IN ('purchase', 'view')), r AS (SELECT DISTINCT key, elem, 'v' AS tag FROM t WHERE kind = 'error')
    SELECT DISTINCT key, elem FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.key = a.key AND r.elem = a.elem AND r.tag = a.tag)""")
def crdt_orset_value(spark, sf):
    """Views add with tag v, purchases with tag p; an error removes what it saw, the v tags."""
    t = _tagged(spark, sf)
    adds = t.filter(F.col("kind").isin("purchase", "view")).select("key", "elem", F.when(F.col("kind") == "purchase", "p").otherwise("v").alias("tag"))
    removes = t.filter("kind = 'error'").select("key", "elem", F.lit("v").alias("tag"))
    return crdt.orset_value(adds, removes, ["key", "elem"])


@query("SELECT user_id AS key, arg_max(event_type, (seq, event_type)) AS value, max(seq) AS seq FROM (SELECT user_id, event_type, epoch_us(ts) // 3600000000 AS seq FROM events) GROUP BY 1")
def crdt_lww(spark, sf):
    """Registers written by the hour; writes of one hour are settled by their head."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("long")
    s = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_type").alias("head"), hour.alias("seq"))
    return crdt.lww(s, ["key"]).select("key", "value", "seq")


@query("SELECT DISTINCT key FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT user_id FROM events)")
def crdt_gset(spark, sf):
    return crdt.gset(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf, "events").select(F.col("user_id").alias("key")))


@query("""WITH f AS (SELECT event_type AS kind, 'user-' || user_id AS target, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 7 AS VARCHAR) AS evidence, round(value, 2) AS severity, CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS confidence, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS source FROM events),
    g AS (SELECT kind, target, evidence, max(severity) AS severity, max(confidence) AS confidence, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT 's' || source)), ',') AS tags FROM f GROUP BY 1, 2, 3)
    SELECT substr(sha256(kind || '|' || target || '|' || evidence), 1, 16) AS finding_id, kind, target, severity, confidence, sources, tags, round(severity * confidence * (1 + least(0.5, 0.1 * (sources - 1))), 6) AS score FROM g""")
def reducer_rank(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    f = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("user-"), F.col("user_id")).alias("target"), F.array((k % 7).cast("string")).alias("evidence"), F.round("value", 2).alias("severity"), (k / 100.0).alias("confidence"), (k % 3).alias("source"))
    return crdt.reduce_findings(f.withColumn("tags", F.array(F.concat(F.lit("s"), F.col("source")))))


@query("SELECT 'cid-' || substr(sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), ' ')), 1, 32) AS cid, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def exact_dup_docs(spark, sf):
    return dedup.exact(texts(spark, sf, "documents"), "doc_id")


@query()
def near_dup_simhash(spark, sf):
    return dedup.near_by_simhash(texts(spark, sf, "documents").filter("text is not null"), "doc_id")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY canonical_url, sha256(coalesce(text, '')) ORDER BY fetched_at, page_id) AS n FROM crawl_pages) WHERE n = 1")
def crawl_document_dedup(spark, sf):
    return dedup.crawl_documents(table(spark, sf, "crawl_pages"), "canonical_url", "text", ["fetched_at", "page_id"]).select("page_id")


@query("SELECT fact_hash, count(*) AS seen, arg_min(fact_text, (coalesce(last_seen, 0), seen_count IS NULL, coalesce(seen_count, 0), fact_text)) AS fact_text, max(last_seen) AS last_seen FROM global_facts GROUP BY 1")
def counting_upsert(spark, sf):
    """Repeated facts counted, the text of the first kept."""
    order = F.struct(F.coalesce("last_seen", F.lit(0.0)), F.col("seen_count").isNull(), F.coalesce("seen_count", F.lit(0)), F.col("fact_text"))
    return table(spark, sf, "global_facts").groupBy("fact_hash").agg(F.count("*").alias("seen"), F.min_by("fact_text", order).alias("fact_text"), F.max("last_seen").alias("last_seen"))


@query("""SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS orders, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""")
def double_join_flows(spark, sf):
    """Edges joined with both of their ends (J3) at the level of nations."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("r"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    cn = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"))
    sn = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cn, F.col("o_custkey") == F.col("c_custkey")).join(sn, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.sum("r").cast("double").alias("revenue"))


@query("SELECT c.chunk_id, c.document_id, v.cid FROM (SELECT DISTINCT chunk_id, document_id FROM chunks) c LEFT JOIN (SELECT source_cid, min(cid) AS cid FROM vector_records GROUP BY 1) v ON v.source_cid = c.chunk_id")
def chunks_with_vectors(spark, sf):
    """Chunks with their stored vector, null where one has to be made."""
    v = table(spark, sf, "vector_records").groupBy(F.col("source_cid").alias("chunk_id")).agg(F.min("cid").alias("cid"))
    return table(spark, sf, "chunks").select("chunk_id", "document_id").distinct().join(v, "chunk_id", "left")


@query("SELECT modality, space_id, count(*) AS n, count(DISTINCT dim) AS dims, count(DISTINCT dim) > 2 AS ambiguous, max(dim) AS most FROM vector_records GROUP BY 1, 2")
def vector_space_summary(spark, sf):
    r = table(spark, sf, "vector_records")
    return r.groupBy("modality", "space_id").agg(F.count("*").alias("n"), F.countDistinct("dim").alias("dims"), (F.countDistinct("dim") > 2).alias("ambiguous"), F.max("dim").alias("most"))


