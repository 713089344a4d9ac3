"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import mixing, near_dup, packing, pair_defects, spans, splitting, style_tree, tokens, vp_knn
from loomspan.session import cut
from loomspan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]



def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return vp_knn.similar_pairs(table(spark, sf, "vector_records"), k=10, min_similarity=0.85)


def p1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The lists themselves: the 10 nearest of every usable record, however far they are."""
    lists = vp_knn.neighbour_lists(table(spark, sf, "vector_records"), k=10, min_similarity=None)
    return lists.select("space_id", "cid", F.posexplode("neighbours").alias("place", "n")).select("space_id", "cid", (F.col("place") + 1).alias("place"), F.col("n.cid").alias("near_cid"), F.col("n.cosine").alias("cosine"))


P2_TABLES = ["chunks", "global_facts"]


def _p2_records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select(F.lit(0).alias("kind"), F.col("chunk_id").alias("id"), "text")
    facts = table(spark, sf, "global_facts").select(F.lit(1).alias("kind"), F.col("fact_hash").alias("id"), F.col("fact_text").alias("text"))
    return chunks.union(facts)


def _p2_name():
    return F.element_at(F.array(*map(F.lit, P2_TABLES)), F.col("kind") + 1).alias("table_name")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.similar_pairs(_p2_records(spark, sf), threshold=0.8).select(_p2_name(), "id_a", "id_b")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.duplicate_classes(_p2_records(spark, sf), threshold=0.8).select(_p2_name(), "id", "class_id", "links")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.places(table(spark, sf, "chunks"), limit=2400)


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(table(spark, sf, "chunks"), limit=2400, overlap=200)


def p3_documents(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.chunk_counts(table(spark, sf, "documents"), p3_pieces(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "translation_feedback").select("id", F.col("source_text").alias("source"), F.col("model_output").alias("output"), F.col("target_lang").alias("target"))
    return pair_defects.find(rows, sample_rows=4000)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "crawl_pages").select("page_id", "host", "title", "text", "links", F.col("http.status").alias("status"))
    return style_tree.main_lines(pages)


def _sized(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """doc_id, source family, n_tokens of every document."""
    docs = table(spark, sf, "documents").select("doc_id", tokens.family().alias("source"), *(F.expr(m) for m in more), "text")
    return tokens.with_sizes(docs)


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_sized(spark, sf), capacity=2048)


def _p7_targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets").withColumn("source", tokens.family())


def p7_select(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf, "sha2(text, 256) AS same"), _p7_targets(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p7_select(spark, sf), _p7_targets(spark, sf))


def _p8_records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.sharing_pairs(_p8_records(spark, sf), length=200).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(_p8_records(spark, sf), length=200).withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return spans.share_report(_p8_records(spark, sf), length=200).withColumnRenamed("id", "doc_id")


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pieces of each oversized chunk cover it, stay under the limit and overlap."""
    p = splitting.split(table(spark, sf, "chunks"), limit=2400, overlap=200)
    w = Window.partitionBy("document_id", "parent_id").orderBy("piece")
    p = p.withColumn("gap", F.col("span_start") - F.lag("span_end").over(w)).withColumn("size", F.col("span_end") - F.col("span_start"))
    g = p.groupBy("document_id", F.col("parent_id").alias("chunk_id")).agg(F.count("*").alias("n"), F.max("span_end").cast("long").alias("n_chars"), (F.min("span_start") == 0).alias("from_start"), (F.max("size") <= 2400).alias("fits"), (F.max("gap") < 0).alias("overlaps"), (F.min("gap") >= -400).alias("moderate"))
    return g.filter("n > 1").drop("n")


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every document's tokens are packed once and no container is over its capacity."""
    sized = cut(_sized(spark, sf))
    packed = cut(packing.pack(sized, capacity=2048))
    packed = packed.withColumn("tokens", F.col("token_end") - F.col("token_start"))
    per = packed.groupBy("doc_id").agg(F.sum("tokens").alias("packed"), F.count("*").alias("pieces"))
    docs = sized.filter("n_tokens > 0").join(per, "doc_id", "full").agg(F.count("*").alias("documents"), F.count_if(~F.col("packed").eqNullSafe(F.col("n_tokens"))).alias("wrong"), F.count_if((F.col("n_tokens") <= 2048) & (F.col("pieces") > 1)).alias("divided"))
    over = packed.groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("over"))
    return docs.select("documents", "wrong", "divided", over.scalar().alias("over"))


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    """source, share of all tokens, and the mean and largest distance of a container's share from it."""
    sized = cut(_sized(spark, sf))
    return packing.share_deviation(packing.pack(sized, capacity=2048), sized)


def p7_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose texts are used more often than they may be: none."""
    same = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("same")).distinct()
    used = p7_select(spark, sf).join(same, "doc_id").groupBy("source", "same").agg(F.sum("copies").alias("copies"))
    most = _p7_targets(spark, sf).select("source", "max_repeats")
    return used.join(most, "source", "left").groupBy().agg(F.count_if(F.col("max_repeats").isNull() | (F.col("copies") > F.col("max_repeats"))).alias("over"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p2_classes": p2_classes,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p3_documents": p3_documents,
        "p3_coverage": p3_coverage,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p6_pack": p6_pack,
        "p6_totals": p6_totals,
        "p6_shares": p6_shares,
        "p7_select": p7_select,
        "p7_shares": p7_shares,
        "p7_limits": p7_limits,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p8_report": p8_report,
    }


P1_SQL = """WITH u AS (SELECT space_id, cid, min(e) AS e FROM (SELECT space_id, cid, embedding::DOUBLE[] AS e FROM vector_records WHERE cid IS NOT NULL AND space_id IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY 1, 2),
    s AS (SELECT a.space_id, a.cid AS x, b.cid AS y, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.space_id = b.space_id AND a.cid <> b.cid),
    r AS (SELECT x, y, c, row_number() OVER (PARTITION BY space_id, x ORDER BY round(c, 6) DESC, y) AS n FROM s)
    SELECT DISTINCT least(x, y) AS cid_a, greatest(x, y) AS cid_b FROM r WHERE n <= 10 AND c >= 0.85"""

P2_SQL = """WITH t AS (SELECT 'chunks' AS table_name, chunk_id AS id, text FROM chunks UNION ALL SELECT 'global_facts', fact_hash, fact_text FROM global_facts),
    d AS (SELECT DISTINCT table_name, id, list_sort(list_distinct(regexp_extract_all(nfc_normalize(lower(text)), '[\\p{L}\\p{N}]+'))) AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
    k AS (SELECT *, row_number() OVER () AS k, len(w) AS n FROM d WHERE len(w) > 0), p AS (SELECT k, table_name, n, unnest(w) AS x FROM k),
    c AS (SELECT a.k AS ka, b.k AS kb, count(*) AS m FROM p a JOIN p b ON a.table_name = b.table_name AND a.x = b.x AND a.k < b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY 1, 2)
    SELECT DISTINCT a.table_name, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM c JOIN k a ON a.k = ka JOIN k b ON b.k = kb WHERE a.id <> b.id AND m >= 0.8 * (a.n + b.n - m) - 1e-9"""

_WINDOWS = "SELECT doc_id, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)"

P8_SQL = f"""WITH g AS (SELECT DISTINCT doc_id, h FROM ({_WINDOWS})), m AS (SELECT list_sort(list(doc_id)) AS ids FROM g GROUP BY h HAVING count(*) > 1), u AS (SELECT DISTINCT ids FROM m)
    SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM (SELECT unnest(ids) AS a, ids FROM u), LATERAL (SELECT unnest(ids) AS b) WHERE a < b"""

P8_REPORT_SQL = f"""WITH g AS MATERIALIZED ({_WINDOWS}), r AS (SELECT h FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g SEMI JOIN r USING (h)),
    s AS (SELECT doc_id, count(*) FILTER (before IS NULL OR i > before + 200) AS n_spans, CAST(sum(least(200, i - coalesce(before, i - 200))) AS BIGINT) AS shared_chars FROM p GROUP BY 1)
    SELECT doc_id, n, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN n > 0 THEN round(coalesce(shared_chars, 0) / n, 6) ELSE 0.0 END AS shared_fraction FROM (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents) LEFT JOIN s USING (doc_id)"""


P8_SPANS_SQL = """WITH t AS (SELECT DISTINCT md5_number(text) AS c, text FROM documents WHERE length(text) >= 200), w AS MATERIALIZED (SELECT c, i, md5_number(substr(text, i, 200)) AS h FROM (SELECT c, text, unnest(range(1, length(text) - 198)) AS i FROM t)),
    r AS (SELECT h, count(DISTINCT c) - 1 AS n FROM w GROUP BY 1 HAVING count(DISTINCT c) > 1), p AS (SELECT c, i, n, lag(i) OVER (PARTITION BY c ORDER BY i) AS before FROM w JOIN r USING (h)), g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS island FROM p),
    s AS (SELECT c, min(i) - 1 AS span_start, max(i) + 199 AS span_end, max(n) AS partners FROM g GROUP BY c, island), m AS (SELECT DISTINCT doc_id, md5_number(text) AS c, length(text) AS n FROM documents WHERE length(text) >= 200), k AS (SELECT c, count(*) AS k FROM m GROUP BY 1)
    SELECT doc_id, span_start, span_end, partners FROM m JOIN k USING (c) JOIN s USING (c) WHERE k = 1 UNION ALL SELECT doc_id, 0, n, greatest(k - 1, coalesce((SELECT max(partners) FROM s WHERE s.c = m.c), 0)) FROM m JOIN k USING (c) WHERE k > 1"""

P2_CLASSES_SQL = """WITH RECURSIVE t AS (SELECT 'chunks' AS table_name, chunk_id AS id, text FROM chunks UNION ALL SELECT 'global_facts', fact_hash, fact_text FROM global_facts),
    d AS (SELECT DISTINCT table_name, id, list_sort(list_distinct(regexp_extract_all(nfc_normalize(lower(text)), '[\\p{L}\\p{N}]+'))) AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
    s AS MATERIALIZED (SELECT table_name, w, len(w) AS n, row_number() OVER () AS k FROM (SELECT DISTINCT table_name, w FROM d WHERE len(w) > 0)), p AS (SELECT k, table_name, n, unnest(w) AS x FROM s),
    c AS (SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS m FROM p a JOIN p b ON a.table_name = b.table_name AND a.x = b.x AND a.k <> b.k AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL), near AS MATERIALIZED (SELECT ka, kb FROM c WHERE m >= 0.8 * (na + nb - m) - 1e-9),
    m AS MATERIALIZED (SELECT table_name, id, k FROM d JOIN s USING (table_name, w)), f AS (SELECT k, min(id) AS first FROM m GROUP BY 1), r AS (SELECT k AS a, k AS b FROM s UNION SELECT r.a, kb FROM r JOIN near ON ka = r.b),
    g AS (SELECT a AS k, min(first) AS class_id FROM r JOIN f ON f.k = r.b GROUP BY 1), l AS (SELECT ka AS k, count(*) AS links FROM near GROUP BY 1)
    SELECT DISTINCT table_name, id, class_id, coalesce(links, 0) AS links FROM m JOIN g USING (k) LEFT JOIN l USING (k)"""


def oracle_sql() -> dict[str, str]:
    """Brute force over all pairs or windows; queries without an entry are tested in ``tests/llm``."""
    return {
        "p1_found": P1_SQL,
        "p2_found": P2_SQL,
        "p2_classes": P2_CLASSES_SQL,
        "p3_coverage": "SELECT document_id, chunk_id, max(length(text)) AS n_chars, true AS from_start, true AS fits, true AS overlaps, true AS moderate FROM chunks WHERE length(text) > 2400 GROUP BY 1, 2",
        "p6_totals": "SELECT count(DISTINCT doc_id) FILTER (text <> '') AS documents, 0 AS wrong, 0 AS divided, 0 AS over FROM documents",
        "p7_limits": "SELECT 0 AS over",
        "p8_found": P8_SQL,
        "p8_spans": P8_SPANS_SQL,
        "p8_report": P8_REPORT_SQL.replace("doc_id, n, ", "doc_id, n AS n_chars, ", 1),
    }
