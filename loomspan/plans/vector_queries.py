"""Queries over vectors, postings and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from loomspan.functions import fixed
from loomspan.operators import lexical as lx
from loomspan.operators import text as tx
from loomspan.operators import vectors as vc
from loomspan.plans.registry import in_list, q, query
from loomspan.sources.tables import table, texts

QUERY_VECTOR = [round(((i * 37) % 23 - 11) / 11, 4) for i in range(64)]
QUERY_TEXT = "the limit of the threshold applies before the transfer is submitted"
QUERIES = {"limits": "limit applies", "cookies": "cookie privacy settings", "crawl": "crawl left pages", "merge": "merge conflicts resolved", "reviewer": "reviewer asked why"}
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_cos = lambda a, b: f"list_cosine_similarity({a}::DOUBLE[], {b})"


def embeddings(spark, sf):
    return table(spark, sf, "embeddings")


def documents(spark, sf):
    return texts(spark, sf, "documents")


@query(f"SELECT vec_id, round({_cos('embedding', _V)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_cosine_topk(spark, sf):
    return vc.top_k(embeddings(spark, sf), "vec_id", "embedding", QUERY_VECTOR, 20)


@query(f"""SELECT cid, round({_cos('embedding', _V)}, 6) AS score FROM (SELECT cid, any_value(embedding) AS embedding FROM vector_records WHERE space_id = 'text-local-v1' AND len(embedding) = dim AND tenant IN ('world', 'tenant-a') AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY 1) ORDER BY score DESC, cid LIMIT 25""")
def tenant_world_scope(spark, sf):
    """Own and world records of one space, ranked (F5, U1, R7); null tenants are not visible."""
    r = table(spark, sf, "vector_records").filter((F.col("space_id") == "text-local-v1") & F.col("tenant").isin("world", "tenant-a") & (F.size("embedding") == F.col("dim")))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vc.top_k(r.filter(usable).dropDuplicates(["cid"]), "cid", "embedding", QUERY_VECTOR, 25)


@query("""WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT vec_id, c.label AS nearest, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings, c)
    SELECT vec_id, nearest, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) AS n FROM s) WHERE n = 1""")
def vector_centroid_classify(spark, sf):
    return vc.classify(embeddings(spark, sf), "vec_id", "label", "embedding")


@query()
def vector_pca_stress(spark, sf):
    return vc.axes_stress(embeddings(spark, sf), "embedding", 3)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b
    ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 79 AND a.label <> b.label WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3""")
def vector_pair_band(spark, sf):
    return vc.band_pairs(embeddings(spark, sf), "vec_id", "label", "vec_id", "embedding", 79, 0.3)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:16], lambda x: pow(x::DOUBLE, 2)))), 6) AS head_norm, round(sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2)))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf):
    e = F.col("embedding")
    return embeddings(spark, sf).select("vec_id", F.round(vc.norm(F.slice(e, 1, 16)), 6).alias("head_norm"), F.round(vc.norm(e), 6).alias("norm"))


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _bm25_sql(t: str, toks: str) -> str:
    parts = []
    for w in dict.fromkeys(lx.query_tokens(t)):
        tf = f"len(list_filter({toks}, lambda x: x = {q(w)}))"
        parts.append(f"CASE WHEN {tf} > 0 THEN {fixed.BM25_IDF} * {tf} * 2.5 / ({tf} + 1.5 * (0.25 + 0.75 * len({toks}) / 120.0)) ELSE 0.0 END")
    return " + ".join(parts)


@query(f"WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT doc_id, round({_bm25_sql(QUERY_TEXT, 't')}, 6) AS score FROM d WHERE len(t) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf):
    return lx.bm25_top(documents(spark, sf), "doc_id", QUERY_TEXT, 50)


_Q = ", ".join(f"({q(n)}, {q(w)}, {len(set(lx.query_tokens(t)))})" for n, t in QUERIES.items() for w in sorted(set(lx.query_tokens(t))))


@query(f"""WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_len FROM d), q(query, token, need) AS (VALUES {_Q}),
    tf AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM d) WHERE token IN (SELECT token FROM q) GROUP BY 1, 2, 3), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query, doc_id, need, count(*) AS found, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))), 6) AS score FROM tf JOIN q USING (token) JOIN df USING (token) CROSS JOIN n GROUP BY 1, 2, 3)
    SELECT query, doc_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM s WHERE found = need) WHERE place <= 20""")
def lexical_idf_search(spark, sf):
    return lx.search(documents(spark, sf), "doc_id", QUERIES, 20)


@query(f"SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS artifacts, min(position)::INT AS first_position FROM (SELECT doc_id, unnest({_TOK}) AS token, generate_subscripts({_TOK}, 1) - 1 AS position FROM documents) GROUP BY 1")
def token_postings(spark, sf):
    return lx.posting_stats(lx.postings(documents(spark, sf), "doc_id", unique=True), "doc_id")


@query(f"SELECT token, count(DISTINCT doc_id) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) GROUP BY 1")
def token_idf(spark, sf):
    return lx.smoothed_idf(documents(spark, sf), "doc_id")


_TERMS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_+\\-.]*'), lambda w: length(w) >= 2 AND w NOT IN {in_list(fixed.STOP_EN)})"


@query(f"""WITH d AS (SELECT {_TERMS} AS t FROM documents), g AS (SELECT unnest(t) AS gram FROM d UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM d
    UNION ALL SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM d) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 80""")
def ngram_themes(spark, sf):
    return lx.themes(documents(spark, sf))


@query("""WITH p AS (SELECT DISTINCT doc_kind, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_./-]*')) AS token FROM documents WHERE text IS NOT NULL), v AS (SELECT count(DISTINCT doc_kind) AS n FROM documents WHERE text IS NOT NULL)
    SELECT token, count(DISTINCT doc_kind) AS views, round(count(DISTINCT doc_kind) / any_value(n), 6) AS score FROM p CROSS JOIN v GROUP BY 1 HAVING count(DISTINCT doc_kind) >= 2""")
def latent_anchors(spark, sf):
    return lx.anchors(documents(spark, sf).filter("text is not null"), "doc_kind")


def _lexical_ranks(spark, sf):
    hits = lx.bm25_top(documents(spark, sf), "doc_id", QUERY_TEXT, 100).select(F.col("doc_id").alias("id"), "score")
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _vector_ranks(spark, sf):
    hits = vc.top_k(embeddings(spark, sf), "vec_id", "embedding", QUERY_VECTOR, 100).select(F.col("vec_id").alias("id"), "score")
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


_LEX = f"SELECT doc_id AS id, round({_bm25_sql(QUERY_TEXT, 't')}, 6) AS score FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE len(t) > 0 ORDER BY score DESC, id LIMIT 100"
_VEC = f"SELECT vec_id AS id, round({_cos('embedding', _V)}, 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 100"


@query(f"""WITH l AS ({_LEX}), v AS ({_VEC}), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM l WHERE score > 0 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM v),
    f AS (SELECT id, round(sum(1.0 / (60 + place)), 9) AS score FROM r GROUP BY 1) SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS place FROM f""")
def rrf_fusion(spark, sf):
    """Two top-100 lists fused; document and vector ids stand for the same items here."""
    return vc.rank_fusion([_lexical_ranks(spark, sf), _vector_ranks(spark, sf)], "id")


@query(f"""WITH t AS (SELECT vec_id, score FROM (SELECT vec_id, round({_cos('embedding', _V)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 60))
    SELECT t.vec_id, t.score, lower(d.lang) AS lang FROM t JOIN documents d ON d.doc_id = t.vec_id WHERE lower(d.lang) = 'en' AND d.word_count >= 50 ORDER BY score DESC, t.vec_id LIMIT 20""")
def pairs_limit_then_filter(spark, sf):
    """Top 3 k first, then the filter, then k: fewer than k can come out."""
    top = vc.top_k(embeddings(spark, sf), "vec_id", "embedding", QUERY_VECTOR, 60)
    docs = documents(spark, sf).select(F.col("doc_id").alias("vec_id"), F.lower("lang").alias("lang"), "word_count")
    return top.join(docs, "vec_id").filter("lang = 'en' and word_count >= 50").orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", "score", "lang")


@query(f"""WITH l AS (SELECT 'lexical' AS arm, CAST(id AS VARCHAR) AS id, score AS raw FROM ({_LEX}) WHERE score > 0), v AS (SELECT 'vector' AS arm, CAST(id AS VARCHAR) AS id, score AS raw FROM ({_VEC})),
    t AS (SELECT 'token' AS arm, CAST(doc_id AS VARCHAR) AS id, CAST(count(*) AS DOUBLE) AS raw FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) WHERE token IN ('limit', 'threshold') GROUP BY 2),
    e AS (SELECT * FROM l UNION ALL SELECT * FROM v UNION ALL SELECT * FROM t), s AS (SELECT arm, id, round(CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1.0 END, 6) AS score FROM e WINDOW w AS (PARTITION BY arm))
    SELECT arm, id, score, CAST(row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) AS INT) AS place FROM s""")
def federated_query(spark, sf):
    post = lx.postings(documents(spark, sf), "doc_id")
    tokens = post.filter(F.col("token").isin("limit", "threshold")).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("score"))
    return lx.federated({"lexical": _lexical_ranks(spark, sf), "vector": _vector_ranks(spark, sf), "token": tokens})


@query(f"""WITH v AS (SELECT DISTINCT token FROM (SELECT unnest({_TOK}) AS token FROM documents) WHERE length(token) BETWEEN 4 AND 12), w(word) AS (VALUES ('limlt'), ('threshhold'), ('cookis'), ('crawls'), ('quer'))
    SELECT word, min(token) AS fixed FROM w JOIN v ON levenshtein(word, token) <= 1 GROUP BY 1""")
def vocabulary_correction(spark, sf):
    """Misspelt words to the first vocabulary word within one edit.

    A few given words against the vocabulary: candidates share the first half
    or the second half of the word's letters, so the join is an equality.
    """
    v = documents(spark, sf).select(F.explode(tx.tokens(F.col("text"), unique=True)).alias("token")).distinct().filter(F.length("token").between(4, 12))
    words = [("limlt",), ("threshhold",), ("cookis",), ("crawls",), ("quer",)]
    w = spark.createDataFrame(words, "word string")

    def halves(c: str, spread: bool):
        """Keys of the halves; within one edit, one half is unchanged and its length known up to one."""
        n = F.length(c)
        cuts = [F.floor((n + d) / 2).cast("int") for d in ((-1, 0, 1) if spread else (0,))]
        return F.array_distinct(F.concat(*(F.array(F.concat(F.lit("<"), F.substring(F.col(c), 1, h)), F.concat(F.lit(">"), F.expr(f"right({c}, length({c}) - {e})"))) for h, e in zip(cuts, [f"floor((length({c}) + {d}) / 2)" for d in ((-1, 0, 1) if spread else (0,))], strict=True))))

    a = w.select("word", F.explode(halves("word", False)).alias("k"))
    b = v.select("token", F.explode(halves("token", True)).alias("k"))
    return b.join(a, "k").filter(F.levenshtein("word", "token") <= 1).groupBy("word").agg(F.min("token").alias("fixed"))
