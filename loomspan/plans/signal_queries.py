"""Queries over labels, gates, slugs, token streams, limits, envelopes and stored lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators import chunking, crdt, lexical, records, search, signals
from loomspan.operators import scoring as sc
from loomspan.operators import text as tx
from loomspan.operators import vectors as vc
from loomspan.plans.registry import ascii_words, in_list, q, query
from loomspan.sources.tables import table, texts


def _pages(spark, sf, *columns):
    p = table(spark, sf, "crawl_pages")
    return p.groupBy("page_id").agg(*(F.min(c).alias(c) for c in columns))


_P = "(SELECT page_id, {} FROM crawl_pages GROUP BY 1)"
_page = lambda *cs: _P.format(", ".join(f"min({c}) AS {c}" for c in cs))


@query(f"""SELECT page_id, score, CASE WHEN score < 0.25 THEN 'citation-canon, not relevance' ELSE 'relevance-verified' END AS ranking FROM
    (SELECT page_id, round((CAST(contains(t, 'notes') AS INT) + CAST(contains(t, 'limits') AS INT) + CAST(contains(t, 'guide') AS INT)) / 3, 2) AS score FROM (SELECT page_id, lower(coalesce(title, '')) AS t FROM {_page('title')}))""")
def title_relevance(spark, sf):
    """How far titles answer a query, labelled."""
    score, label = signals.title_relevance("Notes on limits of guide", F.col("title"))
    return _pages(spark, sf, "title").select("page_id", score.alias("score"), label.alias("ranking"))


@query(f"""SELECT page_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, CASE WHEN u = '' THEN lower(url) ELSE u END AS scope FROM (SELECT page_id, url,
    substr(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9._\\-]+', '-', 'g'), '^[-.]+', ''), '[-.]+$', ''), 1, 40) AS s,
    regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')), '/+$', ''), '[^a-z0-9._/\\-]+', '-', 'g') AS u FROM {_page('title', 'url')})""")
def page_slugs(spark, sf):
    """Names for files and scopes."""
    return _pages(spark, sf, "title", "url").select("page_id", signals.slug(F.col("title"), 40).alias("slug"), signals.scope_slug(F.col("url")).alias("scope"))


_GATE_SQL = f"""({' OR '.join(f"contains(lower(coalesce(url, '')), {q(a)})" for a in fixed.GATE_ADDRESSES)} OR regexp_matches({ascii_words("coalesce(title, '')")}, {q(fixed.GATE_TITLE)}) OR regexp_matches({ascii_words("s")}, {q(fixed.GATE_BODY)})
    OR (len(regexp_extract_all({ascii_words("s")}, {q(fixed.GATE_WEAK)})) >= 2 AND regexp_matches({ascii_words("s")}, {q(fixed.GATE_FORM)})))"""


@query(f"SELECT page_id, {_GATE_SQL} AS gate FROM (SELECT page_id, title, url, substr(coalesce(text, ''), 1, {fixed.GATE_SAMPLE}) AS s FROM {_page('title', 'url', 'text')})")
def login_gates(spark, sf):
    """Pages behind a login by their address, title or beginning (P25)."""
    return _pages(spark, sf, "title", "url", "text").select("page_id", signals.login_gate(F.col("title"), F.col("text"), F.col("url")).alias("gate"))


_TERMS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_+\\-.]*'), lambda w: length(w) >= 2 AND w NOT IN {in_list(fixed.STOP_EN)})"


@query(f"SELECT doc_id, {', '.join(f'round(len(list_intersect([{chr(44).join(q(a) for a in anchors)}], t)) / {len(anchors)}, 4) AS {k}' for k, anchors in fixed.SEMANTIC_TYPES.items())} FROM (SELECT doc_id, {_TERMS} AS t FROM documents)")
def semantic_types(spark, sf):
    """Scores of semantic types."""
    t = tx.tokens(F.col("text"), fixed.TERM, min_len=2, stop=fixed.STOP_EN)
    return texts(spark, sf, "documents").select("doc_id", signals.type_scores(t).alias("s")).select("doc_id", "s.*")


@query(f"SELECT page_id, CAST(len(string_split(h, 'limit')) - 1 + len(string_split(h, 'notes')) - 1 AS DOUBLE) AS score FROM (SELECT page_id, lower(coalesce(title, '') || chr(10) || coalesce(text, '')) AS h FROM {_page('title', 'text')})")
def page_keyword_score(spark, sf):
    """Keyword counts of pages."""
    return _pages(spark, sf, "title", "text").select("page_id", signals.keyword_score(F.col("title"), F.col("text"), ["Limit", "notes"]).alias("score"))


@query("SELECT chunk_id, octet_length(encode(t)) + 3 + 2 AS n_tokens, t AS content FROM (SELECT chunk_id, substr(min(coalesce(text, '')), 1, 1000) AS t FROM chunks GROUP BY 1)")
def trajectory_streams(spark, sf):
    """Token streams of turns and the contents they hold (P41); a stream takes the first 1,000 characters by definition."""
    turns = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("entities", F.array(F.lit("turn"), F.col("chunk_id")))
    s = signals.trajectory_tokens(turns, "chunk_id", "text", "entities")
    return s.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), signals.trajectory_text(F.col("tokens")).alias("content"))


@query(f"""WITH m AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all({ascii_words('t')}, {q(p)})) AS v FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)" for k, p in fixed.MENTIONS.items())})
    SELECT doc_id, kind, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars, true AS in_place, true AS in_order FROM m GROUP BY 1, 2""")
def mention_places(spark, sf):
    """Mentions with their places (P14): each stands where it says, and all of a document are in order of start."""
    from pyspark.sql import Window

    d = texts(spark, sf, "documents").select("doc_id", "text")
    m = search.positioned_mentions(d, "doc_id").join(d, "doc_id")
    w = Window.partitionBy("doc_id", "kind").orderBy("start")
    m = m.withColumn("ok", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("value")).withColumn("sorted", F.coalesce(F.lag("end").over(w) <= F.col("start"), F.lit(True)))
    return m.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"), F.min("ok").alias("in_place"), F.min("sorted").alias("in_order"))


@query("SELECT doc_id, CASE WHEN len(a) > 0 THEN round(len(list_intersect(['limit', 'cookie', 'merge'], a)) / len(list_distinct(list_concat(['limit', 'cookie', 'merge'], a))), 4) ELSE 0.0 END AS overlap FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS a FROM documents)")
def entity_overlap(spark, sf):
    """Overlap of a query's names with a document's words."""
    return texts(spark, sf, "documents").select("doc_id", tx.jaccard(tx.lit_array(["Limit", "cookie", "merge"]), tx.tokens(F.col("text"))).alias("overlap"))


@query("SELECT host, memory_cap, cpu_cap, greatest(1, least(memory_cap, cpu_cap, roles)) AS cap FROM (SELECT s_suppkey AS host, CAST(greatest(0, floor((s_suppkey % 64 - 8) / 3.0)) AS BIGINT) AS memory_cap, CAST(greatest(0, floor((s_suppkey % 17 - 3) / 1.5)) AS BIGINT) AS cpu_cap, 1 + s_nationkey % 6 AS roles FROM supplier)")
def worker_caps(spark, sf):
    """Caps of workers by memory, cores and roles."""
    k = F.col("s_suppkey")
    m, c, cap = signals.worker_cap(k % 64, k % 17, 1 + F.col("s_nationkey") % 6, {"ram": 8, "ram_each": 3.0, "cpus": 3, "cpus_each": 1.5})
    return table(spark, sf, "supplier").select(k.alias("host"), m.alias("memory_cap"), c.alias("cpu_cap"), cap.alias("cap"))


@query("SELECT page_id, len(list_distinct(list_filter(list_transform(links, lambda l: l.text), lambda t: t IS NOT NULL AND trim(t, ' ') <> ''))) AS texts FROM (SELECT page_id, any_value(links) AS links FROM crawl_pages WHERE links IS NOT NULL GROUP BY 1 HAVING count(DISTINCT links) = 1)")
def distinct_link_texts(spark, sf):
    """Texts of anchors, each once (Z18), of pages whose rows agree on them."""
    p = table(spark, sf, "crawl_pages").filter("links is not null").groupBy("page_id").agg(F.collect_set(F.col("links.text")).alias("all"), F.count_distinct("links").alias("n")).filter("n = 1")
    return p.select("page_id", F.size(signals.distinct_strings(F.col("all")[0])).cast("long").alias("texts"))


@query("SELECT page_id, u AS url FROM (SELECT DISTINCT page_id, unnest([u, u || '#top', upper(u)[1:8] || u[9:]]) AS x, u FROM (SELECT page_id, min(canonical_url) AS u FROM crawl_pages WHERE canonical_url <> '' GROUP BY 1)) WHERE x = u")
def merged_page_links(spark, sf):
    """Spellings of one address merged."""
    p = table(spark, sf, "crawl_pages").filter("canonical_url <> ''").groupBy("page_id").agg(F.min("canonical_url").alias("u"))
    two = signals.merged_links(F.array("u", F.concat("u", F.lit("#top"))), F.array(F.concat(F.upper(F.substring("u", 1, 8)), F.expr("substring(u, 9)"))))
    return p.select("page_id", F.explode(two).alias("url"))


@query("SELECT fact_hash FROM global_facts WHERE contains(lower(fact_text), 'limit')")
def substring_hits(spark, sf):
    """Facts with a needle in any case (F1)."""
    f = table(spark, sf, "global_facts")
    return records.contains_text(f, "fact_text", "LIMIT", 1 << 30).select("fact_hash")


_VX = "(SELECT n_nationkey AS id, n_name AS label, 'REGION_' || n_regionkey AS type FROM nation)"


def _nodes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("REGION_"), "n_regionkey").alias("type"))


@query(f"SELECT id, label FROM {_VX} WHERE type IN ('REGION_1') AND (contains(CAST(id AS VARCHAR), '1') OR contains(lower(label), '1'))")
def vertex_lookup(spark, sf):
    """Vertices of a type by a part of their id or label (F2)."""
    return records.vertex_query(_nodes(spark, sf), "REGION_1", "1").select("id", "label")


@query("SELECT src, dst, rel FROM (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, c_mktsegment AS rel FROM customer, supplier WHERE c_custkey % 50 = s_suppkey % 50) WHERE rel = 'BUILDING' AND (contains(CAST(src AS VARCHAR), '2') OR contains(CAST(dst AS VARCHAR), '2') OR contains(lower(rel), '2'))")
def edge_lookup(spark, sf):
    """Edges of a relation by a part of either end."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("rel"), (F.col("c_custkey") % 50).alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dst"), (F.col("s_suppkey") % 50).alias("k"))
    return records.edge_query(c.join(s, "k").select("src", "dst", "rel").distinct(), "BUILDING", "2", 1 << 30).select("src", "dst", "rel")


@query(f"SELECT 'by label' AS asked, id FROM {_VX} WHERE lower(label) = 'nation_7' UNION ALL SELECT 'by part', id FROM {_VX} WHERE contains(lower(label), 'tion_1')")
def resolved_names(spark, sf):
    """What a name stands for (G18): an exact label alone, else every label that holds it."""
    v = _nodes(spark, sf).withColumn("id", F.col("id").cast("string"))
    a = records.resolve(v, "Nation_7").select(F.lit("by label").alias("asked"), F.col("id").cast("int").alias("id"))
    return a.union(records.resolve(v, "tion_1").select(F.lit("by part"), F.col("id").cast("int")))


@query("SELECT name, tier FROM (SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'edge' ELSE 'cloud' END AS tier, s_nationkey % 4 AS role, s_suppkey % 5 > 0 AS active FROM supplier) WHERE role = 2 AND active")
def role_lookup(spark, sf):
    """Active models of a role."""
    k = F.col("s_suppkey")
    m = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, ("local", "edge", "cloud"))), (k % 3 + 1).cast("int")).alias("tier"), (F.col("s_nationkey") % 4).cast("string").alias("role"), F.when(k % 5 > 0, "active").otherwise("retired").alias("status"))
    return records.roles(m, "2", ["local", "edge", "cloud"]).select("name", "tier")


@query("SELECT user_id AS key, arg_max(event_type, (seq, event_type)) AS value, max(seq) AS seq FROM (SELECT user_id, event_type, event_id // 10 AS seq FROM events) GROUP BY 1")
def reconverged_states(spark, sf):
    """Replicas of registers brought together by key."""
    s = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.lit("lww").alias("type"), F.col("event_type").alias("value"), F.col("event_type").alias("head"), F.floor(F.col("event_id") / 10).cast("long").alias("seq"))
    return crdt.reconverge(s, ["key"]).select("key", "value", "seq")


@query("""WITH t AS (SELECT document_id AS k, string_split(coalesce(min(text), ''), chr(10)) AS a, string_split(coalesce(max(text), ''), chr(10)) AS b FROM documents GROUP BY 1)
    SELECT k, CAST(len(x) AS INT) AS added, CAST(len(y) AS INT) AS removed, round((len(x) + len(y)) / (len(a) + len(b)), 6) AS changed FROM (SELECT k, a, b, list_filter(b, lambda l: NOT list_contains(a, l)) AS x, list_filter(a, lambda l: NOT list_contains(b, l)) AS y FROM t)""")
def version_line_changes(spark, sf):
    """Lines that differ between two versions of a document."""
    d = texts(spark, sf, "documents").groupBy(F.col("document_id").alias("k")).agg(F.min("text").alias("old"), F.max("text").alias("new"))
    return crdt.line_changes(d, "k", "old", "new")


_FIND = "(SELECT substr(sha256('{\"file\":\"' || file || '\",\"kind\":\"' || kind || '\",\"lineno\":' || line || ',\"symbol\":\"' || symbol || '\"}'), 1, 16) AS finding_id, user_id FROM (SELECT 'user-' || user_id AS file, event_type AS kind, user_id % 40 AS line, 'k' || json_extract_string(props, '$.k') AS symbol, user_id FROM events))"


def _findings(spark, sf):
    e = table(spark, sf, "events")
    f = e.select(F.concat(F.lit("user-"), "user_id").alias("file"), F.col("event_type").alias("kind"), (F.col("user_id") % 40).alias("lineno"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("symbol"))
    return f.withColumn("finding_id", sc.fingerprint("file", "kind", "lineno", "symbol"))


@query(f"SELECT finding_id, count(*) AS n FROM {_FIND} GROUP BY 1")
def finding_fingerprints(spark, sf):
    """Content ids of findings."""
    return _findings(spark, sf).groupBy("finding_id").agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT DISTINCT finding_id FROM {_FIND}), b AS (SELECT finding_id, count(*) AS c FROM {_FIND} WHERE user_id % 3 = 0 GROUP BY 1) SELECT finding_id FROM f WHERE finding_id NOT IN (SELECT finding_id FROM b WHERE c >= 2)")
def unsuppressed_findings(spark, sf):
    """Findings that were not dismissed twice before."""
    f = _findings(spark, sf)
    base = f.filter("cast(substring(file, 6) as long) % 3 = 0").groupBy("finding_id").agg(F.count("*").alias("dismiss_count"))
    return crdt.suppress(f.select("finding_id").distinct(), base)


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"SELECT DISTINCT token, doc_id FROM (SELECT doc_id, unnest({_TOK}) AS token FROM documents) WHERE token IN ('limit', 'threshold', 'cookies')")
def token_artifacts(spark, sf):
    """Documents of a token."""
    return lexical.artifacts_of(lexical.postings(texts(spark, sf, "documents"), "doc_id"), "doc_id", ["limit", "threshold", "cookies"])


@query(f"SELECT doc_id, CAST(generate_subscripts({_TOK}, 1) - 1 AS INT) AS position, unnest({_TOK}) AS token FROM documents WHERE doc_id IN (1, 2, 3)")
def artifact_tokens(spark, sf):
    """Tokens of an artifact in order."""
    return search.tokens_of(lexical.postings(texts(spark, sf, "documents"), "doc_id"), "doc_id", [1, 2, 3])


@query("SELECT vec_id, round(e[1] / h, 6) AS head, round(sqrt(list_sum(list_transform(e[1:16], lambda x: pow(x / h, 2)))), 6) AS head_norm, round(sqrt(list_sum(list_transform(e, lambda x: pow(x / n, 2)))), 6) AS norm FROM (SELECT vec_id, e, sqrt(list_sum(list_transform(e[1:16], lambda x: x * x))) AS h, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def vector_heads(spark, sf):
    """First dimensions at unit length and vectors at unit length."""
    e = table(spark, sf, "embeddings").select("vec_id", vc.mrl(F.col("embedding"), 16).alias("h"), vc.normalise(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.col("h")[0], 6).alias("head"), F.round(vc.norm(F.col("h")), 6).alias("head_norm"), F.round(vc.norm(F.col("u")), 6).alias("norm"))


@query("SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 320 THEN 1 ELSE 1 + CAST(ceil((len(w) - 320) / 272.0) AS BIGINT) END AS windows FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def chunk_strategies(spark, sf):
    """Chunking by the name of a strategy."""
    windows = chunking.strategy("sliding_window")(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", F.size(windows).cast("long").alias("windows"))


@query("SELECT event_id, CASE WHEN v >= 8 THEN 'rule' WHEN k >= 50 THEN 'model' WHEN user_id % 2 = 0 THEN 'person' END AS label, CASE WHEN v >= 8 THEN 0 WHEN k >= 50 THEN 1 WHEN user_id % 2 = 0 THEN 2 END AS rung FROM (SELECT event_id, user_id, value AS v, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def escalation(spark, sf):
    """The first arm that is sure enough decides."""
    k = F.get_json_object("props", "$.k").cast("double")
    label, rung = sc.escalate([(F.lit("rule"), F.col("value"), 8.0), (F.lit("model"), k, 50.0), (F.lit("person"), (F.col("user_id") % 2 == 0).cast("double"), 1.0)])
    return table(spark, sf, "events").select("event_id", label.alias("label"), rung.alias("rung"))


@query("SELECT fact_hash, 'fact-' || substr(sha256('fact|v1|' || fact_text), 1, 32) AS cid, fact_hash NOT LIKE '%0' AS valid FROM (SELECT DISTINCT fact_hash, fact_text FROM global_facts WHERE fact_text IS NOT NULL)")
def artifact_envelopes(spark, sf):
    """Artifacts in envelopes, and which of them still hold what they were made of (T5): every tenth or so is altered."""
    f = table(spark, sf, "global_facts").select("fact_hash", "fact_text").filter("fact_text is not null").distinct()
    e = records.envelopes(f, "fact", "v1", "fact_text")
    altered = e.withColumn("payload", F.when(F.col("fact_hash").endswith("0"), F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return altered.select("fact_hash", "cid", records.envelope_holds().alias("valid"))


@query("""WITH t AS (SELECT user_id || '-' || CAST(ts AS DATE) AS tx, event_id AS tick, event_type FROM events), l AS (SELECT tx, max(tick) FILTER (event_type IN ('view', 'click')) AS proposed, max(tick) FILTER (event_type = 'signup') AS abandoned, bool_or(event_type = 'error') AS superseded, (SELECT max(event_id) FROM events) AS now FROM t GROUP BY 1)
    SELECT tx, CASE WHEN superseded THEN 'superseded' WHEN abandoned > proposed AND abandoned < proposed + 500 THEN 'abandoned' WHEN now < proposed + 500 THEN 'pending' ELSE 'committed' END AS status FROM l WHERE proposed IS NOT NULL""")
def clocked_transactions(spark, sf):
    """Transactions over a logical clock (Z13): pending until their window has passed, abandoned only until then."""
    e = table(spark, sf, "events")
    op = F.create_map(*(F.lit(x) for x in ("error", "supersede", "signup", "abandon", "view", "propose", "click", "propose")))
    log = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("tx"), F.col("event_id").alias("tick"), F.element_at(op, F.col("event_type")).alias("op"))
    return sc.clocked_state(log, "tx", "tick", 500, e.select(F.max("event_id")).scalar())
