"""Queries over documents and pages: scoring, chunking, redaction, risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators import chunking, text
from loomspan.plans.registry import any_word, ascii_words, hits, in_list, q, query, words
from loomspan.sources.tables import table, texts

AS_OF = date(2026, 1, 1)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents")


def _score_sql(t: str) -> str:
    """Fact score of a text expression that is not null."""
    low_words = words(f"lower({t})")
    bare = f"list_transform({low_words}, lambda w: regexp_replace(w, '[,.]+$', ''))"
    n = f"len({low_words})"
    count = lambda listed: f"len(list_filter({bare}, lambda w: w IN {in_list(listed)}))"
    has = lambda p: f"CASE WHEN regexp_matches({ascii_words(t)}, {q(p)}) THEN 1.0 ELSE 0.0 END"
    pipes = f"(length({t}) - length(replace({t}, '|', '')))"
    markup = f"({hits(t, fixed.MARKUP)} + {hits(t, fixed.MATH)} + CASE WHEN regexp_matches({t}, {q(fixed.TABLE_ROW)}) OR {pipes} >= 4 THEN 4 ELSE 0 END + CASE WHEN regexp_matches({t}, {q(fixed.TEMPLATE)}) THEN 6 ELSE 0 END)"
    return (
        f"CASE WHEN {n} = 0 THEN 0.0 ELSE {count(fixed.PROCEDURE)} / {n} * 2.0 - {count(fixed.NARRATIVE)} / {n} * 1.5 + {has(fixed.NUMERIC)} + {has(fixed.CODE)} + {has(fixed.REF)}"
        f" - least({markup}, 8) * 0.5 - CASE WHEN {_alpha_sql(t)} < 0.55 THEN 3.0 ELSE 0.0 END END"
    )


def _alpha_sql(t: str) -> str:
    solid = f"length(regexp_replace({t}, '\\s', '', 'g'))"
    return f"CASE WHEN {solid} > 0 THEN length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) / {solid} ELSE 0.0 END"


def _kind_sql(s: str) -> str:
    return f"CASE WHEN {s} >= 1.0 THEN 'rule' WHEN {s} >= 0.6 THEN 'fact' ELSE 'narrative' END"


def _sentences_sql(t: str) -> str:
    marked = f"regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split_regex({marked}, '[\\x01]|\\n+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def _density_sql(t: str) -> str:
    a = ascii_words(t)
    return f"round(greatest(0.0, least(1.0, ({hits(a, any_word(fixed.PROCEDURE))} - 0.5 * {hits(a, any_word(fixed.NARRATIVE + fixed.NARRATIVE_MORE))}) / greatest(len({words(t)}), 1) * 10)), 4)"


DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query(f"SELECT doc_id, round(s, 6) AS fact_score, {_kind_sql('s')} AS chunk_kind FROM (SELECT doc_id, {_score_sql('text')} AS s FROM ({DOCS}))")
def doc_fact_score(spark, sf):
    s = text.fact_score(F.coalesce("text", F.lit("")))
    return documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.round("s", 6).alias("fact_score"), text.chunk_kind(F.col("s")).alias("chunk_kind"))


@query(f"SELECT doc_id, round({_alpha_sql('text')}, 6) AS alpha_ratio FROM ({DOCS})")
def doc_alpha_ratio(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(text.alpha_ratio(F.coalesce("text", F.lit(""))), 6).alias("alpha_ratio"))


_like_any = lambda ws: "(" + " OR ".join(f"contains(lower(fact_text), {q(w)})" for w in ws) + ")"
_BUCKET = (
    f"CASE WHEN contains(lower(fact_text), 'v36') THEN 'Upcoming' WHEN {_like_any(fixed.UPCOMING_WORDS)} THEN 'Upcoming'"
    f" WHEN {_like_any(fixed.PREVIOUS_WORDS)} OR regexp_matches({ascii_words('fact_text')}, {q(fixed.PREVIOUS_VERSION)}) THEN 'Previous' ELSE 'Current' END"
)


@query(f"""WITH f AS (SELECT fact_hash AS fact_id, any_value(fact_text) AS fact_text FROM global_facts GROUP BY 1),
    s AS (SELECT fact_id, fact_text, round({_score_sql('fact_text')}, 6) AS fact_score, {_BUCKET} AS bucket FROM f WHERE trim(fact_text) <> '')
    SELECT bucket, place, fact_id, fact_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY fact_score DESC, fact_id DESC) AS INT) AS place FROM s) WHERE place <= 25""")
def fact_version_bucket_top(spark, sf):
    facts = table(spark, sf, "global_facts").groupBy(F.col("fact_hash").alias("fact_id")).agg(F.first("fact_text").alias("fact_text"))
    facts = facts.withColumn("fact_score", F.round(text.fact_score(F.col("fact_text")), 6))
    return text.bucket_top(facts, AS_OF, 25).select("bucket", "place", "fact_id", "fact_score")


_NOISE = (
    lambda t, s: f"CASE WHEN len({words(t)}) = 0 THEN 1.0 WHEN len({words(t)}) < 8 THEN 0.85 ELSE round(least(1.0, greatest(0.0, CASE WHEN {s} > 0 THEN 0.60 * (1.0 - least({s}, 1.0)) + 0.40 * h ELSE h END)), 4) END"
)


@query(f"""WITH s AS (SELECT doc_id, text, {_score_sql('text')} AS s,
      0.30 * least(1.0, {hits(ascii_words('text'), any_word(fixed.BOILERPLATE))} / 3) + 0.20 * least(1.0, {hits('text', '[!?]{2,}|[A-Z]{4,}')} / 5)
      + 0.20 * least(1.0, {hits('text', r'\[.*?\]\(https?://[^\)]+\)')} / greatest(len({words('text')}), 1) * 10) + 0.30 * (1.0 - {_density_sql('text')}) AS h FROM ({DOCS}))
    SELECT doc_id, {_density_sql('text')} AS fact_density, {_NOISE('text', 's')} AS noise_score FROM s""")
def doc_noise_score(spark, sf):
    t = F.coalesce("text", F.lit(""))
    # The score is a column of its own, so that it is worked out once.
    scored = documents(spark, sf).select("doc_id", t.alias("t"), text.fact_score(t).alias("s"))
    return scored.select("doc_id", text.fact_density(F.col("t")).alias("fact_density"), text.noise_score(F.col("t"), F.col("s")).alias("noise_score"))


_WINDOWS = f"""SELECT doc_id, CAST(i AS INT) AS position, array_to_string(w[i * 272 + 1 : i * 272 + 320], ' ') AS chunk_text
    FROM (SELECT doc_id, {words('text')} AS w FROM ({DOCS})), LATERAL (SELECT unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 320 THEN 1 ELSE CAST(ceil((len(w) - 320) / 272) AS BIGINT) + 1 END)) AS i)"""


@query(_WINDOWS)
def chunk_sliding_window(spark, sf):
    return chunking.explode_chunks(documents(spark, sf), "doc_id")


@query(f"""SELECT 'chunk-' || substr(sha256(chunk_text), 1, 16) AS chunk_id, count(*) AS copies, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc,
    array_to_string(list(doc_id || ':' || position ORDER BY doc_id, position), ',') AS provenance FROM ({_WINDOWS}) GROUP BY 1""")
def chunk_dedup_provenance(spark, sf):
    d = chunking.dedup_provenance(chunking.explode_chunks(documents(spark, sf), "doc_id"), "doc_id")
    places = F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["position"].cast("string"))), ",")
    docs = F.size(F.array_distinct(F.transform("provenance", lambda p: p["doc_id"]))).cast("long")
    return d.select("chunk_id", "copies", docs.alias("docs"), F.col("first.doc_id").alias("first_doc"), places.alias("provenance"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS s FROM ({DOCS}))
    SELECT doc_id, CAST(i AS INT) AS position, array_to_string(s[i * 3 + 1 : i * 3 + 3], ' ') AS chunk_text FROM s, LATERAL (SELECT unnest(range(0, CAST(ceil(len(s) / 3) AS BIGINT))) AS i)""")
def chunk_sentence_groups(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(chunking.sentence_groups(F.col("text"), 3)).alias("position", "chunk_text"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS s FROM ({DOCS}))
    SELECT doc_id, len(s) AS pieces, CAST(coalesce(list_max(list_transform(s, lambda p: length(p))), 0) AS INT) AS longest FROM s""")
def chunk_regex_pieces(spark, sf):
    p = chunking.regex_pieces(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(p).cast("long").alias("pieces"), F.coalesce(F.array_max(F.transform(p, lambda x: F.length(x))), F.lit(0)).alias("longest"))


_SIGNAL = " OR ".join(f"regexp_matches({ascii_words('s')}, {q(p)})" for p in (fixed.NUMERIC, fixed.REF, fixed.CODE))


@query(f"""WITH s AS (SELECT doc_id, unnest({_sentences_sql('text')}) AS s, generate_subscripts({_sentences_sql('text')}, 1) AS i FROM ({DOCS})),
    k AS (SELECT doc_id, i, s FROM s WHERE {_SIGNAL} OR {_score_sql('s')} >= 0.6)
    SELECT d.doc_id, coalesce(string_agg(k.s, ' ' ORDER BY k.i), '') AS stem_text, count(DISTINCT k.s) AS facts FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1""")
def doc_stem_text(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", text.stem_text(t).alias("stem_text"), F.size(text.fact_sentences(t)).cast("long").alias("facts"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity_type, {hits(ascii_words('text'), p)} AS n FROM ({DOCS}) WHERE {hits(ascii_words('text'), p)} > 0" for k, p in fixed.MENTIONS.items()))
def entity_mentions(spark, sf):
    return text.mentions(documents(spark, sf), "doc_id").groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, regexp_replace(text, {q(fixed.SECRET)}, '[REDACTED]', 'g') <> text AS redacted, length(regexp_replace(text, {q(fixed.SECRET)}, '[REDACTED]', 'g')) AS n_chars FROM ({DOCS})")
def secret_redaction(spark, sf):
    t = F.coalesce("text", F.lit(""))
    r = text.redact(t)
    return documents(spark, sf).select("doc_id", (r != t).alias("redacted"), F.length(r).cast("long").alias("n_chars"))


_RISK = " + ".join(
    f"CASE WHEN regexp_matches({t}, {q(p)}) THEN {w} ELSE 0.0 END"
    for t, w, p in [("text", fixed.OBFUSCATION_WEIGHT, fixed.OBFUSCATION), *((ascii_words("text"), w, p) for w, p in fixed.INJECTION.values())]
)


@query(f"""WITH r AS (SELECT doc_id, CAST(least(1.0, round({_RISK}, 3)) AS DOUBLE) AS risk FROM ({DOCS}))
    SELECT doc_id, risk, CASE WHEN risk >= 0.8 THEN 'block' WHEN risk >= 0.45 THEN 'confirm' WHEN risk >= 0.2 THEN 'attenuate' ELSE 'proceed' END AS verdict FROM r""")
def injection_risk_verdict(spark, sf):
    risk, verdict = text.injection_risk(F.col("text"))
    return documents(spark, sf).select("doc_id", risk.alias("risk"), verdict.alias("verdict"))


@query(f"SELECT doc_id, length(substr(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), ' '), 1, {fixed.SANITIZE_LIMIT})) AS n_chars, CAST(ceil(length(text) / 4) AS BIGINT) AS token_estimate FROM ({DOCS})")
def doc_sanitized(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf).select("doc_id", F.length(text.sanitize(t)).cast("long").alias("n_chars"), text.token_estimate(t).alias("token_estimate"))


_bag = "regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]+://', ''), '#.*$', '')"
_VALID = "CASE WHEN length(regexp_replace(low, '\\s+', '', 'g')) < 20 THEN 'empty' "
for _layer, _markers in (("captcha", fixed.CAPTCHA_MARKERS), ("login", fixed.LOGIN_MARKERS), ("denied", fixed.DENIED_MARKERS)):
    _VALID += " ".join(f"WHEN contains(low, {q(m)}) THEN {q(_layer + ':' + m)}" for m in _markers) + " "
for _f in fixed.CHALLENGE_FRAGMENTS:
    _VALID += f"WHEN contains(bag, {q(_f)}) OR list_has_all(string_split_regex(bag, '[^a-z0-9]+'), [{', '.join(q(p) for p in _f.split('-'))}]) THEN {q('url:' + _f)} "
_VALID += "WHEN regexp_matches(low, '<input[^>]*type=[\"'']?password') THEN 'password field' WHEN len(regexp_extract_all(low, '<script\\b')) > 3 AND length(trim(regexp_replace(text, '<[^>]+>', '', 'g'))) < 200 THEN 'scripts' END"


@query(f"WITH p AS (SELECT page_id, any_value(coalesce(text, '')) AS text, any_value(url) AS url FROM crawl_pages GROUP BY 1), v AS (SELECT page_id, text, lower(text) AS low, {_bag} AS bag FROM p) SELECT page_id, {_VALID} AS refused FROM v")
def source_validity(spark, sf):
    pages = table(spark, sf, "crawl_pages").groupBy("page_id").agg(F.first("text").alias("text"), F.first("url").alias("url"))
    return pages.select("page_id", text.source_validity(F.col("text"), F.col("url")).alias("refused"))


_LINKS = "SELECT DISTINCT l.url AS url FROM (SELECT unnest(links) AS l FROM crawl_pages) WHERE l.url IS NOT NULL"
_CANON = """SELECT url, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
      || CASE WHEN rest = '' THEN '/' WHEN starts_with(rest, '?') THEN '/' || rest ELSE rest END AS canonical, host
    FROM (SELECT url, lower(regexp_extract(u, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1)) AS host, regexp_extract(u, '^[^:]+://[^/?]*(.*)$', 1) AS rest
      FROM (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t ELSE 'https://' || t END AS u FROM (SELECT url, regexp_replace(trim(url), '#.*$', '') AS t FROM (%s) WHERE trim(url) <> '')))"""


@query(_CANON.replace(", host\n", "\n") % _LINKS)
def url_canonical(spark, sf):
    links = table(spark, sf, "crawl_pages").select(F.explode("links.url").alias("url")).filter("trim(url) <> ''").distinct()
    return links.select("url", text.canonical_url(F.col("url")).alias("canonical"))


_NAME = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':.*$', '')"
_RISKY = " + ".join(f"CAST(contains(h || p, {q(t)}) AS INT)" for t in fixed.RISKY_TOKENS)


@query(f"""WITH u AS (SELECT DISTINCT url FROM ({_LINKS}) UNION SELECT DISTINCT url FROM crawl_pages WHERE url IS NOT NULL),
    h AS (SELECT url, {_NAME} AS n, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM u),
    c AS (SELECT url, c, count(*) AS k FROM (SELECT url, unnest(string_split(n, '')) AS c FROM h WHERE n <> '') GROUP BY 1, 2),
    e AS (SELECT url, -sum(k / t * log2(k / t)) AS bits FROM (SELECT *, sum(k) OVER (PARTITION BY url) AS t FROM c) GROUP BY 1),
    s AS (SELECT h.url, least(100, CASE WHEN regexp_matches(n, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') THEN 35 ELSE 0 END + CASE WHEN contains(n, 'xn--') THEN 25 ELSE 0 END
      + CASE WHEN contains(n, '.') AND regexp_extract(n, '([^.]*)$', 1) IN {in_list(fixed.RISKY_TLDS)} THEN 20 ELSE 0 END + CASE WHEN length(n) - length(replace(n, '.', '')) >= 4 THEN 15 ELSE 0 END
      + CASE WHEN coalesce(bits, 0) > 3.5 THEN 20 ELSE 0 END + CASE WHEN length(n) > 0 AND length(regexp_replace(n, '\\D', '', 'g')) / length(n) > 0.3 THEN 10 ELSE 0 END
      + CASE WHEN length(h.url) > 120 THEN 10 ELSE 0 END + least(20, 7 * ({_RISKY})) + CASE WHEN contains(h.h, '@') THEN 30 ELSE 0 END) AS risk FROM h LEFT JOIN e USING (url))
    SELECT url, CAST(risk AS INT) AS risk, CASE WHEN risk > 74 THEN 'block' WHEN risk > 64 THEN 'review' ELSE 'allow' END AS decision FROM s""")
def url_risk(spark, sf):
    pages = table(spark, sf, "crawl_pages")
    urls = pages.select(F.explode("links.url").alias("url")).union(pages.select("url")).filter("url is not null").distinct()
    risk, decision = text.url_risk(F.col("url"))
    return urls.select("url", risk.cast("int").alias("risk"), decision.alias("decision"))


@query(f"""SELECT host, regexp_matches(lower(host), '^(127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2\\d|3[01])\\.|169\\.254\\.)|^localhost$|\\.(local|internal|localhost)$') AS private FROM (SELECT DISTINCT host FROM crawl_pages WHERE host IS NOT NULL)""")
def private_hosts(spark, sf):
    return table(spark, sf, "crawl_pages").select("host").filter("host is not null").distinct().select("host", text.private_host(F.col("host")).alias("private"))


@query("""SELECT DISTINCT p.url AS parent, l.l.url AS child FROM (SELECT page_id, any_value(url) AS url, any_value(links) AS links FROM crawl_pages GROUP BY 1) p, LATERAL (SELECT unnest(p.links) AS l) l
    WHERE p.url IS NOT NULL AND starts_with(l.l.url, 'http')""")
def crawl_map(spark, sf):
    pages = table(spark, sf, "crawl_pages").dropDuplicates(["page_id"])
    return pages.select(F.col("url").alias("parent"), F.explode("links.url").alias("child")).filter("parent is not null and startswith(child, 'http')").distinct()


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(line, ' ') ORDER BY i) AS n FROM l)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE n = 1 OR length(trim(line, ' ')) > 48 OR trim(line, ' ') = '' GROUP BY 1""")
def short_line_chrome_dedup(spark, sf):
    return text.repeated_short_lines(documents(spark, sf).filter("text is not null"), "doc_id")


_low = "lower(coalesce(source_text, ''))"
_counts = {n: " + ".join(f"CAST(contains(low, {q(k)}) AS INT)" for k in ks) for n, ks in fixed.INTENTS.items()}
_INTENT = " ".join(f"WHEN \"{n}\" = best THEN '{n}'" for n in _counts)


@query(f"""WITH t AS (SELECT id, any_value(source_text) AS source_text FROM translation_feedback GROUP BY 1), c AS (SELECT id, {', '.join(f'{v} AS "{k}"' for k, v in _counts.items())} FROM (SELECT id, {_low} AS low FROM t)),
    b AS (SELECT *, greatest({', '.join(f'"{k}"' for k in _counts)}) AS best, {' + '.join(f'"{k}"' for k in _counts)} AS total FROM c)
    SELECT id, CASE WHEN best = 0 THEN 'unknown' {_INTENT} END AS intent, CASE WHEN best > 0 THEN round(best / total, 2) ELSE 0.0 END AS confidence FROM b""")
def prompt_intent(spark, sf):
    t = table(spark, sf, "translation_feedback").groupBy("id").agg(F.first("source_text").alias("t"))
    name, share = text.intent(F.col("t"))
    return t.select("id", name.alias("intent"), share.alias("confidence"))


_toks = "regexp_extract_all(t, '[A-Za-z0-9.+/_-]+')"


@query(f"""WITH t AS (SELECT id, coalesce(any_value(source_text), '') AS t FROM translation_feedback GROUP BY 1), c AS (SELECT id, t, len({_toks}) AS n, len(list_filter({_toks}, lambda w: lower(w) IN {in_list(fixed.VAGUE)})) AS vague FROM t)
    SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE CAST(round(greatest(0.0, least(1.0, least(1.0, n / 14.0) * 0.6 + CASE WHEN regexp_matches(t, '[A-Z][a-zA-Z]+') OR regexp_matches(t, '\\d') THEN 0.3 ELSE 0.0 END - least(0.4, vague * 0.15) + 0.1)), 2) AS DOUBLE) END AS specificity,
      CASE WHEN contains(lower(t), 'research') OR contains(lower(t), 'find') THEN 'research_orchestration' WHEN contains(lower(t), 'test') THEN 'quality_assurance' WHEN contains(lower(t), 'fix') OR contains(lower(t), 'refactor') THEN 'code_mutation' ELSE 'unknown' END AS turn FROM c""")
def prompt_specificity(spark, sf):
    t = table(spark, sf, "translation_feedback").groupBy("id").agg(F.first("source_text").alias("t"))
    return t.select("id", text.specificity(F.col("t")).alias("specificity"), text.turn_intent(F.col("t")).alias("turn"))
