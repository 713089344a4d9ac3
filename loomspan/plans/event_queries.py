"""Queries over events and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions.columns import beside

from loomspan.operators import events as ev
from loomspan.operators import text
from loomspan.plans.registry import query
from loomspan.sources.tables import table

KINDS = ["signup", "purchase", "view", "click", "error"]


def events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT status, n FROM (SELECT k.status, count(e.event_id) AS n FROM (SELECT unnest(['signup','purchase','view','click','error']) AS status) k LEFT JOIN events e ON e.event_type = k.status GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events)")
def event_queue_depth(spark, sf):
    return ev.status_counts(events(spark, sf), "event_type", KINDS)


@query("SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS event_count, arg_max(event_type, event_id) AS last_kind, max(ts) AS latest FROM events GROUP BY 1")
def event_session_heads(spark, sf):
    return ev.heads(events(spark, sf), ["user_id"], "event_id", "event_type", "ts")


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000.0, 1) AS gap_ms FROM events")
def event_gaps(spark, sf):
    return ev.gaps(events(spark, sf), ["user_id"], "ts", "event_id").select("event_id", "gap_ms")


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events) WHERE place <= 5")
def event_newest(spark, sf):
    return ev.newest(events(spark, sf), ["user_id"], "ts", "event_id", 5).select("user_id", "event_id", "place")


@query("""WITH o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    p AS (SELECT a.event_id, b.event_type, count(*) AS c FROM o a JOIN o b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 9 AND a.i GROUP BY 1, 2),
    h AS (SELECT event_id, sum(c) AS n, -sum(c / t * log2(c / t)) AS bits FROM (SELECT *, sum(c) OVER (PARTITION BY event_id) AS t FROM p) GROUP BY 1)
    SELECT event_id, CAST(CASE WHEN n > 1 THEN CASE WHEN abs(s - floor(s) - 0.5) < 1e-7 THEN 2 * floor((floor(s) + 1) / 2) ELSE round(s) END ELSE 0 END AS INT) AS entropy FROM (SELECT event_id, n, CASE WHEN n > 1 THEN 100 * bits / log2(n) END AS s FROM h)""")
def event_entropy_window(spark, sf):
    return ev.kind_entropy(events(spark, sf), ["user_id"], "event_type", "ts", "event_id").select("event_id", "entropy")


@query("SELECT user_id, CASE WHEN count(ts) >= 2 AND max(ts) > min(ts) THEN round(count(ts) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) ELSE 0.0 END AS tps FROM events GROUP BY 1")
def event_tps(spark, sf):
    return ev.throughput(events(spark, sf), ["user_id"], "ts")


@query("""WITH w AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS b FROM events),
    m AS (SELECT event_id, value, b, list_median(b) AS m FROM w), d AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - m))) AS d FROM m)
    SELECT event_id, CASE WHEN b IS NULL OR len(b) < 2 THEN 0.0 ELSE round(abs(value - m) / (1.4826 * CASE WHEN d = 0 THEN 1e-9 ELSE d END), 4) END AS z FROM d""")
def event_rolling_robust_z(spark, sf):
    return ev.robust_z(events(spark, sf), ["user_id"], "value", "ts", "event_id").select("event_id", "z")


_ORDERED = "o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, i, value AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.3 * o.value + 0.7 * f.s FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT user_id, max(i) AS n, round(arg_max(s, i), 6) AS ewma FROM f GROUP BY 1""")
def event_ewma(spark, sf):
    return ev.ewma(events(spark, sf), ["user_id"], "value", "ts", "event_id")


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, i, value, value AS s, r FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.value, 0.3 * o.value + 0.7 * f.s, o.r FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
    a AS (SELECT user_id, count(*) FILTER (r > 1) AS past, stddev_samp(value - round(s, 6)) FILTER (r > 1) AS sigma, max(value) FILTER (r = 1) AS last, max(round(s, 6)) FILTER (r = 2) AS smooth FROM f GROUP BY 1)
    SELECT user_id, CASE WHEN past < 2 THEN 0.0 ELSE round(abs(last - smooth) / CASE WHEN sigma = 0 THEN 1e-9 ELSE sigma END, 4) END AS deviation FROM a""")
def event_ewma_deviation(spark, sf):
    return ev.ewma_deviation(events(spark, sf), ["user_id"], "value", "ts", "event_id")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence FROM events")
def event_sequence(spark, sf):
    return ev.sequence_numbers(events(spark, sf), ["user_id"], "ts", "event_id").select("event_id", "sequence")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS failed FROM events GROUP BY 1")
def event_failures(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k >= 50).alias("failed"))


_CHAIN = """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type || ':' || coalesce(props, '') AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    c AS (SELECT user_id, event_id, body, i, '' AS prev_hash, sha256('|' || body) AS entry_hash FROM o WHERE i = 1
      UNION ALL SELECT o.user_id, o.event_id, o.body, o.i, c.entry_hash, sha256(c.entry_hash || '|' || o.body) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)"""


def _chained(spark, sf):
    body = F.concat(F.col("event_type"), F.lit(":"), F.coalesce("props", F.lit("")))
    return ev.chain(events(spark, sf).withColumn("body", body), ["user_id"], "event_id", "body")


@query(_CHAIN + " SELECT user_id, event_id, CAST(i AS INT) AS sequence, prev_hash, entry_hash FROM c")
def event_chain(spark, sf):
    return _chained(spark, sf).select("user_id", "event_id", "sequence", "prev_hash", "entry_hash")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN user_id % 3 = 0 AND n >= 7 THEN 7 END::INT AS failed_at, CASE WHEN user_id % 3 = 0 AND n >= 7 THEN 'hash' END AS reason FROM n""")
def event_chain_verify(spark, sf):
    """Every third chain gets one altered body, which verification must find."""
    log = _chained(spark, sf)
    altered = F.when((F.col("user_id") % 3 == 0) & (F.col("sequence") == 7), F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    return ev.verify_chain(log.withColumn("body", altered), ["user_id"], "body")


_QUEUE = "SELECT user_id AS tenant, event_id AS item, ts AS since, CASE event_type WHEN 'error' THEN 'leased' WHEN 'purchase' THEN 'waiting' WHEN 'signup' THEN 'waiting' ELSE 'done' END AS state FROM events"


@query(f"""WITH q AS ({_QUEUE}), h AS (SELECT tenant, count(*) FILTER (state = 'leased') AS held FROM q WHERE state IN ('waiting', 'leased') GROUP BY 1),
    t AS (SELECT count(*) AS active, sum(held) AS all_held FROM h),
    m AS (SELECT q.*, row_number() OVER (PARTITION BY tenant ORDER BY since, item) AS nth FROM q WHERE state = 'waiting'),
    c AS (SELECT m.tenant, m.item, m.since FROM m JOIN h USING (tenant) CROSS JOIN t WHERE held + nth <= ceil(40000 / active))
    SELECT tenant, item, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY since, item) AS place FROM c) CROSS JOIN t WHERE place <= 40000 - all_held""")
def fair_lease_decision(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "error", "leased").when(kind.isin("purchase", "signup"), "waiting").otherwise("done")
    queue = events(spark, sf).select(F.col("user_id").alias("tenant"), F.col("event_id").alias("item"), F.col("ts").alias("at"), state.alias("state"))
    return ev.fair_leases(queue, 40000)


@query("""SELECT user_id, count(*) FILTER (event_type = 'signup') AS opens, count(*) FILTER (event_type = 'error') AS closes, count(*) FILTER (event_type = 'signup') > count(*) FILTER (event_type = 'error') AS open,
    arg_max(event_id, (ts, event_id)) AS watermark FROM events GROUP BY 1""")
def event_packet(spark, sf):
    """Open work and the cursor of each session."""
    opens, closes = F.count_if(F.col("event_type") == "signup"), F.count_if(F.col("event_type") == "error")
    return events(spark, sf).groupBy("user_id").agg(opens.alias("opens"), closes.alias("closes"), (opens > closes).alias("open"), F.max_by("event_id", F.struct("ts", "event_id")).alias("watermark"))


@query("SELECT (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS sessions, (SELECT count(*) FROM orders) AS runs, (SELECT max(event_id) FROM events) AS newest")
def tenant_stats(spark, sf):
    e = events(spark, sf).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("sessions"), F.max("event_id").alias("newest"))
    return beside(e, table(spark, sf, "orders").agg(F.count("*").alias("runs")))


@query("""SELECT e.event_id, o.o_orderkey AS order_key FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def event_as_of_order(spark, sf):
    """Extension: the newest order not after each error, per customer."""
    e = events(spark, sf).filter("event_type = 'error'").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("order_key"))
    return ev.as_of(e, o, ["k"], "ts", "o_orderdate", ["order_key"]).select("event_id", "order_key")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def event_time_sessions(spark, sf):
    """Extension: sessions that end after an hour without events."""
    w = F.session_window(F.col("ts").cast("timestamp"), "1 hour")
    return events(spark, sf).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


FEEDBACK = "(SELECT id, any_value(source_text) AS source_text, any_value(model_output) AS model_output, any_value(human_edit) AS human_edit, lower(regexp_extract(trim(any_value(target_lang)), '^[A-Za-z]+')) AS lang, any_value(domain) AS domain, any_value(qe_score) AS qe_score, any_value(was_accepted) AS was_accepted, any_value(was_edited) AS was_edited, any_value(edit_distance) AS edit_distance FROM translation_feedback GROUP BY id)"


def feedback(spark, sf):
    t = table(spark, sf, "translation_feedback").dropDuplicates(["id"])
    return t.withColumn("lang", F.lower(F.regexp_extract(F.trim("target_lang"), r"^[A-Za-z]+", 0)))


@query(f"SELECT lang, domain, grouping(lang, domain)::INT AS level, count(*) AS pairs, round(avg(qe_score), 6) AS quality, round(avg(was_accepted), 6) AS accepted FROM {FEEDBACK} GROUP BY GROUPING SETS ((lang, domain), (lang), (domain), ())")
def pair_stats_rollup(spark, sf):
    """Counts and mean quality by language, domain, both and none in one pass (A3)."""
    return feedback(spark, sf).cube("lang", "domain").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("pairs"), F.round(F.avg("qe_score"), 6).alias("quality"), F.round(F.avg("was_accepted"), 6).alias("accepted"))


@query(f"SELECT lang, count(*) AS n, round(avg(was_accepted), 6) AS acceptance, round(avg(was_edited), 6) AS edits, round(avg(CASE WHEN was_edited = 1 THEN edit_distance END), 6) AS distance FROM {FEEDBACK} GROUP BY 1")
def feedback_rates(spark, sf):
    return feedback(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("was_accepted"), 6).alias("acceptance"), F.round(F.avg("was_edited"), 6).alias("edits"), F.round(F.avg(F.when(F.col("was_edited") == 1, F.col("edit_distance"))), 6).alias("distance"))


@query(f"SELECT id, CASE WHEN greatest(length(o), length(h)) > 0 THEN round(levenshtein(o, h) / greatest(length(o), length(h)), 6) ELSE 0.0 END AS distance FROM (SELECT id, regexp_replace(coalesce(model_output, ''), '[^ -~]', '?', 'g') AS o, regexp_replace(human_edit, '[^ -~]', '?', 'g') AS h FROM {FEEDBACK} WHERE was_edited = 1 AND human_edit IS NOT NULL AND edit_distance > 0.02)")
def preference_pairs(spark, sf):
    """Edited outputs that moved far enough, with their recomputed distance.

    Letters beyond ASCII count as one placeholder, as DuckDB measures bytes.
    """
    f = feedback(spark, sf).filter("was_edited = 1 and human_edit is not null and edit_distance > 0.02")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^ -~]", "?")
    return f.select("id", text.edit_distance(plain(F.col("model_output")), plain(F.col("human_edit"))).alias("distance"))


@query(f"""WITH p AS (SELECT lang, qe_score, row_number() OVER (PARTITION BY lang ORDER BY id DESC) AS p FROM {FEEDBACK} WHERE qe_score IS NOT NULL), k AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM p WHERE p <= 100),
    d AS (SELECT lang, count(*) AS n, round(avg(qe_score) FILTER (p <= n - n // 2) - avg(qe_score) FILTER (p > n - n // 2), 6) AS drift FROM k GROUP BY 1)
    SELECT lang, n, CASE WHEN n >= 10 THEN drift END AS drift, CASE WHEN n < 10 THEN 'insufficient' WHEN abs(drift) > 0.05 THEN 'drift' ELSE 'stable' END AS verdict FROM d""")
def quality_drift(spark, sf):
    return ev.drift(feedback(spark, sf).filter("qe_score is not null"), ["lang"], "qe_score", [F.desc("id")])


@query(f"SELECT domain, count(*) AS n, round(avg(pow(qe_score - was_accepted, 2)), 6) AS brier, avg(pow(qe_score - was_accepted, 2)) < avg(pow(0.5 - was_accepted, 2)) AS challenger_wins FROM {FEEDBACK} WHERE qe_score IS NOT NULL AND was_accepted IS NOT NULL GROUP BY 1")
def brier_gate(spark, sf):
    """Brier score of the quality estimate against a constant one."""
    f = feedback(spark, sf).filter("qe_score is not null and was_accepted is not null")
    score = F.avg(F.pow(F.col("qe_score") - F.col("was_accepted"), 2))
    return f.groupBy("domain").agg(F.count("*").alias("n"), F.round(score, 6).alias("brier"), (score < F.avg(F.pow(0.5 - F.col("was_accepted"), 2))).alias("challenger_wins"))
