"""Queries over queues, leases, logs and streams."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from loomspan.operators import events as ev
from loomspan.operators import queues
from loomspan.plans.registry import query
from loomspan.session import shared_folder
from loomspan.sources.tables import table
from loomspan.streaming import events as st

_Q = "(SELECT event_id AS cid, user_id AS tenant, CASE event_type WHEN 'view' THEN 'leased' WHEN 'click' THEN 'queued' ELSE 'done' END AS state, event_id % 1000 AS lease_deadline, CAST(user_id % 3 AS INT) AS retry_count FROM events)"


def _queue(spark, sf):
    e = table(spark, sf, "events")
    state = F.when(F.col("event_type") == "view", "leased").when(F.col("event_type") == "click", "queued").otherwise("done")
    return e.select(F.col("event_id").alias("cid"), F.col("user_id").alias("tenant"), state.alias("state"), (F.col("event_id") % 1000).alias("lease_deadline"), (F.col("user_id") % 3).cast("int").alias("retry_count"), F.lit("w").alias("lease_owner"), F.col("event_id").alias("leased_at"))


@query(f"SELECT cid, CASE WHEN late THEN 'queued' ELSE state END AS state, retry_count + CASE WHEN late THEN 1 ELSE 0 END AS retry_count, CASE WHEN late OR state = 'queued' THEN NULL ELSE lease_deadline END AS lease_deadline FROM (SELECT *, state = 'leased' AND lease_deadline < 400 AS late FROM {_Q})")
def reaped_leases(spark, sf):
    """Leases past their deadline taken back (M7)."""
    return queues.reap(_queue(spark, sf), F.lit(400)).select("cid", "state", "retry_count", "lease_deadline")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), w AS (SELECT event_id AS item, ts, event_type = 'view' AS running, user_id % 8 AS attempts, epoch_us(now) - epoch_us(ts) >= 86400000000 * 5 AS old FROM events, n)
    SELECT item, CASE WHEN running AND old AND attempts >= 5 THEN 'failed' WHEN running AND old THEN 'queued' WHEN running THEN 'running' ELSE 'done' END AS status, CASE WHEN running AND old AND attempts >= 5 THEN 'max_attempts_exceeded' END AS error FROM w""")
def recovered_work(spark, sf):
    """Running items of dead workers requeued, or failed after five attempts (M7); five days count as dead here."""
    e = table(spark, sf, "events")
    w = e.select(F.col("event_id").alias("item"), F.col("ts").cast("timestamp").alias("started_at"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), (F.col("user_id") % 8).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return queues.recover(w, e.select(F.max(F.col("ts").cast("timestamp"))).scalar(), older=86400.0 * 5).select("item", "status", "error")


@query("""WITH s AS (SELECT event_id, user_id AS tenant, event_type || (event_id % 7) AS cid FROM events), f AS (SELECT tenant, cid, min(event_id) AS first FROM s GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first, cid) AS place FROM f)
    SELECT event_id, CASE WHEN place > 10 THEN 'queue_full' WHEN event_id = first THEN 'admitted' ELSE 'already_in' END AS fate FROM s JOIN p USING (tenant, cid)""")
def bounded_admission(spark, sf):
    """Submissions to bounded queues of ten distinct items a tenant (M6)."""
    s = table(spark, sf, "events").select("event_id", F.col("user_id").alias("tenant"), F.concat("event_type", F.col("event_id") % 7).alias("cid"))
    return queues.admission(s, "tenant", "cid", "event_id", 10).select("event_id", "fate")


@query("SELECT page_id, place, coalesce(fetched_at < latest, false) AS late FROM (SELECT page_id, fetched_at, CAST(row_number() OVER (PARTITION BY host ORDER BY fetched_at, page_id) AS INT) AS place, max(fetched_at) OVER (PARTITION BY host ORDER BY received_at, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT page_id, any_value(host) AS host, min(fetched_at) AS fetched_at, min(received_at) AS received_at FROM crawl_pages GROUP BY 1))")
def late_pages(spark, sf):
    """Late records accepted, and put in order where they are read (M8)."""
    p = table(spark, sf, "crawl_pages").groupBy("page_id").agg(F.first("host").alias("host"), F.min("fetched_at").alias("fetched_at"), F.min("received_at").alias("received_at"))
    return queues.arrival_order(p, ["host"], "fetched_at", "received_at", "page_id").select("page_id", "place", "late")


@query("SELECT user_id AS tenant, count(*) AS entries, max(event_id) AS last_sequence, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1")
def log_status(spark, sf):
    """Depth, last sequence and projection counts of each tenant's log (A5)."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "tenant")
    return queues.log_status(e, "tenant", "event_id", ["view", "error"], "event_type")


@query("SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY event_id")
def replayed_log(spark, sf):
    """One tenant's log in order."""
    return queues.replay(table(spark, sf, "events"), "user_id", "event_id", 8).select("event_id", "event_type")


@query("SELECT key, value FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1) WHERE kind <> 'error'")
def rebuilt_projection(spark, sf):
    """A projection made anew from the log; errors remove."""
    e = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("int").alias("key"), "event_id", F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"), "value")
    return queues.rebuild(e, "key", "event_id", "op", "value")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def newest_by_user(spark, sf):
    return ev.newest(table(spark, sf, "events"), ["user_id"], "event_id", "event_id", 1).select("event_id", "user_id", "event_type")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FILTER (n <= 5) AS newest, max(event_id) AS head, count(*) FILTER (event_type = 'view') > count(*) FILTER (event_type = 'click') AS open, count(*) AS total FROM n GROUP BY 1""")
def snapshot_packets(spark, sf):
    """Newest events, head and state of each session on one snapshot (M3)."""
    return queues.snapshot_packet(table(spark, sf, "events"), "user_id", "event_id", "event_type", 5, "view", "click")


@query("SELECT kind, ready, blocked_by FROM (VALUES ('search', true, ''), ('report', true, ''), ('publish', false, 'reviewed')) t(kind, ready, blocked_by)")
def possible_steps(spark, sf):
    """What can be done next, ready steps first."""
    r = spark.createDataFrame([("search", 0, ["has_events"]), ("publish", 1, ["has_events", "reviewed"]), ("report", 2, []), ("erase", 3, [])], "kind string, position int, preconditions array<string>")
    holds = table(spark, sf, "events").limit(1).select(F.lit("has_events").alias("predicate"))
    return queues.next_steps(r, holds, ["search", "publish", "report"]).select("kind", "ready", "blocked_by")


@query("SELECT gap, severity FROM (SELECT 'no-documents' AS gap, 'high' AS severity, (SELECT count(*) FROM documents) = 0 AS hit UNION ALL SELECT 'null-texts', 'medium', (SELECT count(*) FROM documents WHERE text IS NULL) > 0 UNION ALL SELECT 'late', 'low', true) WHERE hit")
def policy_gap_report(spark, sf):
    """Rules whose condition a run's counts meet."""
    counts = table(spark, sf, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("empty"))
    return queues.policy_gaps(counts, [("no-documents", "documents = 0", "high"), ("null-texts", "empty > 0", "medium"), ("late", "documents >= 0", "low")])


@query("SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM orders) AS edges, count(*) AS chunks, count(*) FILTER (coalesce(chunk_kind, 'UNKNOWN') = 'UNKNOWN') AS unknown_chunks FROM chunks")
def entity_graph_stats(spark, sf):
    """Counts of an entity graph."""
    c = table(spark, sf, "chunks").select(F.coalesce("chunk_kind", F.lit("UNKNOWN")).alias("kind"))
    return queues.entity_stats(table(spark, sf, "customer"), table(spark, sf, "orders"), c)


def _stream(spark, sf):
    """The events table as a stream of files, each of them read twice to bring copies in."""
    path = f"{sf}/events.parquet"
    folder = path if glob.glob(f"{path}/*") else f"{sf}/events*.parquet"
    return st.source(spark, folder, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def _run(spark, df, name, mode):
    folder = shared_folder(spark)
    return st.run_once(df, f"{name}_{folder[-8:]}", mode, folder)


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_once(spark, sf):
    """A stream of events in which each id comes twice, appended once each."""
    e = _stream(spark, sf)
    return _run(spark, st.once(e.union(e)).select("event_id", "user_id", "event_type"), "once", "append")


@query("SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS event_count, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1")
def stream_heads(spark, sf):
    """Session heads kept by a stream (M2)."""
    return _run(spark, st.heads(_stream(spark, sf)), "heads", "complete")


@query("SELECT user_id, count(*) AS events, count(*) AS admitted FROM events GROUP BY 1")
def stream_bucket(spark, sf):
    """A token bucket a user with room for every event (M5): all of them are admitted, in one state a user."""
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(spark, st.token_bucket(e, 0.001, 1e9), "bucket", "append")
    return got.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("admitted").alias("admitted"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events) SELECT user_id, count(*) AS events, least(count(*), 3) AS admitted FROM e GROUP BY 1")
def stream_bucket_dry(spark, sf):
    """The same bucket with three tokens that never refill (M5)."""
    e = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = _run(spark, st.token_bucket(e, 0.0, 3.0), "dry", "append")
    return got.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("admitted").alias("admitted"))
