"""State of queues, leases and logs as transitions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside


def reap(queue: DataFrame, now: Column) -> DataFrame:
    """The queue after leases past their deadline went back, with one more retry (M7).

    ``queue``: state, lease_deadline, leased_at, lease_owner, retry_count beside its own columns.
    """
    late = (F.col("state") == "leased") & (F.col("lease_deadline") < now)
    keep = F.coalesce(late, F.lit(False))
    out = queue.withColumn("retry_count", F.col("retry_count") + F.when(keep, 1).otherwise(0)).withColumn("state", F.when(keep, "queued").otherwise(F.col("state")))
    # The deadline goes last: the test reads it.
    for c in ("leased_at", "lease_owner", "lease_deadline"):
        out = out.withColumn(c, F.when((F.col("state") == "queued"), F.lit(None)).otherwise(F.col(c)))
    return out


def recover(queue: DataFrame, now: Column, older: float = 300.0, attempts: int = 5) -> DataFrame:
    """The queue after running items of a dead worker went back, or failed after too many attempts (M7).

    An item that never started counts as started now.
    """
    age = F.unix_micros(now) - F.unix_micros(F.coalesce("started_at", now))
    stuck = (F.col("status") == "running") & (age >= older * 1e6)
    dead = stuck & (F.coalesce("attempts", F.lit(0)) >= attempts)
    status = F.when(dead, "failed").when(stuck, "queued").otherwise(F.col("status"))
    error = F.when(dead, "max_attempts_exceeded").otherwise(F.col("error"))
    started = F.when(stuck & ~dead, F.lit(None)).otherwise(F.col("started_at"))
    return queue.select(*(c for c in queue.columns if c not in ("status", "error", "started_at")), status.alias("status"), error.alias("error"), started.alias("started_at"))


def admission(submissions: DataFrame, tenant: str, cid: str, order: str, most: int) -> DataFrame:
    """Each submission's fate in a bounded queue that nobody empties (M6).

    The first ``most`` distinct items of a tenant are in; a copy of one that is
    in is taken without another place; what comes to a full queue is turned away.
    """
    first = submissions.groupBy(tenant, cid).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(tenant).orderBy("_first", cid)
    placed = first.withColumn("_place", F.row_number().over(w)).select(tenant, cid, "_first", "_place")
    j = submissions.join(placed, [tenant, cid])
    fate = F.when(F.col("_place") > most, "queue_full").when(F.col(order) == F.col("_first"), "admitted").otherwise("already_in")
    return j.select(*submissions.columns, fate.alias("fate"))


def arrival_order(events: DataFrame, keys: list[str], at: str, seen: str, tie: str) -> DataFrame:
    """Late events accepted and put in order at reading (M8): place by time, and whether one came after a later one."""
    by_time = Window.partitionBy(*keys).orderBy(at, tie)
    by_arrival = Window.partitionBy(*keys).orderBy(seen, tie).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("place", F.row_number().over(by_time)).withColumn("late", F.coalesce(F.col(at) < F.max(at).over(by_arrival), F.lit(False)))


def log_status(log: DataFrame, tenant: str, sequence: str, kinds: list[str], kind: str) -> DataFrame:
    """tenant, entries, last_sequence and the entries of each kind (A5)."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return log.groupBy(tenant).agg(F.count("*").alias("entries"), F.coalesce(F.max(sequence), F.lit(0)).alias("last_sequence"), *counts)


def replay(log: DataFrame, tenant: str, sequence: str, only=None) -> DataFrame:
    """The log in order, of one tenant if asked for."""
    return (log if only is None else log.filter(F.col(tenant) == only)).orderBy(tenant, sequence)


def rebuild(log: DataFrame, key: str, sequence: str, op: str, value: str) -> DataFrame:
    """key, value: a projection made anew from the log (M12): the last write of each key, none after a removal."""
    last = log.groupBy(key).agg(F.max(F.struct(F.col(sequence).alias("s"), F.col(op).alias("op"), F.col(value).alias("v"))).alias("m"))
    return last.filter("m.op <> 'remove'").select(key, F.col("m.v").alias(value))


def next_steps(registry: DataFrame, holds: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """kind, ready, blocked_by: what can be done now first, then by order of declaration.

    ``registry``: kind, position, preconditions; ``holds``: predicate, of those that are true.
    """
    r = registry if not allowed else registry.filter(F.col("kind").isin(allowed))
    need = r.select("kind", F.explode("preconditions").alias("predicate"))
    unmet = need.join(holds, "predicate", "left_anti").groupBy("kind").agg(F.array_sort(F.collect_set("predicate")).alias("missing"))
    j = r.join(unmet, "kind", "left").select("kind", "position", F.col("missing").isNull().alias("ready"), F.array_join(F.coalesce("missing", F.array().cast("array<string>")), ",").alias("blocked_by"))
    return j.orderBy(F.desc("ready"), "position")


def policy_gaps(counts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """gap, severity of the rules whose condition the one row of counts meets."""
    hits = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("gap"), F.lit(s).alias("severity"))) for n, c, s in rules))
    return counts.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("g")).select("g.gap", "g.severity")


def snapshot_packet(events: DataFrame, key: str, order: str, kind: str, n: int, opens: str, closes: str) -> DataFrame:
    """key, newest (the ids of the newest ``n`` events), head, open, total on one snapshot (M3)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    numbered = events.withColumn("_n", F.row_number().over(w))
    newest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= n, F.struct(F.col("_n").alias("n"), F.col(order).alias("id"))))), lambda x: x["id"].cast("string")), ",")
    state = F.count_if(F.col(kind) == opens) > F.count_if(F.col(kind) == closes)
    return numbered.groupBy(key).agg(newest.alias("newest"), F.max(order).alias("head"), state.alias("open"), F.count("*").alias("total"))


def entity_stats(vertices: DataFrame, edges: DataFrame, chunks: DataFrame, kind: str = "kind") -> DataFrame:
    """nodes, edges, chunks, unknown_chunks."""
    one = vertices.agg(F.count("*").alias("nodes")).transform(beside, edges.agg(F.count("*").alias("edges")))
    return one.transform(beside, chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col(kind) == "UNKNOWN").alias("unknown_chunks")))
