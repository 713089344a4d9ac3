"""Event and sequence operators: queues, heads, gaps, entropy, anomaly scores, hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate
from itertools import chain as chain_of

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside


def status_counts(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """status, n of every known status, absent ones with 0, and ``total`` (A1). Null counts as ``unknown``."""
    s = F.coalesce(F.col(status), F.lit("unknown"))
    one = df.agg(*(F.count_if(s == k).alias(k) for k in known), F.count("*").alias("total"))
    return one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in [*known, "total"])), F.array(*(F.col(k) for k in [*known, "total"])))).alias("status", "n"))


def heads(events: DataFrame, keys: list[str], arrival: str, kind: str, at: str) -> DataFrame:
    """First and last event by arrival, count and last kind of each session (W12). One aggregation."""
    return events.groupBy(*keys).agg(F.min(arrival).alias("first_event"), F.max(arrival).alias("last_event"), F.count("*").alias("event_count"), F.max_by(kind, arrival).alias("last_kind"), F.max(at).alias("latest"))


def _by(keys: list[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def gaps(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """gap_ms to the previous event of the same key, null for the first."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("gap_ms", F.round((us - F.lag(us).over(_by(keys, at, tie))) / 1000.0, 1))


def newest(events: DataFrame, keys: list[str], at: str, tie: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    return events.withColumn("place", F.row_number().over(_by(keys, F.desc(at), F.desc(tie)))).filter(F.col("place") <= n)


def kind_entropy(events: DataFrame, keys: list[str], kind: str, at: str, tie: str, window: int = 10) -> DataFrame:
    """entropy: of the kinds among the last ``window`` events, as a share of the most possible in percent."""
    last = F.collect_list(kind).over(_by(keys, at, tie).rowsBetween(-(window - 1), 0))
    n = F.size("_k")
    p = F.transform(F.array_distinct("_k"), lambda k: F.size(F.filter("_k", lambda x: x == k)) / n)
    bits = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x))
    # Half to even, after rounding errors of the logarithms are taken off.
    score = F.when(n > 1, F.bround(F.round(100 * bits / F.log2(n), 9), 0)).otherwise(0.0).cast("int")
    return events.withColumn("_k", last).withColumn("entropy", score).drop("_k")


def throughput(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """tps: events over their span in seconds, 0 for fewer than two or no span."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    span = (F.max(us) - F.min(us)) / 1e6
    n = F.count(at)
    return events.groupBy(*keys).agg(F.when((n >= 2) & (span > 0), F.round(n / span, 6)).otherwise(0.0).alias("tps"))


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2


def robust_z(events: DataFrame, keys: list[str], value: str, at: str, tie: str, window: int = 20) -> DataFrame:
    """z of each value against median and MAD of the ``window`` values before it (W1); 0 with fewer than two."""
    base = F.collect_list(value).over(_by(keys, at, tie).rowsBetween(-window, -1))
    med = events.withColumn("_b", base).withColumn("_m", F.when(F.size("_b") >= 2, _median(F.col("_b"))))
    dev = F.transform("_b", lambda x: F.abs(x - F.col("_m")))
    med = med.withColumn("_d", F.when(F.size("_b") >= 2, _median(dev)))
    mad = F.when(F.col("_d") == 0, 1e-9).otherwise(F.col("_d"))
    return med.withColumn("z", F.coalesce(F.round(F.abs(F.col(value) - F.col("_m")) / (1.4826 * mad), 4), F.lit(0.0))).drop("_b", "_m", "_d")


def fold(df: DataFrame, keys: list[str], order: list[str], needs: str, out: str, start: Callable, run: Callable) -> DataFrame:
    """``df`` with a column per field of ``out``: a sequential pass over each key's rows in order.

    ``run(state, values) -> (state, lists)`` gets the values of ``needs`` in a stretch of one key's
    rows, beginning with ``start()``. Rows stream through a task sorted by key, so memory is one
    batch and one state however many rows a key has; keys run in parallel.
    """
    fields = [f.strip() for f in out.split(",")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *fields])
    new = [f.split()[0] for f in fields]

    def fold_batches(batches):
        last, state = object(), None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            pdf = pdf.reset_index(drop=True)
            first = np.zeros(n, bool)
            first[0] = True
            for k in keys:
                v = pdf[k]
                first[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy()[1:]
            at = [*np.flatnonzero(first).tolist(), n]
            values, heads = pdf[needs].tolist(), zip(*(pdf[k].iloc[at[:-1]].tolist() for k in keys), strict=True)
            got: list[list] = [[] for _ in new]
            for i, j, head in zip(at, at[1:], heads, strict=False):
                key = tuple(None if pd.isna(x) else x for x in head)
                if key != last:
                    last, state = key, start()
                state, lists = run(state, values[i:j])
                for g, x in zip(got, lists, strict=True):
                    g += x
            yield pdf.assign(**dict(zip(new, got, strict=True)))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold_batches, schema)


def smoothed(events: DataFrame, keys: list[str], value: str, at: str, tie: str, alpha: float = 0.3) -> DataFrame:
    """keys, at, tie, value, smooth: exponentially weighted average up to each row, the first value as it is."""

    def run(state, values):
        x = map(float, values)
        out = list(accumulate(x if state is None else chain_of([state], x), lambda s, v: alpha * v + (1 - alpha) * s))
        out = out if state is None else out[1:]
        return out[-1], (out,)

    return fold(events.select(*keys, at, tie, value), keys, [at, tie], value, "smooth double", lambda: None, run)


def ewma(events: DataFrame, keys: list[str], value: str, at: str, tie: str, alpha: float = 0.3) -> DataFrame:
    """keys, n, ewma: the smoothed value after the last of each key's values."""
    s = smoothed(events, keys, value, at, tie, alpha)
    return s.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max_by("smooth", F.struct(at, tie)), 6).alias("ewma"))


def ewma_deviation(events: DataFrame, keys: list[str], value: str, at: str, tie: str, alpha: float = 0.3) -> DataFrame:
    """keys, deviation of the last value from the smoothed ones in residual deviations (W3), 0 for fewer than three.

    The residuals of all values but the last count, each against the average
    that includes it.
    """
    s = smoothed(events, keys, value, at, tie, alpha).withColumn("smooth", F.round("smooth", 6))
    w = _by(keys, at, tie)
    r = s.withColumn("before", F.lag("smooth").over(w)).withColumn("next", F.lead(value).over(w))
    # Of every row but the last there is a next one.
    sigma = F.stddev_samp(F.when(F.col("next").isNotNull(), F.col(value) - F.col("smooth")))
    sigma = F.when(sigma == 0, 1e-9).otherwise(sigma)
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col("before").alias("b")), F.struct(at, tie))
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), last.alias("l"), sigma.alias("sigma"))
    return g.select(*keys, F.when(F.col("n") >= 3, F.round(F.abs(F.col("l.v") - F.col("l.b")) / F.col("sigma"), 4)).otherwise(0.0).alias("deviation"))


def sequence_numbers(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """sequence: position of each event within its key, from 1."""
    return events.withColumn("sequence", F.row_number().over(_by(keys, at, tie)))


def chain(events: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """keys, order, body, sequence, prev_hash, entry_hash: SHA-256 chain of each key (K7).

    Each hash takes the one before it, which is sequential within a key and
    parallel across keys.
    """

    def run(state, values):
        n, prev = state
        before, after = [], []
        for x in values:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{x}".encode()).hexdigest()
            after.append(prev)
        return (n + len(after), prev), (list(range(n + 1, n + len(after) + 1)), before, after)

    return fold(events.select(*keys, order, body), keys, [order], body, "sequence int, prev_hash string, entry_hash string", lambda: (0, ""), run)


def verify_chain(log: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys, n, failed_at, reason: first broken entry of each chain (W7), null where it holds.

    Contiguity, linkage and the recomputed hash are checked row by row with one
    ``lag``; the first failure is an aggregate.
    """
    w = _by(keys, "sequence")
    want_prev = F.coalesce(F.lag("entry_hash").over(w), F.lit(""))
    reason = (
        F.when(F.col("sequence") != F.row_number().over(w), "gap")
        .when(F.col("prev_hash") != want_prev, "link")
        .when(F.col("entry_hash") != F.sha2(F.concat_ws("|", "prev_hash", body), 256), "hash")
    )
    r = log.withColumn("_r", reason)
    bad = F.when(F.col("_r").isNotNull(), F.col("sequence"))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.min(bad).alias("failed_at"), F.min_by("_r", bad).alias("reason"))


def fair_leases(queue: DataFrame, capacity: int, waiting: str = "waiting", leased: str = "leased") -> DataFrame:
    """tenant, item, place of the items to lease next.

    ``queue``: tenant, item, state, at. A tenant may hold at most the ceiling of
    capacity over active tenants; free slots go to the oldest waiting items.
    Which item would be leased is decided here; mutual exclusion is the store's.
    """
    held = queue.groupBy("tenant").agg(F.count_if(F.col("state") == leased).alias("held"), F.count_if(F.col("state").isin(waiting, leased)).alias("live")).filter("live > 0")
    # One row of totals.
    totals = held.agg(F.count("*").alias("active"), F.sum("held").alias("all_held"))
    share = F.ceil(F.lit(capacity) / F.col("active"))
    w = Window.partitionBy("tenant").orderBy("at", "item")
    mine = queue.filter(F.col("state") == waiting).withColumn("nth", F.row_number().over(w))
    may = mine.join(held, "tenant").transform(beside, totals).filter(F.col("held") + F.col("nth") <= share)
    # Never more than the free slots, so the global order needs the top of each task only.
    free = F.lit(capacity) - F.col("all_held")
    place = F.row_number().over(Window.orderBy("at", "item"))
    return may.orderBy("at", "item").limit(capacity).withColumn("place", place).filter(F.col("place") <= free).select("tenant", "item", "place")


def drift(rows: DataFrame, keys: list[str], value: str, order: list, window: int = 100, least: int = 10, step: float = 0.05) -> DataFrame:
    """keys, n, drift, verdict: mean of the newer half less the older half of the newest ``window`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = rows.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= window)
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    half = F.floor(F.col("_n") / 2)
    newer = F.avg(F.when(F.col("_p") <= F.col("_n") - half, F.col(value)))
    older = F.avg(F.when(F.col("_p") > F.col("_n") - half, F.col(value)))
    d = r.groupBy(*keys).agg(F.count("*").alias("n"), F.round(newer - older, 6).alias("drift"))
    verdict = F.when(F.col("n") < least, "insufficient").when(F.abs("drift") > step, "drift").otherwise("stable")
    return d.select(*keys, "n", F.when(F.col("n") >= least, F.col("drift")).alias("drift"), verdict.alias("verdict"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str]) -> DataFrame:
    """The newest ``right`` row not after each ``left`` row (W15): one sort per key, no pairs."""
    l2 = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).alias(f"_r_{c}") for c in columns))
    r2 = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    both = l2.unionByName(r2, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_r_{c}").alias(c) for c in columns))), ignorenulls=True).over(w)
    return both.withColumn("_m", seen).filter("_side = 1").select(*left.columns, *(F.col(f"_m.{c}").alias(c) for c in columns))
