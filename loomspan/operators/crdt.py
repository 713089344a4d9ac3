"""Merging replicated state: sets, observed-remove sets, registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gset(*states: DataFrame) -> DataFrame:
    """Union of grow-only sets."""
    out = states[0]
    for s in states[1:]:
        out = out.union(s)
    return out.distinct()


def orset_value(adds: DataFrame, removes: DataFrame, keys: list[str]) -> DataFrame:
    """Visible elements: those with an added tag that no removal has seen (U3). Add wins over a concurrent remove."""
    return adds.select(*keys, "tag").join(removes.select(*keys, "tag"), [*keys, "tag"], "left_anti").select(*keys).distinct()


def lww(states: DataFrame, keys: list[str], value: str = "value", seq: str = "seq", head: str = "head") -> DataFrame:
    """keys, value, seq, head of the newest write by (seq, head) (U4)."""
    return states.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("seq"), F.col(head).alias("head"), F.col(value).alias("value"))).alias("m")).select(*keys, "m.value", "m.seq", "m.head")


def reconverge(states: DataFrame, keys: list[str]) -> DataFrame:
    """One newest state per key; keys whose replicas disagree on the type are an error."""
    bad = states.groupBy(*keys).agg(F.countDistinct("type").alias("t")).filter("t > 1")
    if not bad.isEmpty():
        raise ValueError(f"type mismatch for {bad.first().asDict()}")
    return lww(states, keys)


def line_changes(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """key, added, removed, changed: lines of one text that the other lacks, duplicates kept."""
    a, b = F.split(F.coalesce(old, F.lit("")), "\n"), F.split(F.coalesce(new, F.lit("")), "\n")
    add, rem = F.filter(b, lambda x: ~F.array_contains(a, x)), F.filter(a, lambda x: ~F.array_contains(b, x))
    n = F.size(a) + F.size(b)
    return df.select(key, F.size(add).alias("added"), F.size(rem).alias("removed"), F.round((F.size(add) + F.size(rem)) / n, 6).alias("changed"))


def reduce_findings(findings: DataFrame) -> DataFrame:
    """finding_id, kind, target, severity, confidence, sources, tags, score, place.

    Findings of one kind, target and first evidence are one; severity and
    confidence are the highest, sources and tags are united. Score: severity x
    confidence, raised by a tenth for each further source up to half.
    """
    first = F.coalesce(F.get("evidence", F.lit(0)), F.lit(""))
    g = findings.groupBy("kind", "target", first.alias("evidence")).agg(F.max("severity").alias("severity"), F.max("confidence").alias("confidence"), F.count_distinct("source").alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    score = F.round(F.col("severity") * F.col("confidence") * (1 + F.least(F.lit(0.5), 0.1 * (F.col("sources") - 1))), 6)
    return g.select(F.substring(F.sha2(F.concat_ws("|", "kind", "target", "evidence"), 256), 1, 16).alias("finding_id"), "kind", "target", "severity", "confidence", "sources", F.array_join("tags", ",").alias("tags"), score.alias("score"))


def suppress(findings: DataFrame, baseline: DataFrame, least: int = 2) -> DataFrame:
    """Findings whose id was not dismissed ``least`` times before."""
    return findings.join(baseline.filter(F.col("dismiss_count") >= least).select("finding_id"), "finding_id", "left_anti")
