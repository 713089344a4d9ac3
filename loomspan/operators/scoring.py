"""Small scoring operators on columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside


def overlap_score(query: list[str], name: Column, intent: Column) -> Column:
    """Three points for a query token in the name, one in the intent, over the query's tokens."""
    q = F.array(*(F.lit(t) for t in dict.fromkeys(query)))
    return F.round((3 * F.size(F.array_intersect(q, name)) + F.size(F.array_intersect(q, intent))) / max(1, len(set(query))), 6)


def decisiveness(scores: Column) -> Column:
    """Best score less the second best (P44); the best alone if there is no other."""
    s = F.sort_array(F.filter(scores, lambda x: x.isNotNull()), False)
    return F.when(F.size(s) >= 2, s[0] - s[1]).when(F.size(s) == 1, s[0]).otherwise(0.0)


def geometric_mean(scores: Column) -> Column:
    """Geometric mean of the known scores, 0 if one is not positive."""
    s = F.filter(scores, lambda x: x.isNotNull())
    logs = F.aggregate(F.transform(s, lambda x: F.log(F.greatest(x, F.lit(1e-300)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(s) == 0, 0.0).when(F.exists(s, lambda x: x <= 0), 0.0).otherwise(F.exp(logs / F.size(s)))


def softmax(scores: Column, temperature: float = 0.05) -> Column:
    """Probabilities of scores at a temperature."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def surprisal(p: Column) -> Column:
    """-log2 p, infinite for 0."""
    return F.when(p > 0, -F.log2(p)).otherwise(F.lit(float("inf")))


def divergence(p: DataFrame, q: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bits: divergence of one distribution over outcomes from another.

    Both: keys, outcome, p. Infinite where an outcome of the first is
    impossible in the second.
    """
    j = p.select(*keys, "outcome", F.col("p").alias("a")).join(q.select(*keys, "outcome", F.col("p").alias("b")), [*keys, "outcome"], "left").filter("a > 0")
    bits = F.sum(F.when(F.coalesce("b", F.lit(0.0)) > 0, F.col("a") * F.log2(F.col("a") / F.col("b"))))
    lost = F.max(F.coalesce("b", F.lit(0.0)) <= 0)
    return j.groupBy(*keys).agg(F.when(lost, F.lit(float("inf"))).otherwise(F.round(bits, 6)).alias("bits"))


def composite_risk(base: Column, reach: Column, privileged: Column, dismissals: Column) -> Column:
    """Base plus a fifth of the reach plus privilege less a history penalty of at most a fifth, within 0 and 1."""
    r = base + 0.2 * reach + privileged - F.least(F.lit(0.2), 0.1 * dismissals)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)), 6)


def severity(risk: Column) -> Column:
    return F.when(risk >= 0.9, "critical").when(risk >= 0.7, "high").when(risk >= 0.4, "medium").otherwise("low")


def related(query: list[str], tokens: Column) -> Column:
    """Whether a token of at least three letters is shared; an empty query passes."""
    q = [t for t in query if len(t) >= 3]
    return F.arrays_overlap(F.array(*(F.lit(t) for t in q)), tokens) if q else F.lit(True)


def prefix_clusters(symbols: DataFrame, name: str, least: int = 2) -> DataFrame:
    """prefix, members of names that share what stands before their first underscore."""
    p = symbols.filter(F.col(name).contains("_")).select(F.substring_index(name, "_", 1).alias("prefix"), name).distinct()
    return p.groupBy("prefix").agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def distinct_values(constants: DataFrame, name: str, value: str) -> DataFrame:
    """Names with more than one value."""
    return constants.groupBy(name).agg(F.countDistinct(value).alias("values")).filter("values > 1")


def cooccurrence(mentions: DataFrame, chunk: str, position: str, kind: str, node: str) -> DataFrame:
    """src, dst, n: nodes of different kinds in one chunk, the earlier first.

    Each node counts once per chunk at its first place, so that a chunk pairs
    its distinct nodes only.
    """
    first = mentions.groupBy(chunk, kind, node).agg(F.min(position).alias("at"))
    a = first.select(chunk, F.col(kind).alias("ka"), F.col(node).alias("src"), F.col("at").alias("pa"))
    b = first.select(chunk, F.col(kind).alias("kb"), F.col(node).alias("dst"), F.col("at").alias("pb"))
    return a.join(b, chunk).filter("ka <> kb and pa < pb").groupBy("src", "dst").agg(F.count("*").alias("n"))


def merge_arms(arms: dict[str, DataFrame]) -> DataFrame:
    """key, arms, hits of several result lists merged by address without query and trailing slash."""
    every = None
    for name, df in arms.items():
        one = df.select(F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), r"/+$", "").alias("key"), F.lit(name).alias("arm"))
        every = one if every is None else every.union(one)
    return every.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"), F.count("*").alias("hits"))


def islands(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """keys, streak: longest run of rows in order for which ``flag`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    g = rows.withColumn("_g", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.filter(flag).groupBy(*keys, "_g").agg(F.count("*").alias("n"))
    every = rows.select(*keys).distinct()
    return every.join(runs.groupBy(*keys).agg(F.max("n").alias("streak")), keys, "left").na.fill(0, ["streak"])


def work_mix(messages: DataFrame, keys: list[str], text: str, classes: dict[str, list[str]], default: str) -> DataFrame:
    """keys, class, share: weighted share of each class of work, the first matching set decides (Z5). Commands weigh 0.3."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    name = F.lit(default)
    for c, ws in reversed(classes.items()):
        name = F.when(F.greatest(*(low.contains(w) for w in ws), F.lit(False)), c).otherwise(name)
    weight = F.when(low.startswith("/"), 0.3).otherwise(1.0)
    m = messages.select(*keys, name.alias("class"), weight.alias("w")).groupBy(*keys, "class").agg(F.sum("w").alias("w"))
    return m.select(*keys, "class", F.round(F.col("w") / F.sum("w").over(Window.partitionBy(*keys)), 6).alias("share"))


def next_state(log: DataFrame, key: str) -> DataFrame:
    """key, status of each transaction after its log (Z13): superseded, else abandoned, else committed, else pending."""
    has = lambda k: F.max(F.col("op") == k)
    s = log.groupBy(key).agg(has("supersede").alias("s"), has("abandon").alias("a"), has("commit").alias("c"))
    return s.select(key, F.when(F.col("s"), "superseded").when(F.col("a"), "abandoned").when(F.col("c"), "committed").otherwise("pending").alias("status"))


def backoff(errors: Column, base: float, seed: Column) -> Column:
    """Waiting time after errors: doubled up to six times, at most a minute, spread by a seed."""
    return F.least(F.lit(60.0), base * F.pow(F.lit(2.0), F.least(errors, F.lit(6)))) + F.pmod(seed, F.lit(int(max(1, base * 1000 / 4)))) / 1000.0


def fold_frontier(seen: DataFrame, found: DataFrame, most_depth: int) -> DataFrame:
    """url, depth of the addresses to visit next, shallow ones first."""
    new = found.filter(F.col("depth") <= most_depth).groupBy("url").agg(F.min("depth").alias("depth"))
    return new.join(seen.select("url"), "url", "left_anti")


def propagation(impacted: DataFrame, betweenness: DataFrame, rank: DataFrame) -> DataFrame:
    """id, score: nearness to the change, raised for gatekeepers and central vertices.

    ``impacted``: id, distance in edges; a path of n edges has n + 1 vertices.
    """
    j = impacted.join(betweenness, "id", "left").join(rank, "id", "left")
    s = F.pow(F.col("distance") + 1, F.lit(-1.5)) * (1 + 5 * F.coalesce("betweenness", F.lit(0.0))) * (1 + 10 * F.coalesce("rank", F.lit(0.0)))
    return j.groupBy("id").agg(F.round(F.max(s), 6).alias("score"))


def activation(weights: DataFrame, node: str, other: str, weight: str, top: int = 5, least: float = 0.2) -> DataFrame:
    """The ``top`` strongest partners of each node above a weight."""
    w = Window.partitionBy(node).orderBy(F.desc(weight), other)
    return weights.filter(F.col(weight) > least).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def patterns(degrees: DataFrame) -> DataFrame:
    """id, pattern of vertices that stand out: orphans, hubs above three times the mean, unstable ones."""
    mean = degrees.agg(F.avg(F.col("out_degree") + F.col("in_degree")).alias("mean"))
    d = degrees.transform(beside, mean)
    name = F.when(F.col("orphan"), "orphan").when(F.col("out_degree") + F.col("in_degree") > 3 * F.col("mean"), "hub").when((F.col("instability") > 0.8) & (F.col("in_degree") >= 3), "unstable")
    return d.select("id", name.alias("pattern")).filter("pattern is not null")


def fingerprint(*columns: str) -> Column:
    """Content id of some columns as canonical JSON, in order of their names."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def escalate(arms: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """(label, rung) of the first arm whose confidence reaches its threshold (E4), null if none does."""
    label = F.coalesce(*(F.when(c >= t, a) for a, c, t in arms))
    return label, F.coalesce(*(F.when(c >= t, F.lit(i)) for i, (_, c, t) in enumerate(arms)))


def clocked_state(log: DataFrame, key: str, tick: str, window: int, now: Column) -> DataFrame:
    """key, status of transactions over a logical clock.

    ``log``: key, tick, op (propose, abandon, supersede; others do nothing). A
    proposal commits ``window`` ticks after its last submission; abandoning works
    until then only, superseding always. What was never proposed has no status.
    """
    at = lambda op: F.max(F.when(F.col("op") == op, F.col(tick)))
    s = log.groupBy(key).agg(at("propose").alias("p"), at("abandon").alias("a"), F.max(F.col("op") == "supersede").alias("s")).filter("p is not null")
    due = F.col("p") + window
    status = F.when(F.col("s"), "superseded").when((F.col("a") > F.col("p")) & (F.col("a") < due), "abandoned").when(now < due, "pending").otherwise("committed")
    return s.select(key, status.alias("status"))
