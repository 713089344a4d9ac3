"""Filters, lookups and orderings over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside


def contains_text(df: DataFrame, text: str, needle: str, limit: int) -> DataFrame:
    """Rows whose text has the needle in any case, at most ``limit`` (F1)."""
    return df.filter(F.lower(text).contains(needle.lower())).limit(limit)


def vertex_query(v: DataFrame, kind: str | None = None, like: str | None = None, limit: int = 100) -> DataFrame:
    """Vertices by type and a part of their id or label, in order of type and label (F2)."""
    if kind is not None:
        v = v.filter(F.col("type") == kind)
    if like is not None:
        v = v.filter(F.lower("id").contains(like.lower()) | F.lower("label").contains(like.lower()))
    return v.orderBy("type", "label", "id").limit(limit)


def edge_query(e: DataFrame, rel: str | None = None, like: str | None = None, limit: int = 100) -> DataFrame:
    """Edges by relation and a part of either end or the relation."""
    if rel is not None:
        e = e.filter(F.col("rel") == rel)
    if like is not None:
        e = e.filter(F.lower("src").contains(like.lower()) | F.lower("dst").contains(like.lower()) | F.lower("rel").contains(like.lower()))
    return e.orderBy("rel", "src", "dst").limit(limit)


def tier_visible(tier: Column, mine: str) -> Column:
    """Own, world and untiered rows (F4): null is visible."""
    return tier.isNull() | tier.isin(mine, "world")


def tenant_visible(tenant: Column, mine: str) -> Column:
    """Own and world rows (F5): null and empty are not visible."""
    return F.coalesce(tenant.isin(mine, "world"), F.lit(False))


def visible(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a replicated set."""
    return df.join(members.select(key), key, "left_semi")


def defines(v: DataFrame, symbol: str) -> DataFrame:
    """Vertices that define a name with the symbol in it."""
    return v.filter(F.exists("defines", lambda d: d.contains(symbol)))


def resolve(v: DataFrame, name: str) -> DataFrame:
    """The vertices a name stands for (G18): by exact id or label if any, else by a part of the label."""
    low = name.lower()
    rank = F.when((F.col("id") == name) | (F.lower("label") == low), 1).when(F.lower("label").contains(low), 2)
    r = v.withColumn("rank", rank).filter("rank is not null")
    best = r.agg(F.min("rank").alias("best"))
    return r.transform(beside, best).filter("rank = best").drop("best")


def concept_ladder(concepts: DataFrame, queries: DataFrame) -> DataFrame:
    """query, slug: slug, then alias, then token, then part of the label, the most frequent first.

    ``concepts``: slug, label, aliases, occurrences; ``queries``: query. The
    first three rungs are equality joins on keys; parts of labels are looked up
    for the queries that are still open, by their three-letter pieces.
    """
    q = queries.select("query", F.lower(F.trim("query")).alias("q")).filter("q <> ''")
    tokens = F.array_distinct(F.split(F.lower("label"), r"\s+"))
    keys = concepts.select("slug", "occurrences", F.lit(1).alias("rung"), F.lower("slug").alias("k"))
    keys = keys.union(concepts.select("slug", "occurrences", F.lit(2), F.explode(F.transform("aliases", F.lower))))
    keys = keys.union(concepts.select("slug", "occurrences", F.lit(3), F.explode(tokens)))
    hit = q.join(keys, q.q == keys.k).select("query", "slug", "occurrences", "rung")
    open_ones = q.join(hit.select("query"), "query", "left_anti").filter(F.length("q") >= 3)
    piece = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))))
    grams = concepts.filter(F.length("label") >= 3).select("slug", "occurrences", F.lower("label").alias("l"), piece(F.lower("label")).alias("g"))
    part = open_ones.select("query", "q", F.substring("q", 1, 3).alias("g")).join(grams, "g").filter(F.col("l").contains(F.col("q")))
    every = hit.union(part.select("query", "slug", "occurrences", F.lit(4)))
    w = Window.partitionBy("query").orderBy("rung", F.desc("occurrences"), "slug")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query", "slug", "rung")


def dequeue(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` next items: by priority, then by age (O11). The claim itself is the store's."""
    return queue.filter("status = 'queued'").orderBy(F.desc("priority"), "enqueued_at", "item_id").limit(n)


def order_hits(hits: DataFrame, terms: list[str], by_year: bool, k: int | None = None) -> DataFrame:
    """hits with year, found, in order (O9): newest year first if the query names years, else most terms first.

    With ``k`` only the first ``k``, with their place.
    """
    bag = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    year = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(bag, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))), F.lit(0))
    found = sum((bag.contains(t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    h = hits.withColumn("year", year).withColumn("found", found)
    order = [F.desc("year"), F.desc("found")] if by_year else [F.desc("found"), F.desc("year")]
    if k is None:
        return h.orderBy(*order, "url")
    return h.orderBy(*order, "url").limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order, "url")))


def roles(models: DataFrame, role: str, tiers: list[str]) -> DataFrame:
    """Active models of a role by tier, then name."""
    rank = F.coalesce(*(F.when(F.col("tier") == t, F.lit(i)) for i, t in enumerate(tiers)), F.lit(len(tiers)))
    return models.filter((F.col("role") == role) & (F.col("status") == "active")).orderBy(rank, "name")


def policy_hits(texts: DataFrame, key: str, text: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """key, rule, severity of the severest rule a text matches."""
    hit = F.filter(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for n, p, s in rules)), lambda x: x.isNotNull())
    return texts.select(key, F.array_max(hit).alias("m")).filter("m is not null").select(key, "m.rule", "m.severity")


def route(state: Column, table: list[tuple[str, str]], default: str) -> Column:
    """First next step whose condition stands in the state."""
    return F.coalesce(*(F.when(state.contains(c), F.lit(step)) for c, step in table), F.lit(default))


def provenance_ratio(verdicts: DataFrame, key: str) -> DataFrame:
    """key, claims, invented, ratio: share of invented claims; a verdict without evidence is one."""
    e = verdicts.select(key, F.explode_outer("evidence").alias("origin"))
    bad = F.when(F.coalesce(F.col("origin"), F.lit("invented")).isin("inferred", "grounded"), 0).otherwise(1)
    return e.groupBy(key).agg(F.count("*").alias("claims"), F.sum(bad).alias("invented"), F.round(F.avg(bad), 6).alias("ratio"))


def upgrade_events(events: DataFrame, sources: dict[str, str], trust: dict[str, str]) -> DataFrame:
    """Records of the first version as the second (M10): ids kept, new fields filled from the kind, given ones kept."""
    pick = lambda m, default: F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in m.items()), F.lit(default))
    old = F.col("version") == 1
    return events.withColumn("source", F.when(old, F.coalesce("source", pick(sources, "text"))).otherwise(F.col("source"))).withColumn("trust", F.when(old, F.coalesce("trust", pick(trust, "model_proposed"))).otherwise(F.col("trust"))).withColumn("version", F.lit(2))


def idiom_scores(scored: DataFrame, key: str, n: int = 5, near: int = 3) -> DataFrame:
    """key, idiom, nearest, farthest: mean of the ``n`` best likenesses to a corpus within 0 and 1.

    ``scored``: key, other, score; both ends are cut by row number before the shuffle.
    """
    up, down = Window.partitionBy(key).orderBy(F.desc("score"), "other"), Window.partitionBy(key).orderBy("score", "other")
    best = scored.withColumn("p", F.row_number().over(up)).filter(F.col("p") <= max(n, near))
    worst = scored.withColumn("p", F.row_number().over(down)).filter(F.col("p") <= near)
    a = best.groupBy(key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.when(F.col("p") <= n, F.col("score"))))), 6).alias("idiom"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("p") <= near, F.struct("p", "other")))), lambda x: x["other"].cast("string")), ",").alias("nearest"))
    b = worst.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "other"))), lambda x: x["other"].cast("string")), ",").alias("farthest"))
    return a.join(b, key)


def text_links(text: Column) -> Column:
    """Addresses in a text: of Markdown links, then bare ones, each once."""
    t = F.coalesce(text, F.lit(""))
    marked = F.regexp_extract_all(t, F.lit(r"\[[^\]]{0,240}\]\((https?://[^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(F.regexp_replace(t, r"\]\(https?://[^)\s]+\)", "] "), F.lit("(https?://[^\\s<>\\]\\)\"'`]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(marked, bare), lambda u: F.regexp_replace(u, r"[.,;:)'\">\]`]+$", "")))


def query_blocks(text: Column, words: list[str]) -> Column:
    """Blocks between blank lines that hold a query word; all of them if none does."""
    blocks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda b: F.trim(b) != "")
    hit = F.filter(blocks, lambda b: F.greatest(*(F.lower(b).contains(w.lower()) for w in words), F.lit(False)))
    return F.array_join(F.when(F.size(hit) > 0, hit).otherwise(blocks), "\n\n")


def pattern_lines(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, line_no, name of each line a known pattern matches."""
    line = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    names = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in patterns.items())), lambda n: n.isNotNull())
    return line.select(key, "line_no", F.explode(names).alias("name"))


def spine(calls: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """start, depth, id: the first call of each step followed down (G26); ``calls``: src, dst, position."""
    first = calls.groupBy("src").agg(F.min_by("dst", F.struct("position", "dst")).alias("dst"))
    at = starts.select(F.col("id").alias("start"), F.lit(0).alias("depth"), F.col("id"))
    out = at
    for d in range(1, depth + 1):
        at = at.join(first, at.id == first.src).select("start", F.lit(d).alias("depth"), F.col("dst").alias("id"))
        out = out.union(at)
    return out


def envelopes(df: DataFrame, kind: str, version: str, payload: str) -> DataFrame:
    """The rows with kind, version, payload and cid of an artifact (T5); the cid is the content's."""
    e = df.withColumn("payload", F.col(payload)).withColumn("kind", F.lit(kind)).withColumn("version", F.lit(version))
    return e.withColumn("cid", _envelope_cid())


def _envelope_cid() -> Column:
    return F.concat("kind", F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "kind", "version", "payload"), 256), 1, 32))


def envelope_holds() -> Column:
    """Whether an envelope is complete and its cid is that of its content (T5)."""
    return F.coalesce(F.col("cid") == _envelope_cid(), F.lit(False))
