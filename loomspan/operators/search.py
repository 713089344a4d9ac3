"""Search from end to end: hits joined back to records, spaces guarded, lists fused and packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.functions.columns import beside
from loomspan.operators import vectors as vc


def with_records(hits: DataFrame, records: DataFrame, key: str, *columns: str) -> DataFrame:
    """Hits with columns of the chunks or facts they stand for, those without a record dropped."""
    one = records.select(key, *columns).dropDuplicates([key])
    return hits.join(one, key)


def tokens_of(post: DataFrame, key: str, wanted: list) -> DataFrame:
    """key, position, token of given artifacts, in order."""
    return post.filter(F.col(key).isin(wanted)).select(key, "position", "token").orderBy(key, "position")


def resolve_ranked(ranked: DataFrame, records: DataFrame, key: str, *columns: str) -> DataFrame:
    """A ranked list with the records it resolves to, places kept, what does not resolve dropped."""
    return ranked.join(records.select(key, *columns), key)


def same_space(records: DataFrame, space: str, wanted: str, strict: bool = True) -> DataFrame:
    """Records of one space (V8). With ``strict`` a record of another space is an error when it is read."""
    if not strict:
        return records.filter(F.col(space) == wanted)
    guard = F.when(F.col(space) == wanted, F.col(space)).otherwise(F.raise_error(F.concat(F.lit(f"space mismatch: {wanted} and "), F.coalesce(space, F.lit("null")))))
    return records.withColumn(space, guard)


def run_vectors(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """key, score: product of the query with the first of a record's dimensions (R8); shorter records are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = vectors.filter(F.size(vector) >= len(query))
    return v.select(key, F.round(vc.dot(F.slice(vector, 1, len(query)), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_concepts(concepts: DataFrame, slug: str, vector: str, name: str, k: int = 5) -> DataFrame:
    """slug, score of the concepts nearest to one of them (V11); none if it is unknown."""
    own = concepts.filter(F.col(slug) == name).select(F.col(vector).alias("_q")).limit(1)
    others = concepts.filter(F.col(slug) != name).transform(beside, own).filter(F.col("_q").isNotNull())
    return others.select(slug, F.round(vc.dot(F.col(vector), F.col("_q")), 4).alias("score")).orderBy(F.desc("score"), slug).limit(k)


def inbound(graph_rank: DataFrame, records: DataFrame, key: str, vector: str, query: list[float], limit_tokens: int = 1500, handle_tokens: int = 24, k: int = fixed.RRF_K, most: int = 2000) -> DataFrame:
    """place, key, score, tokens, packed: graph rank and vector rank fused and packed to a budget.

    ``graph_rank``: key, rank (higher is better). Only records that resolve take
    part; the best ``most`` of either list are fused, as no more fit a budget.
    """
    known = records.select(key, vector).filter(F.col(vector).isNotNull())
    by_graph = graph_rank.join(known.select(key), key, "left_semi").orderBy(F.desc("rank"), key).limit(most)
    by_vector = vc.top_k(known.join(graph_rank.select(key), key, "left_semi"), key, vector, query, most)
    w = Window.orderBy(F.desc("rank"), key)
    lists = [by_graph.select(key, F.row_number().over(w).alias("place")), by_vector.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("place"))]
    fused = vc.rank_fusion(lists, key, k)
    spent = F.sum("tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return fused.withColumn("tokens", F.lit(handle_tokens) + F.ceil(F.length(F.col(key).cast("string")) / 4)).withColumn("packed", spent <= limit_tokens).select("place", key, "score", "tokens", "packed")


def coherence(packed: DataFrame, place: str, text: str, query: str, top: int = 5, chars: int = 400) -> DataFrame:
    """coherence, ok: likeness of the first results, taken together, to the query."""
    first = packed.orderBy(place).limit(top).select(place, F.substring(text, 1, chars).alias("t"))
    one = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "t"))), lambda x: x["t"]), " ").alias("summary"))
    q = F.array(*(F.lit(x) for x in vc.embed_query(query)))
    c = F.round(vc.cosine(vc.hash_embed(F.col("summary")), q), 4)
    return one.select(c.alias("coherence")).select("coherence", (F.col("coherence") >= fixed.COHERENCE_LEAST).alias("ok"))


def positioned_mentions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, value, start, end of every mention (P14), all kinds together in order of their start.

    A kind's matches do not overlap; those of different kinds may. Starts are
    found piece by piece: what precedes a match is the text less what follows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for i, (kind, pattern) in enumerate(fixed.MENTIONS.items()):
        found = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        # Walking over the matches, each is looked for behind the end of the one before.
        walk = F.aggregate(
            found,
            F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out")),
            lambda a, m: F.struct(
                (_find(t, m, a["at"]) + F.length(m)).alias("at"),
                F.concat(a["out"], F.array(F.struct(m.alias("value"), (_find(t, m, a["at"]) - 1).alias("start"), (_find(t, m, a["at"]) - 1 + F.length(m)).alias("end")))).alias("out"),
            ),
        )
        parts.append(F.transform(walk["out"], _of_kind(i, kind)))
    every = df.select(key, F.explode(F.array_sort(F.concat(*parts))).alias("m"))
    return every.select(key, "m.kind", "m.value", "m.start", "m.end")


def _of_kind(order: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["end"].alias("end"))


def _find(text: Column, part: Column, start: Column) -> Column:
    """Place of a part in a text from a place on, counted from 1."""
    return F.position(part, text, start)
