"""The ranking pipeline: recall, fast rank, heavy rank, diverse rerank, budgeted pack."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators import chunking, lexical, text, vectors
from loomspan.session import cut, spread


def candidates(docs: DataFrame, query: str, k: int = fixed.RECALL_K) -> tuple[DataFrame, float]:
    """(doc_id, source, position, chunk_id, text, recall of the ``k`` chunks most similar to the query, mean chunk length).

    Chunks are made and scored in one pass that counts their words as well. Ids
    and scores are shuffled to find equal chunks, not texts: those of the ``k``
    best are cut from their documents again.
    """
    lengths = Observation()
    chunks = spread(docs).select("doc_id", "source", F.posexplode(chunking.windows(F.col("text"))).alias("position", "text"))
    chunks = chunks.withColumn("words", F.size(text.words_of(F.col("text")))).observe(lengths, F.avg("words").alias("mean"))
    scored = chunks.select("doc_id", "source", "position", chunking.chunk_id(F.col("text")).alias("chunk_id"), vectors.similarity_to(query)(F.col("text")).alias("recall"))
    one = scored.groupBy("chunk_id").agg(F.min(F.struct("doc_id", "position", "source")).alias("c"), F.max("recall").alias("recall"))
    top = cut(one.select("chunk_id", "c.*", "recall").orderBy(F.desc("recall"), "chunk_id").limit(k))
    # At most k rows go to the documents.
    cutting = F.get(chunking.windows(F.col("text")), F.col("position")).alias("text")
    # Ids of documents are unique; where they are not, the chunk's own id tells which one is meant.
    whole = docs.select("doc_id", "text").join(top, "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    whole = whole.select("doc_id", "source", "position", "chunk_id", cutting, "recall")
    whole = whole.filter(chunking.chunk_id(F.col("text")) == F.col("chunk_id")).dropDuplicates(["chunk_id"])
    return whole, float(lengths.get.get("mean") or 120.0)


def fast_rank(cands: DataFrame, query: str, mean_len: float, k: int = fixed.FAST_K) -> DataFrame:
    """The ``k`` best by BM25, density, recall and entities (R2), with score, noise and kind."""
    entities = [m for _, m in query_mentions(query)]
    toks = text.tokens(F.col("text"), fixed.TERM, min_len=2, stop=fixed.STOP_EN)
    c = cands.withColumn("fact_score", text.fact_score(F.col("text"))).withColumn("bm25", lexical.bm25(_terms(query), toks, mean_len))
    density = F.when(F.col("fact_score") > 0, F.col("fact_score")).otherwise(text.fact_density(F.col("text")))
    found = F.concat(*(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)) for p in fixed.MENTIONS.values()))
    w = fixed.FAST_WEIGHTS
    score = w["bm25"] * F.least(F.lit(1.0), F.col("bm25") / 10.0) + w["density"] * density + w["recall"] * F.col("recall") + w["entity"] * text.jaccard(text.lit_array(entities) if entities else F.array().cast("array<string>"), found) + w["prior"] * 0.5
    c = c.withColumn("fast", F.round(score, 6)).withColumn("noise", text.noise_score(F.col("text"), F.col("fact_score"))).withColumn("kind", text.chunk_kind(F.col("fact_score")))
    return c.orderBy(F.desc("fast"), "chunk_id").limit(k)


def _terms(query: str) -> list[str]:
    import re

    return [w for w in re.findall(fixed.TERM, query.lower()) if len(w) > 1 and w not in fixed.STOP_EN]


def query_mentions(query: str) -> list[tuple[str, str]]:
    """Entity mentions of the query text, on the driver."""
    import re

    return [(k, m.group()) for k, p in fixed.MENTIONS.items() for m in re.finditer(p, query)]


def heavy_rank(ranked: DataFrame, k: int = fixed.HEAVY_K) -> DataFrame:
    """A tenth more for rules, a tenth less for narrative (R3); the kind stands in for a classifier's label."""
    bonus = F.when(F.col("kind") == "rule", 0.10).when(F.col("kind") == "narrative", -0.10).otherwise(0.0)
    return ranked.withColumn("heavy", F.round(F.col("fast") + bonus, 6)).orderBy(F.desc("heavy"), "chunk_id").limit(k)


def rerank(ranked: DataFrame) -> DataFrame:
    """final, dropped: greedy choice with a penalty for likeness to what is chosen, a cap per source and a noise limit.

    Sequential by nature; it sees the at most ``HEAVY_K`` rows that are left.
    """
    rows = ranked.withColumn("vector", vectors.hash_embed(F.col("text"))).withColumn("g", F.lit(1))
    out = "chunk_id string, doc_id long, position int, source string, text string, fast double, heavy double, noise double, final double, dropped string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["heavy", "chunk_id"], ascending=[False, True])
        chosen: list[np.ndarray] = []
        per: dict = {}
        final, dropped = [], []
        for r in pdf.itertuples():
            if r.noise > fixed.NOISE_MAX:
                final.append(None)
                dropped.append("noise")
                continue
            if per.get(r.source, 0) >= fixed.SOURCE_CAP:
                final.append(None)
                dropped.append("source cap")
                continue
            v = np.array(r.vector)
            like = max((float(v @ c) for c in chosen), default=0.0)
            final.append(round(max(0.0, r.heavy - (fixed.MMR_PENALTY * like if chosen else 0.0)), 6))
            dropped.append(None)
            per[r.source] = per.get(r.source, 0) + 1
            chosen.append(v)
        pdf = pdf.assign(final=final, dropped=dropped)
        return pdf[[c.split()[0] for c in out.split(", ")]]

    return rows.groupBy("g").applyInPandas(run, out)


def pack(ranked: DataFrame, limit_tokens: int = 1500) -> DataFrame:
    """place, tokens, packed: best first, as long as the sum of token estimates fits."""
    kept = ranked.filter("dropped is null")
    w = Window.orderBy(F.desc("final"), "chunk_id")
    t = kept.withColumn("place", F.row_number().over(w)).withColumn("tokens", text.token_estimate(F.col("text")))
    return t.withColumn("packed", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= limit_tokens)


def ranked_pack(docs: DataFrame, query: str, limit_tokens: int = 6000) -> DataFrame:
    """The whole pipeline over documents (doc_id, source, text) for one query."""
    best, mean_len = candidates(docs, query)
    top = rerank(heavy_rank(fast_rank(best, query, mean_len)))
    return pack(top, limit_tokens).select("place", "chunk_id", "doc_id", "position", "source", "final", "heavy", "fast", "noise", "tokens", "packed")


def waste(injected: DataFrame, turns: DataFrame, first: int = 3) -> DataFrame:
    """pack_id, injected, used, waste (J15, A17): handles that the first turns mention, by a word of their text.

    ``injected``: pack_id, handle; ``turns``: pack_id, turn, text. Mentions are
    words, so the match is an equality join.
    """
    said = turns.filter(F.col("turn") < first).select("pack_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("handle"), "turn")
    hit = injected.join(said, ["pack_id", "handle"], "left").groupBy("pack_id", "handle").agg(F.min("turn").alias("turn"))
    return hit.groupBy("pack_id").agg(F.count("*").alias("injected"), F.count("turn").alias("used")).withColumn("waste", F.round(1 - F.col("used") / F.col("injected"), 6))
