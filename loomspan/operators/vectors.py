"""Vector operators on array columns: built-in expressions for one query, block products for pairs."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.functions.columns import beside

_TERM, _STOP = re.compile(fixed.TERM), frozenset(fixed.STOP_EN)


def dot(a: Column, b: Column) -> Column:
    """Scalar product in doubles, 0 for unequal lengths or nulls (V1)."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.coalesce(s, F.lit(0.0))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def normalise(a: Column, least: float = 1e-12) -> Column:
    """Unit length; shorter than ``least`` stays as it is (V2)."""
    n = norm(a)
    return F.when(n > least, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1 and 1; 0 for zero, unequal or non-finite vectors (V3)."""
    n = norm(a) * norm(b)
    c = dot(a, b) / n
    # A NaN counts as larger than any number, so it has to be seen before the clamp.
    return F.when((n > 0) & ~F.isnan(c) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))).otherwise(0.0)


def mrl(a: Column, k: int) -> Column:
    """First ``k`` dimensions at unit length."""
    return normalise(F.slice(a, 1, k))


def top_k(records: DataFrame, key: str, vector: str, query: list[float], k: int, within: Column | None = None) -> DataFrame:
    """key, score of the ``k`` most similar records to one vector.

    A projection and a top-k per task; only k rows per task are shuffled. Ties
    go to the smaller key. Null vectors are skipped.
    """
    lit = F.array(*(F.lit(float(x)) for x in query))
    r = records if within is None else records.filter(within)
    scored = r.filter(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), lit), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def mean_vectors(records: DataFrame, label: str, vector: str) -> DataFrame:
    """label, i, mean: component means of each group."""
    return records.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def classify(records: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, nearest, score: the class of the nearest centroid.

    Centroids are one row per class, few next to the records.
    """
    means = mean_vectors(records, label, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("c"))
    # All centroids as one array, so that records are only projected.
    every = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("c")))).alias("centroids"))
    scored = F.transform("centroids", lambda c: F.struct((-F.round(cosine(F.col(vector), c["c"]), 6)).alias("s"), c["l"].alias("l")))
    best = F.array_min(scored)
    return records.transform(beside, every).select(key, best.alias("b")).select(key, F.col("b.l").alias("nearest"), (-F.col("b.s")).alias("score"))


def _covariance(records: DataFrame, vector: str) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """(rows, mean, covariance) of vectors of one dimension, null ones left out.

    The sums of products are taken per task and added up; what reaches the
    driver is one matrix of the vectors' dimension.
    """

    def partial(batches):
        n, s, p = 0, None, None
        for b in batches:
            rows = b.column(0).drop_null()
            if not len(rows):
                continue
            x = rows.flatten().cast(pa.float64()).to_numpy().reshape(len(rows), -1)
            n, s, p = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if p is None else p)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], names=["n", "s", "p"])

    parts = records.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(partial, "n long, s array<double>, p array<double>")
    i = parts.select("n", F.posexplode("p").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    total = parts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    if total == 0:
        return 0, None, None
    prods = np.zeros(i.count())
    for r in i.collect():
        prods[r["at"]] = r["v"]
    d = math.isqrt(len(prods))
    sums = np.zeros(d)
    for r in parts.select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    return int(total), sums / total, prods.reshape(d, d) / total - np.outer(sums, sums) / total**2


def axes_stress(records: DataFrame, vector: str, k: int = 3) -> DataFrame:
    """n, stress: share of the variance outside the first ``k`` principal axes."""
    n, _, covariance = _covariance(records, vector)
    if not n:
        return records.sparkSession.createDataFrame([(0, 0.0)], "n long, stress double")
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    stress = 1 - values[:k].sum() / max(values.sum(), 1e-300)
    return records.sparkSession.createDataFrame([(n, round(float(stress), 6))], "n long, stress double")


def principal_axes(records: DataFrame, vector: str, k: int = 3) -> list[list[float]]:
    """The first ``k`` axes (A14, A15), each with its largest component positive."""
    n, _, covariance = _covariance(records, vector)
    if not n:
        return []
    axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :k].T
    return [(a if a[np.abs(a).argmax()] > 0 else -a).tolist() for a in axes]


def project(records: DataFrame, key: str, vector: str, axes: list[list[float]]) -> DataFrame:
    """key, x0, x1, ... : products of each vector with the axes."""
    lit = lambda a: F.array(*(F.lit(float(x)) for x in a))
    return records.select(key, *(F.round(dot(F.col(vector), lit(a)), 6).alias(f"x{i}") for i, a in enumerate(axes)))


def drifting_centroid(rows: DataFrame, keys: list[str], order: str, vector: str, alpha: float = 0.3) -> DataFrame:
    """keys, centroid, runs: vectors of a key folded in order, each weighing ``alpha`` against what was.

    The first is taken as it is; every step is rounded to six digits, as it is
    stored. A key's vectors are folded from one sorted array.
    """
    every = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))))
    step = lambda a, x: F.when(F.size(a) == 0, F.transform(x["v"], lambda y: F.round(y, 6))).otherwise(F.zip_with(a, x["v"], lambda p, n: F.round(alpha * n + (1 - alpha) * p, 6)))
    g = rows.groupBy(*keys).agg(every.alias("_all"))
    return g.select(*keys, F.aggregate("_all", F.array().cast("array<double>"), step).alias("centroid"), F.size("_all").alias("runs"))


def band_pairs(records: DataFrame, key: str, group: str, position: str, vector: str, width: int = 79, least: float = 0.72) -> DataFrame:
    """a, b, score of records within ``width`` places of different groups with cosine >= ``least``.

    Positions are cut into tiles of ``width``; a record is compared inside its
    tile and with the tile before, as blocks of one matrix product each.
    """
    tile = F.floor(F.col("_pos") / width)
    base = records.select(F.col(key).alias("_key"), F.col(group).alias("_group"), F.col(position).alias("_pos"), F.col(vector).alias("_vec"))
    both = base.withColumn("tile", tile).withColumn("home", F.lit(True)).union(base.withColumn("tile", tile + 1).withColumn("home", F.lit(False)))

    def run(t: pa.Table) -> pa.Table:
        pos = t.column("_pos").to_numpy()
        home = t.column("home").to_numpy(zero_copy_only=False)
        x = np.array([v if v is not None else [] for v in t.column("_vec").to_pylist()], dtype=float)
        size = np.sqrt((x * x).sum(1))
        x = x / np.where(size > 0, size, 1)[:, None]
        g = np.array(t.column("_group").to_pylist(), object)
        s = np.round(x @ x.T, 6)
        gap = pos[None, :] - pos[:, None]
        ok = (gap > 0) & (gap <= width) & (s >= least) & (g[:, None] != g[None, :]) & home[None, :]
        i, j = np.nonzero(ok)
        k = t.column("_key")
        return pa.table([k.take(pa.array(i)), k.take(pa.array(j)), pa.array(s[i, j])], names=["a", "b", "score"])

    kind = dict(records.dtypes)[key]
    return both.groupBy("tile").applyInArrow(run, f"a {kind}, b {kind}, score double")


def against_corpus(corpus: DataFrame, queries: DataFrame, key: str, vector: str, most: int, least: int, corpus_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """key, other, score: the ``most`` best and ``least`` worst cosines of each query in each block of the corpus.

    Queries and corpus are cut into blocks by hash; a pair of blocks is one matrix product, so the
    corpus travels once for each block of queries. A record is not compared with itself. Rows of
    either side without a vector are left out; vectors have one dimension.
    """
    q, c = (d.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null") for d in (queries, corpus))
    nq, nc = max(1, -(-q.count() // query_rows)), max(1, -(-c.count() // corpus_rows))
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    left = q.select("k", "v", block(nq).alias("qb"), ids(nc).alias("cb"), F.lit(True).alias("asks"))
    right = c.select("k", "v", ids(nq).alias("qb"), block(nc).alias("cb"), F.lit(False).alias("asks"))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        a, b = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        if not len(a) or not len(b):
            return pa.table({"key": a.column("k")[:0], "other": a.column("k")[:0], "score": pa.array([], pa.float64())})
        x, y = (np.array(s.column("v").to_pylist(), float) for s in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] for m in (x, y))
        s = np.round(np.clip(x @ y.T, -1, 1), 6)
        names = np.array(b.column("k").to_pylist(), object)
        s[np.array(a.column("k").to_pylist(), object)[:, None] == names[None, :]] = np.nan
        # Ties go to the smaller key: columns in order of keys, then a stable sort.
        by_key = np.argsort(names, kind="stable")
        s, b = s[:, by_key], b.take(pa.array(by_key))
        up, down = np.argsort(-s, axis=1, kind="stable")[:, :most], np.argsort(s, axis=1, kind="stable")[:, :least]
        rows = np.repeat(np.arange(len(a)), up.shape[1] + down.shape[1])
        cols = np.concatenate([up, down], axis=1).ravel()
        score = s[rows, cols]
        ok = ~np.isnan(score)
        return pa.table({"key": a.column("k").take(pa.array(rows[ok])), "other": b.column("k").take(pa.array(cols[ok])), "score": pa.array(score[ok])})

    kind = dict(corpus.dtypes)[key]
    return left.union(right).groupBy("qb", "cb").applyInArrow(run, f"key {kind}, other {kind}, score double").distinct()


def rank_fusion(lists: list[DataFrame], key: str, k: int = fixed.RRF_K) -> DataFrame:
    """key, score, place: reciprocal rank fusion of lists of (key, place)."""
    every = lists[0].select(key, "place")
    for one in lists[1:]:
        every = every.union(one.select(key, "place"))
    fused = every.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key)))


_slots: dict[int, dict[str, tuple[int, float]]] = {}


def term_weights(text: str | None, dims: int = 256) -> dict[int, float]:
    """Sums of signed hash buckets of a text's terms and term pairs (V4, V6), by bucket.

    The bucket is BLAKE2b, which is no built-in; a worker looks each term up once.
    """
    known = _slots.setdefault(dims, {})
    terms = [w for w in _TERM.findall((text or "").lower()) if len(w) > 1 and w not in _STOP]
    out: dict[int, float] = {}
    for f in chain(terms, map(" ".join, zip(terms, terms[1:], strict=False))):
        got = known.get(f)
        if got is None:
            if len(known) > 500_000:
                known.clear()
            h = hashlib.blake2b(f.encode("utf-8"), digest_size=8).digest()
            got = known[f] = (int.from_bytes(h[:4], "big") % dims, 1.0 if h[4] % 2 == 0 else -1.0)
        out[got[0]] = out.get(got[0], 0.0) + got[1]
    return out


def embed_query(text: str | None, dims: int = 256) -> list[float]:
    """Unit vector of a text's signed hash buckets (V5), to six digits."""
    v = np.zeros(dims)
    for i, x in term_weights(text, dims).items():
        v[i] = x
    n = math.sqrt(float(v @ v))
    return np.round(v / n if n > 1e-12 else v, 6).tolist()


def hash_embed(text: Column, dims: int = 256) -> Column:
    """The same vector of every text of a column, over Arrow batches (V5)."""

    @F.pandas_udf("array<double>")
    def embed(col: pd.Series) -> pd.Series:
        return pd.Series([embed_query(t, dims) for t in col])

    return embed(text)


def similarity_to(query: str, dims: int = 256):
    """A function column -> cosine of a text's vector with a query's; no vector leaves the worker."""
    q = embed_query(query, dims)

    @F.pandas_udf("double")
    def run(col: pd.Series) -> pd.Series:
        out = np.zeros(len(col))
        for k, t in enumerate(col):
            v = term_weights(t, dims)
            n = math.sqrt(sum(x * x for x in v.values()))
            out[k] = sum(x * q[i] for i, x in v.items()) / n if n > 1e-12 else 0.0
        return pd.Series(np.round(out, 6))

    return run


def embed_dual(df: DataFrame, text: str, model=None, dims: int = 256) -> DataFrame:
    """``df`` with deterministic and semantic vectors (V12); the semantic one is null without ``model``, a function column -> vector."""
    semantic = F.lit(None).cast("array<double>") if model is None else model(F.col(text))
    return df.withColumn("deterministic", hash_embed(F.col(text), dims)).withColumn("semantic", semantic)
