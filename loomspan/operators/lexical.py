"""Lexical operators: postings, BM25, inverse document frequency, federated search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside

from loomspan.functions import fixed
from loomspan.operators import text as tx


def postings(docs: DataFrame, key: str, text: str = "text", unique: bool = False) -> DataFrame:
    """token, key, position: one row per occurrence, repeated rows once.

    ``unique`` says that no key repeats, which saves the distinct.
    """
    out = docs.select(key, F.posexplode(tx.tokens(F.col(text))).alias("position", "token"))
    return out if unique else out.distinct()


def posting_stats(post: DataFrame, key: str) -> DataFrame:
    """token, occurrences, artifacts, first_position; counted per artifact first, so that a common token is one row of each."""
    per = post.groupBy("token", key).agg(F.count("*").alias("n"), F.min("position").alias("p"))
    return per.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count("*").alias("artifacts"), F.min("p").alias("first_position"))


def artifacts_of(post: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """token, key of the distinct artifacts with each wanted token."""
    return post.filter(F.col("token").isin(wanted)).select("token", key).distinct()


def bm25(query_tokens: list[str], toks: Column, mean_len: float = 120.0) -> Column:
    """BM25 with a constant idf over distinct query tokens."""
    wanted = list(dict.fromkeys(query_tokens))

    def score(n: Column, hit: Column) -> Column:
        total = F.lit(0.0)
        for t in wanted:
            tf = F.size(hit) - F.size(F.array_remove(hit, t))
            total = total + F.when(tf > 0, fixed.BM25_IDF * tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * n / mean_len))).otherwise(0.0)
        return F.when(n > 0, F.round(total, 6)).otherwise(0.0)

    # One-element arrays bind the tokens, and the few of them that are asked for, to a name.
    bound = F.transform(F.array(toks), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(wanted)).alias("hit")))
    return F.transform(bound, lambda b: score(b["n"], b["hit"]))[0]


def query_tokens(query: str) -> list[str]:
    """Tokens of a query text, on the driver."""
    import re

    return re.findall(fixed.WORD, query.lower())


def bm25_top(docs: DataFrame, key: str, query: str, k: int, text: str = "text") -> DataFrame:
    """key, score of the ``k`` best documents, ties by key."""
    scored = docs.select(key, tx.tokens(F.col(text)).alias("_t")).select(key, bm25(query_tokens(query), F.col("_t")).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def search(docs: DataFrame, key: str, queries: dict[str, str], k: int, text: str = "text") -> DataFrame:
    """query, key, score, place: BM25 with idf from all documents for many queries at once (Q8).

    All query words are required. One pass over the documents turns each into
    its counts of query words; only those counts are shuffled. The document
    frequencies are one row per query word.
    """
    spark = docs.sparkSession
    wanted = {q: sorted(set(query_tokens(t))) for q, t in queries.items()}
    vocabulary = sorted({w for ws in wanted.values() for w in ws})
    if not vocabulary:
        return spark.createDataFrame([], f"query string, {key} {dict(docs.dtypes)[key]}, score double, place int")
    d = docs.select(key, tx.tokens(F.col(text)).alias("toks")).select(key, F.size("toks").alias("len"), F.filter("toks", lambda t: t.isin(vocabulary)).alias("hit"))
    totals = d.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    tf = d.filter(F.size("hit") > 0).select(key, "len", F.explode("hit").alias("token")).groupBy(key, "len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    q = spark.createDataFrame([(name, w, len(ws)) for name, ws in wanted.items() for w in ws], "query string, token string, need int")
    scored = tf.join(q, "token").join(df, "token").transform(beside, totals)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean_len")))
    hits = scored.groupBy("query", key, "need").agg(F.count("*").alias("found"), F.sum(part).alias("s")).filter("found = need")
    ranked = hits.select("query", key, F.round("s", 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def smoothed_idf(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """token, df, idf = ln((N + 1) / (df + 1)) + 1."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(key, F.explode(tx.tokens(F.col(text), unique=True)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.transform(beside, n).select("token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def themes(docs: DataFrame, text: str = "text", longest: int = 3, k: int = 80) -> DataFrame:
    """gram, n of the most frequent runs of 1 to ``longest`` terms (A10, A11); ties by gram."""
    t = tx.tokens(F.col(text), fixed.TERM, min_len=2, stop=fixed.STOP_EN)
    grams = docs.select(t.alias("t")).select(F.explode(F.concat(*(tx.ngrams(F.col("t"), i) for i in range(1, longest + 1)))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(k)


def anchors(docs: DataFrame, view: str, text: str = "text", least: int = 2) -> DataFrame:
    """token, views, score of tokens seen in several views, score = views over all views."""
    per = docs.select(view, F.explode(tx.tokens(F.col(text), fixed.CODE_TOKEN, unique=True)).alias("token")).distinct()
    total = docs.agg(F.countDistinct(view).alias("all_views"))
    seen = per.groupBy("token").agg(F.countDistinct(view).alias("views")).filter(F.col("views") >= least)
    return seen.transform(beside, total).select("token", "views", F.round(F.col("views") / F.col("all_views"), 6).alias("score"))


def federated(arms: dict[str, DataFrame], key: str = "id", score: str = "score") -> DataFrame:
    """arm, id, score, place: hits of several arms on one scale (Q5, Q6); scores are min-max normalised per arm."""
    every = None
    for name, hits in arms.items():
        one = hits.select(F.lit(name).alias("arm"), F.col(key).cast("string").alias("id"), F.col(score).cast("double").alias("raw"))
        every = one if every is None else every.union(one)
    w = Window.partitionBy("arm")
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    s = F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(1.0)
    scored = every.withColumn("score", F.round(s, 6)).drop("raw")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("score"), "id")))
