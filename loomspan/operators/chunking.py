"""Chunking and content-addressed chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import fixed
from loomspan.operators.text import words_of


def windows(text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` words that share ``overlap``; the last one reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    w = words_of(F.coalesce(text, F.lit("")))
    n = F.size(w)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
    return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))


def regex_pieces(text: Column, pattern: str = r"\n\s*\n") -> Column:
    """Trimmed pieces between matches, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentence_groups(text: Column, per: int = 3) -> Column:
    """Groups of ``per`` runs between stops, no white space needed."""
    s = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / per).cast("int") - 1), lambda i: F.array_join(F.slice(s, i * per + 1, F.lit(per)), " "))
    return F.when(F.size(s) > 0, groups).otherwise(F.array().cast("array<string>"))


STRATEGIES = {"sliding_window": windows, "regex": regex_pieces, "sentence": sentence_groups}


def register(name: str, make) -> None:
    """Adds a strategy, a function column -> array of texts (E2). Doing so twice is fine, another one of a known name is an error."""
    if STRATEGIES.setdefault(name, make) is not make:
        raise ValueError(f"{name!r} is another strategy already")


def strategy(name: str):
    """A chunking strategy by name (C4)."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {name!r}, known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def content_id(x: Column, n: int = 16) -> Column:
    """First hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, n)


def chunk_id(text: Column) -> Column:
    return F.concat(F.lit("chunk-"), content_id(text))


def explode_chunks(docs: DataFrame, key: str, text: str = "text", **kw) -> DataFrame:
    """key, position, chunk_text."""
    return docs.select(key, F.posexplode(windows(F.col(text), **kw)).alias("position", "chunk_text"))


def dedup_provenance(chunks: DataFrame, key: str) -> DataFrame:
    """chunk_id, first place, copies and all places of each distinct chunk text.

    Aggregated by id with partial aggregation; ``provenance`` lists (key,
    position) in order.
    """
    at = F.struct(F.col(key).alias(key), "position")
    return chunks.withColumn("chunk_id", chunk_id(F.col("chunk_text"))).groupBy("chunk_id").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.array_sort(F.collect_list(at)).alias("provenance"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def identified_windows(docs: DataFrame, key: str, text: str = "text", size: int = 320, overlap: int = 48) -> DataFrame:
    """key, position, cid, word_count, simhash, chunk_text of windows."""
    from loomspan.operators import dedup
    from loomspan.operators import text as tx

    c = explode_chunks(docs, key, text, size=size, overlap=overlap)
    return c.select(key, "position", chunk_id(F.col("chunk_text")).alias("cid"), tx.word_count(F.col("chunk_text")).alias("word_count"), dedup.simhash(F.col("chunk_text")).alias("simhash"), "chunk_text")
