"""Exact and near duplicates of whole texts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut, spread


def normal_id(text: Column) -> Column:
    """Content id of a text in lower case with white space collapsed."""
    n = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.concat(F.lit("cid-"), F.substring(F.sha2(n, 256), 1, 32))


def exact(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """cid, first, copies of each normalised text (X1); one aggregation, no text is shuffled."""
    return docs.select(key, normal_id(F.col(text)).alias("cid")).groupBy("cid").agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def simhash(text: Column) -> Column:
    """64-bit simhash of the white-space tokens of a normalised text (X2), as a long; FNV-1a token hashes."""

    @F.pandas_udf("long")
    def run(col: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        signs = np.empty((1024, 64), np.int32)
        out = np.zeros(len(col), np.uint64)
        bits = np.arange(64, dtype=np.uint64)
        for k, t in enumerate(col):
            at = []
            for tok in (t or "").lower().split():
                i = known.get(tok)
                if i is None:
                    h = 0xCBF29CE484222325
                    for b in tok.encode("utf-8"):
                        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                    i = known[tok] = len(known)
                    if i == len(signs):
                        signs = np.concatenate([signs, np.empty_like(signs)])
                    signs[i] = ((np.uint64(h) >> bits) & np.uint64(1)).astype(np.int32) * 2 - 1
                at.append(i)
            if at:
                out[k] = ((signs[at].sum(axis=0) > 0).astype(np.uint64) << bits).sum()
            if len(known) > 200_000:
                known.clear()
        return pd.Series(out.view(np.int64))

    return run(text)


def _close(banded: DataFrame, most: int, key_rows: int) -> DataFrame:
    """early, late of rows (h, first, b, v) with one key whose hashes differ in at most ``most`` bits.

    Keys of more than ``key_rows`` rows are cut into blocks by hash; every pair of blocks is a key of its own.
    """
    sized = banded.groupBy("b", "v").agg(F.count("*").alias("n")).filter("n > 1")
    one = banded.join(sized, ["b", "v"])
    blocks = F.ceil(F.col("n") / key_rows).cast("int")
    one = one.withColumn("block", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = lambda s: one.select("b", "v", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *(F.col(c).alias(f"{c}_{s}") for c in ("h", "first", "block")))
    j = side("x").join(side("y"), ["b", "v", "low", "high"]).filter((F.col("first_x") < F.col("first_y")) & ((F.col("low") == F.col("high")) | (F.col("block_x") != F.col("block_y"))))
    return j.filter(F.bit_count(F.col("h_x").bitwiseXOR(F.col("h_y"))) <= most).select(F.col("first_x").alias("early"), F.col("first_y").alias("late")).distinct()


def near_by_simhash(docs: DataFrame, key: str, text: str = "text", most: int = 3, key_rows: int = 4096) -> DataFrame:
    """key, kept, near: documents in order of key; one within ``most`` bits of a kept one is near it.

    Equal hashes are one row first, so that candidates are an equality join of
    distinct hashes. The first-seen rule is resolved in rounds: a hash is kept once
    all smaller neighbours are near another, near once a kept one is beside it.
    """
    h = cut(spread(docs.select(key, text)).select(key, simhash(F.col(text)).alias("h")))
    one = cut(h.groupBy("h").agg(F.min(key).alias("first")))
    # Of six blocks of bits, three are equal where at most three bits differ: 20 keys of 32 bits, far rarer than quarters of 16.
    if most > 3:
        raise ValueError("the blocks find hashes that differ in at most 3 bits")
    blocks, at = [], 0
    for width in (11, 11, 11, 11, 10, 10):
        blocks.append(F.shiftrightunsigned("h", at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    key_of = lambda c: F.shiftleft(blocks[c[0]], 22).bitwiseOR(F.shiftleft(blocks[c[1]], 11)).bitwiseOR(blocks[c[2]])
    keys = F.array(*(F.struct(F.lit(i).alias("b"), key_of(c).alias("v")) for i, c in enumerate(combinations(range(6), 3))))
    banded = one.select("h", "first", F.explode(keys).alias("k")).select("h", "first", "k.b", "k.v")
    pairs = cut(_close(banded, most, key_rows))
    state = cut(one.select("first", F.lit(None).cast("string").alias("state")))
    while True:
        early = pairs.join(state.select(F.col("first").alias("early"), F.col("state").alias("s")), "early")
        per = early.groupBy(F.col("late").alias("first")).agg(F.max(F.col("s") == "kept").alias("any_kept"), F.count_if(F.col("s").isNull()).alias("open"))
        new = F.when(F.col("state").isNotNull(), F.col("state")).when(F.coalesce("any_kept", F.lit(False)), "near").when(F.coalesce("open", F.lit(0)) == 0, "kept")
        state = cut(state.join(per, "first", "left").select("first", new.alias("state")))
        if state.filter("state is null").isEmpty():
            break
    kept = state.filter("state = 'kept'").select(F.col("first").alias("early"))
    near = pairs.join(kept, "early").groupBy(F.col("late").alias("first")).agg(F.min("early").alias("near"))
    rep = state.join(near, "first", "left").select("first", (F.col("state") == "kept").alias("rep_kept"), F.when(F.col("state") == "near", F.col("near")).alias("near"))
    return h.join(one, "h").join(rep, "first").select(key, ((F.col(key) == F.col("first")) & F.col("rep_kept")).alias("kept"), F.coalesce("near", F.when(F.col(key) != F.col("first"), F.col("first"))).alias("near"))


def crawl_documents(pages: DataFrame, source: str, text: str, order: list[str]) -> DataFrame:
    """First page of each (source, text) (X5); the same text at another address is kept."""
    w = Window.partitionBy(source, F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).orderBy(*order)
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
