"""Mixing sources to target weights: pivotal dependent rounding.

A source's copies per text are its target tokens over its tokens, at most its
cap; the whole part is certain, the fraction is a probability. Fractions are
rounded in pairs: token mass moves from one text to the other, in a direction
drawn so that each keeps its expectation, until one of the two is integral. The
sum of tokens never changes, so a source is off by less than one text at the
end. Sources are cut into hashed blocks of about ``block_rows`` texts; each
block leaves at most one fractional text, and these residuals are combined
``fan_in`` blocks at a time in a reduction tree.

Equal texts are one text (of the smallest id among the targeted sources), so
that copies under several ids do not break the cap. Texts without tokens and
sources without a positive weight and cap are not selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.columns import beside

from loomspan.session import cut


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(probabilities after rounding, index of the one fractional text or -1).

    sum(size * p) is kept, up to rounding errors of doubles.
    """
    p = p.astype(np.float64).copy()
    tiny = 1e-12
    coin = rng.random(len(p))
    at = -1
    for j in range(len(p)):
        if not tiny < p[j] < 1 - tiny:
            p[j] = round(p[j])
            continue
        if at < 0:
            at = j
            continue
        a, b = size[at], size[j]
        to_at = min(a * (1 - p[at]), b * p[j])
        to_j = min(a * p[at], b * (1 - p[j]))
        move = to_at if coin[j] * (to_at + to_j) < to_j else -to_j
        p[at] += move / a
        p[j] -= move / b
        for i in (at, j):
            if p[i] < tiny or p[i] > 1 - tiny:
                p[i] = round(p[i])
        fractional = [i for i in (at, j) if 0 < p[i] < 1]
        at = fractional[0] if fractional else -1
    return p, at


def _round(level: int, seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
        turns = t.column("turn").to_numpy()
        rng = np.random.default_rng([seed, level, len(t), *(turns[:2].view(np.uint64) >> np.uint64(1)).tolist()])
        p, _ = pivotal(t.column("n_tokens").to_numpy(), t.column("p").to_numpy(), rng)
        return t.set_column(t.column_names.index("p"), "p", pa.array(p)).select(["source", "doc_id", "n_tokens", "turn", "p"])

    return run


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20, block_rows: int = 32768, fan_in: int = 64) -> DataFrame:
    """source, doc_id, n_tokens, copies (>= 1), target_share, reached_share.

    ``docs``: doc_id, source, n_tokens, same (equal for equal texts);
    ``targets``: source, weight, max_repeats, one row per source (of repeated
    rows the weights add up and the smallest cap holds). ``target_share`` is
    the weight over the weights of all targets, those without records included;
    ``total_tokens`` defaults to the most for which every source that has
    records reaches its share of the rest within its cap.
    """
    want = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    # One row per source; sources are few next to records.
    goal = {r["source"]: (r["weight"], r["max_repeats"]) for r in want.collect() if r["source"] is not None}
    all_weight = sum(w for w, _ in goal.values())
    usable = [s for s, (w, c) in goal.items() if w > 0 and c > 0]
    texts = docs.filter((F.col("n_tokens") > 0) & F.col("source").isin(usable))
    texts = cut(texts.groupBy("same").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t")).select("t.*").select("source", "doc_id", "n_tokens"))
    held = {r["source"]: (r["t"], r["n"]) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    if not held:
        return spark.createDataFrame([], "source string, doc_id long, n_tokens long, copies int, target_share double, reached_share double")
    weight = sum(goal[s][0] for s in held)
    most = min(goal[s][1] * held[s][0] * weight / goal[s][0] for s in held)
    total = most if total_tokens is None else total_tokens
    rate = {s: min(goal[s][1], total * goal[s][0] / weight / held[s][0]) for s in held}
    blocks = {s: max(1, -(-n // block_rows)) for s, (_, n) in held.items()}
    per = lambda m: F.element_at(F.create_map(*(x for s, v in m.items() for x in (F.lit(s), F.lit(v)))), F.col("source"))
    r = per({s: float(v) for s, v in rate.items()})
    n_blocks = per(blocks)
    turn = F.xxhash64("doc_id", F.lit(seed))
    texts = texts.select("*", turn.alias("turn"), (r - F.floor(r)).alias("p"), F.floor(r).cast("int").alias("sure"))
    schema = "source string, doc_id long, n_tokens long, turn long, p double"
    work, level, most_blocks = texts.select("source", "doc_id", "n_tokens", "turn", "p"), 0, max(blocks.values())
    settled = None
    while True:
        block = F.pmod("turn", n_blocks) if level == 0 else F.floor(F.pmod("turn", n_blocks) / F.lit(fan_in**level))
        out = cut(work.withColumn("block", block).groupBy("source", "block").applyInArrow(_round(level, seed), schema))
        whole = out.filter("p = 0 or p = 1")
        settled = whole if settled is None else settled.union(whole)
        work = out.filter("p > 0 and p < 1")
        if most_blocks <= 1:
            break
        most_blocks, level = -(-most_blocks // fan_in), level + 1
    # The last of each source: less than one text, drawn by its probability.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    settled = settled.union(work.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0)))
    chosen = settled.select("source", "doc_id", "n_tokens", (F.floor(r) + F.col("p")).cast("int").alias("copies")).filter("copies > 0")
    chosen = cut(chosen)
    got = {x["source"]: x["t"] for x in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    whole = sum(got.values()) or 1
    return chosen.select("*", per({s: goal[s][0] / all_weight for s in held}).alias("target_share"), per({s: got.get(s, 0) / whole for s in held}).alias("reached_share"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, tokens, texts, most_copies of every target, absent ones included."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"), F.max("reached_share").alias("reached_share"))
    want = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"))
    total = want.agg(F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    # One row of totals.
    return want.transform(beside, total).join(got, "source", "left").select("source", share.alias("target_share"), zero("reached_share", "double"), zero("tokens", "long"), zero("texts", "long"), zero("most_copies", "int"))
