"""Comparison of rows that share a key, over key-sorted streams of Arrow batches.

Rows arrive sorted by key. Runs of one key are compared in place with array
operations; a run longer than ``limit`` is handed on as it is ("hot"), to be
cut into blocks whose pairs become tasks of their own, so that no task holds
or compares an unbounded run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import cut

Columns = dict[str, np.ndarray]


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[tuple[bool, Columns]]:
    """(is hot, rows): parts in which no key of at most ``limit`` rows is cut in two."""
    held: list[Columns] = []
    held_rows = 0
    hot_key = None

    def join(parts: list[Columns]) -> Columns:
        return parts[0] if len(parts) == 1 else {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if not len(cols[key]):
            continue
        if hot_key is not None:
            n = int(np.searchsorted(cols[key] != hot_key, True))
            if n:
                yield True, {k: v[:n] for k, v in cols.items()}
                cols = {k: v[n:] for k, v in cols.items()}
            if not len(cols[key]):
                continue
            hot_key = None
        if held:
            cols = join([*held, cols])
        k = cols[key]
        last = len(k) - int(np.searchsorted(k[::-1] != k[-1], True))
        tail_rows = len(k) - last
        if last:
            yield from _split_hot({c: v[:last] for c, v in cols.items()}, key, limit)
        tail = {c: v[last:] for c, v in cols.items()}
        if tail_rows > limit:
            hot_key = k[-1]
            yield True, tail
            held, held_rows = [], 0
        else:
            held, held_rows = [tail], tail_rows
    if held_rows:
        yield from _split_hot(join(held), key, limit)


def _split_hot(cols: Columns, key: str, limit: int) -> Iterator[tuple[bool, Columns]]:
    k = cols[key]
    edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(edge, len(k)))
    if (size <= limit).all():
        yield False, cols
        return
    long = np.repeat(size > limit, size)
    yield True, {c: v[long] for c, v in cols.items()}
    yield False, {c: v[~long] for c, v in cols.items()}


def pairs_in_runs(cols: Columns, key: str, go_on: Callable, keep: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, of rows with one key.

    ``go_on(i, j)`` must stay false for all later j once it is false for i;
    ``keep(i, j)`` selects the pairs that come out.
    """
    k = cols[key]
    i = np.arange(len(k) - 1)
    lag = 1
    while len(i):
        i = i[: np.searchsorted(i, len(k) - lag)]
        j = i + lag
        alive = k[i] == k[j]
        i, j = i[alive], j[alive]
        if len(i):
            alive = go_on(i, j)
            i, j = i[alive], j[alive]
        if len(i):
            chosen = keep(i, j)
            if chosen.any():
                yield i[chosen], j[chosen]
        lag += 1


def compare(postings: DataFrame, key: str, order: list[str], out: str, pairs: Callable, limit: int) -> DataFrame:
    """Pairs of ``postings`` rows with equal ``key``, without a task for a whole hot key; pairs can repeat.

    ``postings`` has long columns only. ``pairs(cols, cross)`` yields dicts of
    arrays with the columns of ``out``; where ``cross`` is true only rows of
    different ``block`` may be paired. Keys of more than ``limit`` rows are cut
    into blocks of about ``limit`` rows by hash; every pair of blocks is one
    task's work, so such a key costs rows x blocks in the shuffle.
    """
    names = postings.columns
    out_names = [c.split()[0] for c in out.split(", ")]
    schema = "hot boolean, " + ", ".join(f"{c} long" for c in names) + ", " + ", ".join(f"out_{c}" for c in out.split(", "))
    arrow = pa.schema([("hot", pa.bool_()), *((c, pa.int64()) for c in names), *((f"out_{c}", pa.int64()) for c in out_names)])

    def run(batches):
        for hot, cols in whole_runs(batches, key, limit):
            n = len(cols[key])
            if hot:
                yield pa.record_batch([pa.array(np.ones(n, bool)), *(pa.array(cols[c]) for c in names), *(pa.nulls(n, pa.int64()) for _ in out_names)], schema=arrow)
                continue
            for got in pairs(cols, False):
                n = len(got[out_names[0]])
                yield pa.record_batch([pa.array(np.zeros(n, bool)), *(pa.nulls(n, pa.int64()) for _ in names), *(pa.array(got[c]) for c in out_names)], schema=arrow)

    first = cut(postings.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema))
    found = first.filter(~F.col("hot")).select(*(F.col(f"out_{c}").alias(c) for c in out_names))
    hot = first.filter("hot").select(*names)
    if hot.isEmpty():
        return found
    # One row of each key's duplicates would do, but dropping them here needs no second rule.
    hot = hot.distinct()
    blocks = hot.groupBy(key).agg(F.ceil(F.count("*") / limit).cast("long").alias("n_blocks"))
    mine = F.pmod(F.xxhash64(*names), F.col("n_blocks"))
    spread = (
        hot.join(blocks, key)
        .withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .select(
            *names,
            "block",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
        )
        .withColumn("task", F.xxhash64(key, "low", "high"))
    )
    out_schema = pa.schema([(c, pa.int64()) for c in out_names])

    def run_blocks(batches):
        for _, cols in whole_runs(batches, "task", 1 << 62):
            for got in pairs(cols, True):
                yield pa.record_batch([pa.array(got[c]) for c in out_names], schema=out_schema)

    crossed = spread.repartition("task").sortWithinPartitions("task", *order).mapInArrow(run_blocks, out)
    return found.union(crossed)
