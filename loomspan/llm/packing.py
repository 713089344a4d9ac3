"""Filling fixed-capacity containers: mixture-controlled packing.

Records are spread over packing tasks by hash of their id, so a source that
holds a third of the rows is spread as well. A task keeps a queue per source
and fills window after window by deficit round-robin: every window credits each
source with its target share of the capacity, the source with the largest
credit goes next, and what it puts in is charged to it. Credits carry over from
window to window; what all tasks of a round leave a source owed or owing is
carried over to the tasks of the next round, in equal parts.

From the chosen queue the largest item is taken for whose remaining room some
queue holds an item of exactly that size, else the largest that fits.
Windows that stay too empty, and those in which sources of more than ``DRY`` of the
mixture are owed something but have nothing left in their task, are packed again
together, ``fan_in`` tasks at a time, until one task holds the rest: what one
task lacks another has too much of.

An item above the capacity is divided into full containers and a remainder;
nothing else is divided, and nothing is left out but records without tokens
(null and empty texts). Repeated ids are packed as the separate rows they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import cut

OUT = "container_id long, slot int, doc_id long, piece int, token_start long, token_end long, source string, open boolean"


#: Share of the mixture that a window may miss because its task has run out of sources.
DRY = 0.05


def fill_windows(size: np.ndarray, source: np.ndarray, shares: np.ndarray, credit: np.ndarray, capacity: int) -> tuple[list[list[int]], list[float]]:
    """(items of each window in order of their placing, share of the mixture that had run dry); every size is in 1..capacity."""
    n_sources = len(shares)
    stock = [[[] for _ in range(capacity + 1)] for _ in range(n_sources)]
    have = np.zeros((n_sources, capacity + 1), np.int64)
    for i in range(len(size) - 1, -1, -1):
        stock[source[i]][size[i]].append(i)
        have[source[i], size[i]] += 1
    total = have.sum(axis=0)
    left, credit, windows, dry = len(size), credit.astype(np.float64).copy(), [], []
    stocked = have.sum(axis=1)

    while left:
        credit += shares * capacity
        dry.append(float(shares[(stocked == 0) & (credit > 0)].sum()))
        room, window = capacity, []
        while room and left:
            fits = have[:, 1 : room + 1].any(axis=1)
            if not fits.any():
                break
            s = int(np.argmax(np.where(fits, credit, -np.inf)))
            mine = have[s, : room + 1] > 0
            rest = total[: room + 1][::-1] > 0  # at l: is there an item of room - l
            rest[room] = True
            half = room // 2
            if room % 2 == 0 and total[half] < 2:
                rest[half] = False
            exact = np.flatnonzero(mine & rest)
            take = int(exact[-1] if len(exact) else np.flatnonzero(mine)[-1])
            window.append(stock[s][take].pop())
            have[s, take] -= 1
            total[take] -= 1
            stocked[s] -= 1
            credit[s] -= take
            room -= take
            left -= 1
        windows.append(window)
    return windows, dry


def _pack(items: DataFrame, shares: dict[str, float], credit: dict[str, float], capacity: int, parts: int, level: int, open_below: float, dry_most: float) -> DataFrame:
    """One round: items (doc_id, piece, token_start, token_end, source) in ``parts`` tasks, which share the credits."""
    names = sorted(shares)
    at = {s: i for i, s in enumerate(names)}
    share = np.array([shares[s] for s in names])
    part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(parts)).alias("part")
    items = items.select("*", part)
    start_credit = np.array([credit.get(s, 0.0) / parts for s in names])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        start, end = t.column("token_start").to_numpy(), t.column("token_end").to_numpy()
        src = t.column("source").to_pylist()
        code = np.array([at[s] for s in src])
        windows, dry = fill_windows(end - start, code, share, start_credit, capacity)
        order = np.array([i for x in windows for i in x])
        length = np.array([len(x) for x in windows])
        number = np.repeat(np.arange(len(windows)), length)
        slot = np.arange(len(order)) - np.repeat(np.cumsum(length) - length, length)
        filled = np.bincount(number, (end - start)[order])
        base = (level << 56) + (int(t.column("part")[0].as_py()) << 28)
        take = pa.array(order)
        return pa.table(
            [pa.array(base + number), pa.array(slot, pa.int32()), *(t.column(c).take(take) for c in ("doc_id", "piece", "token_start", "token_end", "source")), pa.array(((filled < open_below * capacity) | (open_below > 0) & (np.array(dry) > dry_most))[number])],
            names=[c.split()[0] for c in OUT.split(", ")],
        )

    return items.groupBy("part").applyInArrow(run, OUT)


def pack(docs: DataFrame, capacity: int = 2048, targets: dict[str, float] | None = None, part_items: int = 8192, fan_in: int = 16, open_below: float = 0.99) -> DataFrame:
    """container_id, slot, doc_id, piece, token_start, token_end, source of all tokens.

    ``docs``: doc_id, source (not null), n_tokens. ``targets`` are the shares the
    mixture of each window aims at; by default each source's share of all
    tokens, so that no queue runs dry before the others over all tasks. With
    given targets a source can run dry for good; its windows are then closed as
    they are.
    """
    docs = docs.select("doc_id", "source", "n_tokens").filter("n_tokens > 0")
    last = F.ceil(F.col("n_tokens") / capacity).cast("int") - 1
    pieces = docs.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    items = cut(
        pieces.select(
            "doc_id",
            "piece",
            (F.col("piece") * F.lit(capacity)).cast("long").alias("token_start"),
            F.least(F.col("n_tokens"), (F.col("piece") + 1) * F.lit(capacity)).cast("long").alias("token_end"),
            "source",
        )
    )
    # One row per source family.
    sums = {r["source"]: (r["t"], r["n"]) for r in items.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("n")).collect()}
    if not sums:
        return items.select(F.lit(0).cast("long").alias("container_id"), F.lit(0).alias("slot"), "*")
    want = {s: float(t) for s, (t, _) in sums.items()} if targets is None else {s: max(0.0, targets.get(s, 0.0)) for s in sums}
    scale = sum(want.values()) or 1.0
    shares = {s: v / scale for s, v in want.items()}
    parts = max(1, -(-sum(n for _, n in sums.values()) // part_items))
    done, level, credit = None, 0, dict.fromkeys(sums, 0.0)
    while True:
        packed = cut(_pack(items, shares, credit, capacity, parts, level, open_below if parts > 1 else 0.0, DRY if targets is None else math.inf))
        closed = packed.filter("not open").drop("open")
        done = closed if done is None else done.union(closed)
        if parts == 1:
            return done
        # One row per source: what closed windows gave it, against its share of them.
        given = {r["source"]: float(r["t"]) for r in closed.groupBy("source").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t")).collect()}
        credit = {s: credit[s] + shares[s] * sum(given.values()) - given.get(s, 0.0) for s in sums}
        items = packed.filter("open").select("doc_id", "piece", "token_start", "token_end", "source")
        rest = items.count()
        if not rest:
            return done
        parts = max(1, min(-(-parts // fan_in), -(-rest // part_items)) if -(-rest // part_items) > 1 else 1)
        level += 1


def share_deviation(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """source, share, mean_off, most_off: a source's share of all tokens, and how far containers are from it on average and at most.

    A container without a source counts with 0 of it; the last containers, of which there is nothing
    left to choose, count like all others.
    """
    size = F.col("token_end") - F.col("token_start")
    total = docs.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("all"))
    share = total.select("source", (F.col("all") / F.sum("all").over(Window.partitionBy())).alias("share"))
    n = packed.agg(F.count_distinct("container_id").alias("containers"))
    whole = packed.groupBy("container_id").agg(F.sum(size).alias("whole"))
    each = packed.groupBy("container_id", "source").agg(F.sum(size).alias("own")).join(whole, "container_id").join(share, "source")
    off = F.abs(F.col("own") / F.col("whole") - F.col("share"))
    seen = each.groupBy("source", "share").agg(F.sum(off).alias("off"), F.max(off).alias("most"), F.count("*").alias("in"))
    absent = F.col("containers") - F.col("in")
    out = seen.select("*", n.scalar().alias("containers"))
    most = F.greatest("most", F.when(absent > 0, F.col("share")).otherwise(0.0))
    return out.select("source", F.round("share", 6).alias("share"), F.round((F.col("off") + absent * F.col("share")) / F.col("containers"), 6).alias("mean_off"), F.round(most, 6).alias("most_off"))
