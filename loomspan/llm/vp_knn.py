"""Most similar vectors for every vector: vantage-point trees per shard.

Vectors are scaled to unit length; the distance is the chord, a metric with
cosine = 1 - d^2 / 2. Three levels:

* equal vectors (to six decimals) are one representative; a representative
  keeps the k + 1 smallest ids of its copies, which is all a list of k can use.
  Until the lists are named it goes by a 64-bit hash of space and vector;
* per space, a routing tree cuts the space into shards of about ``shard_rows``
  vectors. It is fitted on a bounded sample: ``LEAF_SAMPLE`` vectors a shard, at
  least ``sample_rows`` and at most ``SAMPLE_MOST``, which is enough for 537
  million vectors a space; beyond that shards grow. Every vector is indexed in
  exactly one shard and asks every shard that the relaxed triangle inequality
  does not exclude; its own it asks with the row by which it is indexed;
* in each shard a vantage-point tree with leaves of ``leaf_rows`` vectors. All
  queries of a shard descend together; a leaf is one matrix product.

A branch is skipped when |d(q, vantage) - radius| > factor * tau, tau being
the query's current search radius: the distance of its k-th best so far, and at
most the distance that ``min_similarity`` allows. ``factor`` 1 is the triangle
inequality and exact; below 1 it is relaxed. A find counts for both of its
vectors, so a pair is only lost when both searches miss it.

Unusable vectors (null, wrong number of elements, null or non-finite elements,
all zero) have no neighbours and are nobody's. Repeated rows of an id in a
space count once (the smallest of different vectors is taken). Ties go to the
smaller id; cosines are compared to six decimals. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import chars
from loomspan.session import cut

DIGITS = 6
LEAF_SAMPLE = 8  # sample vectors a shard
SAMPLE_MOST = 1 << 18
POINT, QUERY = 1, 2  # what a routed row is; 3 is both


@dataclass
class Node:
    vantage: np.ndarray | None = None
    radius: float = 0.0
    inner: int = -1
    outer: int = -1
    leaf: int = -1
    rows: np.ndarray | None = None


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def build(x: np.ndarray, max_leaves: int, leaf_rows: int, rng: np.random.Generator) -> list[Node]:
    """A tree over unit vectors that halves them by distance from vantage points.

    Of a few candidates the vantage point with the widest spread of distances
    is taken. Vectors that no distance separates stay in one leaf.
    """
    nodes = [Node(rows=np.arange(len(x)))]
    todo, leaves = [(-len(x), 0)], 1
    while todo:
        at = heapq.heappop(todo)[1]
        rows = nodes[at].rows
        if leaves >= max_leaves or len(rows) <= leaf_rows:
            continue
        tries = rng.choice(rows, min(8, len(rows)), replace=False)
        probe = x[rng.choice(rows, min(256, len(rows)), replace=False)]
        v = x[tries[int(np.argmax(chord(probe @ x[tries].T).std(axis=0)))]]
        d = chord(x[rows] @ v)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            inside = d < radius
        if not inside.any() or inside.all():
            continue
        nodes[at] = Node(v, radius, len(nodes), len(nodes) + 1)
        nodes += [Node(rows=rows[inside]), Node(rows=rows[~inside])]
        for i in (len(nodes) - 2, len(nodes) - 1):
            heapq.heappush(todo, (-len(nodes[i].rows), i))
        leaves += 1
    for i, n in enumerate(x for x in nodes if x.rows is not None):
        n.leaf = i
    return nodes


def home(nodes: list[Node], q: np.ndarray) -> np.ndarray:
    """Leaf number that each vector itself belongs to."""
    out = np.zeros(len(q), np.int64)
    todo = [(0, np.arange(len(q)))]
    while todo:
        at, idx = todo.pop()
        n = nodes[at]
        if n.leaf >= 0:
            out[idx] = n.leaf
            continue
        inside = chord(q[idx] @ n.vantage) <= n.radius
        todo += [(c, i) for c, i in ((n.inner, idx[inside]), (n.outer, idx[~inside])) if len(i)]
    return out


def reach(nodes: list[Node], q: np.ndarray, tau, factor: float):
    """(leaf node, indices of the queries that must see it); ``tau()`` is read at each visit."""
    todo = [(0, np.arange(len(q)))]
    while todo:
        at, idx = todo.pop()
        n = nodes[at]
        if n.leaf >= 0:
            yield n, idx
            continue
        d = chord(q[idx] @ n.vantage)
        margin = factor * tau()[idx] + 1e-5
        todo += [(c, i) for c, i in ((n.inner, idx[d - margin <= n.radius]), (n.outer, idx[d + margin >= n.radius])) if len(i)]


class Best:
    """The k best finds of each query, with the radius they leave to search."""

    def __init__(self, n: int, k: int, floor: float):
        self.cos = np.full((n, k), -2.0, np.float32)
        self.row = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, floor, np.float32)
        self.limit = floor

    def tau(self) -> np.ndarray:
        return chord(np.maximum(self.floor, -1.0))

    def add(self, idx: np.ndarray, cos: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        cos = np.round(cos, DIGITS)
        hit = (cos >= self.floor[idx][:, None]) & (rows[None, :] != own[idx][:, None])
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        who, k = idx[some], self.cos.shape[1]
        c = np.where(hit[some], cos[some], -2.0).astype(np.float32)
        if c.shape[1] > 4 * k:
            cut_at = -np.partition(-c, k, axis=1)[:, k]
            c[c < cut_at[:, None]] = -2.0
            used = np.flatnonzero((c > -2.0).any(axis=0))
            c, rows = c[:, used], rows[used]
        all_cos = np.concatenate([self.cos[who], c], axis=1)
        all_row = np.concatenate([self.row[who], np.broadcast_to(rows, c.shape)], axis=1)
        order = np.lexsort((all_row, -all_cos), axis=1)[:, :k]
        self.cos[who] = np.take_along_axis(all_cos, order, 1)
        self.row[who] = np.take_along_axis(all_row, order, 1)
        self.floor[who] = np.maximum(self.limit, self.cos[who, -1])


def search(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: float, factor: float, leaf_rows: int, seed: int = 7, block: int = 8192):
    """(cosines, rows of x) of the k best of each query; ``own`` is the query's own row or -1."""
    nodes = build(x, 1 << 30, leaf_rows, np.random.default_rng(seed))
    leaf = {n.leaf: (n.rows, x[n.rows]) for n in nodes if n.leaf >= 0}
    cos, row = [], []
    for s in range(0, len(q), block):
        qs, mine = q[s : s + block], own[s : s + block]
        best = Best(len(qs), k, floor)
        at = home(nodes, qs)
        for i in np.unique(at):
            idx = np.flatnonzero(at == i)
            best.add(idx, qs[idx] @ leaf[i][1].T, leaf[i][0], mine)
        for n, idx in reach(nodes, qs, best.tau, factor):
            idx = idx[at[idx] != n.leaf]
            if len(idx):
                best.add(idx, qs[idx] @ leaf[n.leaf][1].T, leaf[n.leaf][0], mine)
        cos.append(best.cos)
        row.append(best.row)
    return np.concatenate(cos), np.concatenate(row)


def _units(batches):
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        col = batch.column("embedding")
        n_el = np.array([-1 if v is None else v for v in pa.compute.list_value_length(col).to_pylist()], np.int64)
        ok = (n_el > 0) & (n_el == np.nan_to_num(dims.astype(np.float64), nan=-1).astype(np.int64))
        keep, key, unit = [], [], []
        for d in np.unique(n_el[ok]).tolist():
            rows = np.flatnonzero(ok & (n_el == d))
            flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), d)
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            rows, flat = rows[good], flat[good]
            if not len(rows):
                continue
            flat = flat / np.abs(flat).max(axis=1, keepdims=True)
            flat /= np.sqrt((flat * flat).sum(axis=1, keepdims=True))
            grid = np.rint(flat * 10**DIGITS).astype(np.int64).view(np.uint64)
            place = chars.mix(np.arange(1, d + 1, dtype=np.uint64))
            keep.append(rows)
            key.append(chars.mix(chars.mix(grid * place + place).sum(axis=1, dtype=np.uint64)).view(np.int64))
            unit += [r.tobytes() for r in flat.astype(np.float32)]
        if keep:
            rows = pa.array(np.concatenate(keep))
            yield pa.record_batch([batch.column("space_id").take(rows), batch.column("cid").take(rows), pa.array(np.concatenate(key)), pa.array(unit, pa.binary())], names=["space_id", "cid", "same", "unit"])


def _first_tau(floor: float, min_similarity: float | None, near: float) -> float:
    """Search radius before anything is found."""
    return near if min_similarity is None else math.sqrt(max(0.0, 2.0 - 2.0 * floor))


def _rows_of(col) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1) if raw else np.empty((0, 1), np.float32)


def sample_size(shards: int, sample_rows: int) -> int:
    """Sample vectors for a routing tree of so many shards."""
    return min(max(sample_rows, LEAF_SAMPLE * shards), max(sample_rows, SAMPLE_MOST))


def router(sample: np.ndarray, shards: int) -> list[Node]:
    """The routing tree of a space: as many leaves as shards, without the sample itself."""
    nodes = build(sample, shards, LEAF_SAMPLE // 2, np.random.default_rng(11))
    for n in nodes:
        n.rows = None
    return nodes


def neighbour_lists(records: DataFrame, k: int = 10, min_similarity: float | None = None, factor: float = 0.25, shard_rows: int = 16384, leaf_rows: int = 128, sample_rows: int = 4096, query_rows: int = 65536) -> DataFrame:
    """space_id, cid, neighbours: array<struct<cosine, cid>> of at most k, best first.

    ``records``: cid, space_id, embedding array, dim. With ``min_similarity``
    only neighbours of at least that cosine are listed; vectors without any are
    left out.
    """
    spark = records.sparkSession
    # Unknown how near the k-th is, the search starts from everything.
    floor = -1.0 if min_similarity is None else float(min_similarity) - 2 * 10**-DIGITS
    usable = records.select("space_id", "cid", "dim", "embedding").filter("cid is not null and space_id is not null").mapInArrow(_units, "space_id string, cid string, same long, unit binary")
    # Ids and vectors are made unique apart, so that vectors are shuffled once.
    members = cut(usable.groupBy("space_id", "cid").agg(F.min("same").alias("same")).select("space_id", "cid", "same", F.xxhash64("space_id", "same").alias("vid")))
    names = members.groupBy("space_id", "same").agg(F.min("cid").alias("rep"))
    units = usable.groupBy("space_id", "same").agg(F.min("unit").alias("unit"))
    reps = cut(units.join(names, ["space_id", "same"]).select("space_id", F.xxhash64("space_id", "same").alias("vid"), "rep", "unit"))

    # One row per space; the sample is a bounded number of vectors of each.
    sizes = {r["space_id"]: r["n"] for r in reps.groupBy("space_id").agg(F.count("*").alias("n")).collect()}
    routers, near = {}, {}
    shards = {s: math.ceil(n / shard_rows) for s, n in sizes.items() if n > shard_rows}
    if shards:
        w = Window.partitionBy("space_id").orderBy(F.xxhash64("vid"), "vid")
        most = F.element_at(F.create_map(*(F.lit(v) for s, n in shards.items() for v in (s, sample_size(n, sample_rows)))), F.col("space_id"))
        some = reps.filter(F.col("space_id").isin(list(shards))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(sample_size(n, sample_rows) for n in shards.values()))
        sample: dict[str, list[bytes]] = {}
        for r in some.filter(F.col("r") <= most).select("space_id", "unit").collect():
            sample.setdefault(r["space_id"], []).append(r["unit"])
        for s, raw in sample.items():
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)
            routers[s] = router(x, shards[s])
            # Without a least similarity the shards are chosen by the k-th distance in the sample.
            kth = np.sort(chord(x[:256] @ x.T), axis=1)[:, min(k, len(x) - 1)]
            near[s] = 2.0 if factor >= 1 else float(np.quantile(kth, 0.95))
    # Queries of one shard are cut into blocks, each of which sees all the shard's points.
    blocks = {s: max(1, math.ceil(n / query_rows)) for s, n in sizes.items()}
    for s, nodes in routers.items():
        x = np.frombuffer(b"".join(sample[s][:sample_rows]), np.float32).reshape(min(len(sample[s]), sample_rows), -1)
        tau = np.full(len(x), _first_tau(floor, min_similarity, near[s]))
        asked = sum(len(idx) for _, idx in reach(nodes, x, lambda tau=tau: tau, factor)) / len(x)
        blocks[s] = max(1, math.ceil(sizes[s] * asked / sum(n.leaf >= 0 for n in nodes) / query_rows))
    plan = spark.sparkContext.broadcast((routers, blocks, near))

    def route(batches):
        trees, blocks, near = plan.value
        for batch in batches:
            spaces = np.array(batch.column("space_id").to_pylist(), object)
            for s in dict.fromkeys(spaces.tolist()):
                rows = np.flatnonzero(spaces == s)
                q = _rows_of(batch.column("unit").take(pa.array(rows)))
                if s in trees:
                    mine = home(trees[s], q)
                    tau = np.full(len(q), _first_tau(floor, min_similarity, near[s]))
                    asks = [(n.leaf, idx[mine[idx] != n.leaf]) for n, idx in reach(trees[s], q, lambda tau=tau: tau, factor)]
                else:
                    mine, asks = np.zeros(len(q), np.int64), []
                block = (chars.mix(np.arange(len(q), dtype=np.uint64) + np.uint64(len(q))) % np.uint64(blocks[s])).astype(np.int64)
                for b in range(blocks[s]):
                    yield _routed(batch, rows, mine, np.full(len(rows), b), np.where(block == b, POINT | QUERY, POINT))
                for leaf, idx in asks:
                    if len(idx):
                        yield _routed(batch, rows[idx], np.full(len(idx), leaf), block[idx], np.full(len(idx), QUERY))

    def _routed(batch, rows, shard, block, part):
        take = pa.array(rows)
        # Only points are named: their order decides ties.
        rep = pa.compute.if_else(pa.array(part != QUERY), batch.column("rep").take(take), None)
        return pa.record_batch(
            [batch.column("space_id").take(take), batch.column("vid").take(take), rep, batch.column("unit").take(take), pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(part, pa.int32())],
            names=["space_id", "vid", "rep", "unit", "shard", "block", "part"],
        )

    def answer(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        part = t.column("part").to_numpy()
        points, queries = t.filter(pa.array(part & POINT > 0)).sort_by("rep"), t.filter(pa.array(part & QUERY > 0))
        if not len(points) or not len(queries):
            return pa.table({"vid": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        x, q = _rows_of(points.column("unit")), _rows_of(queries.column("unit"))
        ids, asking = points.column("vid").to_numpy(), queries.column("vid").to_numpy()
        order = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids, asking, sorter=order), len(ids) - 1)
        own = np.where(ids[order[at]] == asking, order[at], -1)
        cos, row = search(x, q, own, k, floor, factor, leaf_rows)
        i, j = np.nonzero(cos > -1.5)
        to = row[i, j]
        exact = np.round(np.einsum("ij,ij->i", q[i].astype(np.float64), x[to].astype(np.float64)), DIGITS)
        return pa.table({"vid": pa.array(asking[i]), "near": pa.array(ids[to]), "cosine": pa.array(exact)})

    routed = reps.mapInArrow(route, "space_id string, vid long, rep string, unit binary, shard long, block long, part int")
    found = cut(routed.groupBy("space_id", "shard", "block").applyInArrow(answer, "vid long, near long, cosine double"))
    if min_similarity is not None:
        found = found.filter(F.col("cosine") >= min_similarity)
    both = found.union(found.select(F.col("near").alias("vid"), F.col("vid").alias("near"), "cosine"))
    # The limit on the rank is applied before the shuffle as well, so a hub costs about k rows a task; ties stay
    # in until they have names. A pair found from both sides is there twice, which the limit has to allow for.
    w = Window.partitionBy("vid").orderBy(F.desc("cosine"))
    both = both.withColumn("r", F.rank().over(w)).filter(F.col("r") <= 2 * k).select("vid", "near", "cosine").distinct()

    w = Window.partitionBy("vid").orderBy("cid")
    firsts = members.select("vid", "cid").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).drop("r")
    theirs = both.join(firsts.withColumnRenamed("vid", "near"), "near").select("vid", "cosine", "cid")
    listed = theirs.union(firsts.select("vid", F.lit(1.0).alias("cosine"), "cid"))
    w = Window.partitionBy("vid").orderBy(F.desc("cosine"), "cid")
    listed = listed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    lists = listed.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("r", "cosine", "cid"))).alias("all"))
    out = members.select("space_id", "cid", "vid").join(lists, "vid")
    others = F.slice(F.filter("all", lambda x: x["cid"] != F.col("cid")), 1, k)
    return out.select("space_id", "cid", F.transform(others, lambda x: F.struct(x["cosine"].alias("cosine"), x["cid"].alias("cid"))).alias("neighbours")).filter(F.size("neighbours") > 0)


def similar_pairs(records: DataFrame, k: int = 10, min_similarity: float = 0.85, **kw) -> DataFrame:
    """cid_a, cid_b (smaller first): at least one of them is among the other's k nearest."""
    one = neighbour_lists(records, k, min_similarity, **kw).select(F.col("cid").alias("x"), F.explode("neighbours.cid").alias("y"))
    return one.select(F.least("x", "y").alias("cid_a"), F.greatest("x", "y").alias("cid_b")).distinct()
