"""Graph operators on vertex and edge tables.

Edges are (src, dst) with optional kind and weight; vertices are (id). Traversals
are iterative frontier joins whose lineage is cut in the shared checkpoint
folder; nothing is collected but loop conditions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.columns import beside

from loomspan.session import cut, cut_by


def neighbours(edges: DataFrame, ids: list, direction: str = "both") -> DataFrame:
    """id, neighbour, direction of given vertices, duplicates kept."""
    out = edges.filter(F.col("src").isin(ids)).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.filter(F.col("dst").isin(ids)).select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.union(into)}[direction]


def reach(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """start, id, distance of the vertices within ``depth`` steps, the start left out."""
    e = edges.select(F.col("dst").alias("f"), F.col("src").alias("t")) if reverse else edges.select(F.col("src").alias("f"), F.col("dst").alias("t"))
    e = e.distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier.id == e.f).select("start", F.col("t").alias("id")).distinct()
        frontier = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.filter("distance > 0")


def shortest_path(edges: DataFrame, source, target, hops: int = 6) -> DataFrame:
    """path, hops: the shortest path, of equals the one that comes first.

    ``[x]`` for a vertex to itself, no row beyond ``hops`` steps. A true hop
    bound takes the place of a bound on visited vertices.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    frontier = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path"))
    seen = frontier.select("id")
    e = edges.select("src", "dst").distinct()
    for d in range(hops + 1):
        hit = frontier.filter(F.col("id") == F.lit(target)).select("path", F.lit(d).alias("hops"))
        if not hit.isEmpty():
            return hit
        step = frontier.join(e, frontier.id == e.src).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("id"))
    return frontier.filter(F.lit(False)).select("path", F.lit(0).alias("hops"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, instability = in / (in + out), orphan (G5, G10); parallel edges count."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    d = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    r = vertices.select("id").join(d, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    total = F.col("in_degree") + F.col("out_degree")
    return r.select("id", "out_degree", "in_degree", F.when(total > 0, F.round(F.col("in_degree") / total, 6)).otherwise(0.0).alias("instability"), (total == 0).alias("orphan"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density, avg_out_degree."""
    n = beside(vertices.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")))
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return n.select("nodes", "edges", F.when(possible > 0, F.round(F.col("edges") / possible, 6)).otherwise(0.0).alias("density"), F.round(F.col("edges") / F.greatest("nodes", F.lit(1)), 2).alias("avg_out_degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, every: int = 5) -> DataFrame:
    """id, rank (G6): parallel edges count, edges to unknown targets still take their share, dangling mass is lost."""
    n = vertices.count()
    if n == 0:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    # Parallel edges are one row with a multiplicity. Both tables are partitioned once: a step shuffles the sums alone.
    share = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").join(vertices.select(F.col("id").alias("dst")), "dst").select("src", "dst", (F.col("m") / F.col("out")).alias("w")))
    share, ids = cut_by(share, "src"), cut_by(vertices.select("id").distinct(), "id")
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for i in range(iterations):
        got = share.join(rank, share.src == rank.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        rank = ids.join(got, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * damping + (1 - damping) / n).alias("rank"))
        if (i + 1) % every == 0 and i + 1 < iterations:
            rank = cut_by(rank, "id")
    return rank.select("id", F.round("rank", 6).alias("rank"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, clustering: directed edges among a vertex's neighbours over those possible.

    Triangles are found from the edge side: every edge (a, b) is joined with
    the neighbours of its end of lower degree, so that a hub does not pair all
    its neighbours.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    nb = cut(e.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(e.select(F.col("dst").alias("id"), F.col("src").alias("n"))).distinct())
    size = nb.groupBy("id").agg(F.count("*").alias("k"))
    k = size.withColumnRenamed("id", "v")
    ends = e.join(k.select(F.col("v").alias("src"), F.col("k").alias("ks")), "src").join(k.select(F.col("v").alias("dst"), F.col("k").alias("kd")), "dst")
    low = F.when(F.col("ks") <= F.col("kd"), F.col("src")).otherwise(F.col("dst"))
    high = F.when(F.col("ks") <= F.col("kd"), F.col("dst")).otherwise(F.col("src"))
    wedge = ends.select(low.alias("id"), high.alias("other")).join(nb, "id").filter("n <> other")
    closed = wedge.join(nb.select(F.col("id").alias("other"), F.col("n").alias("n")), ["other", "n"], "left_semi")
    count = closed.groupBy(F.col("n").alias("id")).agg(F.count("*").alias("c"))
    # A vertex with a loop is its own neighbour: its edges from and to itself count, loops of others do not.
    selfish = size.join(loops, "id").select("id", F.lit(1).alias("own"))
    direct = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("touch"))
    r = vertices.select("id").join(size, "id", "left").join(count, "id", "left").join(selfish, "id", "left").join(direct, "id", "left")
    kk = F.coalesce("k", F.lit(0)) + F.coalesce("own", F.lit(0))
    c = F.coalesce("c", F.lit(0)) + F.when(F.col("own") == 1, F.coalesce("touch", F.lit(0))).otherwise(0)
    return r.select("id", F.when(kk >= 2, F.round(c / (kk * (kk - 1)), 6)).otherwise(0.0).alias("clustering"))


#: Graphs that one task takes whole; larger ones are an error.
MOST_VERTICES = 1 << 18


def _small(rows: DataFrame, what: str, most: int = MOST_VERTICES) -> None:
    """An error for a table that is too large for one task; no more than one row over the bound is counted."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what} takes the whole graph in each task and is limited to {most} rows here")


def _spans(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``start[i]`` to ``start[i + 1]`` of each i of ``at``, and the i of each."""
    size = start[at + 1] - start[at]
    return np.repeat(at, size), np.arange(size.sum()) + np.repeat(start[at] - np.cumsum(size) + size, size)


def _add(total: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
    """Sums ``by`` into ``total``, with repeated positions; one sweep over all of it where there are many."""
    if len(at) * 8 < len(total):
        np.add.at(total, at, by)
    else:
        total += np.bincount(at, by, len(total))


def _shares(sides: list, sources) -> np.ndarray:
    """Sums over shortest paths from the sources, by vertex; ``sides``: starts, ends and multiplicities of edges out of and into vertices."""
    (start, to, times), (b_start, b_from, b_times) = sides
    n = len(start) - 1
    out, into = np.diff(start), np.diff(b_start)
    total, dist, sigma, delta, place = np.zeros(n), np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for s in sources:
        dist[s], sigma[s] = 0, 1.0
        level, steps, seen, unseen = np.array([s]), [], [], len(to) - into[s]
        while len(level):
            seen.append(level)
            far = len(seen)
            if unseen + n // 8 < out[level].sum():
                w, e = _spans(b_start, np.flatnonzero(dist < 0))
                v = b_from[e]
                on = np.flatnonzero(dist[v] == far - 1)
                v, w, m = v[on], w[on], None if b_times is None else b_times[e[on]]
                level = w[np.diff(w, prepend=-1) > 0]
            else:
                v, e = _spans(start, level)
                w = to[e]
                on = np.flatnonzero(dist[w] < 0)
                v, w, m = v[on], w[on], None if times is None else times[e[on]]
                place[w] = np.arange(len(w))
                level = w[place[w] == np.arange(len(w))]
            dist[level] = far
            unseen -= into[level].sum()
            _add(sigma, w, sigma[v] if m is None else m * sigma[v])
            steps.append((v, w, m))
        for v, w, m in reversed(steps):
            share = sigma[v] * ((1 + delta[w]) / sigma[w])
            _add(delta, v, share if m is None else m * share)
        every = np.concatenate(seen)
        every = slice(None) if 4 * len(every) > n else every
        delta[s] = 0.0
        total[every] += delta[every]
        dist[every], sigma[every], delta[every] = -1, 0.0, 0.0
    return total


def betweenness(vertices: DataFrame, edges: DataFrame, sources: int | None = None) -> DataFrame:
    """id, betweenness (G7): Brandes' accumulation, parallel over source vertices.

    Every vertex is a source unless ``sources`` takes only the first ones by
    id. Parallel edges are paths of their own. A level is found from the edges
    out of the last one or, where they are fewer, from those into the vertices
    not yet seen; only edges of shortest paths are summed over. The whole graph
    goes to each task as arrays, so it is for graphs of at most
    ``MOST_VERTICES`` vertices; a larger one is an error.
    """
    _small(vertices, "betweenness")
    _small(edges, "betweenness", 40 * MOST_VERTICES)
    ids = [r["id"] for r in vertices.select("id").distinct().orderBy("id").collect()]
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    merged = edges.groupBy("src", "dst").agg(F.count("*").alias("m")).toArrow()
    order = np.array(sorted((at[a], at[b], m) for a, b, m in zip(*(merged[c].to_pylist() for c in ("src", "dst", "m")), strict=True) if a in at and b in at), np.int64).reshape(-1, 3)
    times = order[:, 2]
    if times.sum() <= 1.2 * len(times):  # few parallel edges stand one by one and need no multiplicity
        order, times = np.repeat(order, times, axis=0), None
    back = np.argsort(order[:, 1], kind="stable")
    sides = [(np.searchsorted(o[:, k], np.arange(n + 1)), o[:, 1 - k].copy(), None if times is None else o[:, 2].astype(np.float64)) for o, k in ((order, 0), (order[back], 1))]
    spark = vertices.sparkSession
    graph = spark.sparkContext.broadcast(sides)

    def run(batches):
        ids = (s for pdf in batches for s in pdf["id"].tolist())
        total = _shares(graph.value, ids)
        yield pd.DataFrame({"i": np.arange(len(total)), "b": total})

    some = spark.range(n if sources is None else min(sources, n)).repartition(min(32, max(1, n)))
    parts = some.mapInPandas(run, "i long, b double").groupBy("i").agg(F.sum("b").alias("b"))
    scale = max(1.0, float((n - 1) * (n - 2))) if n > 2 else 1.0
    names = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"i long, id {dict(vertices.dtypes)['id']}") if ids else vertices.select(F.lit(0).cast("long").alias("i"), "id")
    return names.join(parts, "i", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) / scale, 6).alias("betweenness"))


def components(edges: DataFrame, directed: bool = True) -> DataFrame:
    """id, component of the strongly (or weakly) connected components (G14), named by their smallest vertex.

    Strong components by forward and backward colouring: the smallest vertex
    that reaches a vertex is its colour; those that reach back are a component,
    and the rest goes on. Each colouring takes labels from labels, so long chains halve.
    """
    if not directed:
        return _colour(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    vertices = left.select(F.col("src").alias("id")).union(left.select(F.col("dst"))).union(edges.filter("src = dst").select("src")).distinct()
    done = None
    while True:
        left, single = _trim(left)
        if left is None:
            break
        colour = _colour(left)
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").filter("c1 = c2")
        back = _back(inside.select("src", "dst", F.col("c1").alias("component")), colour)
        done = back if done is None else cut(done.union(back))
        gone = back.select("id")
        left = cut(left.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if done is None:
        return vertices.select("id", F.col("id").alias("component"))
    return vertices.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _trim(e: DataFrame):
    """Edges without vertices that lack a way in or out, which are components of their own."""
    while True:
        if e.isEmpty():
            return None, None
        ok = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
        kept = cut(e.join(ok.select(F.col("id").alias("src")), "src", "left_semi").join(ok.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if kept.count() == e.count():
            return kept, None
        e = kept


def _colour(e: DataFrame) -> DataFrame:
    """id, component: the smallest vertex that reaches each vertex."""
    labels = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst"))).distinct().select("id", F.col("id").alias("component")))
    while True:
        heard = e.join(labels, e.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("h"))
        step = labels.join(heard, "id", "left").select("id", F.least("component", F.coalesce("h", "component")).alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        if step.filter("component <> old").isEmpty():
            return step.select("id", "component")
        labels = step.select("id", "component")


def _back(inside: DataFrame, colour: DataFrame) -> DataFrame:
    """id, component of the vertices that reach their colour's own vertex."""
    seen = colour.filter("id = component")
    frontier = seen
    while True:
        step = inside.join(frontier.select(F.col("id").alias("dst"), "component"), ["dst", "component"]).select(F.col("src").alias("id"), "component").distinct()
        frontier = cut(step.join(seen, ["id", "component"], "left_anti"))
        if frontier.isEmpty():
            return cut(seen)
        seen = seen.union(frontier)


def tensor_edges(links: DataFrame, weights: dict[str, float]) -> DataFrame:
    """relation, i, j, v: clamped confidences summed and symmetrised (G21); unknown relations are dropped."""
    known = links.filter(F.col("relation").isin(list(weights))).filter("src is not null and dst is not null")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    one = known.select("relation", F.col("src").alias("i"), F.col("dst").alias("j"), v.alias("v"))
    both = one.union(one.select("relation", F.col("j"), F.col("i"), "v"))
    return both.groupBy("relation", "i", "j").agg((F.sum("v") / 2).alias("v"))


def centrality(tensor: DataFrame, vertices: DataFrame, weights: dict[str, float], tolerance: float = 1e-9, most: int = 20000) -> DataFrame:
    """id, centrality: dominant vector of the weighted sum of relations, shifted by its largest row sum."""
    return centralities(tensor, vertices, [weights], tolerance, most).select("id", F.col("c0").alias("centrality"))


#: Vertices whose rows of the matrix are packed together.
BLOCK_VERTICES = 1 << 14


def centralities(tensor: DataFrame, vertices: DataFrame, weights: list[dict[str, float]], tolerance: float = 1e-9, most: int = 20000) -> DataFrame:
    """id, c0, c1, ...: the centrality of each of some weightings, found together.

    The matrix is packed into blocks of rows once and stays with the tasks; the
    vectors, a number a vertex and weighting, go to all tasks and back in each
    step of the power iteration. An error when one does not converge.
    """
    spark, kind, q = vertices.sparkSession, dict(vertices.dtypes)["id"], len(weights)
    ids = cut(vertices.select("id").distinct())
    n = ids.count()
    blocks = max(1, n // BLOCK_VERTICES)
    place = F.row_number().over(Window.partitionBy("b").orderBy("id")) - 1
    names = cut(ids.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("k", place))
    size = dict(names.groupBy("b").count().collect())
    start = np.concatenate([[0], np.cumsum([size.get(i, 0) for i in range(blocks)])]).astype(np.int64)
    at = names.withColumn("p", (F.element_at(F.lit(start.tolist()), F.col("b") + 1) + F.col("k")).cast("int"))
    pairs = [F.create_map(*(x for k, w in each.items() for x in (F.lit(k), F.lit(float(w))))) for each in weights]
    m = tensor.groupBy("i", "j").agg(*(F.coalesce(F.sum(F.col("v") * F.element_at(w, F.col("relation"))), F.lit(0.0)).alias(f"v{c}") for c, w in enumerate(pairs)))
    m = m.join(at.select(F.col("id").alias("j"), "p"), "j").join(at.select(F.col("id").alias("i"), "b", "k"), "i").drop("i", "j")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["b"].iloc[0])
        order = np.argsort(pdf["k"].to_numpy(), kind="stable")
        per_row = np.bincount(pdf["k"], minlength=start[b + 1] - start[b]).astype(np.int32)
        v = np.stack([pdf[f"v{c}"].to_numpy(float)[order] for c in range(q)])
        return pd.DataFrame({"b": [b], "n": [per_row.tobytes()], "p": [pdf["p"].to_numpy(np.int32)[order].tobytes()], "v": [v.tobytes()]})

    packed = cut(m.groupBy("b").applyInPandas(pack, "b int, n binary, p binary, v binary"))

    def times(xs: np.ndarray) -> np.ndarray:
        """The products of the matrices with their vectors."""
        sent = spark.sparkContext.broadcast(xs)

        def run(batches):
            xs = sent.value
            for batch in batches:
                for r in range(batch.num_rows):
                    b, per_row, p, v = (batch.column(c)[r] for c in ("b", "n", "p", "v"))
                    per_row, p = (np.frombuffer(x.as_buffer(), np.int32) for x in (per_row, p))
                    v = np.frombuffer(v.as_buffer(), np.float64).reshape(len(xs), -1)
                    i = np.repeat(np.arange(len(per_row)), per_row)
                    y = np.stack([np.bincount(i, v[c] * xs[c][p], len(per_row)) for c in range(len(xs))])
                    yield pa.record_batch([pa.array([b.as_py()], pa.int32()), pa.array([y.tobytes()], pa.binary())], names=["b", "y"])

        out = np.zeros((q, n))
        for b, y in packed.mapInArrow(run, "b int, y binary").collect():
            out[:, start[b] : start[b + 1]] = np.frombuffer(y).reshape(q, -1)
        sent.destroy()
        return out

    x = np.full((q, n), 1 / np.sqrt(max(1, n)))
    sigma = times(np.ones((q, n))).max(axis=1, initial=0.0)
    moving = sigma > 0
    for _ in range(most):
        if not moving.any():
            break
        y = sigma[:, None] * x + times(x)
        for c in np.flatnonzero(moving):
            new = y[c] / np.linalg.norm(y[c])
            moving[c] = np.abs(new - x[c]).sum() >= tolerance
            x[c] = new
    if moving.any():
        raise ValueError("power iteration did not converge")
    sent = spark.sparkContext.broadcast(x)

    def named(batches):
        for batch in batches:
            p = start[batch.column("b").to_numpy()] + batch.column("k").to_numpy()
            yield pa.record_batch([batch.column("id"), *(pa.array(sent.value[c][p]) for c in range(q))], names=["id", *(f"c{c}" for c in range(q))])

    out = cut(names.mapInArrow(named, f"id {kind}, " + ", ".join(f"c{c} double" for c in range(q))))
    sent.destroy()
    return out


def rank_delta(weighted: DataFrame, uniform: DataFrame, share: float = 0.1) -> DataFrame:
    """id, rank_det, rank_ai, delta, lane (G23, W8, W10): the top share by delta, ties included, goes to people."""
    place = lambda df, name: df.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("centrality", 9)), "id")).alias(name))
    both = place(weighted, "rank_det").join(place(uniform, "rank_ai"), "id")
    d = both.withColumn("delta", F.abs(F.col("rank_det") - F.col("rank_ai")))
    ranked = d.withColumn("_p", F.row_number().over(Window.orderBy(F.desc("delta")))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    least = ranked.filter(F.col("_p") == F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).select(F.col("delta").alias("least"))
    return d.transform(beside, least).select("id", "rank_det", "rank_ai", "delta", F.when(F.col("delta") >= F.col("least"), "human").otherwise("auto").alias("lane"))


def schema_of(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """src_kind, kind, dst_kind, edges, cardinality of each relation (G16, A26): 1:1, 1:N, N:1 or N:M at 1.1."""
    k = kinds.select("id", F.col("kind").alias("k"))
    e = edges.join(k.select(F.col("id").alias("src"), F.col("k").alias("src_kind")), "src").join(k.select(F.col("id").alias("dst"), F.col("k").alias("dst_kind")), "dst")
    d = e.select("src_kind", "kind", "dst_kind", "src", "dst").distinct()
    # Distinct counts in two levels, so that no row carries a set.
    keys = ["src_kind", "kind", "dst_kind"]
    s = d.groupBy(*keys, "src").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.avg("c").alias("per_src"), F.sum("c").alias("edges"))
    t = d.groupBy(*keys, "dst").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.avg("c").alias("per_dst"))
    many, manys = F.col("per_src") > 1.1, F.col("per_dst") > 1.1
    card = F.when(many & manys, "N:M").when(many, "1:N").when(manys, "N:1").otherwise("1:1")
    return s.join(t, keys).select(*keys, "edges", card.alias("cardinality"))


def complexity(vertices: DataFrame, edges: DataFrame, rank: DataFrame | None = None, closeness: DataFrame | None = None) -> DataFrame:
    """complexity and its parts, one row (G12): coupling, spread of rank, tightness, orphans, instability."""
    rank = pagerank(vertices, edges) if rank is None else rank
    closeness = clustering(vertices, edges) if closeness is None else closeness
    d = degrees(vertices, edges).agg(F.avg(F.col("orphan").cast("double")).alias("orphan_ratio"), F.avg("instability").alias("instability_mean"))
    one = density(vertices, edges).select("density").transform(beside, d)
    one = one.transform(beside, rank.agg(F.var_pop("rank").alias("rank_variance"))).transform(beside, closeness.agg(F.avg("clustering").alias("clustering_mean")))
    c = F.coalesce
    zero = F.lit(0.0)
    total = c("density", zero) * 0.25 + c("rank_variance", zero) * 100 * 0.25 + c("clustering_mean", zero) * 0.20 + c("orphan_ratio", zero) * 0.15 + c("instability_mean", zero) * 0.15
    return one.select(F.round(total, 6).alias("complexity"), "density", *(F.round(c(x, zero), 6).alias(x) for x in ("rank_variance", "clustering_mean", "orphan_ratio", "instability_mean")))


def standing_out(vertices: DataFrame, edges: DataFrame, cycle_kind: str, between: DataFrame | None = None, closeness: DataFrame | None = None) -> DataFrame:
    """pattern, id of vertices that stand out (G13): in cycles, hubs, orphans, unstable, gatekeepers, tightly coupled."""
    d = degrees(vertices, edges)
    means = d.agg(F.avg("in_degree").alias("mean_in"), F.avg("out_degree").alias("mean_out"))
    flags = d.transform(beside, means)
    named = {
        "hub": (F.col("in_degree") > 3 * F.col("mean_in")) | (F.col("out_degree") > 3 * F.col("mean_out")),
        "orphan": F.col("orphan"),
        "unstable": F.col("instability") > 0.8,
    }
    out = flags.select("id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())), lambda x: x.isNotNull())).alias("pattern"))
    if between is not None:
        out = out.union(between.filter("betweenness > 0.1").select("id", F.lit("gatekeeper")))
    closeness = clustering(vertices, edges) if closeness is None else closeness
    out = out.union(closeness.filter("clustering > 0.5").select("id", F.lit("tight")))
    strong = components(edges.filter(F.col("kind") == cycle_kind))
    large = strong.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    out = out.union(strong.join(large, "component").select("id", F.lit("cycle")))
    return out.select("pattern", "id")


def long_chains(edges: DataFrame, starts: DataFrame, least: int = 7, depth: int = 10) -> DataFrame:
    """src, dst, vertices: ends whose shortest path has at least ``least`` vertices, from given starts among themselves."""
    hops = reach(edges, starts, depth)
    ends = hops.join(starts.select("id"), "id", "left_semi").filter("start < id")
    return ends.filter(F.col("distance") + 1 >= least).select(F.col("start").alias("src"), F.col("id").alias("dst"), (F.col("distance") + 1).alias("vertices"))
