import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators import crdt, dedup
from loomspan.operators import graph as g
from loomspan.plans import match, pipeline

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("s", "s"), ("g", "zz")]
NODES = ["a", "b", "c", "d", "e", "f", "g", "s", "lone"]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame([(n,) for n in NODES], "id string"), spark.createDataFrame([(a, b, "import", 1.0) for a, b in EDGES], "src string, dst string, kind string, weight double")


def test_pagerank(graph):
    v, e = graph
    got = {r["id"]: r["rank"] for r in g.pagerank(v, e).collect()}
    rank = dict.fromkeys(NODES, 1 / len(NODES))
    for _ in range(30):
        new = dict.fromkeys(NODES, 0.0)
        for a, b in EDGES:
            if b in new:
                new[b] += rank[a] / sum(x == a for x, _ in EDGES)
        rank = {n: 0.85 * new[n] + 0.15 / len(NODES) for n in NODES}
    assert got == {n: pytest.approx(round(r, 6), abs=1e-6) for n, r in rank.items()}


def test_reach_and_paths(spark, graph):
    v, e = graph
    starts = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["distance"]) for r in g.reach(e, starts, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert {r["id"] for r in g.reach(e, starts, 5, reverse=True).collect()} == {"b", "c"}
    assert g.shortest_path(e, "a", "f", 8).collect()[0]["path"] == ["a", "b", "c", "d", "e", "f"]
    assert g.shortest_path(e, "a", "a").collect()[0]["path"] == ["a"]
    assert g.shortest_path(e, "a", "f", 2).count() == 0 and g.shortest_path(e, "lone", "a").count() == 0


def test_degrees_and_density(graph):
    v, e = graph
    got = {r["id"]: (r["out_degree"], r["in_degree"], r["instability"], r["orphan"]) for r in g.degrees(v, e).collect()}
    assert got["c"] == (3, 1, 0.25, False) and got["d"] == (1, 2, round(2 / 3, 6), False) and got["lone"] == (0, 0, 0.0, True)
    d = g.density(v, e).collect()[0]
    assert d["density"] == round(10 / 72, 6) and d["avg_out_degree"] == 1.11


def test_strong_components_equal_reachability(spark):
    rng = random.Random(4)
    for n, m in ((6, 9), (12, 22)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        nodes = {x for p in pairs for x in p}
        reach = {x: {x} for x in nodes}
        for _ in nodes:
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
        got = {r["id"]: r["component"] for r in g.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        assert got == want


def test_clustering_and_betweenness(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 1)]
    v, e = spark.createDataFrame([(i,) for i in range(1, 7)], "id long"), spark.createDataFrame(pairs, "src long, dst long")
    nb = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(1, 7)}
    want = {i: round(sum((a, b) in pairs for a, b in itertools.permutations(n, 2)) / (len(n) * (len(n) - 1)), 6) if len(n) > 1 else 0.0 for i, n in nb.items()}
    assert {r["id"]: r["clustering"] for r in g.clustering(v, e).collect()} == want
    got = {r["id"]: r["betweenness"] for r in g.betweenness(v, e).collect()}
    assert got[3] == max(got.values()) and got[6] == 0 and got[4] == round(3 / 20, 6)


def test_tensor_ranks(spark):
    links = spark.createDataFrame([("x", "a", "b", 2.0), ("x", "b", "c", 0.5), ("y", "a", "c", 1.0), ("no", "a", "c", 1.0)], "relation string, src string, dst string, confidence double")
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    t = g.tensor_edges(links, {"x": 1.0, "y": 0.5})
    assert {(r["relation"], r["i"], r["j"]): r["v"] for r in t.collect()}[("x", "b", "a")] == 0.5
    one = g.centrality(t, v, {"x": 1.0, "y": 0.5})
    d = g.rank_delta(one, one).collect()
    assert len(d) == 3 and all(r["delta"] == 0 and r["lane"] == "human" for r in d)


def test_match_language(spark, graph):
    v = spark.createDataFrame([("a", "file", ["foo", "bar"]), ("b", "file", []), ("c", "test", ["foot"]), ("d", None, None)], "id string, kind string, defines array<string>")
    _, e = graph
    rows = lambda q: [tuple(r) for r in match.run(q, v, e).collect()]
    assert rows("MATCH (n) WHERE n.defines CONTAINS 'foo' RETURN n.id") == [("a",), ("c",)]
    assert rows("match (n) where n.kind = 'file' and n.id != \"a\" return n.id, n.nothing") == [("b", None)]
    assert rows("MATCH (n) WHERE n.kind = 'None' RETURN n.id") == [("d",)]
    # A condition on the second vertex finds no field of that name.
    assert rows("MATCH (a)-[:import]->(b) WHERE b.kind = 'file' RETURN a.id") == []
    assert rows("MATCH (a)-[:call]->(b) RETURN a.id") == []
    # The limit cuts before DISTINCT.
    assert rows("MATCH (a)-[r]->(b) RETURN DISTINCT r.kind LIMIT 2") == [("import",)]
    assert rows("MATCH (a)-[r]->(b) WHERE a.id STARTS WITH 'c' RETURN a.id, b.id, r.weight") == [("c", "a", 1.0), ("c", "d", 1.0), ("c", "d", 1.0)]
    for bad in ("SELECT 1", "MATCH (a) nonsense", "MATCH (a) WHERE a.id ~ 3"):
        with pytest.raises(ValueError):
            match.run(bad, v, e)


def test_pipeline_language(spark):
    r = pipeline.standard()
    assert pipeline.parse('a.b[x: 1, y: -2.5, z: true, n: null, s: "q\\"r"] | c') == [("a.b", {"x": 1, "y": -2.5, "z": True, "n": None, "s": 'q"r'}), ("c", {})]
    assert pipeline.plan_id(pipeline.parse("c[a: 1, b: 2]")) == pipeline.plan_id(pipeline.parse("c[b: 2,a: 1]"))
    for bad in ("", "A", "a|b", "a[x: 1", "a[x: 1 y: 2]", "a[x: 1, x: 2]", 'a[x: "q]', 'a[x: "b; rm"]'):
        with pytest.raises(pipeline.PipelineError):
            pipeline.parse(bad)
    for bad in ("rows.keep[least: 1]", "nothing", "text.score[x: 1]"):
        with pytest.raises(pipeline.PipelineError):
            pipeline.check(pipeline.parse(bad), r, ["doc_id", "text"])
    docs = spark.createDataFrame([(1, "you must pay 10"), (2, "i think"), (3, None)], "doc_id long, text string")
    assert [x["doc_id"] for x in pipeline.execute("text.score | rows.top[n: 1]", docs, r).collect()] == [1]


def naive_kept(hashes, most=3):
    kept = []
    for k, h in hashes:
        if not any(bin((h ^ x) & (2**64 - 1)).count("1") <= most for _, x in kept):
            kept.append((k, h))
    return {k for k, _ in kept}


def test_simhash_keeps_the_first_seen(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = rng.choice(base).split()
        if rng.random() < 0.7:
            t[rng.randrange(40)] = rng.choice("abcxyz")
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "id long, text string")
    hashes = [(r["id"], r["h"]) for r in df.select("id", dedup.simhash(df["text"]).alias("h")).orderBy("id").collect()]
    got = {r["id"] for r in dedup.near_by_simhash(df, "id").filter("kept").collect()}
    assert got == naive_kept(hashes)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 2), st.integers(0, 9)), max_size=12), st.randoms())
def test_lww_does_not_depend_on_order(spark, writes, rnd):
    make = lambda ws: spark.createDataFrame([(a, b, c, d) for a, b, c, d in ws], "key int, seq int, head int, value int")
    read = lambda ws: {tuple(r) for r in crdt.lww(make(ws), ["key"]).collect()}
    other = [*writes, *writes[:3]]
    rnd.shuffle(other)
    assert read(writes) == read(other)


def test_orset_and_reconverge(spark):
    adds = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "elem string, tag string")
    removes = spark.createDataFrame([("x", "1"), ("y", "1")], "elem string, tag string")
    assert [r["elem"] for r in crdt.orset_value(adds, removes, ["elem"]).collect()] == ["x"]
    bad = spark.createDataFrame([("k", "a", 1, 1, 1), ("k", "b", 1, 1, 1)], "key string, type string, value int, seq int, head int")
    with pytest.raises(ValueError):
        crdt.reconverge(bad, ["key"])


def test_line_changes(spark):
    df = spark.createDataFrame([(1, "a\nb\nb", "a\nc")], "id int, old string, new string")
    r = crdt.line_changes(df, "id", "old", "new").collect()[0]
    assert (r["added"], r["removed"]) == (1, 2)


def test_betweenness_of_parallel_edges_loops_and_long_paths(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(14), rng.randrange(16)) for _ in range(40)] + [(20 + i, 21 + i) for i in range(9)] + [(3, 5), (3, 5)]
    ids = [i for i in range(30) if i != 15]
    got = {r["id"]: r["betweenness"] for r in g.betweenness(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: pytest.approx(b, abs=1e-6) for i, b in brandes(ids, pairs).items()}


def brandes(ids, pairs):
    """The reference feature: a queue and lists of predecessors, all vertices as sources."""
    total = dict.fromkeys(ids, 0.0)
    out = {i: [b for a, b in pairs if a == i and b in total] for i in ids}
    for s in ids:
        stack, preds, sigma, dist, queue = [], {i: [] for i in ids}, dict.fromkeys(ids, 0.0), dict.fromkeys(ids, -1), [s]
        sigma[s], dist[s] = 1.0, 0
        while queue:
            v = queue.pop(0)
            stack.append(v)
            for w in out[v]:
                if dist[w] < 0:
                    queue.append(w)
                    dist[w] = dist[v] + 1
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    preds[w].append(v)
        delta = dict.fromkeys(ids, 0.0)
        while stack:
            w = stack.pop()
            for v in preds[w]:
                delta[v] += sigma[v] / sigma[w] * (1.0 + delta[w])
            if w != s:
                total[w] += delta[w]
    return {i: round(b / ((len(ids) - 1) * (len(ids) - 2)), 6) for i, b in total.items()}


def test_queries_take_all_sources_and_iterations(spark, monkeypatch):
    from loomspan.plans import graph_queries as gq
    from loomspan.plans import scoring_queries as sq

    pairs = [(i, i + 1) for i in range(40, 60)] + [(60, 40), (45, 58), (50, 1), (1, 2), (2, 40)]
    ids = list(range(1, 70))
    v, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(a, b, "R", 1.0) for a, b in pairs], "src long, dst long, kind string, weight double")
    monkeypatch.setattr(gq, "vertices", lambda *_: v)
    monkeypatch.setattr(gq, "edges", lambda *_: e)
    want = brandes(ids, pairs)
    assert {r["id"]: r["betweenness"] for r in gq.graph_betweenness(spark, "").collect()} == {i: pytest.approx(b, abs=1e-6) for i, b in want.items()}
    rank = {r["id"]: r["rank"] for r in g.pagerank(v, e).collect()}
    near = {}
    for s in (1, 2, 3, 5, 8):
        level, seen = {s}, {s}
        for d in (1, 2, 3):
            level = {a for a, b in pairs if b in level} - seen
            seen |= level
            for x in level:
                near[x] = min(d, near.get(x, d))
    scores = {r["id"]: r["score"] for r in sq.change_propagation(spark, "").collect()}
    assert scores == {x: pytest.approx((d + 1) ** -1.5 * (1 + 5 * want[x]) * (1 + 10 * rank[x]), abs=1e-5) for x, d in near.items()}


def test_queries_without_sql_take_all_lines(spark, tmp_path):
    from loomspan.plans import graph_queries as gq

    lines = [(1, n, part, q, flag) for n, (part, q, flag) in enumerate([(1, 5.0, "N"), (2, 50.0, "R"), (3, 1.0, "A"), (1, 40.0, "N"), (100, 2.0, "R")], 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 3, 100)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert {(r["id"], r["component"]) for r in gq.graph_strong_components(spark, str(tmp_path)).collect()} == {(1, 1), (2, 1), (3, 1), (100, 100)}
    assert gq.graph_shortest_path(spark, str(tmp_path)).collect()[0]["path"] == [1, 100]
    got = {r["id"]: r["betweenness"] for r in gq.graph_betweenness(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(b, abs=1e-6) for i, b in brandes([1, 2, 3, 100], [(1, 2), (2, 3), (3, 1), (1, 100)]).items()}


def test_betweenness_looks_at_few_edges(spark, monkeypatch):
    rng = random.Random(12)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(900)] + [(60, 61), (61, 3)]
    ids = list(range(63))
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    for many in (pairs, pairs * 3, [(1, 2)]):
        got = {r["id"]: r["betweenness"] for r in g.betweenness(v, spark.createDataFrame(many, "src long, dst long")).collect()}
        assert got == {i: pytest.approx(b, abs=1e-6) for i, b in brandes(ids, many).items()}
    looked, spans = [], g._spans

    def counted(start, at):
        looked.append(int((start[at + 1] - start[at]).sum()))
        return spans(start, at)

    monkeypatch.setattr(g, "_spans", counted)
    e = np.array(sorted(pairs))
    sides = [(np.searchsorted(o[:, k], np.arange(64)), o[:, 1 - k].copy(), None) for o, k in ((e, 0), (e[np.argsort(e[:, 1], kind="stable")], 1))]
    total = g._shares(sides, ids)
    assert {i: round(b / (62 * 61), 6) for i, b in enumerate(total)} == {i: pytest.approx(b, abs=1e-6) for i, b in brandes(ids, pairs).items()}
    # All edges out of every vertex that is reached would be looked at else.
    assert sum(looked) < 0.75 * len(pairs) * 62


def test_change_propagation_makes_its_edges_once(spark, monkeypatch, tmp_path):
    from loomspan.plans import graph_queries as gq
    from loomspan.plans import scoring_queries as sq

    seen = str(tmp_path / "seen")

    def noted(batches):
        for pdf in batches:
            with open(seen, "a") as f:
                f.write("x" * len(pdf))
            yield pdf

    pairs = [(4, 1), (6, 4), (7, 2), (1, 7)]
    e = spark.createDataFrame([(a, b, "R", 1.0) for a, b in pairs], "src long, dst long, kind string, weight double")
    monkeypatch.setattr(gq, "vertices", lambda *_: spark.createDataFrame([(i,) for i in range(1, 9)], "id long"))
    monkeypatch.setattr(gq, "edges", lambda *_: e.mapInPandas(noted, e.schema))
    assert {r["id"] for r in sq.change_propagation(spark, "").collect()} == {1, 4, 6, 7}
    with open(seen) as f:
        assert len(f.read()) == len(pairs)


def test_centralities_in_blocks_equal_dense_vectors(spark, monkeypatch):
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(70)]
    links = [(rng.choice("xy"), rng.choice(ids[:60]), rng.choice([*ids[:60], "unknown"]), rng.random()) for _ in range(300)]
    monkeypatch.setattr(g, "MOST_VERTICES", 5)
    monkeypatch.setattr(g._small, "__defaults__", (5,))
    monkeypatch.setattr(g, "BLOCK_VERTICES", 8, raising=False)
    both = ({"x": 1.0, "y": 0.3}, {"x": 1.0, "y": 1.0})
    v = spark.createDataFrame([(i,) for i in ids], "id string")
    t = g.tensor_edges(spark.createDataFrame(links, "relation string, src string, dst string, confidence double"), both[0])
    for w in both:
        got = {r["id"]: r["centrality"] for r in g.centrality(t, v, w).collect()}
        a = np.zeros((70, 70))
        for r, i, j, c in links:
            if j in ids:
                a[ids.index(i), ids.index(j)] += w[r] * c / 2
                a[ids.index(j), ids.index(i)] += w[r] * c / 2
        top = np.linalg.eigh(a)[1][:, -1]
        assert [got[i] for i in ids] == pytest.approx(list(np.abs(top)), abs=1e-6)
    two = {r["id"]: (r["c0"], r["c1"]) for r in g.centralities(t, v, list(both)).collect()}
    assert [two[i][1] for i in ids] == pytest.approx([got[i] for i in ids], abs=1e-12)
    none = g.centrality(t.limit(0), v, both[0]).collect()
    assert len(none) == 70 and all(r["centrality"] == pytest.approx(70**-0.5) for r in none)
    assert g.centrality(t, v.limit(0), both[0]).count() == 0
    with pytest.raises(ValueError):
        g.centrality(t, v, both[0], most=2)
