"""Relations, queues, search and signals against brute force and on dirty rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import dedup, queues, records, relations, search, signals
from loomspan.operators import graph as g
from loomspan.operators import scoring as sc
from loomspan.operators import vectors as vc
from loomspan.sources import html, sinks


def test_similar_symbols_equal_brute_force(spark):
    rng = random.Random(3)
    parts = [f"p{i}" for i in range(14)] + ["X1", "é", ""]
    rows = [(f"f{rng.randrange(4)}", "_".join(rng.choices(parts, k=rng.randrange(1, 7)))) for _ in range(150)] + [("f1", None), (None, "p1_p2")]
    stems = lambda n: frozenset(s for s in ("".join(c for c in p.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789") for p in n.split("_")) if len(s) >= 2)
    want = set()
    for fa, a in rows:
        for fb, b in rows:
            if fa and fb and a and b and fa != fb and stems(a) and stems(b):
                j = len(stems(a) & stems(b)) / len(stems(a) | stems(b))
                if j >= 0.8:
                    want.add((min(a, b), max(a, b), round(j, 6)))
    got = {tuple(r) for r in relations.similar_symbols(spark.createDataFrame(rows, "file string, name string"), "file", "name").collect()}
    assert got == want


def test_versions_are_matched_within_their_section(spark):
    old = [("s1", 1, "the quick brown fox jumps"), ("s1", 2, "same text"), ("s1", 3, "to be removed entirely, zzz"), ("s2", 4, "same text"), ("s2", 5, None)]
    new = [("s1", 11, "the quick brown fox jumped"), ("s1", 12, "same text"), ("s2", 13, "wholly other words 12345"), ("s3", 14, "same text")]
    schema = "section string, id long, body string"
    got = {(r["section"], r["old"], r["new"], r["status"]) for r in relations.version_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["section"], "id", "body").collect()}
    assert got == {("s1", "1", "11", "modified"), ("s1", "2", "12", "unchanged"), ("s1", "3", None, "removed"), ("s2", "4", None, "removed"), ("s2", "5", None, "removed"), ("s2", None, "13", "added"), ("s3", None, "14", "added")}
    assert relations.version_changes(spark.createDataFrame([], schema), spark.createDataFrame([], schema), ["section"], "id", "body").count() == 0


def test_triples_are_directed_in_pairs(spark):
    df = spark.createDataFrame([([0.6, 0.8], [0.0, 1.0])], "a array<double>, b array<double>")
    rel = {"calls": "directed", "imports": "directed", "near": "symmetric"}
    score = lambda a, b, r: df.select(relations.triple_score(F.col(a), F.col(b), r, rel, 2).alias("s")).first()["s"]
    assert score("a", "b", "near") == pytest.approx(0.8) and score("a", "b", "calls") == pytest.approx(1.4) and score("b", "a", "calls") == pytest.approx(0.2)
    assert sum(score("a", "b", r) for r in ("calls", "imports")) == pytest.approx(1.6)
    with pytest.raises(ValueError):
        relations.directed_slots({"calls": "directed"}, 4)


def test_granularity(spark):
    slugs = spark.createDataFrame([("a.x.com",), ("b.x.com",), ("c.x.com",), ("a.y.com",), ("b.y.com",), ("*.z.com",), ("lone",), ("a.x.com",)], "slug string")
    history = spark.createDataFrame([("a.x.com", 0.1), ("b.x.com", 0.2), ("a.y.com", 0.1), ("b.y.com", 0.9)], "slug string, drift double")
    assert {tuple(r) for r in relations.granularity(slugs, history).collect()} == {("reduce", "*.x.com"), ("expand", "a.y.com")}
    assert relations.granularity(slugs.limit(0), history).count() == 0


def test_queue_transitions(spark):
    q = spark.createDataFrame([("a", "leased", 5, 1, "w", 0), ("b", "leased", 15, 1, "w", 0), ("c", "queued", None, None, None, 2), ("d", "leased", None, 1, "w", 0)], "cid string, state string, lease_deadline long, leased_at long, lease_owner string, retry_count int")
    got = {r["cid"]: (r["state"], r["lease_deadline"], r["lease_owner"], r["retry_count"]) for r in queues.reap(q, F.lit(10)).collect()}
    assert got == {"a": ("queued", None, None, 1), "b": ("leased", 15, "w", 0), "c": ("queued", None, None, 2), "d": ("leased", None, "w", 0)}
    w = spark.sql("SELECT * FROM VALUES ('a', 'running', timestamp'2024-01-01 00:00:00', 1, null), ('b', 'running', timestamp'2024-01-01 00:00:00', 5, null), ('c', 'running', null, null, null), ('d', 'done', null, 9, 'x') AS t(item, status, started_at, attempts, error)")
    got = {r["item"]: (r["status"], r["error"], r["started_at"] is None) for r in queues.recover(w, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert got == {"a": ("queued", None, True), "b": ("failed", "max_attempts_exceeded", False), "c": ("running", None, True), "d": ("done", "x", True)}
    s = spark.createDataFrame([("t", "x", 1), ("t", "x", 2), ("t", "y", 3), ("t", "z", 4), ("u", "z", 5)], "tenant string, cid string, at long")
    assert {r["at"]: r["fate"] for r in queues.admission(s, "tenant", "cid", "at", 2).collect()} == {1: "admitted", 2: "already_in", 3: "admitted", 4: "queue_full", 5: "admitted"}


def test_signals_on_dirty_rows(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "", ""), (3, "Sign in", "x", "https://a.b/c"), (4, "Fine", "logins login username", "https://a.b/"), (5, "Fine", "plain", "https://a.b/SSO")], "id long, title string, text string, url string")
    got = {r["id"]: r["g"] for r in df.select("id", signals.login_gate(F.col("title"), F.col("text"), F.col("url")).alias("g")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}
    slugs = {r["id"]: r["s"] for r in df.select("id", signals.slug(F.col("title")).alias("s")).collect()}
    assert slugs == {1: "item", 2: "item", 3: "sign-in", 4: "fine", 5: "fine"}
    turns = spark.createDataFrame([(1, "é—x" * 400, ["e"]), (2, None, None), (3, "", [])], "id long, body string, ents array<string>")
    t = {r["id"]: r["tokens"] for r in signals.trajectory_tokens(turns, "id", "body", "ents").collect()}
    assert t[2] == t[3] == [258, 256, 257] and t[1][1] >= 1_000_000 and bytes(x for x in t[1] if x < 256).decode() == ("é—x" * 400)[:1000]
    links = spark.createDataFrame([(["https://A.b/x#y", None, "https://a.b/x"], None)], "a array<string>, b array<string>")
    assert links.select(signals.merged_links(F.col("a"), F.col("b")).alias("m")).first()["m"] == ["https://a.b/x"]


def test_mentions_stand_where_they_say(spark):
    text = "a@b.io and a@b.io on 2024-01-02, $5 or 10.0.0.1"
    m = search.positioned_mentions(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id").collect()
    assert [(r["kind"], r["start"]) for r in m if r["kind"] == "EMAIL"] == [("EMAIL", 0), ("EMAIL", 11)]
    assert all(text[r["start"] : r["end"]] == r["value"] for r in m) and {r["id"] for r in m} == {1}
    assert [r["start"] for r in m] == sorted(r["start"] for r in m)


def test_corpus_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 6)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>")
    s = vc.against_corpus(df, df.filter("id % 20 = 0"), "id", "v", 5, 3, corpus_rows=20, query_rows=2)
    got = {r["id"]: (r["idiom"], r["nearest"], r["farthest"]) for r in records.idiom_scores(s.withColumnRenamed("key", "id"), "id").collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 90, 20):
        c = np.round(u @ u[q], 6)
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-c[i], i))
        low = sorted((i for i in range(90) if i != q), key=lambda i: (c[i], i))
        assert got[q][0] == pytest.approx(max(0, min(1, np.mean([c[i] for i in order[:5]]))), abs=2e-6)
        assert got[q][1] == ",".join(map(str, order[:3])) and got[q][2] == ",".join(map(str, low[:3]))
    assert set(got) == set(range(0, 90, 20))


def test_principal_axes_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) * [5, 3, 2, 0.5, 0.1] + [1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    want = [a if a[np.abs(a).argmax()] > 0 else -a for a in axes[:, ::-1].T[:3]]
    got = vc.principal_axes(df, "v")
    assert np.allclose(got, want, atol=1e-8)
    assert vc.axes_stress(df, "v").first()["stress"] == pytest.approx(values[:2].sum() / values.sum(), abs=1e-6)
    p = {r["id"]: r["x0"] for r in vc.project(df.filter("v is not null"), "id", "v", got).collect()}
    assert p[7] == pytest.approx(float(x[7] @ want[0]), abs=1e-5)
    assert vc.principal_axes(df.limit(0), "v") == []


def test_simhash_keys_in_blocks_lose_nothing(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "id long, text string")
    want = [tuple(r) for r in dedup.near_by_simhash(df, "id").orderBy("id").collect()]
    got = [tuple(r) for r in dedup.near_by_simhash(df, "id", key_rows=3).orderBy("id").collect()]
    assert got == want and sum(r[1] for r in want) < 60


def test_graph_measures(spark, monkeypatch):
    chain = [(i, i + 1, "R") for i in range(9)] + [(20, 21, "R"), (21, 20, "R"), (30, 31, "A"), (31, 30, "A")]
    e = spark.createDataFrame(chain, "src long, dst long, kind string")
    v = spark.createDataFrame([(i,) for i in (*range(10), 20, 21, 30, 31, 99)], "id long")
    out = {(r["pattern"], r["id"]) for r in g.standing_out(v, e, "R", g.betweenness(v, e)).collect()}
    assert {("cycle", 20), ("cycle", 21), ("orphan", 99), ("unstable", 9)} <= out and ("cycle", 30) not in out
    starts = spark.createDataFrame([(0,), (7,), (9,)], "id long")
    assert {tuple(r) for r in g.long_chains(e, starts).collect()} == {(0, 7, 8), (0, 9, 10)}
    monkeypatch.setattr(g, "MOST_VERTICES", 5)
    monkeypatch.setattr(g._small, "__defaults__", (5,))
    with pytest.raises(ValueError):
        g.betweenness(v, e)


def test_spaces_and_stores(spark):
    r = spark.createDataFrame([("a", "s1", [1.0, 0.0]), ("b", "s2", [0.0, 1.0]), ("c", "s1", [1.0])], "cid string, space string, v array<double>")
    assert [x["cid"] for x in search.run_vectors(search.same_space(r, "space", "s1", strict=False), "cid", "v", [1.0, 1.0], 5).collect()] == ["a"]
    with pytest.raises(Exception, match="space mismatch"):
        search.same_space(r, "space", "s1").collect()
    stored = spark.createDataFrame([("ok",), ("bad",)], "content string").withColumn("hash", F.sha2("content", 256))
    altered = stored.withColumn("content", F.when(F.col("content") == "bad", "worse").otherwise(F.col("content")))
    assert [x["content"] for x in sinks.cache_get(altered, stored).collect()] == ["ok"]
    from loomspan.operators import events as ev

    log = ev.chain(spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "k string, i long, body string"), ["k"], "i", "body")
    new = spark.createDataFrame([("k", 3, "c")], "k string, i long, body string")
    assert sinks.append_chained(log, new, ["k"], "i", "body").count() == 3
    with pytest.raises(ValueError, match="broken"):
        sinks.append_chained(log.withColumn("body", F.lit("x")), new, ["k"], "i", "body")


def test_pruned_pages():
    assert html.prune(None) == "" and html.prune("") == ""
    page = "<div class='menu'><a href='/x'>Home</a><a href='/y'>News</a></div><main><h1>T</h1><p>" + "Words of the body. " * 15 + "</p><img src='i.png'></main><script>bad()</script><p>unclosed"
    out = html.prune(page)
    assert "Words of the body" in out and "bad()" not in out and 'src="i.png"' in out and "<main>" in out
    assert html.prune("</div></p><b>x") == "<b>x</b>" or "x" in html.prune("</div></p><b>x")


def test_clocked_transactions(spark):
    log = spark.createDataFrame([("a", 1, "propose"), ("b", 1, "propose"), ("b", 3, "abandon"), ("c", 1, "propose"), ("c", 30, "abandon"), ("d", 1, "propose"), ("d", 99, "supersede"), ("e", 95, "propose"), ("f", 5, "abandon"), ("g", 1, None)], "tx string, tick long, op string")
    got = {r["tx"]: r["status"] for r in sc.clocked_state(log, "tx", "tick", 10, F.lit(100)).collect()}
    assert got == {"a": "committed", "b": "abandoned", "c": "committed", "d": "superseded", "e": "pending"}


def test_tables_partitioned_once_are_not_shuffled_again(spark):
    from loomspan.session import cut_by

    a = cut_by(spark.range(100).withColumn("k", F.col("id") % 10), "k")
    plan = a.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_unchanged_chunks_compare_no_texts(spark):
    from conftest import SF

    from loomspan.plans import relation_queries as rq

    schema = "section string, id long, body string"
    old = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "a"), ("s1", 3, "abc"), ("s2", 4, "a"), ("s2", 5, None), (None, 6, "a"), ("s3", None, "z")], schema)
    new = spark.createDataFrame([("s1", 11, "a"), ("s1", 12, "abd"), ("s2", 13, ""), ("s2", 14, "a"), ("s2", 15, "a"), (None, 16, "a"), ("s3", 17, "z")], schema)
    got = {tuple(r) for r in relations.unchanged(old, new, ["section"], "id", "body").collect()}
    assert got == {("s1", "1", "11"), ("s2", "4", "14"), ("s2", "5", "13")}
    assert got == {(r["section"], r["old"], r["new"]) for r in relations.version_changes(old.filter("section is not null"), new.filter("section is not null"), ["section"], "id", "body").filter("status = 'unchanged'").collect()}
    assert "InPandas" not in rq.unchanged_chunks(spark, SF)._jdf.queryExecution().executedPlan().toString()
