import json

import pytest
from conftest import SF

from loomspan.operators import vectors as vc
from loomspan.sources import html, readers, sinks
from loomspan.streaming import events as se


def test_jsonl_and_csv(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "1", "text": "a"}\nnot json\n{"url": "u", "body": "b"}\n{"content": "c"}\n{"id": "5"}\n')
    rows = {r["text"]: r["id"] for r in readers.dataset(spark, str(p)).collect()}
    assert rows["a"] == "1" and rows["b"] == "u" and rows["c"].startswith("row-") and len(rows) == 3
    assert readers.jsonl(spark, str(tmp_path / "missing.jsonl")).count() == 0
    c = tmp_path / "x.csv"
    c.write_text('id,text\n1,"a, ""q""\nb"\n2,\n')
    assert [(r["id"], r["text"]) for r in readers.dataset(spark, str(c)).collect()] == [("1", 'a, "q"\nb')]
    with pytest.raises(ValueError):
        readers.dataset(spark, "https://example.com/x")


def test_text_tree_and_graph(spark, tmp_path):
    (tmp_path / "t" / ".git").mkdir(parents=True)
    (tmp_path / "t" / "a.md").write_text("Größe")
    (tmp_path / "t" / ".git" / "b.md").write_text("no")
    (tmp_path / "t" / "c.bin").write_text("no")
    assert [(r["text"], r["n_chars"]) for r in readers.dataset(spark, str(tmp_path / "t")).collect()] == [("Größe", 5)]
    g = tmp_path / "graph.json"
    g.write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "r", "weight": 0.5}]}))
    v, e = readers.graph_json(spark, str(g))
    assert v.count() == 2 and tuple(e.collect()[0]) == ("a", "b", "r", 0.5)


def test_modality(spark):
    rows = [(b"\x89PNG\r\n\x1a\n1234",), (b"",), (b"PK\x03\x04zz",), (b"plain text here",), (b"\x00\x00\x00\x18ftypmp42",), (b"a\x00b",)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r[0] for r in df.select(readers.modality()).collect()] == ["image", "quarantine", "archive", "text", "video", "quarantine"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("c", 3, 1), ("c", 3, 1)], "k string, v int, seq int")
    assert [r["k"] for r in sinks.insert_ignore(old, new, ["k"]).collect()] == ["c"]
    assert {(r["k"], r["v"]) for r in sinks.replace_rows(old, new, ["k"], "seq").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    v = spark.createDataFrame([("a", "X")], "id string, type string")
    e = spark.createDataFrame([("a", "z", 1.0)], "src string, dst string, weight double")
    assert {tuple(r) for r in sinks.with_endpoints(v, e).collect()} == {("a", "X"), ("z", "UNKNOWN")}
    assert '"a" -> "z"' in sinks.dot(e)

    def boom(_):
        raise RuntimeError("no")

    seen = []
    receipt = sinks.fan_out(old, {"bad": boom, "good": seen.append})
    assert receipt["good"] == "ok" and receipt["bad"].startswith("failed") and len(seen) == 1


def test_run_artifacts(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "t"), ("c2", "u")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0])], "chunk_id string, vector array<double>")
    assert sinks.run_artifacts({"chunks": chunks, "vectors": vectors}, str(tmp_path)) == {"chunks": 2, "vectors": 1}
    assert {(r["chunk_id"], r["vector"] is None) for r in readers.run_artifacts(spark, str(tmp_path)).collect()} == {("c1", False), ("c2", True)}


def test_html():
    t, title, links = html.extract("<title>T &amp; t</title><nav><a href='/n'>n</a></nav><h2>Head</h2><p>One<br>two <a href='/x#1'>l</a><a href='/x#1'>l</a></p><ul><li>i</li></ul><script>no</script>", "https://e.com/a/")
    assert (t, title, links) == ("## Head\nOne\ntwo ll\n- i", "T & t", ["https://e.com/x#1"])
    assert html.extract(None) == ("", "", [])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vc.cosine(df["a"], df["b"])).collect()] == [0.96, 0.0, 0.0, 0.0]
    texts = spark.createDataFrame([("The quick brown fox",), ("",), (None,)], "t string")
    got = [r[0] for r in texts.select(vc.hash_embed(texts["t"], 32)).collect()]
    assert got[0] == vc.embed_query("The quick brown fox", 32) and not any(got[1]) and not any(got[2])
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-4


def test_streamed_heads_equal_batch(spark, tmp_path):
    batch = spark.read.schema(se.SCHEMA).parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.union(batch.limit(50)).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = se.once(se.source(spark, str(tmp_path / "in")))
    got = se.run_once(se.heads(stream), "heads_out", "complete", str(tmp_path / "cp1"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in se.heads(batch).collect()}


def test_streamed_token_bucket_and_batches(spark, tmp_path):
    batch = spark.read.schema(se.SCHEMA).parquet(f"{SF}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = se.run_once(se.token_bucket(se.source(spark, str(tmp_path / "in")), 1 / 86400, 2.0), "bucket_out", "append", str(tmp_path / "cp2"))
    per = {}
    for r in batch.orderBy("ts", "event_id").collect():
        per.setdefault(r["user_id"], []).append(r)
    import pandas as pd

    want = set()
    for u, rs in per.items():
        t = pd.DataFrame({"t": [r["ts"].timestamp() for r in rs], "event_id": [r["event_id"] for r in rs]}).sort_values(["t", "event_id"])
        ok, _, _ = se.admit(t, 1 / 86400, 2.0, 2.0, None)
        want |= {(u, e, o) for e, o in zip(t["event_id"], ok, strict=True)}
    assert {tuple(r) for r in got.collect()} == want
    seen = []
    se.run_once(se.source(spark, str(tmp_path / "in")), "x", "append", str(tmp_path / "cp3"), each=lambda df, n: seen.append(df.count()))
    assert sum(seen) == batch.count()


def test_appended_rows_stay_off_the_driver(spark, tmp_path):
    batch = spark.read.schema(se.SCHEMA).parquet(f"{SF}/events.parquet")
    batch.limit(40).repartition(2).write.parquet(str(tmp_path / "in"))
    got = se.run_once(se.once(se.source(spark, str(tmp_path / "in"))).select("event_id"), "rows_out", "append", str(tmp_path / "cp"))
    assert got.inputFiles() and got.count() == 40
    batch.limit(0).write.parquet(str(tmp_path / "none"))
    none = se.run_once(se.token_bucket(se.source(spark, str(tmp_path / "none")), 1.0, 2.0), "none_out", "append", str(tmp_path / "cp0"))
    assert none.columns == ["user_id", "event_id", "admitted"] and none.count() == 0
    (tmp_path / "bare").mkdir()
    assert se.run_once(se.once(se.source(spark, str(tmp_path / "bare"))), "bare_out", "append", str(tmp_path / "cp1")).count() == 0


def test_stream_once_reads_files_and_drops_copies(spark):
    from loomspan.plans import queue_queries as qq

    got = qq.stream_once(spark, SF)
    assert got.inputFiles()
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in batch.select("event_id", "user_id", "event_type").distinct().collect())


def test_stream_bucket_counts_rows_of_files(spark):
    from loomspan.plans import queue_queries as qq

    got = qq.stream_bucket(spark, SF)
    assert got.inputFiles()
    rows = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count().collect()
    assert {tuple(r) for r in got.collect()} == {(u, n, n) for u, n in rows}
