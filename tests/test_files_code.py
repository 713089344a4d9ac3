"""Readers of files, code and sites; registries, guards and the types of the pipeline language."""

import gzip
import io
import zipfile

import pytest

from loomspan.functions import guard, registry
from loomspan.plans import pipeline
from loomspan.sources import code, extract, readers, sites


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in members.items():
            z.writestr(n.replace("__", "/"), t)
    return out.getvalue()


def test_texts_of_many_formats(spark):
    docx = zipped(**{"word__document.xml": "<d xmlns:w='w'><w:p><w:t>One</w:t><w:t> line</w:t></w:p><w:p><w:t>Two</w:t></w:p></d>"})
    epub = zipped(**{"META-INF__container.xml": "<c/>", "x10.xhtml": "<p>Last</p>", "x2.xhtml": "<p>First</p>"})
    rows = {
        "docx": (docx, ("docx", "One line\nTwo")),
        "epub": (epub, ("epub", "First\n\nLast")),
        "nested": (zipped(**{"b.zip": zipped(**{"c.txt": "deep"}), "a.txt": "flat"}), ("zip", "flat\n\ndeep")),
        "gzip": (gzip.compress("größe".encode()), ("gzip", "größe")),
        "html": (b"<html><body><p>Hi</p></body></html>", ("html", "Hi")),
        "json": (b'{"b":1,"a":[2]}', ("json", '{\n "a": [\n  2\n ],\n "b": 1\n}')),
        "bad json": (b"{no", ("text", "{no")),
        "pdf": (b"%PDF-1.7 x", ("pdf", None)),
        "binary": (b"a\0b", ("binary", None)),
        "broken zip": (docx[:40], ("damaged", None)),
        "broken gzip": (gzip.compress(b"x" * 99)[:20], ("damaged", None)),
        "broken xml": (zipped(**{"word__document.xml": "<a><b>"}), ("damaged", None)),
        "empty": (b"", ("empty", "")),
        "null": (None, ("empty", "")),
    }
    df = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in rows.items()], "name string, content binary")
    assert {r["name"]: (r["format"], r["text"]) for r in extract.texts(df, "name").collect()} == {k: v[1] for k, v in rows.items()}
    assert extract.texts(df.limit(0), "name").count() == 0


def test_archives_that_unfold_without_end_are_left_alone():
    data = b"x"
    for _ in range(8):
        data = gzip.compress(data)
    assert extract.extract(data) == ("gzip", None)


def test_code_entities_and_edges(spark):
    files = [
        ("pkg/a.py", "import pkg.b\nfrom pkg import c\n\nclass A(Base):\n    def run(self):\n        return helper(1) + self.run()\n"),
        ("pkg/b.py", "def helper(x):\n    return other(x)\n\nclass Base:\n    pass\n"),
        ("pkg/c/__init__.py", "def other(x):\n    return x\n"),
        ("pkg/d.py", "def other(x):\n    return x\n"),
        ("bad.py", "def ("),
        ("none.py", None),
    ]
    e = code.entities(spark.createDataFrame(files, "file string, text string"))
    got = {(r["file"], r["kind"], r["name"], r["parent"]) for r in e.collect()}
    assert {("pkg/a.py", "class", "A", None), ("pkg/a.py", "method", "run", "A"), ("pkg/b.py", "function", "helper", None), ("bad.py", "unreadable", "bad.py", None), ("none.py", "module", "none", None)} <= got
    assert {tuple(r)[:2] for r in code.import_edges(e).collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c/__init__.py")}
    # ``other`` has two definitions, so it leads nowhere.
    assert {tuple(r)[:2] for r in code.call_edges(e).collect()} == {("pkg/a.py", "pkg/b.py")}
    rel = {(r["kind"], r["src"], r["dst"]) for r in code.relations(e).collect()}
    assert ("inherits", "pkg/a.py:A", "pkg/b.py:Base") in rel and ("calls", "pkg/a.py:A:run", "pkg/b.py:helper") in rel and ("contains", "pkg/a.py:a", "pkg/a.py:A") in rel
    again = code.entities(spark.createDataFrame(files[:2] + [("new.py", "x = 1")], "file string, text string"), known=e)
    assert {r["file"] for r in again.collect()} == {"new.py"}


def test_site_posts(spark):
    rows = [
        (1, "https://x.com/a/1", '<meta name="twitter:title" content="A &amp; B"><div data-testid="tweetText">a longer text here</div> 12 reposts 3 likes'),
        (2, "https://www.reddit.com/r/x", '<title>t | r/x</title><shreddit-post title="Post"><faceplate-number number="42">'),
        (3, "https://scholar.google.com/s", '<h3 class="gs_rt"><a href="u">Paper</a></h3><div class="gs_a">X, Y</div> Cited by 7'),
        (4, "https://other.example/", "<title>no</title>"),
        (5, "https://x.com/b", None),
        (6, None, None),
    ]
    got = {r["id"]: r for r in sites.posts(spark.createDataFrame(rows, "id long, url string, html string"), "id").collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1]["title"], got[1]["body"], got[1]["shares"], got[1]["likes"], got[1]["ok"]) == ("A & B", "a longer text here", 12, 3, True)
    assert (got[2]["title"], got[2]["likes"], got[3]["title"], got[3]["author"], got[3]["citations"]) == ("Post", 42, "Paper", "X, Y", 7)
    assert got[5]["ok"] is False and got[5]["title"] == ""


def test_parallel_corpus(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"source_text":"a","target_text":"b","source_lang":"EN-us","target_lang":null}\nbroken\n{"source_text":" ","target_text":"x"}\n{"source_text":"a"}\n')
    got = readers.parallel_corpus(spark, str(tmp_path / "p.jsonl")).collect()
    assert [(r["source_text"], r["target_text"], r["source_lang"], r["target_lang"]) for r in got] == [("a", "b", "en", None)]


def test_capabilities():
    c = guard.issue("t1", {"read"}, b"key")
    assert guard.guarded(c, b"key", lambda t: f"rows of {t}", "read") == "rows of t1"
    for bad, key, scope in ((c, b"other", None), (c, b"key", "write"), (guard.Capability("t2", c.scopes, c.signature), b"key", None), (guard.issue("world", {"read"}, b"key"), b"key", None), (guard.issue("", {"read"}, b"key"), b"key", None)):
        with pytest.raises(guard.Refused):
            guard.guarded(bad, key, lambda t: pytest.fail("must not run"), scope)


def test_registries():
    r = registry.Registry()
    r.register("a", (1, 2))
    assert r.register("a", (1, 2)) == (1, 2) and r.names() == ["a"]
    with pytest.raises(registry.Conflict):
        r.register("a", (3,))
    with pytest.raises(KeyError):
        r.get("b")
    assert registry.catalogue([registry.Algorithm("x", len), registry.Algorithm("y", waits_for="a model")]) == {"live": ["x"], "deferred": ["y"]}
    with pytest.raises(ValueError):
        registry.catalogue([registry.Algorithm("z")])


def test_types_of_a_chain_are_checked():
    assert pipeline.fits("int", "bigint") and pipeline.fits("array<int>", "array<double>") and not pipeline.fits("bigint", "int") and not pipeline.fits("string", "double")
    steps = pipeline.parse("text.score | rows.keep[least: 1.0]")
    pipeline.check(steps, pipeline.standard(), {"text": "string"})
    with pytest.raises(pipeline.PipelineError, match="text as string"):
        pipeline.check(steps, pipeline.standard(), {"text": "binary"})
