import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomspan.functions import encoding as enc
from loomspan.operators import ranking, records, scoring


@given(st.lists(st.tuples(st.integers(1, 300), st.one_of(st.integers(0, 2**64 - 1), st.binary(max_size=40))), max_size=8))
def test_canonical_form_round_trips(fields):
    data = enc.encode(fields)
    back = enc.decode(data)
    assert enc.encode(back) == data and sorted(map(repr, back)) == sorted(map(repr, fields))


@pytest.mark.parametrize("bad", [b"\x80", b"\x08", b"\x08\x80\x00", b"\x0b\x01", b"\x12\x05ab", b"\x10\x01\x08\x01", b"\xff" * 11])
def test_malformed_bytes_are_refused(bad):
    with pytest.raises(ValueError):
        enc.decode(bad)


def test_known_encodings():
    assert enc.varint(300) == b"\xac\x02" and enc.read_varint(b"\xac\x02") == (300, 2)
    assert enc.canonical_json({"b": 1, "a": "é"}) == '{"a":"\\u00e9","b":1}'


def test_tiers_and_tenants_differ_on_null(spark):
    df = spark.createDataFrame([("me",), ("you",), ("world",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    seen = lambda f: {r["t"] for r in df.filter(f(F.col("t"), "me")).collect()}
    assert seen(records.tier_visible) == {"me", "world", None} and seen(records.tenant_visible) == {"me", "world"}


def test_resolve_and_ladder(spark):
    v = spark.createDataFrame([("n1", "Alpha"), ("n2", "alphabet"), ("n3", "Beta")], "id string, label string")
    assert [r["id"] for r in records.resolve(v, "alpha").collect()] == ["n1"]
    assert {r["id"] for r in records.resolve(v, "lph").collect()} == {"n1", "n2"}
    assert records.resolve(v, "zzz").count() == 0
    c = spark.createDataFrame([("amazon ec2", "Amazon EC2", ["elastic"], 3), ("azure vm", "Azure VM", [], 9), ("azure net", "Azure Networks", [], 2)], "slug string, label string, aliases array<string>, occurrences long")
    q = spark.createDataFrame([("Azure VM",), ("Elastic",), ("ec2",), ("azure",), ("etwor",), ("none at all",), ("",)], "query string")
    got = {r["query"]: (r["slug"], r["rung"]) for r in records.concept_ladder(c, q).collect()}
    assert got == {"Azure VM": ("azure vm", 1), "Elastic": ("amazon ec2", 2), "ec2": ("amazon ec2", 3), "azure": ("azure vm", 3), "etwor": ("azure net", 4)}


def test_text_links_and_blocks(spark):
    df = spark.createDataFrame([("see [a](https://e.com/x) and https://e.com/y. and (https://e.com/x)",), (None,)], "t string")
    assert [r[0] for r in df.select(records.text_links(df["t"])).collect()] == [["https://e.com/x", "https://e.com/y"], []]
    b = spark.createDataFrame([("one\n\ntwo limit\n \nthree",), ("one\n\ntwo",)], "t string")
    assert [r[0] for r in b.select(records.query_blocks(b["t"], ["limit"])).collect()] == ["two limit", "one\n\ntwo"]


def test_scores(spark):
    df = spark.createDataFrame([([0.9, 0.5, None],), ([0.4],), ([],), ([0.0, 1.0],)], "s array<double>")
    got = df.select(scoring.decisiveness(df["s"]).alias("d"), scoring.geometric_mean(df["s"]).alias("g")).collect()
    assert [round(r["d"], 6) for r in got] == [0.4, 0.4, 0.0, 1.0]
    assert [round(r["g"], 6) for r in got] == [round((0.9 * 0.5) ** 0.5, 6), 0.4, 0.0, 0.0]
    p = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.5), ("b", "z", 1.0)], "k string, outcome string, p double")
    q = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75)], "k string, outcome string, p double")
    bits = {r["k"]: r["bits"] for r in scoring.divergence(p, q, ["k"]).collect()}
    assert bits["a"] == pytest.approx(0.207519, abs=1e-6) and bits["b"] == float("inf")


def test_rerank_and_pack(spark):
    rows = [("c1", 1, 0, "s", "alpha beta gamma " * 3, 0.9, 0.9, 0.1), ("c2", 2, 0, "s", "alpha beta gamma " * 3, 0.8, 0.8, 0.1), ("c3", 3, 0, "t", "delta epsilon", 0.7, 0.7, 0.1), ("c4", 4, 0, "t", "noise", 0.99, 0.99, 0.95)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id long, position int, source string, text string, fast double, heavy double, noise double")
    got = {r["chunk_id"]: r for r in ranking.rerank(df).collect()}
    assert got["c4"]["dropped"] == "noise" and got["c1"]["final"] == 0.9 and got["c2"]["final"] == pytest.approx(0.5, abs=1e-4)
    packed = ranking.pack(ranking.rerank(df), 14).orderBy("place").collect()
    assert [r["chunk_id"] for r in packed] == ["c1", "c3", "c2"] and [r["packed"] for r in packed] == [True, False, False]


def test_upgrade_keeps_what_is_given(spark):
    e = spark.createDataFrame([(1, "view", 1, None, "mine"), (2, "view", 2, "s", None)], "event_id long, kind string, version int, source string, trust string")
    got = {r["event_id"]: (r["source"], r["trust"], r["version"]) for r in records.upgrade_events(e, {"view": "screen"}, {}).collect()}
    assert got == {1: ("screen", "mine", 2), 2: ("s", None, 2)}
