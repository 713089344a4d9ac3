import hashlib
import math
import statistics

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators import events as ev
from loomspan.streaming.events import admit

SCHEMA = "k string, id long, ts timestamp, kind string, value double"


def rows(values, kinds=None, k="a"):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return [(k, i, t + dt.timedelta(seconds=i), (kinds or ["x"] * len(values))[i], float(v)) for i, v in enumerate(values)]


def test_robust_z(spark):
    values = [1, 1, 1, 1, 9, 2, 5, 3, 8, 1]
    got = [r["z"] for r in ev.robust_z(spark.createDataFrame(rows(values), SCHEMA), ["k"], "value", "ts", "id", 4).orderBy("id").collect()]
    for i, v in enumerate(values):
        base = values[max(0, i - 4) : i]
        if len(base) < 2:
            assert got[i] == 0
            continue
        m = statistics.median(base)
        mad = statistics.median([abs(x - m) for x in base]) or 1e-9
        assert math.isclose(got[i], round(abs(v - m) / (1.4826 * mad), 4), rel_tol=1e-6)


def test_ewma_and_deviation(spark):
    values = [3.0, 5.0, 2.0, 8.0, 20.0]
    df = spark.createDataFrame(rows(values) + rows([1, 2], k="b"), SCHEMA)
    smooth = [values[0]]
    for v in values[1:]:
        smooth.append(0.3 * v + 0.7 * smooth[-1])
    got = {r["k"]: r for r in ev.ewma(df, ["k"], "value", "ts", "id").collect()}
    assert got["a"]["ewma"] == round(smooth[-1], 6) and got["a"]["n"] == 5
    past = [round(x, 6) for x in smooth[:-1]]
    sigma = statistics.stdev([a - b for a, b in zip(values[:-1], past, strict=True)])
    dev = {r["k"]: r["deviation"] for r in ev.ewma_deviation(df, ["k"], "value", "ts", "id").collect()}
    assert dev["a"] == round(abs(values[-1] - past[-1]) / sigma, 4) and dev["b"] == 0


def test_entropy_is_half_to_even(spark):
    got = [r["entropy"] for r in ev.kind_entropy(spark.createDataFrame(rows([0] * 4, ["a", "b", "a", "a"]), SCHEMA), ["k"], "kind", "ts", "id", 3).orderBy("id").collect()]
    assert got == [0, 100, 58, 58]


def test_chain_and_each_kind_of_break(spark):
    df = spark.createDataFrame([(k, i, f"b{i}") for k in "abcd" for i in range(4)], "k string, id long, body string")
    log = ev.chain(df, ["k"], "id", "body")
    h, want = "", []
    for i in range(4):
        h = hashlib.sha256(f"{h}|b{i}".encode()).hexdigest()
        want.append(h)
    assert [r["entry_hash"] for r in log.filter("k = 'a'").orderBy("sequence").collect()] == want
    from pyspark.sql import functions as F

    broken = log.filter("not (k = 'b' and sequence = 2)")
    broken = broken.withColumn("prev_hash", F.when((F.col("k") == "c") & (F.col("sequence") == 3), "no").otherwise(F.col("prev_hash")))
    broken = broken.withColumn("body", F.when((F.col("k") == "d") & (F.col("sequence") == 4), "no").otherwise(F.col("body")))
    got = {r["k"]: (r["failed_at"], r["reason"]) for r in ev.verify_chain(broken, ["k"], "body").collect()}
    assert got == {"a": (None, None), "b": (3, "gap"), "c": (3, "link"), "d": (4, "hash")}


def test_fair_leases(spark):
    q = [("a", i, i, "waiting") for i in range(5)] + [("b", 10, 0, "leased"), ("b", 11, 9, "waiting"), ("c", 12, 1, "done")]
    got = [(r["tenant"], r["item"]) for r in ev.fair_leases(spark.createDataFrame(q, "tenant string, item long, at long, state string"), 4).orderBy("place").collect()]
    assert got == [("a", 0), ("a", 1), ("b", 11)]


def test_status_counts_fill_zeros(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert {r["status"]: r["n"] for r in ev.status_counts(df, "s", ["a", "b", "unknown"]).collect()} == {"a": 2, "b": 0, "unknown": 1, "total": 3}


def test_drift(spark):
    df = spark.createDataFrame([("a", i, 0.5 + 0.4 * (i >= 10)) for i in range(20)] + [("b", 1, 0.1)], "k string, id long, v double")
    from pyspark.sql import functions as F

    got = {r["k"]: r for r in ev.drift(df, ["k"], "v", [F.desc("id")]).collect()}
    assert got["a"]["verdict"] == "drift" and math.isclose(got["a"]["drift"], 0.4) and got["b"]["verdict"] == "insufficient" and got["b"]["drift"] is None


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 4, "z")], "k string, s long, v string")
    assert {(r["k"], r["t"]): r["v"] for r in ev.as_of(left, right, ["k"], "t", "s", ["v"]).collect()} == {("a", 5): "y", ("a", 1): None, ("b", 3): None}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 100), max_size=30), st.floats(0.1, 5), st.integers(1, 5))
def test_bucket_never_exceeds_rate_and_burst(times, rate, burst):
    import pandas as pd

    times = sorted(times)
    ok, tokens, _ = admit(pd.DataFrame({"t": times}), rate, burst, float(burst), None)
    assert -1e-9 <= tokens <= burst
    if times:
        assert sum(ok) <= burst + rate * (times[-1] - times[0]) + 1e-6
