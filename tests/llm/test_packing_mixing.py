import numpy as np

from loomspan.llm import mixing, packing, tokens


def docs(spark, n=600, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1]), int(rng.integers(1, 3000)), f"t{i}") for i in range(n)]
    return rows, spark.createDataFrame([(i, str(s), n, t) for i, s, n, t in rows], "doc_id long, source string, n_tokens long, same string")


def check_pack(rows, got, capacity):
    fill, seen = {}, {}
    for r in got:
        size = r["token_end"] - r["token_start"]
        assert size > 0
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + size
        seen.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
    assert max(fill.values()) <= capacity
    for i, _, n, _ in rows:
        parts = sorted(seen.get(i, []))
        assert (parts == [] and n == 0) or (parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)))
        assert len(parts) <= 1 or n > capacity
    return sum(fill.values()) / capacity / len(fill)


def test_everything_is_packed_once_and_tightly(spark):
    rows, df = docs(spark)
    assert check_pack(rows, packing.pack(df, 2048).collect(), 2048) > 0.985
    # Several tasks, whose open windows are packed again.
    assert check_pack(rows, packing.pack(df, 2048, part_items=64, fan_in=4).collect(), 2048) > 0.97


def test_windows_follow_the_targets(spark):
    rows = [(i, s, 100, "") for i, s in enumerate(["a"] * 200 + ["b"] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, same string")
    got = packing.pack(df, 1000, targets={"a": 3.0, "b": 1.0}).collect()
    first = {}
    for r in got:
        first.setdefault(r["container_id"], []).append(r["source"])
    early = [s for c in sorted(first)[:20] for s in first[c]]
    assert abs(early.count("a") / len(early) - 0.75) < 0.03


def test_pack_edges(spark):
    schema = "doc_id long, source string, n_tokens long, piece string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", 0, ""), (2, "a", 2048, ""), (3, "a", 5000, ""), (4, "b", 1, "")]
    assert check_pack([(a, b, c, "") for a, b, c, _ in rows], packing.pack(spark.createDataFrame(rows, schema), 2048).collect(), 2048) > 0.8


def test_pivotal_keeps_mass_and_expectation():
    size, p = np.array([10.0, 200.0, 35.0, 35.0, 7.0] * 40), np.full(200, 0.3)
    runs = [mixing.pivotal(size, p, np.random.default_rng(s)) for s in range(60)]
    for q, at in runs:
        assert abs((size * q).sum() - (size * p).sum()) < 1e-6
        assert sum(0 < x < 1 for x in q) == (at >= 0)
    assert abs(np.mean([q.mean() for q, _ in runs]) - 0.3) < 0.02


def test_mix_reaches_shares_and_caps(spark):
    rows, df = docs(spark, 900)
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 3), ("c", 2.0, 4), ("gone", 1.0, 2), ("b", None, None)], "source string, weight double, max_repeats int")
    targets = targets.filter("weight is not null")
    got = mixing.mix(df, targets, block_rows=64, fan_in=4).collect()
    caps = {"a": 1, "b": 3, "c": 4}
    size = {i: n for i, _, n, _ in rows}
    total = {}
    for r in got:
        assert 1 <= r["copies"] <= caps[r["source"]]
        total[r["source"]] = total.get(r["source"], 0) + r["copies"] * size[r["doc_id"]]
    whole = sum(total.values())
    for s, want in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(total[s] - want * whole) < 2 * 3000
    report = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert report["gone"]["tokens"] == 0 and abs(report["c"]["target_share"] - 0.4) < 1e-9


def test_equal_texts_are_one(spark):
    rows = [(i, "a", 50, "same") for i in range(30)] + [(100, "a", 50, "other")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, same string")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    assert {(r["doc_id"], r["copies"]) for r in mixing.mix(df, t).collect()} == {(0, 2), (100, 2)}
    assert mixing.mix(df.limit(0), t).count() == 0


def test_sizes_and_families(spark):
    df = spark.createDataFrame([(1, " Crawl ", "hello world"), (2, None, None), (3, "", ""), (4, "x", "a" * 20000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["f"], r["n_tokens"]) for r in tokens.with_sizes(df.withColumn("f", tokens.family())).collect()}
    assert got[1] == ("crawl", 2) and got[2] == ("(none)", 0) and got[3] == ("(none)", 0) and got[4][1] > 0
