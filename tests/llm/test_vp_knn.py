import numpy as np

from loomspan.llm import vp_knn

SCHEMA = "cid string, space_id string, embedding array<float>, dim int, tenant string"


def brute(rows, k, least):
    best, out = {}, set()
    for cid, space, e, dim, _ in rows:
        if cid is None or space is None or e is None or len(e) != dim or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, np.float32).astype(float)
        best.setdefault(space, {}).setdefault(cid, v / np.linalg.norm(v))
    for m in best.values():
        for a in m:
            near = sorted((-round(float(m[a] @ m[b]), 6), b) for b in m if b != a)[:k]
            out |= {(min(a, b), max(a, b)) for s, b in near if -s >= least}
    return out


def clustered(seed, n, d, space):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    rows = []
    for i in range(n):
        c = centres[rng.integers(len(centres))] + rng.normal(size=d) * rng.choice([0.1, 0.4, 2.0])
        rows.append((f"{space}-{i:05d}", space, (c * rng.uniform(0.1, 9)).astype(np.float32).tolist(), d, "t"))
    return rows


def test_exact_with_factor_one(spark):
    rows = clustered(1, 300, 16, "s1") + clustered(2, 120, 24, "s2")
    got = {tuple(r) for r in vp_knn.similar_pairs(spark.createDataFrame(rows, SCHEMA), 5, 0.85, factor=1.0, shard_rows=64, leaf_rows=8, sample_rows=100, query_rows=50).collect()}
    assert got == brute(rows, 5, 0.85)


def test_recall_when_relaxed(spark):
    rows = clustered(3, 800, 32, "s")
    got = {tuple(r) for r in vp_knn.similar_pairs(spark.createDataFrame(rows, SCHEMA), 10, 0.85, shard_rows=128, leaf_rows=16).collect()}
    want = brute(rows, 10, 0.85)
    assert len(got & want) / len(want) >= 0.97


def test_dirty_rows_copies_and_ties(spark):
    v, w = [1.0, 0.0, 0.5, 0.25], [0.9, 0.1, 0.5, 0.2]
    rows = [(f"c{i:02d}", "s", [x * (i + 1) for x in v], 4, None) for i in range(9)]
    rows += [("w", "s", w, 4, None), ("w", "s", w, 4, None), ("other", "t", v, 4, None)]
    rows += [("n1", "s", None, 4, None), ("n2", "s", [], 4, None), ("n3", "s", v[:3], 4, None), ("n4", "s", [0.0] * 4, 4, None), ("n5", "s", [None, 1.0, 1.0, 1.0], 4, None), ("n6", "s", [float("nan"), 1.0, 1.0, 1.0], 4, None), ("n7", "s", [float("inf"), 1.0, 1.0, 1.0], 4, None), ("n8", None, v, 4, None), (None, "s", v, 4, None), ("n9", "s", v, None, None)]
    got = {tuple(r) for r in vp_knn.similar_pairs(spark.createDataFrame(rows, SCHEMA), 3, 0.85).collect()}
    assert got == brute(rows, 3, 0.85)
    lists = {r["cid"]: [n["cid"] for n in r["neighbours"]] for r in vp_knn.neighbour_lists(spark.createDataFrame(rows, SCHEMA), 3, 0.85).collect()}
    assert lists["c05"] == ["c00", "c01", "c02"] and lists["c00"] == ["c01", "c02", "c03"]


def test_without_least_similarity(spark):
    rows = clustered(4, 200, 8, "s")
    lists = vp_knn.neighbour_lists(spark.createDataFrame(rows, SCHEMA), 4, None, factor=1.0, shard_rows=64, leaf_rows=8).collect()
    got = {(min(r["cid"], n["cid"]), max(r["cid"], n["cid"])) for r in lists for n in r["neighbours"]}
    assert got == brute(rows, 4, -2) and all(len(r["neighbours"]) == 4 for r in lists)


def test_empty_table(spark):
    assert vp_knn.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_usable_record_gets_its_neighbours(spark):
    from conftest import SF
    from loomspan.llm import queries

    spaces = {}
    for r in spark.read.parquet(f"{SF}/vector_records.parquet").collect():
        e = r["embedding"]
        if r["cid"] and r["space_id"] and e and len(e) == r["dim"] and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, np.float32).astype(float)
            spaces.setdefault(r["space_id"], {}).setdefault(r["cid"], v / np.linalg.norm(v))
    got = {}
    for r in queries.p1_neighbours(spark, SF).collect():
        got.setdefault((r["space_id"], r["cid"]), []).append(r["cosine"])
    found = asked = 0
    for s, m in spaces.items():
        for c in m:
            best = sorted((float(m[c] @ m[o]) for o in m if o != c), reverse=True)[:10]
            mine = got.get((s, c), [])
            assert len(mine) == len(best)
            asked += len(best)
            found += sum(x >= best[-1] - 2e-6 for x in mine)
    assert asked and found / asked >= 0.9


def test_shards_stay_bounded_in_a_large_space():
    rng = np.random.default_rng(5)
    n, shard_rows = 100_000_000, 16384
    shards = -(-n // shard_rows)
    size = vp_knn.sample_size(shards, 4096)
    x = rng.normal(size=(size, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = vp_knn.router(x, shards)
    leaves = sum(m.leaf >= 0 for m in nodes)
    fresh = rng.normal(size=(200_000, 16)).astype(np.float32)
    fresh /= np.linalg.norm(fresh, axis=1, keepdims=True)
    rows = np.bincount(vp_knn.home(nodes, fresh), minlength=leaves) * (n / len(fresh))
    assert leaves >= 0.99 * shards and np.quantile(rows, 0.99) <= 5 * shard_rows
    assert vp_knn.sample_size(1 << 30, 4096) == vp_knn.SAMPLE_MOST
