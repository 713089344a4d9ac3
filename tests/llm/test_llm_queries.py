"""Problem queries against brute force in SQL on the smallest tables; the others for a stable schema and sane totals."""

import pytest
from conftest import SF
from oracle import compare, connect

from loomspan.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, queries.queries()[name], queries.oracle_sql()[name], SF) == ""


def test_shares_of_containers(spark):
    rows = queries.p6_shares(spark, SF).collect()
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-4 and all(0 <= r["mean_off"] <= r["most_off"] <= 1 for r in rows)


def test_windows_keep_their_proportions_over_several_tasks(spark):
    from loomspan.llm import packing

    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE 'c' END AS source", "20 + (id * 37) % 60 AS n_tokens")
    packed = packing.pack(docs, capacity=2048, part_items=500)
    off = {r["source"]: r for r in packing.share_deviation(packed, docs).collect()}
    assert {s: round(r["share"], 1) for s, r in off.items()} == {"a": 0.6, "b": 0.3, "c": 0.1}
    # Within about an item of its share of each window on average.
    assert all(r["mean_off"] <= 80 / 2048 for r in off.values())
