"""Catalogue of the engine's own queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans import event_queries, graph_queries, io_queries, queue_queries, ranking_queries, record_queries, relation_queries, scoring_queries, signal_queries, text_queries, vector_queries  # noqa: F401
from loomspan.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["ranked_pack"](spark, sf)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
