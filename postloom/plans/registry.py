"""All registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.plans import general, retrieval, retrieval_sql


def collect() -> tuple[dict, dict]:
    """(queries, SQL) of every plan module."""
    queries: dict = {}
    sql: dict = {}
    for module in (general, retrieval):
        queries |= module.QUERIES
        sql |= getattr(module, "SQL", {})
    return queries, sql | retrieval_sql.SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query that stands for the engine."""
    return retrieval.bm25_topk(spark, folder)
