"""Queries of the top-N operator over itemcf_model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilnwork.llm.topn import top_per_group
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table

_SQL = """
WITH r AS (SELECT b1, b2, max(sim) sim FROM itemcf_model WHERE sim IS NOT NULL AND NOT isnan(sim) GROUP BY b1, b2),
     o AS (SELECT *, row_number() OVER (PARTITION BY b1 ORDER BY sim DESC, b2) place FROM r)
SELECT {} FROM o WHERE place <= {}
"""


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_per_group(table(spark, folder, "itemcf_model"), "b1", "b2", "sim", n=5).select("b1", "b2")


def p2_top3(spark: SparkSession, folder: str) -> DataFrame:
    """The three most similar items of every item with scores and places."""
    return top_per_group(table(spark, folder, "itemcf_model"), "b1", "b2", "sim", n=3)


def register(out: Registry) -> None:
    out.add("p2_found", _SQL.format("b1, b2", 5))(p2_found)
    out.add("p2_top3", _SQL.format("b1, b2, sim, place::INTEGER place", 3))(p2_top3)
