"""Queries of the co-occurrence operator over ub_sample_data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.cooccurrence import pair_surprise
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table

_BASKETS = """
WITH ub AS (SELECT DISTINCT user_id u, business_id b FROM ub_sample_data WHERE user_id <> '' AND business_id <> ''),
     n AS (SELECT count(DISTINCT u) baskets FROM ub),
     freq AS (SELECT b, count(*) c FROM ub GROUP BY b),
     pair AS (SELECT x.b b1, y.b b2, count(*) n FROM ub x JOIN ub y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 8)
"""


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = pair_surprise(table(spark, folder, "ub_sample_data"), "user_id", "business_id", min_count=8, min_lift=5)
    return pairs.where(F.col("n") * F.col("baskets") >= 5 * F.col("n1") * F.col("n2")).select("b1", "b2")


def p1_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs more often together than chance at a false-discovery rate of 0.1 %."""
    pairs = pair_surprise(table(spark, folder, "ub_sample_data"), "user_id", "business_id", min_count=8)
    return pairs.where(F.col("fdr") <= 0.001)


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs in at least 8 baskets with their counts and lift."""
    pairs = pair_surprise(table(spark, folder, "ub_sample_data"), "user_id", "business_id", min_count=8)
    return pairs.select("b1", "b2", "n", "n1", "n2", "baskets", F.round("lift", 6).alias("lift"))


def register(out: Registry) -> None:
    out.add(
        "p1_found",
        _BASKETS + """SELECT b1, b2 FROM pair JOIN freq f ON f.b = b1 JOIN freq g ON g.b = b2 CROSS JOIN n
        WHERE pair.n * baskets >= 5 * f.c * g.c""",
    )(p1_found)
    out.add("p1_surprise")(p1_surprise)
    out.add(
        "p1_counts",
        _BASKETS + """SELECT b1, b2, pair.n, f.c n1, g.c n2, baskets, round(pair.n * baskets::DOUBLE / (f.c * g.c), 6) lift
        FROM pair JOIN freq f ON f.b = b1 JOIN freq g ON g.b = b2 CROSS JOIN n""",
    )(p1_counts)
