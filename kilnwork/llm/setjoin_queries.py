"""Queries of the set similarity join over train_review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.setjoin import expanded, similar_between, similar_sets
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = similar_sets(table(spark, folder, "train_review"), "business_id", "user_id", threshold=0.5, min_size=3)
    return expanded(pairs, members).select(F.col("r1").alias("b1"), F.col("r2").alias("b2"))


def p7_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every business with at least 3 users: its class of equal sets and how many other classes are similar to it."""
    pairs, members = similar_sets(table(spark, folder, "train_review"), "business_id", "user_id", threshold=0.5, min_size=3)
    links = pairs.select(F.explode(F.array("r1", "r2")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    return members.join(links, "representative", "left").select(
        F.col("record").alias("business_id"), F.col("representative").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )


def p7_between(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses by those who reviewed them and businesses by those who liked them (4 stars or more): sets of at least 3 users, similar at 0.5."""
    rows = table(spark, folder, "train_review")
    found = similar_between(rows, rows.where((F.col("stars") >= 4) & ~F.isnan("stars")), "business_id", "user_id", threshold=0.5, min_size=3)
    return found.select(F.col("left").alias("reviewed"), F.col("right").alias("liked"), "common")


_SETS = """
WITH t AS (SELECT DISTINCT business_id b, user_id u FROM train_review WHERE business_id <> '' AND user_id <> ''),
     n AS (SELECT b, count(*) n, string_agg(u, ' ' ORDER BY u) k FROM t GROUP BY b HAVING count(*) >= 3),
     j AS (SELECT x.b b1, y.b b2, count(*) c FROM t x JOIN t y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2),
     f AS (SELECT b1, b2, p.k k1, q.k k2 FROM j JOIN n p ON p.b = b1 JOIN n q ON q.b = b2 WHERE 2 * c >= p.n + q.n - c)
"""


def register(out: Registry) -> None:
    out.add("p7_found", _SETS + "SELECT b1, b2 FROM f")(p7_found)
    out.add(
        "p7_between",
        """WITH t AS (SELECT DISTINCT business_id b, user_id u FROM train_review WHERE business_id <> '' AND user_id <> ''),
        s AS (SELECT DISTINCT business_id b, user_id u FROM train_review WHERE business_id <> '' AND user_id <> '' AND stars >= 4 AND NOT isnan(stars)),
        n AS (SELECT b, count(*) n FROM t GROUP BY b HAVING count(*) >= 3), m AS (SELECT b, count(*) n FROM s GROUP BY b HAVING count(*) >= 3),
        j AS (SELECT t.b x, s.b y, count(*) common FROM t JOIN s USING (u) GROUP BY 1, 2)
        SELECT x reviewed, y liked, common FROM j JOIN n ON n.b = x JOIN m ON m.b = y WHERE 2 * common >= n.n + m.n - common""",
    )(p7_between)
    out.add(
        "p7_links",
        _SETS + """, d AS (SELECT k, min(b) c FROM n GROUP BY k),
        e AS (SELECT DISTINCT k1 k, k2 l FROM f WHERE k1 <> k2 UNION SELECT k2, k1 FROM f WHERE k1 <> k2),
        g AS (SELECT k, count(*) links FROM e GROUP BY k)
        SELECT b business_id, c class_id, coalesce(links, 0)::BIGINT links FROM n JOIN d USING (k) LEFT JOIN g USING (k)""",
    )(p7_links)
