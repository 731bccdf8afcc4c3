"""Queries of the heavy-light sketch over review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.heavy import frequent_values
from kilnwork.llm.terms import one_each, stop_list, terms
from kilnwork.plans.registry import Registry
from kilnwork.sources.staging import stage
from kilnwork.sources.tables import table

#: Least shares: of reviews for users and texts, of occurrences for terms.
SHARES = {"user_id": 0.005, "text": 0.005, "term": 0.0074}

TERMS_SQL = """
r AS (SELECT * FROM review QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at) = 1),
s AS (SELECT trim(value) w FROM stopwords),
t AS (SELECT review_id, business_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z \\t\\r\\n]+', '', 'g'), '[ \\t\\r\\n]+')) term FROM r),
w AS (SELECT * FROM t WHERE term <> '' AND term NOT IN (SELECT w FROM s))
"""


def _frequent(spark: SparkSession, folder: str) -> DataFrame:
    stop = stop_list(table(spark, folder, "stopwords"))
    reviews = one_each(table(spark, folder, "review").select("review_id", "user_id", "text", "loaded_at"), ["loaded_at"], "review_id")
    rows = stage(
        reviews.select(F.lit(1).alias("n_user_id"), F.lit(1).alias("n_text"), F.array("user_id").alias("user_id"), F.array("text").alias("text"), terms(F.col("text"), stop).alias("term")),
        "reviews",
    )
    return frequent_values(rows, {"user_id": F.col("user_id"), "text": F.col("text"), "term": F.col("term")}, SHARES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select("field", "item")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same items with their counts."""
    return _frequent(spark, folder).select("field", "item", "n")


def register(out: Registry) -> None:
    sql = (
        "WITH " + TERMS_SQL + """,
        u AS (SELECT 'user_id' field, user_id item, count(*) n FROM r WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.005 * (SELECT count(*) FROM r)
        UNION ALL SELECT 'text', text, count(*) FROM r WHERE text IS NOT NULL GROUP BY text HAVING count(*) >= 0.005 * (SELECT count(*) FROM r)
        UNION ALL SELECT 'term', term, count(*) FROM w GROUP BY term HAVING count(*) >= 0.0074 * (SELECT count(*) FROM w))
        SELECT {} FROM u"""
    )
    out.add("p5_found", sql.format("field, item"))(p5_found)
    out.add("p5_counts", sql.format("field, item, n"))(p5_counts)
