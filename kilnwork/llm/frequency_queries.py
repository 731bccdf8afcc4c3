"""Queries of the radix term counter over review.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.frequency import marked, term_frequencies
from kilnwork.llm.heavy_queries import TERMS_SQL
from kilnwork.llm.terms import one_each, stop_list, terms
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    review = table(spark, folder, "review")
    stop = stop_list(table(spark, folder, "stopwords"))
    each = one_each(review.select("review_id", "text", "loaded_at"), ["loaded_at"], "review_id")
    records = review.select("review_id").distinct().count()
    return marked(term_frequencies(each.select(terms(F.col("text"), stop).alias("terms")), "terms"), records)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where("mark is not null").select("term", "mark")


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, its reviews and its mark."""
    return _terms(spark, folder)


def register(out: Registry) -> None:
    sql = (
        "WITH " + TERMS_SQL + """,
        f AS (SELECT term, count(*) n, count(DISTINCT review_id) records FROM w GROUP BY term),
        m AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM r) THEN 'common' END mark FROM f)
        SELECT {} FROM m {}"""
    )
    out.add("p6_found", sql.format("term, mark", "WHERE mark IS NOT NULL"))(p6_found)
    out.add("p6_counts", sql.format("*", ""))(p6_counts)
