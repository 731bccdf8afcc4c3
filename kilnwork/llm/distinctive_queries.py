"""Queries of the parsimonious language model over review texts by business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnwork.llm.distinctive import WEIGHT, distinctive_terms
from kilnwork.llm.heavy_queries import TERMS_SQL
from kilnwork.llm.terms import stop_list
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table


def _terms(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    review = table(spark, folder, "review").select("review_id", "business_id", "text", "loaded_at")
    return distinctive_terms(review, "business_id", "review_id", "text", "loaded_at", stop_list(table(spark, folder, "stopwords")), min_in_parts=2, min_parts=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, records = _terms(spark, folder)
    score = F.round(F.col("n") / F.col("most") * F.log2(F.lit(float(records)) / F.col("records")), 6)
    place = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("score"), "term"))
    return rows.withColumn("score", score).withColumn("place", place).where("place <= 3").select(F.col("record").alias("business_id"), "term")


def p4_parsimonious(spark: SparkSession, folder: str) -> DataFrame:
    """The five terms of greatest converged probability of every business with at least 5 reviews."""
    rows, _ = _terms(spark, folder)
    place = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("p"), "term"))
    kept = rows.withColumn("p", F.round("p", 6)).where("p > 0").withColumn("place", place).where("place <= 5")
    return kept.select(F.col("record").alias("business_id"), "term", "place", "n", "records", "p")


def register(out: Registry) -> None:
    out.add(
        "p4_found",
        "WITH " + TERMS_SQL + """,
        b AS (SELECT business_id FROM r WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
        f AS (SELECT business_id, term, count(*) tf, count(DISTINCT review_id) c FROM w WHERE business_id IS NOT NULL GROUP BY 1, 2),
        n AS (SELECT count(DISTINCT business_id) n FROM f),
        d AS (SELECT term, count(*) d FROM f GROUP BY 1),
        x AS (SELECT business_id, term, c, round(tf / max(tf) OVER (PARTITION BY business_id) * log2(n / d), 6) score FROM f JOIN d USING (term) CROSS JOIN n),
        o AS (SELECT business_id, term, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, term) k FROM x JOIN b USING (business_id) WHERE c >= 2)
        SELECT business_id, term FROM o WHERE k <= 3""",
    )(p4_found)
    # the fixed point in closed form: of the terms by falling n / background, the longest run whose last one still has p > 0
    c = (1 - WEIGHT) / WEIGHT
    out.add(
        "p4_parsimonious",
        "WITH " + TERMS_SQL + f""",
        b AS (SELECT business_id FROM r WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
        f AS (SELECT business_id, term, count(*) n, count(DISTINCT review_id) c FROM w WHERE business_id IS NOT NULL GROUP BY 1, 2),
        d AS (SELECT term, count(*) records, sum(n) / (SELECT sum(n) FROM f) g FROM f GROUP BY 1),
        x AS (SELECT f.*, records, g, n / g q, sum(n) OVER k / (1 + {c} * sum(g) OVER k) mass FROM f JOIN d USING (term) WINDOW k AS (PARTITION BY business_id ORDER BY n / g DESC)),
        y AS (SELECT *, min(mass) FILTER (q > {c} * mass AND q = last) OVER (PARTITION BY business_id) m FROM (SELECT *, min(q) FILTER (q > {c} * mass) OVER (PARTITION BY business_id) AS last FROM x)),
        z AS (SELECT business_id, term, n, c, records, n / m - {c} * g p FROM y WHERE q >= last),
        o AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY p DESC, term) place FROM z JOIN b USING (business_id) WHERE c >= 2 AND p > 0)
        SELECT business_id, term, place::INTEGER place, n, records, round(p, 6) p FROM o WHERE place <= 5""",
    )(p4_parsimonious)
