"""Queries of the personal information finder over documents."""

from __future__ import annotations

import secrets
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.personal import personal
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table

#: The setting that holds the key of the pseudonyms. Values are linked between runs, and can be taken back, by its holder only.
KEY_SETTING = "spark.kilnwork.pseudonymKey"


@cache
def _random_key() -> bytes:
    return secrets.token_bytes(32)


def _key(spark: SparkSession) -> bytes:
    """The caller's key; where none is set, one of this process that nobody holds."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode()[:64] if given else _random_key()


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in enough partitions for work that is heavy per byte; ids are unique, so they spread evenly."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 3), "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = personal(_spread(spark, folder), ["doc_id"], "text", table(spark, folder, "name_list"), None, with_text=False, dates=None)
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.kind", "f.start_pos")


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed pseudonyms in place of personal values, dates of birth too, and how many there were."""
    rows = personal(_spread(spark, folder), ["doc_id"], "text", table(spark, folder, "name_list"), _key(spark))
    return rows.select("doc_id", F.size("found").alias("finds"), "redacted")


def register(out: Registry) -> None:
    out.add("p10_found")(p10_found)
    out.add("p10_redacted")(p10_redacted)
