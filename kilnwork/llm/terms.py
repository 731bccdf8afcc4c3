"""The terms of texts, and reviews taken once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stop-word list is read to the driver only up to this length.
MOST_STOPWORDS = 100_000


def stop_list(df: DataFrame, column: str = "value") -> list[str]:
    """The words of a stop-word table, without outer blanks. More than MOST_STOPWORDS words are refused."""
    words = [r[0] for r in df.select(F.trim(column)).where(F.trim(column) != "").distinct().limit(MOST_STOPWORDS + 1).collect()]
    if len(words) > MOST_STOPWORDS:
        raise ValueError(f"more than {MOST_STOPWORDS} stop words")
    return sorted(words)


def terms(text: Column, stop: list[str]) -> Column:
    """Array of the terms of a text in order: lower-cased, all but a-z and blanks deleted, split at blanks, stop words dropped.

    A null or empty text has an empty array.
    """
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z \t\r\n]+", "")
    return F.filter(F.split(letters, r"[ \t\r\n]+"), lambda t: (t != "") & ~t.isin(stop) if stop else t != "")


def one_each(df: DataFrame, key: list[str], id_column: str, by: list[str] | None = None) -> DataFrame:
    """One row for each value of id_column (a null id is a value), after one shuffle by `by` (or the id).

    Rows of one id are held to be copies; the least by the columns of `key` stays. With `by`, rows of one id must agree in it.
    """
    part = by or [id_column]
    spread = df.repartition(*part)
    order = Window.partitionBy(*dict.fromkeys([*part, id_column])).orderBy(*key)
    return spread.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
