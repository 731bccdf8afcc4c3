"""Readers of the file formats that the operators start from. Schemas are given, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, name string, city string, state string, categories string"
USER = "user_id string, friends string, useful int"
PAIRS = "user_id string, business_id string"
MODEL = "b1 string, b2 string, sim double"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a missing field is null, a line that is no JSON is a row of nulls."""
    return spark.read.schema(schema).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def json_map(spark: SparkSession, path: str, key: str = "id", value: str = "avg") -> DataFrame:
    """A file holding one JSON object of numbers, as rows of key and value (never as a struct with a field for each id)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,double>")).alias(key, value))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """value: the non-empty lines of a text file without outer blanks."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def points(spark: SparkSession, path: str) -> DataFrame:
    """id, features, file of all chunk files `id,f1,f2,...` in a folder; `file` sorts as the names do, for chunked clustering."""
    cut = F.split("value", ",")
    features = F.transform(F.slice(cut, F.lit(2), F.size(cut) - 1), lambda v: v.cast("double"))
    return spark.read.text(path).select(F.get(cut, F.lit(0)).cast("long").alias("id"), features.alias("features"), F.input_file_name().alias("file")).where("id is not null")


def model_pairs(spark: SparkSession, path: str, schema: str = MODEL) -> DataFrame:
    """A pair model from JSON lines with the pair in order."""
    a, b, sim = (c.split()[0] for c in schema.split(","))
    rows = json_lines(spark, path, schema)
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), sim)


def sections(spark: SparkSession, path: str, marker: str = "user") -> tuple[DataFrame, DataFrame]:
    """The two tables (id, features) of a profile model written by writers.sections."""
    return spark.read.parquet(f"{path}/section=first"), spark.read.parquet(f"{path}/section={marker}")
