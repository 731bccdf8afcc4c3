"""What the optimiser makes of the operators: ranges and columns reach the scans, ranks are cut before shuffles, no Python per row."""

import re

import pytest
from pyspark.sql import functions as F

from kilnwork.operators import relational as R
from kilnwork.operators import sketch as H
from kilnwork.operators.pairs import common_counts


@pytest.fixture
def reviews(spark, tmp_path):
    rows = [(f"u{i % 7}", f"b{i % 5}", float(i % 5), "some words", f"201{i % 9}-01-01 00:00:00") for i in range(300)]
    spark.createDataFrame(rows, "user_id string, business_id string, stars double, text string, date string").write.parquet(str(tmp_path / "r"))
    return spark.read.parquet(str(tmp_path / "r"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_range_is_pushed_down_and_columns_pruned(reviews):
    text = plan(R.in_year(reviews, "date", 2017).agg(F.count("*")))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]
    assert "GreaterThanOrEqual(date,2017)" in pushed and "LessThan(date,2018)" in pushed
    assert re.search(r"ReadSchema: struct<date:string>", text)


def test_top_keeps_a_heap_and_counts_combine_before_the_shuffle(reviews):
    text = plan(R.top(R.counted(reviews, "user_id"), 3, "n", "user_id"))
    assert "TakeOrderedAndProject" in text and text.index("partial_count") > text.index("Exchange")
    assert "stars" not in text


def test_average_joins_one_row_a_business(reviews, spark):
    business = spark.createDataFrame([("b1", "A, B")], "business_id string, categories string")
    text = plan(R.category_averages(reviews, business))
    assert text.index("Join") < text.index("partial_sum(stars")  # summed below the join


def test_no_python_in_the_core_plans(reviews):
    rows = reviews.select(F.col("user_id").alias("g"), F.col("business_id").alias("x")).distinct()
    for df in (common_counts(rows, "g", "x", 2), R.word_counts(reviews, "text", reviews.select(F.col("text").alias("value"))), H.bottom_sample(reviews, "date", 3)):
        assert not re.search("Python|Pandas|MapInArrow", plan(df))


def test_no_cartesian_products(reviews):
    rows = reviews.select(F.col("user_id").alias("g"), F.col("business_id").alias("x")).distinct()
    assert "Cartesian" not in plan(common_counts(rows, "g", "x", 2))
