"""Counting, ranking, joining and partitioning of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import SIGNS, key_sum, values_of, words


def in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows whose `yyyy-MM-dd HH:mm:ss` string falls in a year; malformed and null dates don't. The range reaches the scan."""
    ranged = df.where((F.col(date) >= f"{year:04d}") & (F.col(date) < f"{year + 1:04d}"))
    return ranged.where(F.year(F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd HH:mm:ss"))) == year)


def counted(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows of greatest `by`, ties by the named columns ascending; a heap per task, no full sort."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def word_counts(df: DataFrame, text: str, stop: DataFrame, value: str = "value") -> DataFrame:
    """word, n over all texts, without stop words and single signs."""
    exploded = df.select(F.explode(words(F.col(text))).alias("word")).where(~F.col("word").isin(SIGNS))
    return counted(exploded, "word").join(stop.select(F.trim(value).alias("word")), "word", "left_anti")


def category_averages(review: DataFrame, business: DataFrame) -> DataFrame:
    """category, avg_stars (one decimal) over the reviews of its businesses; a business row repeated multiplies its reviews."""
    stars = review.where("stars is not null").groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("n"))
    own = business.where("categories is not null").select("business_id", F.explode(values_of(F.col("categories"))).alias("category"))
    # sums per business first: the join then carries one row a business, however many reviews a hot one has
    return own.join(stars, "business_id").groupBy("category").agg(F.round(F.sum("s") / F.sum("n"), 1).alias("avg_stars"))


def having_more(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys with more than `least` rows."""
    return counted(df.where(F.col(key).isNotNull()), key).where(F.col("n") > least)


def of_state(review: DataFrame, business: DataFrame, state: str) -> DataFrame:
    """user_id, business_id of reviews of businesses in a state."""
    kept = business.where(F.col("state") == state).select("business_id")
    return review.join(kept, "business_id", "left_semi").select("user_id", "business_id")


def baskets(df: DataFrame, case: int, columns: tuple[str, str] = ("user_id", "business_id")) -> DataFrame:
    """Distinct (basket, item) rows: case 1 groups by the first column, case 2 by the second. Null and empty values don't count."""
    if case not in (1, 2):
        raise ValueError("case must be 1 or 2")
    basket, item = columns if case == 1 else columns[::-1]
    return df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket <> '' and item <> ''").distinct()


def larger_baskets(rows: DataFrame, k: int) -> DataFrame:
    """Rows of baskets of more than k items."""
    large = counted(rows, "basket").where(F.col("n") > k).select("basket")
    return rows.join(large, "basket", "left_semi")


def ranked_ids(df: DataFrame, key: str) -> DataFrame:
    """key and its rank from 0 among the distinct non-null keys, without sorting in one task.

    Range partitions are counted, the counts of the partitions before (as many numbers as partitions) are added to the rank
    within the partition.
    """
    from pyspark.sql import Window

    ids = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    from kilnwork.sources.staging import stage

    ids = stage(ids, "ids")
    sizes = counted(ids, "__part")
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return ids.withColumn("__nth", within).join(F.broadcast(before), "__part").select(key, (F.col("__before") + F.col("__nth") - 1).cast("long").alias("idx"))


def by_key_sum(df: DataFrame, key: str, n: int) -> DataFrame:
    """df in n partitions, a row going to partition (first character + last character) mod n."""
    return df.repartitionById(n, F.pmod(key_sum(F.col(key)), F.lit(n)).cast("int"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """part, n: rows of each partition that has any."""
    return counted(df.select(F.spark_partition_id().alias("part")), "part")
