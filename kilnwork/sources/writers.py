"""Writers of the report and model formats. Reports are a few rows by nature and go to one file; models stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of the report formats (fixed values).
CANDIDATES, FREQUENT = "Candidates: \n", "Frequent Itemsets:\n"
AFTER_SINGLES, AFTER_LARGER = " \n \n", "\n \n"
COMPARISON = "Task2,%d \nTask3,%d\nIntersection,%d"
ESTIMATE_COLUMNS = ("Time", "Ground Truth", "Estimation")
TAG_TOTAL = "The number of tweets with tags from the beginning: %d\n"


def json_report(df: DataFrame, path: str, **fields: Column) -> None:
    """One JSON object: aggregates of a small df, by name."""
    df.agg(*[c.alias(n) for n, c in fields.items()]).select(F.to_json(F.struct(*fields)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def sections(first: DataFrame, second: DataFrame, path: str, marker: str = "user") -> None:
    """Two profile tables as one partitioned model."""
    first.write.mode("overwrite").parquet(f"{path}/section=first")
    second.write.mode("overwrite").parquet(f"{path}/section={marker}")


def flags(line: DataFrame, path: str) -> None:
    """A row of flags parted by blanks."""
    line.coalesce(1).write.mode("overwrite").text(path)


def itemset_lines(sets: DataFrame) -> DataFrame:
    """size, line: the itemsets of each size in order, commas between: ('a'),('b') and ('a', 'b'),('a', 'c')."""
    one = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    return sets.withColumn("set", one).groupBy("size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("items", "set"))), lambda s: s["set"]), ",").alias("line"))


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """value: the whole report, candidates and then frequent itemsets, a line for each size with a blank line behind it."""
    block = lambda d: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("size", "line"))), lambda s: F.concat(s["line"], F.when(s["size"] == 1, AFTER_SINGLES).otherwise(AFTER_LARGER))), "")
    c = itemset_lines(candidates).agg(block(candidates).alias("c"))
    f = itemset_lines(frequent).agg(block(frequent).alias("f"))
    return c.join(F.broadcast(f)).select(F.concat(F.lit(CANDIDATES), "c", F.lit(FREQUENT), "f").alias("value"))  # one row each


def comparison_lines(counts: DataFrame) -> DataFrame:
    """value: the comparison of two miners, from itemsets.agreement."""
    return counts.select(F.format_string(COMPARISON, "first", "second", "both").alias("value"))


def tuple_lines(df: DataFrame, *names: str, weight: str | None = None) -> DataFrame:
    """value: 'a', 'b' of each row, or ('a', 'b'), weight."""
    quoted = F.concat(F.lit("'"), F.concat_ws("', '", *names), F.lit("'"))
    return df.select((F.concat(F.lit("("), quoted, F.lit("), "), F.col(weight).cast("string")) if weight else quoted).alias("value"))


def cluster_map(df: DataFrame, path: str) -> None:
    """id -> cluster as JSON lines in order of id, outliers as -1."""
    df.orderBy("id").write.mode("overwrite").json(path)


def estimate_lines(windows: DataFrame) -> DataFrame:
    """Time, Ground Truth, Estimation of windows (start, users, estimate)."""
    time, exact, guess = ESTIMATE_COLUMNS
    return windows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias(time), F.col("users").alias(exact), F.col("estimate").alias(guess))


def json_object(df: DataFrame, path: str, key: str, value: str, one_file: int = 1_000_000) -> None:
    """One JSON object of key: value, in order of the key; null keys are left out.

    Up to `one_file` rows make one file; more make several, whose texts in order of their names are the object.
    """
    inner = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  as JSON has it, without the array's brackets
    body = df.where(F.col(key).isNotNull()).select(F.lit(1).alias("at"), F.col(key).cast("string").alias("key"), F.concat(inner(F.col(key).cast("string")), F.lit(":"), inner(F.col(value))).alias("value"))
    number = body.count()
    ends = df.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "at int, key string, value string")
    last = body.agg(F.max("key").alias("key")).first()["key"]
    comma = F.when((F.col("at") == 1) & (F.col("key") != F.lit(last)), F.concat("value", F.lit(","))).otherwise(F.col("value"))
    lines = ends.unionByName(body).select("at", "key", comma.alias("value"))
    ordered = lines.coalesce(1).sortWithinPartitions("at", "key") if number <= one_file else lines.orderBy("at", "key")
    ordered.select("value").write.mode("overwrite").text(path)


def tag_snapshot(ranked: DataFrame, total: int) -> DataFrame:
    """value: the number of items so far, then `tag : n` lines by falling n and tag, from sketch.top_dense."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))), lambda s: F.concat(s["tag"], F.lit(" : "), (-s["k"]).cast("string"))), "\n")
    return ranked.agg(F.concat(F.lit(TAG_TOTAL % total), lines, F.lit("\n")).alias("value"))
