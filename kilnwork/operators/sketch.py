"""Bloom membership, Flajolet-Martin distinct counts, hash samples and frequency ranks, as batch operators.

The streaming forms in kilnwork.streaming share these functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.functions.text import affine, coefficients, halves, id_number, trailing_zeros

BITS_PER_KEY, BLOOM_HASHES, FM_HASHES, FM_GROUPS = 10, 7, 60, 6


def hashes(x: Column, k: int) -> Column:
    """Array of k affine hashes of a number below 2^60, each below 2^61."""
    high, low = halves(x)
    return F.array(*[affine(high, low, a, b) for a, b in coefficients(k)])


def bloom_bits(df: DataFrame, key: str, k: int = BLOOM_HASHES, bits: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """(bit: the set bits, size of the filter) over the distinct non-empty keys; a table, so it may be larger than any one memory."""
    keys = df.select(key).where(F.col(key) != "").distinct()
    size = max(keys.count(), 1) * bits
    return keys.select(F.explode(F.transform(hashes(id_number(F.col(key)), k), lambda h: h % size)).alias("bit")).distinct(), size


def bloom_members(df: DataFrame, key: str, bits: DataFrame, size: int, k: int = BLOOM_HASHES) -> DataFrame:
    """Distinct keys of df (a null as an empty string) with member 1 where all their bits are set, else 0; empty ones are none."""
    keys = df.select(F.coalesce(F.col(key), F.lit("")).alias(key)).distinct()
    asked = keys.where(F.col(key) != "").select(key, F.explode(F.array_distinct(F.transform(hashes(id_number(F.col(key)), k), lambda h: h % size))).alias("bit"))
    hit = asked.join(bits.withColumn("on", F.lit(1)), "bit", "left").groupBy(key).agg(F.min(F.coalesce("on", F.lit(0))).alias("member"))
    return keys.join(hit, key, "left").select(key, F.coalesce("member", F.lit(0)).alias("member"))


def flags_line(members: DataFrame, order: str) -> DataFrame:
    """One row: the flags in order, parted by blanks (the report's single line)."""
    return members.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "member"))), lambda s: s["member"].cast("string")), " ").alias("flags"))


def hopping(ts: Column, length: str, slide: str) -> Column:
    return F.window(ts, length, slide)


def window_counts(df: DataFrame, ts: str, key: str, length: str, slide: str) -> DataFrame:
    """start, n, users: rows and exact distinct keys of each hopping window."""
    return df.groupBy(hopping(F.col(ts), length, slide).alias("w")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("users")).select(F.col("w.start").alias("start"), "n", "users")


def fm_zeros(rows: DataFrame, group: str, more: list[Column] | None = None, k: int = FM_HASHES) -> DataFrame:
    """group, zeros (array of k): the greatest number of trailing zeros of each hash of the numbers x; and further aggregates."""
    high, low = halves(F.col("x"))
    rows = rows.withColumns({"__high": high, "__low": low})
    tops = [F.max(trailing_zeros(affine(F.col("__high"), F.col("__low"), a, b))).alias(f"__z{i}") for i, (a, b) in enumerate(coefficients(k))]
    found = rows.groupBy(group).agg(*(more or []), *tops)
    return found.withColumn("zeros", F.array(*[F.coalesce(f"__z{i}", F.lit(0)) for i in range(k)])).drop(*[f"__z{i}" for i in range(k)])


def fm_sketch(df: DataFrame, ts: str, key: Column, length: str, slide: str, k: int = FM_HASHES) -> DataFrame:
    """start, and the greatest number of trailing zeros of each hash over the window (zeros: array of k). Merges by maximum."""
    rows = df.select(hopping(F.col(ts), length, slide).alias("w"), id_number(key).alias("x")).where("x is not null")
    return fm_zeros(rows, "w", k=k).select(F.col("w.start").alias("start"), "zeros")


def fm_estimate(sketch: DataFrame, groups: int = FM_GROUPS) -> DataFrame:
    """The sketch's columns with estimate in place of zeros: the median over `groups` groups of hashes of the mean of 2^zeros, as a whole number."""
    k = FM_HASHES
    means = [sum((F.pow(F.lit(2.0), F.get("zeros", F.lit(i))) for i in range(g, k, groups)), F.lit(0.0)) / len(range(g, k, groups)) for g in range(groups)]
    ordered = F.array_sort(F.array(*means))
    middle = (F.get(ordered, F.lit((groups - 1) // 2)) + F.get(ordered, F.lit(groups // 2))) / 2
    return sketch.withColumn("estimate", F.floor(middle).cast("long")).drop("zeros")


def bottom_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash of their key: a uniform sample without replacement that merges and repeats."""
    return df.withColumn("__h", F.md5(F.col(key).cast("string"))).orderBy("__h", key).limit(n).drop("__h")


def top_dense(counts: DataFrame, name: str, n: str = "n", ranks: int = 3) -> DataFrame:
    """Rows of the `ranks` greatest distinct counts, ties all kept: name, n, rank.

    The counts themselves are ranked, one row each, so the sort is over as many rows as there are different counts among the greatest.
    """
    best = counts.where(F.col(n) > 0).select(n).distinct().orderBy(F.desc(n)).limit(ranks)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n))))
    return counts.join(F.broadcast(ranked), n).select(name, n, "rank")  # `ranks` rows
