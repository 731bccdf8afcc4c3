"""Counting members that two items have in common, without expanding the largest groups.

A pair with at least m common groups lies in at least one group outside the m - 1 largest. Pairs are made from the others only;
each item carries a bit for each of the largest groups that it is in, which complete the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.sources.staging import release, stage

BLOCK = 256
#: Rows (group, item) up to which every task holds them all (two numbers a row), so that pairs are counted where they are made.
HELD_ROWS = 2_000_000


def largest_groups(rows: DataFrame, group: str, n: int) -> list:
    return [r[0] for r in rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n).collect()] if n else []


def expanded(kept: DataFrame) -> DataFrame:
    """Rows (g, p) to the pairs p < q of structs within every g, without ever holding a whole group: blocks and pairs of blocks."""
    sizes = kept.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    cut = kept.join(sizes, "g", "left").withColumn("block", F.pmod(F.xxhash64("p"), F.coalesce("blocks", F.lit(1))))
    blocks = cut.groupBy("g", "block", F.col("blocks").isNotNull().alias("cut")).agg(F.sort_array(F.collect_list("p")).alias("items"))
    within = blocks.select(F.posexplode("items").alias("k", "p"), "items").select("p", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("q"))
    l, r = blocks.where("cut").alias("l"), blocks.where("cut").alias("r")
    across = (
        l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.block") < F.col("r.block")))
        .select(F.explode("l.items").alias("p"), F.col("r.items").alias("right")).select("p", F.explode("right").alias("q"))
        .select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    )
    return within.unionByName(across)


def common_counts(rows: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """a < b, n: pairs of items in at least `least` common groups. rows: distinct (group, item), both set."""
    large = largest_groups(rows, group, min(least - 1, 40))
    bit = F.coalesce(*[F.when(F.col(group) == g, F.lit(1 << i)) for i, g in enumerate(large)], F.lit(0)).cast("long")
    enough = rows.groupBy(item).agg(F.count("*").alias("d"), F.bit_or(bit).alias("bits")).where(F.col("d") >= least).select(item, "bits")
    others = rows.where(~F.col(group).isin(large)) if large else rows
    kept = others.join(enough, item).select(F.col(group).alias("g"), F.struct(F.col(item).alias("i"), "bits").alias("p"))
    return (
        expanded(kept).groupBy(F.col("p.i").alias("a"), F.col("q.i").alias("b"), F.col("p.bits").bitwiseAND(F.col("q.bits")).alias("both"))
        .agg(F.count("*").alias("n")).select("a", "b", (F.col("n") + F.bit_count("both")).alias("n")).where(F.col("n") >= least)
    )


def held_common_counts(rows: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """The same as common_counts, without shuffling pairs where the rows fit a task: each task counts all pairs of its share of the items."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    enough = rows.groupBy(item).agg(F.count("*").alias("d")).where(F.col("d") >= least).select(item)
    kept = stage(rows.join(enough, item, "left_semi").select(F.col(group).alias("g"), F.col(item).alias("i")), "rows")
    if not 0 < kept.count() <= HELD_ROWS:
        return common_counts(kept, "g", "i", least)
    spark, held = kept.sparkSession, kept.toArrow()  # counted before
    names = pc.unique(held["i"])
    names = names.take(pc.sort_indices(names))
    items = pc.index_in(held["i"], names).to_numpy()
    groups = held["g"].combine_chunks().dictionary_encode().indices.to_numpy()
    n, sizes = len(names), np.bincount(groups)
    bits = np.zeros(n, np.int64)
    for k, g in enumerate(np.argsort(-sizes, kind="stable")[: min(least - 1, 40)]):
        bits[items[groups == g]] |= 1 << k
        groups = np.where(groups == g, -1, groups)
    items, groups = items[groups >= 0], groups[groups >= 0]

    def listed(keys, values, number):
        order = np.lexsort((values, keys))
        return np.searchsorted(keys[order], np.arange(number + 1)), values[order]

    table = spark.sparkContext.broadcast((*listed(items, groups, n), *listed(groups, items, len(sizes)), bits, names))

    def share(batches):
        of, near, starts, members, bits, names = table.value
        for batch in batches:
            for p in batch.column(0).to_pylist():
                own = [members[starts[g] : starts[g + 1]] for g in near[of[p] : of[p + 1]].tolist()]
                met = np.concatenate([x[np.searchsorted(x, p, "right") :] for x in own]) if own else members[:0]
                if 8 * len(met) > n:
                    c = np.bincount(met, minlength=n)
                    q = np.flatnonzero(c)
                    c = c[q]
                else:
                    q, c = np.unique(met, return_counts=True)
                c = c + np.bitwise_count(bits[q] & bits[p])
                q, c = q[c >= least], c[c >= least]
                if len(q):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(q), p))), names.take(pa.array(q)), pa.array(c.astype(np.int64))], ["a", "b", "n"])

    release(kept)
    kind = kept.schema["i"].dataType.simpleString()
    return spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(share, f"a {kind}, b {kind}, n long")
