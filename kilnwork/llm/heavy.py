"""Most frequent items in bounded memory: a heavy-light sketch, merged over partitions, and an exact recount of its candidates.

Items are 64-bit hashes in the sketch. Each task keeps buckets of `SLOTS` exact counters with one count of votes against them, and a
light array of counters; their numbers follow from the least share that is asked for (`sketch_size`), not from the data. A batch is counted first; then in each bucket a resident's count is added
to it, newcomers fill free slots, and the strongest newcomer takes the weakest resident's slot once the votes against exceed
`EVICT` times its count; whatever is evicted or refused is added to the light array. Memory is the same for any input.

Partitions merge by recombining buckets: counts of a hash are added, the best `SLOTS` of a bucket stay, the rest joins the light
array, cell by cell. An item's true count is then at most its slot's count plus its light cell, so the items that may reach a
threshold are those whose bound does, and any item of a light cell that alone reaches it. There are at most as many of either as
slots and as total / threshold; exactly these are recounted by their values, so the result is exact whatever the sketch lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.sources.staging import stage

BUCKETS, SLOTS, CELLS, EVICT = 512, 8, 8192, 8
#: Light cells at most: beyond it a smaller share is refused instead of using more memory.
MOST_CELLS = 1 << 24


def sketch_size(share: float) -> tuple[int, int]:
    """Buckets and light cells for values of at least this share: eight cells and half a bucket of slots for each value there can be.

    A light cell then holds an eighth of the least count on average, so few reach it by many small values.
    """
    cells = CELLS
    while cells * share < 8:
        cells *= 2
    if cells > MOST_CELLS:
        raise ValueError(f"a share below {8 / MOST_CELLS:g} needs more than {MOST_CELLS} cells")
    return cells // 16, cells


class HeavyLight:
    """The sketch of one task for one field."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, cells: int = CELLS) -> None:
        self.keys = np.zeros((buckets, slots), np.int64)
        self.votes = np.zeros((buckets, slots), np.int64)  # 0: free
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros(cells, np.int64)

    def _to_light(self, keys: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.light, cell_of(keys, len(self.light)), counts)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct keys with their counts."""
        bucket = bucket_of(keys, len(self.votes))
        hit = (self.keys[bucket] == keys[:, None]) & (self.votes[bucket] > 0)
        known = hit.any(1)
        self.votes[bucket[known], hit[known].argmax(1)] += counts[known]
        keys, counts, bucket = keys[~known], counts[~known], bucket[~known]
        order = np.lexsort((keys, -counts, bucket))  # the strongest newcomer of each bucket first
        keys, counts, bucket = keys[order], counts[order], bucket[order]
        while len(keys):
            first = np.r_[True, bucket[1:] != bucket[:-1]]
            b, k, c = bucket[first], keys[first], counts[first]
            weakest = self.votes[b].argmin(1)
            least = self.votes[b, weakest]
            self.against[b] += np.where(least > 0, c, 0)
            wins = (least == 0) | (self.against[b] > EVICT * least) | (c > least)
            out = wins & (least > 0)
            self._to_light(self.keys[b[out], weakest[out]], least[out])
            self.keys[b[wins], weakest[wins]] = k[wins]
            self.votes[b[wins], weakest[wins]] = c[wins]
            self.against[b[out]] = 0
            self._to_light(k[~wins], c[~wins])
            # what is left goes against the bucket; a bucket that refused its strongest refuses the rest at once
            rest = ~first
            refused = np.zeros(len(self.votes), bool)
            refused[b[~wins]] = True
            gone = rest & refused[bucket]
            np.add.at(self.against, bucket[gone], counts[gone])
            self._to_light(keys[gone], counts[gone])
            stay = rest & ~gone
            keys, counts, bucket = keys[stay], counts[stay], bucket[stay]


def _mixed(keys: np.ndarray, by: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys, 0x9E3779B97F4A7C15) % np.uint64(buckets)).astype(np.int64)


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    return (_mixed(keys, 0xC2B2AE3D27D4EB4F) % np.asarray(cells).astype(np.uint64)).astype(np.int64)


def _sketch(sizes: list[tuple[int, int]]):
    """Batches of (field int, keys list<long>) to rows (field, kind 0 heavy / 1 light, place, key, count); sizes by field."""

    def sketched(batches):
        yield from _sketched(batches, sizes)

    return sketched


def _sketched(batches, sizes):
    fields: dict[int, HeavyLight] = {}
    for batch in batches:
        field = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(field, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        for f in np.unique(of):
            keys, counts = np.unique(flat[of == f], return_counts=True)
            fields.setdefault(int(f), HeavyLight(sizes[f][0], SLOTS, sizes[f][1])).add(keys, counts)
    for f, s in fields.items():
        b, k = np.nonzero(s.votes)
        cells = np.nonzero(s.light)[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(b) + len(cells), f), pa.int32()), pa.array(np.r_[np.zeros(len(b)), np.ones(len(cells))], pa.int32()),
                pa.array(np.r_[b, cells], pa.int64()), pa.array(np.r_[s.keys[b, k], np.zeros(len(cells), np.int64)], pa.int64()), pa.array(np.r_[s.votes[b, k], s.light[cells]], pa.int64()),
            ],
            names=["field", "kind", "place", "key", "count"],
        )


def _cells(sizes: list[tuple[int, int]]):
    """Adds to batches of (field, place, key, count) the light cell of each key."""
    cells = np.array([c for _, c in sizes])

    def with_cells(batches):
        for b in batches:
            key, field = b.column("key").to_numpy(zero_copy_only=False), b.column("field").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(key, cells[field]), pa.int64())], names=[*b.schema.names, "cell"])

    return with_cells


def merged_sketch(df: DataFrame, sizes: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Of rows (field int, keys array<long>): heavy (field, key, count, cell) and light (field, cell, count) over all partitions."""
    parts = stage(df.mapInArrow(_sketch(sizes), "field int, kind int, place long, key long, count long"), "sketches")
    summed = parts.groupBy("field", "kind", "place", "key").agg(F.sum("count").alias("count"))
    rank = Window.partitionBy("field", "place").orderBy(F.desc("count"), "key")
    heavy = summed.where("kind = 0").mapInArrow(_cells(sizes), "field int, kind int, place long, key long, count long, cell long").withColumn("nth", F.row_number().over(rank))
    light = (
        summed.where("kind = 1").select("field", F.col("place").alias("cell"), "count")
        .unionByName(heavy.where(F.col("nth") > SLOTS).select("field", "cell", "count"))
        .groupBy("field", "cell").agg(F.sum("count").alias("count"))
    )
    return heavy.where(F.col("nth") <= SLOTS).select("field", "key", "count", "cell"), light


def _bounds(df: DataFrame, fields: dict[str, Column], sizes: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """field, key, count, cell, bound (the most it can be) of what is in the buckets, and the light cells."""
    keyed = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("field"), F.transform(F.filter(c, lambda v: v.isNotNull()), lambda v: F.xxhash64(v)).alias("keys")) for i, c in enumerate(fields.values())
    ])).alias("k")).select("k.field", "k.keys")
    heavy, light = merged_sketch(keyed, sizes)
    return heavy.join(light.withColumnRenamed("count", "more"), ["field", "cell"], "left").withColumn("bound", F.col("count") + F.coalesce("more", F.lit(0))), light


def approximate_top(df: DataFrame, field: Column, n: int, share: float) -> DataFrame:
    """The n values of greatest approximate count of one field (a column of arrays of strings): item, least, most, exact bounds of the count.

    One pass makes the sketch, a second finds the values of its hashes; nothing is counted again. Values of at least `share` of all
    are sure to be among the buckets' (share sets the memory, see sketch_size). Order: least descending, then item. Nulls don't count.
    """
    both, _ = _bounds(df, {"field": field}, [sketch_size(share)])
    best = stage(both.orderBy(F.desc("count"), "key").limit(n).select("key", F.col("count").alias("least"), F.col("bound").alias("most")), "best")
    values = df.select(F.explode(field).alias("item")).where("item is not null").withColumn("key", F.xxhash64("item"))
    named = values.join(F.broadcast(best), "key").groupBy("item").agg(F.first("least").alias("least"), F.first("most").alias("most"))  # n rows
    return named.orderBy(F.desc("least"), "item").limit(n)


def frequent_values(df: DataFrame, fields: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """Values with at least their field's share of all values of the field: columns field, item, n (exact), bound (the sketch's).

    df must be cheap to read twice (a staged table). fields: name -> a column of arrays of strings, whose non-null elements are
    counted; shares: name -> least share, relative to `n_<field>` if df has such a column to sum, else to the number of values.
    Nulls don't count; equal bounds and counts are all kept; an empty table has no rows.
    """
    names = list(fields)
    size = lambda n: F.coalesce(F.sum(F.size(F.filter(fields[n], lambda v: v.isNotNull()))), F.lit(0)).cast("long")
    sums = df.agg(*[x for n in names for x in (size(n).alias(f"{n} held"), (F.coalesce(F.sum(f"n_{n}"), F.lit(0)).cast("long") if f"n_{n}" in df.columns else size(n)).alias(f"{n} total"))]).first()
    least = {n: shares[n] * sums[f"{n} total"] for n in names}
    sizes = [sketch_size(min(1.0, max(least[n], 1) / max(sums[f"{n} held"], 1))) for n in names]
    both, light = _bounds(df, fields, sizes)
    at_least = F.coalesce(*[F.when(F.col("field") == i, F.lit(float(max(least[n], 1)))) for i, n in enumerate(names)])
    # at most slots and total / threshold rows
    sure = both.where(F.col("bound") >= at_least).select("field", "key", "bound").collect()
    hot = light.where(F.col("count") >= at_least).select("field", "cell").collect()
    asked = []
    for i, n in enumerate(names):
        keys = sorted(r["key"] for r in sure if r["field"] == i)
        cells = sorted(r["cell"] for r in hot if r["field"] == i)
        if cells:  # of whole light cells the values have to be looked at one by one
            values = df.select(F.explode(fields[n]).alias("item")).where("item is not null").withColumn("key", F.xxhash64("item"))
            rest = values.where(_cell_column(F.col("key"), sizes[i][1]).isin(cells) | F.col("key").isin(keys)).select(F.lit(i).alias("field"), "item", "key")
        else:
            rest = None
        asked.append((i, n, keys, rest))
    # all other fields in one pass
    wanted = [F.struct(F.lit(i).alias("field"), F.filter(fields[n], _among(keys)).alias("items")) for i, n, keys, rest in asked if rest is None and keys]
    parts = [rest for *_, rest in asked if rest is not None]
    if wanted:
        parts.append(df.select(F.explode(F.array(*wanted)).alias("k")).select("k.field", F.explode("k.items").alias("item")).withColumn("key", F.xxhash64("item")))
    if not parts:
        return df.sparkSession.createDataFrame([], "field string, item string, n long, bound long")
    counted = reduce(DataFrame.unionByName, parts).groupBy("field", "item", "key").agg(F.count("*").alias("n"))
    bounds = df.sparkSession.createDataFrame([tuple(r) for r in sure], "field int, key long, bound long")
    found = counted.join(F.broadcast(bounds), ["field", "key"], "left")  # as many rows as slots at most
    name = F.coalesce(*[F.when(F.col("field") == i, F.lit(n)) for i, n in enumerate(names)])
    enough = F.coalesce(*[F.when(F.col("field") == i, F.lit(float(least[n]))) for i, n in enumerate(names)])
    return found.where(F.col("n") >= enough).select(name.alias("field"), "item", "n", F.coalesce("bound", "n").alias("bound"))


def _among(keys: list[int]):
    return lambda v: F.xxhash64(v).isin(keys) & v.isNotNull()


def _cell_column(key: Column, cells: int) -> Column:
    """cell_of as a column, for the rare recount of whole light cells."""

    @F.pandas_udf("long")
    def cell(k):
        import pandas as pd

        return pd.Series(cell_of(k.to_numpy(), cells))

    return cell(key)
