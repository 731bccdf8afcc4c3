"""Filling containers of fixed capacity by sum-of-squares packing.

An item goes where it makes the sum, over residual gaps, of the squared number of open containers with that gap smallest: into an
open container of some gap that it fits, or into a new one; of equal places the smallest gap is taken. That spreads open
containers over many gaps, so later items find a fitting one. Containers without a gap are closed and don't count.

Items are dealt by a hash to shards of about `CONTAINERS` containers and packed shard by shard, largest first, as they stream
through the task, whose state is the list of open containers by gap. Items of one size come together: a run of them is placed by
one table of changes, of which a placing alters four entries. There are a few tasks a core, each with as many shards as fall to it. Only
ids and sizes are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.sources.staging import stage

CONTAINERS, MOST_ITEMS, TASKS_A_CORE = 1024, 1_000_000, 4


class SumOfSquares:
    """Open containers of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.count = [0] * (capacity + 1)
        self.by_gap: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The container for an item of this size (0 <= size <= capacity)."""
        return self.place_run(size, 1)[0]

    def place_run(self, size: int, times: int) -> list[int]:
        """The containers for that many items of this size, one after the other."""
        if size == 0:
            if not self.opened:
                self._keep(self._new(), self.capacity)
            return [self.opened - 1] * times
        n, rest, out = self.count, self.capacity - size, []
        # change of the sum by filling a gap: 1 - 2 n[gap], and 2 n[gap - size] + 1 if that leaves one
        some = sorted(g for g, held in self.by_gap.items() if held and g >= size)
        change = np.full(self.capacity + 1, np.iinfo(np.int64).max)
        for g in some:
            change[g] = self._change(g, size)
        for _ in range(times):
            gap = int(change.argmin())  # the smallest of equally good gaps
            if n[gap] and gap >= size and (change[gap] <= (2 * n[rest] + 1 if rest else 0) or gap == self.capacity):
                container = self.by_gap[gap].pop()
                n[gap] -= 1
                left = gap - size
            else:
                gap, container, left = 0, self._new(), rest
            self._keep(container, left)
            out.append(container)
            for g in {gap, left, gap + size, left + size}:
                if size <= g <= self.capacity:
                    change[g] = self._change(g, size) if n[g] else np.iinfo(np.int64).max
        return out

    def _change(self, gap: int, size: int) -> int:
        return 1 - 2 * self.count[gap] + (2 * self.count[gap - size] + 1 if gap > size else 0)

    def _new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def _keep(self, container: int, gap: int) -> None:
        if gap:
            self.by_gap.setdefault(gap, []).append(container)
            self.count[gap] += 1


def pack(sizes: DataFrame, item: str, size: str, capacity: int, containers: int = CONTAINERS) -> DataFrame:
    """Every item's container: columns item, piece (int), start, n_tokens (long), container (long), in a table of pieces.

    sizes: a staged table of items, their ids a whole number, and whole sizes; rows with a null id or size or a negative size have no row.
    An item of at most `capacity` is one piece; a larger one is cut into pieces of the capacity and a rest, the only items that
    are cut. An item of size 0 joins a container without taking room. Repeated rows are items of their own; an empty table has no
    rows. `start` is the piece's first token. Container numbers are unique over all shards. Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = sizes.sparkSession
    items = sizes.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).where("item is not null and size >= 0")
    rows, total = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = max(1, round(total / (capacity * containers)), -(-rows // MOST_ITEMS))
    tasks = min(shards, max(spark.sparkContext.defaultParallelism * TASKS_A_CORE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    last = F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0))
    pieces = items.select("item", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        "item", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_tokens")
    )
    shard = F.pmod(F.xxhash64("item", "piece"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("shard", shard).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", F.desc("n_tokens"), "item", "piece")

    def packed(batches):
        at, open_ = None, None
        for pdf in batches:
            of, n = pdf["shard"].to_numpy(), pdf["n_tokens"].to_numpy()
            start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (n[1:] != n[:-1])]) if len(pdf) else []
            out = np.empty(len(pdf), np.int64)
            for a, b in zip(start, np.r_[start[1:], len(pdf)] if len(pdf) else [], strict=True):  # runs of one size in a shard
                if of[a] != at:
                    at, open_ = of[a], SumOfSquares(capacity)
                out[a:b] = (int(at) << 40) + np.array(open_.place_run(int(n[a]), int(b - a)), np.int64)
            yield pd.DataFrame({"item": pdf["item"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["n_tokens"], "container": out})

    kind = items.schema["item"].dataType.simpleString()
    return dealt.mapInPandas(packed, f"item {kind}, piece int, start long, n_tokens long, container long").withColumnRenamed("item", item)


def filling(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, least (containers that the tokens need at least), used (share of all room that is filled), cut_pieces."""
    each = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("piece") > 0).alias("cut_pieces"))
    return each.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).cast("long").alias("least"), F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used"), "cut_pieces"
    )


def invariants(packed: DataFrame, sizes: DataFrame, item: str, size: str, capacity: int, slack: float = 0.01) -> DataFrame:
    """One row: items, tokens, and rules broken: over_capacity (containers), misplaced (pieces out of order, or cut without need), lost and
    doubled (items whose pieces' tokens fall short of or exceed their size), wasteful (1 if containers exceed the least by more than `slack` and 1)."""
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > capacity).alias("over_capacity"), F.count("*").alias("containers"))
    pieces = packed.groupBy(item).agg(
        F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"), F.count_if((F.col("start") != F.col("piece") * capacity) | (F.col("n_tokens") > capacity)).alias("wrong")
    )
    wanted = sizes.where(F.col(item).isNotNull() & (F.col(size) >= 0)).groupBy(item).agg(F.sum(size).alias("size"), F.sum(F.greatest(F.ceil(F.col(size) / capacity), F.lit(1))).alias("least_pieces"))
    both = wanted.join(pieces, item, "full")
    placed, size_ = F.coalesce("placed", F.lit(0)), F.coalesce("size", F.lit(0))
    rules = both.agg(
        F.count("*").alias("items"), F.coalesce(F.sum(size_), F.lit(0)).alias("tokens"), F.count_if((F.coalesce("wrong", F.lit(0)) > 0) | (F.col("pieces") != F.col("least_pieces"))).alias("misplaced"),
        F.count_if((placed < size_) | F.col("pieces").isNull()).alias("lost"), F.count_if((placed > size_) | F.col("size").isNull()).alias("doubled"),
    )
    least = F.ceil(F.col("tokens") / capacity)
    return rules.join(F.broadcast(over)).select("items", "tokens", "over_capacity", "misplaced", "lost", "doubled", (F.col("containers") > least * (1 + slack) + 1).cast("int").alias("wasteful"))  # one row each


def sized(df: DataFrame, item: str, text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Staged token sizes of the texts."""
    from kilnwork.llm.tokens import token_sizes

    return stage(token_sizes(df, [item], text, vocabulary), "sizes")
