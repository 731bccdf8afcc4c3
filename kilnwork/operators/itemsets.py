"""Frequent itemsets: level-wise mining, the two-stage partitioned algorithm, FP-growth, and their comparison.

Itemsets are arrays of sorted items with a size and a count. rows is always distinct (basket, item).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions.text import key_sum
from kilnwork.operators.pairs import held_common_counts
from kilnwork.operators.relational import ranked_ids
from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage


def frequent_items(rows: DataFrame, support: int) -> DataFrame:
    return rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_pairs(rows: DataFrame, support: int) -> DataFrame:
    """a < b, n."""
    return held_common_counts(rows, "basket", "item", support)


def _candidates(sets: DataFrame, size: int) -> DataFrame:
    """items, left, item: unions of two frequent itemsets (array column items) of `size` that differ in their last item, all of whose
    subsets are frequent; left is the first of the two, item the last item of the other."""
    head = lambda c: F.slice(c, 1, size - 1)
    number = sets.count()
    l, r = sets.select(F.col("items").alias("left"), head("items").alias("h")), sets.select(F.col("items").alias("r"), head("items").alias("h"))
    grown = l.join(small(r, number), "h").where(F.element_at("left", -1) < F.element_at("r", -1)).select(F.concat("left", F.slice("r", size, 1)).alias("items"), "left", F.element_at("r", -1).alias("item"))
    # the two that it was made of are frequent
    for i in range(size - 1):
        sub = F.concat(F.slice("items", 1, i), F.slice("items", i + 2, size - i))
        grown = grown.withColumn("__sub", sub).join(small(sets.select(F.col("items").alias("__sub")), number), "__sub", "left_semi").drop("__sub")
    return grown


def _met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """basket, tail, met: of the given pairs (tail, head, both columns of items) those that a basket holds, met being the heads of a tail.

    A basket's items are looked for within the basket, so no pair is shuffled.
    """
    heads = stage(pairs.groupBy("tail").agg(F.collect_list("head").alias("heads")), "heads")
    whole = rows.groupBy("basket").agg(F.collect_list("item").alias("all")).select("basket", "all", F.explode("all").alias("tail"))
    met = whole.join(small(heads, pairs.count()), "tail").select("basket", "tail", F.array_intersect("all", "heads").alias("met"))
    return met.where(F.size("met") > 0)


def _baskets_of(rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """items, basket: the baskets that hold each of the given sets, looked for in those of its rarest item, by one join per other item."""
    frequency = rows.groupBy("item").agg(F.count("*").alias("n"))
    order = sets.select("items", F.explode("items").alias("item")).join(frequency, "item").groupBy("items").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda s: s["item"]).alias("by"))
    found = order.withColumn("item", F.get("by", F.lit(0))).join(rows, "item").select("items", "by", "basket")
    for i in range(1, size):
        found = found.withColumn("item", F.get("by", F.lit(i))).join(rows, ["item", "basket"], "left_semi").drop("item")
    return found.select("items", "basket")


def _ranks(single: DataFrame) -> DataFrame:
    """item, idx of frequent items (item, n): numbers in order of frequency, the rarest first; marked for broadcast if few."""
    ranks = ranked_ids(single.select(F.struct("n", "item").alias("key")), "key").select(F.col("key")["item"].alias("item"), "idx")
    ranks = stage(ranks, "ranks")
    return small(ranks, ranks.count())


def frequent_itemsets(rows: DataFrame, support: int, least: Column | None = None, up_to: int | None = None) -> DataFrame:
    """items (sorted array), size, n of all itemsets in at least `support` baskets, of every size, or up to the size up_to.

    least: see _levels; without it items are numbered from rare to frequent, so that sets with the same first items are few, also where one
    item is in pairs with most others.
    """
    if least is not None:
        return _levels(rows, support, least, up_to)
    rows = stage(rows, "baskets")
    ranks = _ranks(frequent_items(rows, support))
    sets = stage(_levels(rows.join(ranks, "item").select("basket", F.col("idx").alias("item")), support, None, up_to), "itemsets")
    named = sets.select(F.col("items").alias("numbers"), "n", F.explode("items").alias("idx")).join(ranks, "idx")
    named = named.groupBy("numbers").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("n").alias("n"))
    return named.select("items", F.size("items").alias("size"), "n")


def _levels(rows: DataFrame, support: int, least: Column | None, up_to: int | None) -> DataFrame:
    """items (sorted array), size, n of all itemsets in at least `support` baskets, of every size: levels grow until one is empty.

    up_to: the size beyond which none are asked for.

    From pairs on each level keeps the baskets of its sets, in which a candidate's further item is looked for, so a level takes one join with
    the baskets. least: further bound of n that depends on the column items, for which every subset of a set that reaches it must
    reach it, too.
    """
    rows = stage(rows, "baskets")
    enough = (lambda d: d.where((F.col("n") >= support) & (F.col("n") >= least))) if least is not None else (lambda d: d.where(F.col("n") >= support))
    levels = [stage(enough(frequent_items(rows, support).select(F.array("item").alias("items"), "n")), "items")]
    kept = rows.join(levels[0].select(F.col("items")[0].alias("item")), "item", "left_semi")
    levels.append(stage(enough(frequent_pairs(kept, support).select(F.array("a", "b").alias("items"), "n")), "pairs"))
    held = None
    while (up_to is None or len(levels) < up_to) and levels[-1].limit(1).count():
        if held is None:
            kept = stage(rows.join(levels[-1].select(F.explode("items").alias("item")).distinct(), "item", "left_semi"), "kept")
            n = lambda c: levels[0].select(F.col("items")[0].alias(c), F.struct("n", F.col("items")[0].alias("item")).alias(f"n_{c}"))
            sized = levels[-1].select(F.col("items")[0].alias("a"), F.col("items")[1].alias("b")).join(n("a"), "a").join(n("b"), "b")
            # the rarer item is looked up
            rarer = stage(sized.select(F.least("n_a", "n_b")["item"].alias("tail"), F.greatest("n_a", "n_b")["item"].alias("head")), "rarer")
            held = _met(kept, rarer).select("basket", "tail", F.explode("met").alias("head")).select(F.array_sort(F.array("tail", "head")).alias("items"), "basket")
        found = _candidates(levels[-1], len(levels)).join(held.withColumnRenamed("items", "left"), "left").join(kept, ["item", "basket"], "left_semi").select("items", "basket")
        found = stage(found, "held")
        levels.append(stage(enough(found.groupBy("items").agg(F.count("*").alias("n"))), "itemsets"))
        held = found.join(levels[-1].select("items"), "items", "left_semi")
    return reduce(DataFrame.unionByName, levels).select("items", F.size("items").alias("size"), "n")


def _chunked(rows: DataFrame, chunks: int) -> DataFrame:
    """With the chunk of each basket: (first + last character of its key) mod chunks, so it doesn't depend on Spark's partitions."""
    return rows.withColumn("chunk", F.pmod(key_sum(F.col("basket")), F.lit(chunks)).cast("int"))


def partitioned_candidates(rows: DataFrame, support: int, chunks: int) -> DataFrame:
    """Stage one: itemsets of every size that reach the scaled support in some chunk of baskets: items, size.

    The local threshold is floor(support * baskets of the chunk / all baskets), at least 1. Chunks without candidates add none. All
    chunks are mined by the same jobs: an item counts as another one in every chunk, and each chunk has its own threshold.
    """
    cut = stage(_chunked(rows, chunks), "chunks")
    sizes = {r[0]: r[1] for r in cut.groupBy("chunk").agg(F.count_distinct("basket")).collect()}  # a row a chunk
    if not sizes:
        return rows.select(F.array("item").alias("items")).limit(0).select("items", F.size("items").alias("size"))
    total = sum(sizes.values())
    least = {c: max(support * n // total, 1) for c, n in sizes.items()}
    width = len(str(chunks))
    own = cut.select("basket", F.concat(F.lpad(F.col("chunk").cast("string"), width, "0"), "item").alias("item"))
    bound = F.create_map(*[F.lit(x) for c, n in least.items() for x in (str(c).zfill(width), n)])[F.substring(F.col("items")[0], 1, width)]
    found = frequent_itemsets(own, min(least.values()), bound)
    return found.select(F.transform("items", lambda x: F.substring(x, F.lit(width + 1), F.length(x))).alias("items"), "size").distinct()


def candidate_counts(rows: DataFrame, candidates: DataFrame, chunks: int) -> DataFrame:
    """Stage two within each chunk: chunk, items, n of every candidate (items, size) that its baskets hold."""
    rows, candidates = stage(_chunked(rows, chunks), "chunks"), stage(candidates, "candidates")
    sizes = sorted(r[0] for r in candidates.select("size").distinct().collect())  # one row a size
    if not sizes:
        return rows.select("chunk", F.array("item").alias("items"), F.lit(1).cast("long").alias("n")).limit(0)
    found = [_baskets_of(rows, candidates.where(F.col("size") == size).select("items"), size) for size in sizes]
    return reduce(DataFrame.unionByName, [f.join(rows.select("basket", "chunk").distinct(), "basket").groupBy("chunk", "items").agg(F.count("*").alias("n")) for f in found])


def partitioned_itemsets(rows: DataFrame, support: int, chunks: int) -> DataFrame:
    """items, size, n of all itemsets in at least `support` baskets, by both stages: the chunks' candidates, counted in every chunk, summed.

    A set that falls short of the scaled support in every chunk falls short of the support, so none is lost.
    """
    rows = stage(rows, "baskets")
    counts = candidate_counts(rows, partitioned_candidates(rows, support, chunks), chunks)
    return counts.groupBy("items").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("items", F.size("items").alias("size"), "n")


def fp_growth(rows: DataFrame, support: int) -> DataFrame:
    """The same itemsets by FP-growth (items of each set sorted).

    The model gets the conditional pattern bases in place of the baskets: for every basket and item the frequent pairs of that item with a
    more frequent one of the basket. A set's rarest item makes a frequent pair with each of the others, so sets of pairs of one item are the
    itemsets with their exact counts, and a tree holds pairs that occur in place of all items of the largest baskets.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = stage(rows, "baskets")
    single = stage(frequent_items(rows, support), "items")
    # a pair's lower number is its rarer item
    few = _ranks(single)
    numbered = rows.join(few, "item").select("basket", F.col("idx").alias("item"))
    pairs = stage(frequent_pairs(numbered, support).select(F.col("a").alias("tail"), F.col("b").alias("head")), "pairs")
    pair = lambda h: F.shiftleft(F.col("tail"), 31).bitwiseOR(h)
    bases = stage(_met(numbered, pairs).select(F.transform("met", pair).alias("items")), "bases")
    out = single.select(F.array("item").alias("items"), F.lit(1).alias("size"), "n")
    number = bases.count()
    if not number:
        return out
    # the model's threshold is ceil(minSupport * rows seen): half a row less keeps floats from rounding it up
    model = FPGrowth(itemsCol="items", minSupport=max(support - 0.5, 0) / number, minConfidence=1.0).fit(bases)
    sets = stage(model.freqItemsets.select("freq", "items"), "itemsets")
    numbers = F.concat(F.array(F.shiftright(F.col("items")[0], 31)), F.transform("items", lambda p: p.bitwiseAND(F.lit((1 << 31) - 1))))
    named = sets.select("items", "freq", F.explode(numbers).alias("idx")).join(few, "idx").groupBy(F.col("items").alias("pairs")).agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("freq").alias("n"))
    return out.unionByName(named.select("items", F.size("items").alias("size"), "n"))


def agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: number of itemsets of either miner and of both."""
    count = lambda d, n: d.agg(F.count("*").alias(n))
    one, other = stage(one.select("items"), "one"), stage(other.select("items"), "other")
    both = one.select("items").intersect(other.select("items"))
    return count(one, "first").join(count(other, "second")).join(count(both, "both"))
