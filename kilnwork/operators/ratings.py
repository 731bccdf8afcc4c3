"""Collaborative filtering: correlation models over items or users, predictions from them, and the hybrid blend.

Ratings are whole hundredths of a star, one for each (user, business): the mean of repeated ones, rounded. Sums over them are exact, so
a correlation's sign doesn't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.operators.pairs import expanded, largest_groups
from kilnwork.sources.staging import stage

#: The fitted blend of the user-based and the item-based score (fixed values).
BLEND = (1.52930944, 0.2414251, 0.3575569)


def ratings(df: DataFrame) -> DataFrame:
    """user, business, r."""
    rows = df.where("user_id <> '' and business_id <> '' and stars is not null and not isnan(stars)")
    return rows.groupBy(F.col("user_id").alias("user"), F.col("business_id").alias("business")).agg(F.round(F.avg("stars") * 100).cast("long").alias("r"))


def _correlation() -> tuple[Column, Column]:
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    over = n * sxy - sx * sy
    return over, over / F.sqrt((n * sxx - sx * sx).cast("double") * (n * syy - sy * sy).cast("double"))


def _positive(sums: DataFrame, least: int) -> DataFrame:
    over, r = _correlation()
    return sums.where((F.col("n") >= least) & (over > 0)).select("a", "b", F.round(r, 6).alias("sim"))


def correlation_model(rows: DataFrame, item: str, by: str, least: int = 3, similar: float = 0.0) -> DataFrame:
    """a < b, sim: items with a positive Pearson correlation over at least `least` common raters, means over these alone.

    With `similar`, only pairs whose sets of raters have at least that Jaccard similarity; all of them are found.

    The least - 1 largest raters never make pairs: each item carries its rating by them, which completes the sums of the pairs
    that the others make.
    """
    large = largest_groups(rows, by, least - 1)
    kept_cols = [F.max(F.when(F.col(by) == u, F.col("r"))).alias(f"m{i}") for i, u in enumerate(large)]
    enough = rows.groupBy(item).agg(F.count("*").alias("d"), *kept_cols).where(F.col("d") >= least).drop("d")
    others = rows.where(~F.col(by).isin(large)) if large else rows
    marks = [f"m{i}" for i in range(len(large))]
    kept = others.join(enough, item).select(F.col(by).alias("g"), F.struct(F.col(item).alias("i"), "r", *marks).alias("p"))
    x, y = F.col("p.r"), F.col("q.r")
    sums = expanded(kept).groupBy(F.col("p.i").alias("a"), F.col("q.i").alias("b"), *[F.col(f"{s}.{m}").alias(f"{s}{m}") for s in "pq" for m in marks]).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )
    for m in marks:
        both = F.col(f"p{m}").isNotNull() & F.col(f"q{m}").isNotNull()
        px, py = F.when(both, F.col(f"p{m}")).otherwise(0), F.when(both, F.col(f"q{m}")).otherwise(0)
        sums = sums.withColumns({"n": F.col("n") + both.cast("long"), "sx": F.col("sx") + px, "sy": F.col("sy") + py, "sxx": F.col("sxx") + px * px, "syy": F.col("syy") + py * py, "sxy": F.col("sxy") + px * py})
    if similar:
        sizes = rows.groupBy(item).agg(F.count("*").alias("d"))
        sums = sums.where(F.col("n") >= least).join(sizes.select(F.col(item).alias("a"), F.col("d").alias("da")), "a").join(sizes.select(F.col(item).alias("b"), F.col("d").alias("db")), "b")
        sums = sums.where(F.col("n") / (F.col("da") + F.col("db") - F.col("n")) >= similar)
    return _positive(sums, least)


def correlation_of(pairs: DataFrame, rows: DataFrame, item: str, by: str, least: int = 3) -> DataFrame:
    """The same model over given pairs (id1, id2) only, as from banding."""
    l = rows.select(F.col(item).alias("id1"), by, F.col("r").alias("x"))
    r = rows.select(F.col(item).alias("id2"), by, F.col("r").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = pairs.join(l, "id1").join(r, ["id2", by]).groupBy(F.col("id1").alias("a"), F.col("id2").alias("b")).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )
    return _positive(sums, least)


def neighbour_scores(pairs: DataFrame, rows: DataFrame, model: DataFrame, item: str, by: str, n: int) -> DataFrame:
    """user, business, score (stars, uncapped) from the n most similar items that the pair's rater rated; ties by the item.

    A pair meets either its item's neighbours or what its rater rated, whichever is fewer: neither a popular item nor a busy rater
    is expanded for the other's pairs.
    """
    both = model.select(F.col("a").alias(item), F.col("b").alias("near"), "sim").unionByName(model.select(F.col("b").alias(item), F.col("a").alias("near"), "sim"))
    rated = rows.select(by, F.col(item).alias("near"), "r")
    order = Window.partitionBy("user", "business").orderBy(F.desc("sim"), "near")
    degree = lambda d, c, name: d.groupBy(c).agg(F.count("*").alias(name))
    sized = stage(pairs.select("user", "business").join(degree(both, item, "neighbours"), item).join(degree(rated, by, "rated"), by).select("user", "business", (F.col("neighbours") <= F.col("rated")).alias("few")), "pairs")
    by_item = sized.where("few").join(both, item).join(rated, [by, "near"])
    by_rater = sized.where("not few").join(rated, by).join(both, [item, "near"])
    met = by_item.select("user", "business", "near", "sim", "r").unionByName(by_rater.select("user", "business", "near", "sim", "r"))
    best = met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return best.groupBy("user", "business").agg((F.sum(F.col("r") * F.col("sim")) / F.sum(F.abs("sim")) / 100).alias("score"))


def predictions(pairs: DataFrame, rows: DataFrame, model: DataFrame, item: str, by: str, n: int = 3) -> DataFrame:
    """user, business, stars (at most 5): the known rating, else the neighbours' score; pairs with neither are dropped."""
    known = pairs.select("user", "business").distinct().join(rows, ["user", "business"], "left")
    scores = neighbour_scores(known.where("r is null"), rows, model, item, by, n)
    stars = F.coalesce(F.col("r") / 100, F.col("score"))
    return known.join(scores, ["user", "business"], "left").where(stars.isNotNull()).select("user", "business", F.round(F.least(stars, F.lit(5.0)), 4).alias("stars"))


def averages(rows: DataFrame, key: str) -> DataFrame:
    """key, avg of its ratings in stars."""
    return rows.groupBy(key).agg((F.avg("r") / 100).alias("avg"))


def overridden(computed: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """Averages of either table; where both have one, the supplied."""
    s = supplied.select(key, F.col("avg").alias("given"))
    return computed.join(s, key, "full").select(key, F.coalesce("given", "avg").alias("avg"))


def best_friends(edges: DataFrame, useful: DataFrame, n: int = 10) -> DataFrame:
    """user, friend, place: of the users listing `user` (edges friend -> user), the n most useful; ties by the friend."""
    order = Window.partitionBy("user").orderBy(F.desc("useful"), "friend")
    return edges.join(useful, "friend").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("user", "friend", "place")


def friend_averages(refs: DataFrame, user_avg: DataFrame, overall: float) -> DataFrame:
    """user, friend_avg: mean of the friends' averages, `overall` standing in for unknown ones."""
    known = refs.join(user_avg.select(F.col("user").alias("friend"), "avg"), "friend", "left")
    return known.groupBy("user").agg(F.avg(F.coalesce("avg", F.lit(overall))).alias("friend_avg"))


def _hybrid_score(pairs: DataFrame, rows: DataFrame, model: DataFrame, item: str, by: str, name: str, own: Column, other: Column, default: float) -> DataFrame:
    scores = neighbour_scores(pairs.where("r is null"), rows, model, item, by, 5)
    joined = pairs.join(scores, ["user", "business"], "left")
    value = F.coalesce(F.col("r") / 100, 0.8 * F.col("score") + 0.1 * own + 0.1 * other, F.lit(default))
    return joined.withColumn(name, F.least(F.greatest(value, F.lit(0.0)), F.lit(5.0))).drop("score")


def hybrid(pairs: DataFrame, rows: DataFrame, item_model: DataFrame, user_model: DataFrame, user_avg: DataFrame, business_avg: DataFrame, refs: DataFrame) -> DataFrame:
    """user, business, seen (both known), stars of distinct pairs.

    Seen pairs: the blend of a user-based and an item-based score, each the known rating, else 0.8 neighbours (5) + 0.1 either
    average, else the mean of its side's averages; at most 5. Unseen: 0.2 users' mean + 0.8 business average for a new user, 0.8 friends'
    average + 0.2 businesses' mean for a new business, half of both means where both are new.
    """
    mean = lambda d: d.agg(F.avg("avg")).first()[0] or 0.0
    u_mean, b_mean = mean(user_avg), mean(business_avg)
    known = (
        pairs.select("user", "business").distinct()
        .join(user_avg.select("user", F.col("avg").alias("u")), "user", "left").join(business_avg.select("business", F.col("avg").alias("b")), "business", "left")
    )
    seen = known.where("u is not null and b is not null").join(rows, ["user", "business"], "left")
    scored = _hybrid_score(seen, rows, user_model, "user", "business", "by_user", F.col("u"), F.col("b"), u_mean)
    scored = _hybrid_score(scored, rows, item_model, "business", "user", "by_item", F.col("b"), F.col("u"), b_mean)
    c0, cu, ci = BLEND
    blended = scored.select("user", "business", F.lit(True).alias("seen"), F.least(F.lit(5.0), c0 + cu * F.col("by_user") + ci * F.col("by_item")).alias("stars"))
    new = known.where("u is null or b is null").join(friend_averages(refs, user_avg, u_mean), "user", "left")
    cold = (
        F.when(F.col("u").isNull() & F.col("b").isNull(), F.lit((u_mean + b_mean) / 2))
        .when(F.col("u").isNull(), 0.2 * u_mean + 0.8 * F.col("b")).otherwise(0.8 * F.coalesce("friend_avg", F.lit(u_mean)) + 0.2 * b_mean)
    )
    return blended.unionByName(new.select("user", "business", F.lit(False).alias("seen"), cold.alias("stars"))).withColumn("stars", F.round("stars", 4))
