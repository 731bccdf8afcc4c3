"""K-means, moment summaries, Mahalanobis assignment and the chunked discard / compression / retained clustering.

points: id, features (array<double>). Centroids and summaries have at most a few hundred rows of the points' dimension: they are bound
by the number of clusters, which is a parameter, so they are broadcast.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.graph import connected_components
from kilnwork.sources.staging import delete_on_exit, release, shared_dir, stage

#: Floor of a variance: an axis without spread can't divide by zero.
LEAST_VARIANCE = 1e-9


def distance(x: Column, y: Column) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def scaled_distance(x: Column, y: Column, variance: Column) -> Column:
    """Mahalanobis with a variance for each axis."""
    apart = F.zip_with(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), variance, lambda d, v: d / F.greatest(v, F.lit(LEAST_VARIANCE)))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, v: s + v))


def first_points(points: DataFrame, k: int, seed: int = 2021) -> DataFrame:
    """k initial centroids, a random sample by seed (the points of least hash): cluster (from 0), center."""
    rows = points.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(k).collect()
    return points.sparkSession.createDataFrame([(i, list(map(float, r["features"]))) for i, r in enumerate(rows)], "cluster int, center array<double>")


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """points with cluster and dist of the nearest center, the lower cluster of equally near ones: one broadcast array, no shuffle."""
    held = F.broadcast(centers.groupBy().agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("__centers")))  # k rows
    near = F.array_min(F.transform("__centers", lambda c: F.struct(distance(F.col("features"), c["center"]).alias("dist"), c["cluster"].alias("cluster"))))
    return points.join(held).withColumn("__near", near).select("id", "features", F.col("__near.cluster").alias("cluster"), F.col("__near.dist").alias("dist"))


def moments(assigned: DataFrame) -> DataFrame:
    """cluster, dim, n, total, squares: sums over each axis of each cluster."""
    flat = assigned.select("cluster", F.posexplode("features").alias("dim", "x"))
    return flat.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def sums(assigned: DataFrame) -> DataFrame:
    """cluster, n, total, squares: the sums as arrays, a row a cluster."""
    return _arrays(moments(assigned))


def added(*tables: DataFrame) -> DataFrame:
    """Sums of the same clusters in several tables of sums, added."""
    flat = reduce(DataFrame.unionByName, tables).select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "v"))
    return _arrays(flat.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.total").alias("total"), F.sum("v.squares").alias("squares")))


def _arrays(flat: DataFrame) -> DataFrame:
    each = flat.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total", "squares"))).alias("s"))
    return each.select("cluster", "n", F.col("s.total").alias("total"), F.col("s.squares").alias("squares"))


def spread(table: DataFrame) -> DataFrame:
    """cluster, n, center, variance of a table of sums."""
    center = F.transform("total", lambda t: t / F.col("n"))
    return table.select("cluster", "n", center.alias("center"), F.zip_with("squares", center, lambda s, c: s / F.col("n") - c * c).alias("variance"))


def summaries(assigned: DataFrame) -> DataFrame:
    """cluster, n, center, variance as arrays."""
    return spread(sums(assigned))


def kmeans(points: DataFrame, k: int, rounds: int = 10, least_move: float = 0.01, centers: DataFrame | None = None) -> DataFrame:
    """points with their cluster after Lloyd rounds from a seeded sample of k points; a cluster without points keeps its center."""
    held = {r["cluster"]: r["center"] for r in (centers if centers is not None else first_points(points, k)).collect()}  # k rows
    table = lambda: points.sparkSession.createDataFrame(sorted(held.items()), "cluster int, center array<double>")
    for _ in range(rounds):
        new = {r["cluster"]: r["center"] for r in summaries(assign(points, table())).select("cluster", "center").collect()}  # one job a round
        move = max((math.dist(held[c], new[c]) for c in new), default=0.0)
        held |= new
        if move <= least_move:
            break
    return assign(points, table())


def admit(points: DataFrame, clusters: DataFrame, radius: float) -> DataFrame:
    """points with the cluster of least scaled distance if that is below radius * sqrt(d), else null; radius in spreads."""
    held = F.broadcast(clusters.groupBy().agg(F.sort_array(F.collect_list(F.struct("cluster", "center", "variance"))).alias("__c")))  # few rows
    near = F.array_min(F.transform("__c", lambda c: F.struct(scaled_distance(F.col("features"), c["center"], c["variance"]).alias("dist"), c["cluster"].alias("cluster"))))
    ok = F.col("__near.dist") < F.lit(radius) * F.sqrt(F.size("features").cast("double"))
    return points.join(held, how="left").withColumn("__near", near).select("id", "features", F.when(ok, F.col("__near.cluster")).alias("cluster"), F.col("__near.dist").alias("dist"))


def _by_size(assigned: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Points of clusters of more than `most` points, and those of the others."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    sized = stage(assigned.join(F.broadcast(sizes), "cluster"), "sized")  # a row a cluster
    return sized.where(F.col("n") > most).select("id", "features", "cluster"), sized.where(F.col("n") <= most).select("id", "features")


def merged(table: DataFrame, close: float) -> DataFrame:
    """cluster, component of a table of sums: clusters whose centers are nearer than close * sqrt(d), directly or through others, are one.

    A component has the least number of its clusters; clusters that join none have no row.
    """
    c = stage(spread(table).select("cluster", "center"), "centers")
    l, r = c.select(F.col("cluster").alias("a"), F.col("center").alias("x")), c.select(F.col("cluster").alias("b"), F.col("center").alias("y"))
    near = distance(F.col("x"), F.col("y")) < F.lit(close) * F.sqrt(F.size("x").cast("double"))
    pairs = stage(l.join(F.broadcast(r), (F.col("a") < F.col("b")) & near).select("a", "b"), "near")  # a row a cluster
    if not pairs.limit(1).count():
        return pairs.select(F.col("a").alias("cluster"), F.col("b").alias("component"))
    return connected_components(pairs).select(F.col("id").alias("cluster"), "component")


def chunked_clusters(points: DataFrame, chunk: str, k: int, tight: float = 1.0, loose: float = 2.5, close: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Discard / compression / retained clustering, chunk by chunk in order of the column `chunk`.

    Returns (rounds, final). rounds: round_id, clusters and points in the discard set, in the compression set, and retained
    points, after each chunk; the points add up to those seen. final: id, cluster (-1 for outliers). Of the first chunk 100 k points
    (those of least hash) are clustered by k-means into 5 k clusters; the points of its larger ones (more than 3) form k clusters,
    the n others are clustered into n / 2, of which those of more than one point become compression clusters; single points are
    retained. Other points join the nearest discard cluster within `tight` spreads, else the nearest compression cluster within
    `loose`, else they are retained; more than 5 k retained points are clustered again in one round, groups of more than 2 becoming
    compression clusters. After each chunk compression clusters closer than `close` are merged. A chunk is assigned as a whole
    against the summaries at its start. At the end compression clusters join their nearest discard cluster.

    Of discard and compression clusters only sums are kept (count, sum and sum of squares, a row a cluster); a chunk's points are read
    once, their clusters appended to one table. Only retained points stay as points.
    """
    spark = points.sparkSession
    chunks = [r[0] for r in points.select(chunk).distinct().orderBy(chunk).collect()]  # one value a file
    log = f"{shared_dir(spark)}/staged/assigned-{uuid.uuid4().hex}"
    delete_on_exit(spark, log)

    def keep(assigned: DataFrame, kind: str, table: DataFrame) -> DataFrame:
        """Note the clusters of points for good and add their sums to the table."""
        assigned.select("id", "cluster", F.lit(kind).alias("kind")).write.mode("append").parquet(log)
        return stage(added(table, sums(assigned)), kind)

    none = spark.createDataFrame([], "cluster int, n long, total array<double>, squares array<double>")
    discard, compressed, retained = none, none, spark.createDataFrame([], "id long, features array<double>")
    now = spark.createDataFrame([], "cluster int, component int")  # compression clusters that were merged, and where they are now
    rounds, fresh = [], k
    for at, value in enumerate(chunks):
        new = points.where(F.col(chunk) == value).select(F.col("id").cast("long").alias("id"), "features")
        if not at:
            sample = stage(new.orderBy(F.xxhash64("id"), "id").limit(100 * k), "sample")
            new = new.join(F.broadcast(sample.select("id")), "id", "left_anti")  # 100 k rows
            inner, outer = _by_size(kmeans(sample, 5 * k, 30).select("id", "features", "cluster"), 3)
            discard = keep(stage(kmeans(inner.select("id", "features"), k, 30), "inner"), "discard", none)
            groups = -(-outer.count() // 2)
            if groups:
                apart = kmeans(outer, groups).select("id", "features", (F.col("cluster") + fresh).alias("cluster"))
                fresh += groups
                larger, retained = _by_size(apart, 1)
                compressed = keep(larger, "compressed", none)
        first = stage(admit(new, spread(discard), tight), "admitted")
        second = stage(admit(first.where("cluster is null").select("id", "features"), spread(compressed), loose), "admitted")
        old = discard, compressed, retained
        discard = keep(first.where("cluster is not null"), "discard", discard)
        compressed = keep(second.where("cluster is not null"), "compressed", compressed)
        retained = stage(retained.unionByName(second.where("cluster is null").select("id", "features")), "retained")
        if retained.count() > 5 * k:
            again = kmeans(retained, k, 1).select("id", "features", (F.col("cluster") + fresh).alias("cluster"))
            fresh += k
            larger, retained = _by_size(again, 2)
            compressed = keep(larger, "compressed", compressed)
        release(first, second, *old)
        joins = stage(merged(compressed, close), "joins")
        if joins.limit(1).count():
            where = lambda t, c: t.join(F.broadcast(joins.select(F.col("cluster").alias(c), F.col("component").alias("to"))), c, "left")  # noqa: E731  a row a cluster
            compressed = stage(added(where(compressed, "cluster").select(F.coalesce("to", "cluster").alias("cluster"), "n", "total", "squares")), "compressed")
            moved = where(now, "component").select("cluster", F.coalesce("to", "component").alias("component"))
            now = stage(moved.unionByName(joins.join(now, "cluster", "left_anti").select("cluster", "component")), "now")
        (dc, dn), (cc, cn) = (t.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() for t in (discard, compressed))
        rounds.append((at + 1, dc, dn, cc, cn, retained.count()))
    shape = "round_id int, nof_cluster_discard long, nof_point_discard long, nof_cluster_compression long, nof_point_compression long, nof_point_retained long"
    report = spark.createDataFrame(rounds, shape)
    if not rounds:
        return report, retained.select("id", F.lit(-1).alias("cluster"))
    centers = spread(compressed).select(F.col("cluster").alias("id"), F.col("center").alias("features"))
    target = assign(centers, spread(discard).select("cluster", "center")).select(F.col("id").alias("component"), F.col("cluster").alias("to"))
    ends = now.unionByName(compressed.select("cluster", F.col("cluster").alias("component"))).dropDuplicates(["cluster"]).join(target, "component").select("cluster", "to", F.lit("compressed").alias("kind"))
    final = spark.read.parquet(log).join(F.broadcast(stage(ends, "ends")), ["kind", "cluster"], "left")  # a row a cluster
    final = final.select("id", F.coalesce("to", "cluster").alias("cluster"))
    return report, final.unionByName(retained.select("id", F.lit(-1).alias("cluster")))
