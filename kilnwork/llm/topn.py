"""Top N items within every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage

#: Shares of the rows above the lower edge of each band but the last. They steer the work only, never the result.
BANDS = (0.3, 0.6)


def top_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5, bands: tuple[float, ...] = BANDS, limit: int | None = None) -> DataFrame:
    """The n items of greatest score of every group: columns group, item, score (double) and place (int, from 1).

    Order is score descending as an exact double (-0.0 as 0.0), then item ascending by code point. Rows with a null group or
    item or a null or NaN score don't count; infinite scores do. Of a repeated (group, item) the greatest score counts. Groups
    with fewer than n items give them all; an empty table gives no rows. Other columns are not read.

    Bands of score are worked off from the top, each read with its range pushed down to the scan. A band's rows of groups
    already filled are dropped by an anti-join; what the open groups have from higher bands joins the band, repeats are merged
    by (group, item), so a hot group is spread over all tasks, and ranks are taken after each task cut every group to its own
    best n (Spark's window group limit). A group is filled once it has n items, since lower bands have only lower scores.
    limit: number of filled groups that are broadcast at most (kilnwork.sources.bounds by default).
    """
    value = F.col(score).cast("double") + F.lit(0.0)

    def scored(of: DataFrame) -> DataFrame:
        return of.select(F.col(group).alias("g"), F.col(item).alias("i"), value.alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")

    rows = scored(df)
    edges = rows.approxQuantile("s", [1 - b for b in bands], 0.02) if bands else []
    edges = sorted(set(edges), reverse=True)
    order = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    done, filled, waiting = [], None, None
    for k in range(len(edges) + 1):
        low, high = (edges[k] if k < len(edges) else None), (edges[k - 1] if k else None)
        # on the column as it is stored, so that the scan sees the range; -0.0 equals 0.0 there, too
        within = df
        if low is not None:
            within = within.where(F.col(score) >= low)
        if high is not None:
            within = within.where(F.col(score) < high)
        band = scored(within)
        if filled is not None:
            number = filled.count()
            if number:
                band = band.join(small(filled, number, **({} if limit is None else {"limit": limit})), "g", "left_anti")
        if waiting is not None:
            band = band.unionByName(waiting)
        best = band.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
        if low is None:
            done.append(best)
            break
        best = stage(best.withColumn("have", F.count("*").over(Window.partitionBy("g"))), "band")
        full = best.where(F.col("have") >= n)
        done.append(full.select("g", "i", "s", "place"))
        more = full.where(F.col("place") == 1).select("g")
        filled = more if filled is None else filled.unionByName(more)
        waiting = best.where(F.col("have") < n).select("g", "i", "s")
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("place").cast("int").alias("place"))
