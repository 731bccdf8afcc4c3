"""Queries of collaborative filtering and the hybrid blend: train_review is the training set, the pairs of review the test set."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import ratings as C
from kilnwork.operators.pairs import common_counts
from kilnwork.plans.registry import Registry
from kilnwork.sources.staging import stage
from kilnwork.sources.tables import table

_R = """r AS (SELECT user_id u, business_id b, round(avg(stars) * 100)::BIGINT r FROM train_review
        WHERE user_id <> '' AND business_id <> '' AND stars IS NOT NULL AND NOT isnan(stars) GROUP BY 1, 2)"""
_CORR = """count(*) n, sum(x.r) sx, sum(y.r) sy, sum(x.r * x.r) sxx, sum(y.r * y.r) syy, sum(x.r * y.r) sxy"""
_SIM = "a, b, round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE), 6) sim"
_IM = f""", i0 AS (SELECT x.b a, y.b b, {_CORR} FROM r x JOIN r y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 3),
im AS (SELECT {_SIM} FROM i0 WHERE n * sxy - sx * sy > 0)"""
#: Users of 3 common businesses and a Jaccard similarity of 0.01, all of them: counted, not banded.
LEAST_SIMILAR = 0.01
_UM = f""", z AS (SELECT u id, count(*) size FROM r GROUP BY 1),
u0 AS (SELECT x.u a, y.u b, {_CORR} FROM r x JOIN r y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 3),
um AS (SELECT {_SIM} FROM u0 JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE n * sxy - sx * sy > 0 AND n / (p.size + q.size - n) >= {LEAST_SIMILAR})"""
_T = ", t AS (SELECT DISTINCT user_id u, business_id b FROM review WHERE user_id <> '' AND business_id <> '')"


def _scores(name: str, item: str, by: str, n: int) -> str:
    return f""", {name} AS (SELECT u, b, sum(r * sim) / sum(abs(sim)) / 100 score FROM (
    SELECT t.u, t.b, m.sim, r.r, row_number() OVER (PARTITION BY t.u, t.b ORDER BY m.sim DESC, m.near) k
    FROM t JOIN (SELECT a it, b near, sim FROM {name[0]}m UNION ALL SELECT b, a, sim FROM {name[0]}m) m ON m.it = t.{item} JOIN r ON r.{by} = t.{by} AND r.{item} = m.near
    WHERE (t.u, t.b) NOT IN (SELECT (u, b) FROM r)) WHERE k <= {n} GROUP BY 1, 2)"""


_PRED = """ SELECT u "user", b business, round(least(coalesce(r / 100, score), 5.0), 4) stars FROM t LEFT JOIN r USING (u, b) LEFT JOIN {0} USING (u, b) WHERE coalesce(r / 100, score) IS NOT NULL"""
_FR = """, fe AS (SELECT x.u a, y.u b FROM r x JOIN r y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= 3),
fl AS (SELECT a friend, b u FROM fe UNION ALL SELECT b, a FROM fe), us AS (SELECT u friend, count(*) useful FROM r GROUP BY 1),
ft AS (SELECT u, friend, row_number() OVER (PARTITION BY u ORDER BY useful DESC, friend) place FROM fl JOIN us USING (friend)),
f10 AS (SELECT * FROM ft WHERE place <= 10)"""
_AV = """, ua0 AS (SELECT u, avg(r) / 100 a FROM r GROUP BY 1), ba0 AS (SELECT b, avg(r) / 100 a FROM r GROUP BY 1),
su AS (SELECT user_id u, avg(stars) a FROM review WHERE user_id <> '' AND stars IS NOT NULL AND user_id IN (SELECT u FROM r) GROUP BY 1), sb AS (SELECT business_id b, avg(stars) a FROM review WHERE business_id <> '' AND stars IS NOT NULL AND business_id IN (SELECT b FROM r) GROUP BY 1)"""
_MEAN = ", ua AS (SELECT * FROM ua0), ba AS (SELECT * FROM ba0), mu AS (SELECT avg(a) um FROM ua), mb AS (SELECT avg(a) bm FROM ba)"
_FA = ", fa AS (SELECT f10.u, avg(coalesce(a, (SELECT um FROM mu))) friend_avg FROM f10 LEFT JOIN ua ON ua.u = friend GROUP BY 1)"
_C0, _CU, _CI = C.BLEND


def _rows(s, d):
    return stage(C.ratings(table(s, d, "train_review")), "ratings")


def _pairs(s, d):
    return table(s, d, "review").select(F.col("user_id").alias("user"), F.col("business_id").alias("business")).where("user <> '' and business <> ''").distinct()


def _item_model(rows):
    return stage(C.correlation_model(rows, "business", "user"), "item_model")


def _user_model(rows):
    return stage(C.correlation_model(rows, "user", "business", similar=LEAST_SIMILAR), "user_model")


def _friends(rows):
    pairs = common_counts(rows, "business", "user", 3)
    edges = pairs.select(F.col("a").alias("friend"), F.col("b").alias("user")).unionByName(pairs.select(F.col("b").alias("friend"), F.col("a").alias("user")))
    useful = rows.groupBy(F.col("user").alias("friend")).agg(F.count("*").alias("useful"))
    return C.best_friends(edges, useful)


def register(out: Registry) -> None:
    q = out.add

    @q("cf_item_model", "WITH " + _R + _IM + " SELECT * FROM im")
    def _(s, d):
        return C.correlation_model(_rows(s, d), "business", "user")

    @q("cf_user_model", "WITH " + _R + _UM + " SELECT * FROM um")
    def _(s, d):
        return _user_model(_rows(s, d))

    @q("cf_item_predict", "WITH " + _R + _IM + _T + _scores("ip", "b", "u", 3) + _PRED.format("ip"))
    def _(s, d):
        rows = _rows(s, d)
        return C.predictions(_pairs(s, d), rows, _item_model(rows), "business", "user")

    @q("cf_user_predict", "WITH " + _R + _UM + _T + _scores("up", "u", "b", 3) + _PRED.format("up"))
    def _(s, d):
        rows = _rows(s, d)
        return C.predictions(_pairs(s, d), rows, _user_model(rows), "user", "business")

    @q("friend_top10", "WITH " + _R + _FR + ' SELECT u "user", friend, place::INTEGER place FROM f10')
    def _(s, d):
        return _friends(_rows(s, d))

    @q("friend_avg_fallback", "WITH " + _R + _FR + _AV + _MEAN + _FA + ' SELECT u "user", round(friend_avg, 6) friend_avg FROM fa')
    def _(s, d):
        rows = _rows(s, d)
        user_avg = C.averages(rows, "user")
        return C.friend_averages(_friends(rows), user_avg, user_avg.agg(F.avg("avg")).first()[0]).withColumn("friend_avg", F.round("friend_avg", 6))

    @q("avg_override", "WITH " + _R + _AV + ", n AS (SELECT user_id u, avg(stars) a FROM review WHERE user_id <> '' AND stars IS NOT NULL GROUP BY 1) SELECT coalesce(n.u, ua0.u) \"user\", round(coalesce(n.a, ua0.a), 6) \"avg\" FROM ua0 FULL JOIN n ON n.u = ua0.u")
    def _(s, d):
        supplied = table(s, d, "review").where("user_id <> '' and stars is not null").groupBy(F.col("user_id").alias("user")).agg(F.avg("stars").alias("avg"))
        return C.overridden(C.averages(_rows(s, d), "user"), supplied, "user").withColumn("avg", F.round("avg", 6))

    hybrid_sql = (
        "WITH " + _R + _IM + _UM + _T + _scores("ip", "b", "u", 5) + _scores("up", "u", "b", 5) + _FR + _AV + _MEAN + _FA
        + f""", kn AS (SELECT t.u, t.b, ua.a ua, ba.a ba, r.r FROM t LEFT JOIN ua ON ua.u = t.u LEFT JOIN ba ON ba.b = t.b LEFT JOIN r ON r.u = t.u AND r.b = t.b),
        h AS (SELECT kn.*, greatest(least(coalesce(r / 100, 0.8 * up.score + 0.1 * ua + 0.1 * ba, (SELECT um FROM mu)), 5), 0) su,
        greatest(least(coalesce(r / 100, 0.8 * ip.score + 0.1 * ba + 0.1 * ua, (SELECT bm FROM mb)), 5), 0) si FROM kn LEFT JOIN up USING (u, b) LEFT JOIN ip USING (u, b)),
        o AS (SELECT h.u, h.b, ua IS NOT NULL AND ba IS NOT NULL seen, CASE WHEN ua IS NOT NULL AND ba IS NOT NULL THEN least(5.0, {_C0} + {_CU} * su + {_CI} * si)
        WHEN ua IS NULL AND ba IS NULL THEN ((SELECT um FROM mu) + (SELECT bm FROM mb)) / 2 WHEN ua IS NULL THEN 0.2 * (SELECT um FROM mu) + 0.8 * ba
        ELSE 0.8 * coalesce(friend_avg, (SELECT um FROM mu)) + 0.2 * (SELECT bm FROM mb) END stars FROM h LEFT JOIN fa ON fa.u = h.u)
        SELECT u "user", b business, round(stars::DOUBLE, 4) stars FROM o WHERE """
    )

    def blend(s, d):
        rows = _rows(s, d)
        return C.hybrid(_pairs(s, d), rows, _item_model(rows), _user_model(rows), C.averages(rows, "user"), C.averages(rows, "business"), _friends(rows))

    @q("hybrid_predict", hybrid_sql + "seen")
    def _(s, d):
        return blend(s, d).where("seen").drop("seen")

    @q("hybrid_cold_start", hybrid_sql + "NOT seen")
    def _(s, d):
        return blend(s, d).where("not seen").drop("seen")
