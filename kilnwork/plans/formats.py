"""Queries of the readers and writers: tables written in a format and read back, and the reports' texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kilnwork.functions.text import bytes_mod
from kilnwork.operators import itemsets as I
from kilnwork.operators import profiles as T
from kilnwork.operators import ratings as C
from kilnwork.operators import relational as R
from kilnwork.plans.graphs import _PT, _points
from kilnwork.plans.ratings import _IM, _R, _item_model, _rows
from kilnwork.plans.registry import Registry
from kilnwork.plans.relational import _ITEMSETS, SUPPORT
from kilnwork.plans.similarity import _P, _features
from kilnwork.sources import readers, writers
from kilnwork.sources.staging import delete_on_exit, shared_dir
from kilnwork.sources.tables import table

MODULUS = 1_000_003


def _folder(s, label):
    path = f"{shared_dir(s)}/formats/{label}-{uuid.uuid4().hex}"
    delete_on_exit(s, path)
    return path


def _sets(s, d):
    return I.frequent_itemsets(R.baskets(table(s, d, "ub_sample_data"), 1), SUPPORT)


def register(out: Registry) -> None:
    q = out.add

    @q("json_lines_round_trip", "SELECT user_id, business_id, stars, text FROM train_review")
    def _(s, d):
        path = _folder(s, "json")
        writers.json_lines(table(s, d, "train_review").select("user_id", "business_id", "stars", "text"), path)
        return readers.json_lines(s, path, "user_id string, business_id string, stars double, text string")

    @q("csv_round_trip", "SELECT DISTINCT user_id, business_id FROM ub_sample_data WHERE user_id <> '' AND business_id <> ''")
    def _(s, d):
        path = _folder(s, "csv")
        writers.csv(R.baskets(table(s, d, "ub_sample_data"), 1), path)
        return readers.csv_rows(s, path, "basket string, item string").select(F.col("basket").alias("user_id"), F.col("item").alias("business_id"))

    @q("json_object_round_trip", "WITH " + _R + " SELECT u id, round(avg(r) / 100, 6) \"avg\" FROM r GROUP BY 1")
    def _(s, d):
        path = _folder(s, "averages")
        writers.json_object(C.averages(_rows(s, d), "user"), path, "user", "avg")
        return readers.json_map(s, path).withColumn("avg", F.round("avg", 6))

    @q("pair_model_round_trip", "WITH " + _R + _IM + " SELECT a AS b1, b AS b2, sim FROM im")
    def _(s, d):
        path = _folder(s, "model")
        writers.json_lines(_item_model(_rows(s, d)).select(F.col("b").alias("b1"), F.col("a").alias("b2"), "sim"), path)
        return readers.model_pairs(s, path).select(F.col("a").alias("b1"), F.col("b").alias("b2"), "sim")

    @q(
        "profile_model_round_trip",
        "WITH " + _P + " SELECT 'business' part, doc id, string_agg(idx, ' ' ORDER BY idx) features FROM b GROUP BY 2 UNION ALL SELECT 'user', owner, string_agg(idx, ' ' ORDER BY idx) FROM u GROUP BY 2",
    )
    def _(s, d):
        path = _folder(s, "profiles")
        rows, tf, features = _features(s, d)
        profiles = T.document_profiles(tf, features)
        writers.sections(profiles, T.owner_profiles(rows, "user_id", "business_id", profiles), path)
        first, second = readers.sections(s, path)
        both = first.select(F.lit("business").alias("part"), F.col("doc").alias("id"), "features").unionByName(second.select(F.lit("user").alias("part"), F.col("owner").alias("id"), "features"))
        return both.withColumn("features", F.array_join(F.col("features").cast("array<string>"), " "))

    @q("points_round_trip", "WITH " + _PT + " SELECT id, id % 5 chunk, round(list_sum(x), 4) total FROM pt")
    def _(s, d):
        path = _folder(s, "points")
        lines = _points(s, d).select((F.col("id") % 5).alias("chunk"), F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.col("features").cast("array<string>"), ",")).alias("value"))
        lines.write.partitionBy("chunk").text(path)
        back = readers.points(s, path)
        chunk = F.regexp_extract("file", r"chunk=(\d+)", 1).cast("long")
        return back.select("id", chunk.alias("chunk"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))

    @q("cluster_map_round_trip", "WITH " + _PT + " SELECT id, label cluster FROM pt")
    def _(s, d):
        path = _folder(s, "clusters")
        writers.cluster_map(_points(s, d).select("id", "cluster"), path)
        return readers.json_lines(s, path, "id long, cluster int")

    @q("stop_words", "SELECT trim(value) AS value FROM stopwords WHERE trim(value) <> ''")
    def _(s, d):
        path = _folder(s, "words")
        table(s, d, "stopwords").select("value").write.text(path)
        return readers.word_list(s, path)

    @q("review_report", "SELECT '{\"n\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS value FROM review")
    def _(s, d):
        path = _folder(s, "report")
        writers.json_report(table(s, d, "review"), path, n=F.count("*"), users=F.count_distinct("user_id"))
        return s.read.text(path)

    # lines and the report of itemsets: ('a'),('b') and ('a', 'b'),('a', 'c'), a line a size
    lines = _ITEMSETS + ", l AS (SELECT size, string_agg('(''' || array_to_string(k, ''', ''') || ''')', ',' ORDER BY k) line FROM (SELECT size, string_split(items, ' ') k FROM sets) GROUP BY size)"

    @q("itemset_lines", lines + " SELECT size, line FROM l")
    def _(s, d):
        return writers.itemset_lines(_sets(s, d))

    @q(
        "itemset_report",
        lines + ", t AS (SELECT string_agg(line || CASE WHEN size = 1 THEN ' ' || chr(10) || ' ' || chr(10) ELSE chr(10) || ' ' || chr(10) END, '' ORDER BY size) t FROM l) "
        "SELECT 'Candidates: ' || chr(10) || t || 'Frequent Itemsets:' || chr(10) || t AS value FROM t",
    )
    def _(s, d):
        sets = _sets(s, d)
        return writers.itemset_report(sets, sets)

    @q("comparison_lines", _ITEMSETS + " SELECT 'Task2,' || count(*) || ' ' || chr(10) || 'Task3,' || count(*) || chr(10) || 'Intersection,' || count(*) AS value FROM sets")
    def _(s, d):
        sets = _sets(s, d)
        return writers.comparison_lines(I.agreement(sets, sets))

    @q("tuple_lines", "SELECT DISTINCT '''' || user_id || ''', ''' || business_id || '''' AS value FROM ub_sample_data WHERE user_id <> '' AND business_id <> ''")
    def _(s, d):
        return writers.tuple_lines(R.baskets(table(s, d, "ub_sample_data"), 1), "basket", "item")

    @q("bytes_mod", f"SELECT DISTINCT business_id, list_reduce(list_transform(string_split(business_id, ''), lambda c: ascii(c)::BIGINT), lambda a, c: (a * 256 + c) % {MODULUS}, 0::BIGINT) h FROM business WHERE business_id <> ''")
    def _(s, d):
        return table(s, d, "business").where("business_id <> ''").select("business_id", bytes_mod(F.col("business_id"), MODULUS).alias("h")).distinct()
