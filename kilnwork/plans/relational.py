"""Queries of the relational and itemset operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.operators import itemsets as I
from kilnwork.operators import relational as R
from kilnwork.plans.registry import Registry
from kilnwork.sources.staging import stage
from kilnwork.sources.tables import table

SUPPORT = 8
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '')"
_STRIP = "regexp_replace({}, '^[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{3000}}]+|[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{3000}}]+$', '', 'g')"
_UB = "ub AS (SELECT DISTINCT user_id basket, business_id item FROM ub_sample_data WHERE user_id <> '' AND business_id <> '')"
_PAIRS = "SELECT x.item a, y.item b, count(*) n FROM {0} x JOIN {0} y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2"


def _mined(source: str, bound: str, by: str = "") -> str:
    """Recursive part that mines itemsets of every size: mined(items, last, basket) over `source`(basket, item), by groups."""
    keys = f"{by}, items" if by else "items"
    extra, same = (f", {by}", f" AND k.{by} = l.{by}") if by else ("", "")
    return f"""mined AS (SELECT [item] items, item last, basket{extra} FROM {source} QUALIFY count(*) OVER (PARTITION BY {by + ", " if by else ""}item) >= {bound}
    UNION ALL SELECT * FROM (SELECT list_append(l.items, k.item) items, k.item AS last, l.basket{f", l.{by}" if by else ""} FROM mined l JOIN {source} k ON k.basket = l.basket AND k.item > l.last{same}) QUALIFY count(*) OVER (PARTITION BY {keys}) >= {bound})"""


_SETS = "sets AS (SELECT array_to_string(items, ' ') items, len(items)::INTEGER size, count(*) n FROM mined GROUP BY mined.items)"
_ITEMSETS = "WITH RECURSIVE " + _UB + ", " + _mined("ub", str(SUPPORT)) + ", " + _SETS
_CHUNKS = 4


def _joined(df):
    return df.withColumn("items", F.array_join("items", " "))


def register(out: Registry) -> None:
    def q(name, sql=None):
        return out.add(name, sql)

    @q("project_ratings", "SELECT user_id, business_id, stars FROM train_review")
    def _(s, d):
        return table(s, d, "train_review").select("user_id", "business_id", "stars")

    @q("count_all", "SELECT count(*) n FROM review")
    def _(s, d):
        return table(s, d, "review").agg(F.count("*").alias("n"))

    @q("count_in_year", "SELECT count(*) n FROM review WHERE year(try_strptime(date, '%Y-%m-%d %H:%M:%S')) = 2017")
    def _(s, d):
        return R.in_year(table(s, d, "review"), "date", 2017).agg(F.count("*").alias("n"))

    @q("count_distinct_users", "SELECT count(DISTINCT user_id) n FROM review")
    def _(s, d):
        return table(s, d, "review").agg(F.count_distinct("user_id").alias("n"))

    @q("distinct_pairs", "SELECT DISTINCT user_id, business_id FROM train_review")
    def _(s, d):
        return table(s, d, "train_review").select("user_id", "business_id").distinct()

    @q("top_users", "SELECT user_id, count(*) n FROM review WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    def _(s, d):
        return R.top(R.counted(table(s, d, "review").where("user_id is not null"), "user_id"), 10, "n", "user_id")

    @q(
        "word_count_topn",
        f"""WITH w AS (SELECT unnest({_WORDS}) word FROM review) SELECT word, count(*) n FROM w
        WHERE word NOT IN (SELECT trim(value) FROM stopwords) AND word NOT IN ('(', '[', ',', '.', '!', '?', ':', ';', ']', ')') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    )
    def _(s, d):
        return R.top(R.word_counts(table(s, d, "review"), "text", table(s, d, "stopwords")), 10, "n", "word")

    @q("having_count_gt", "SELECT business_id, count(*) n FROM review WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(*) > 20")
    def _(s, d):
        return R.having_more(table(s, d, "review"), "business_id", 20)

    @q(
        "category_avg_topn",
        f"""WITH c AS (SELECT business_id, unnest(string_split(categories, ',')) v FROM business WHERE categories IS NOT NULL),
        e AS (SELECT business_id, {_STRIP.format("v")} category FROM c)
        SELECT category, round(sum(stars) / count(*), 1) avg_stars FROM e JOIN review USING (business_id) WHERE category <> '' AND stars IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    )
    def _(s, d):
        return R.top(R.category_averages(table(s, d, "review"), table(s, d, "business")), 10, "avg_stars", "category")

    @q("semi_join_baskets", "SELECT user_id, business_id FROM review WHERE business_id IN (SELECT business_id FROM business WHERE state = 'NV')")
    def _(s, d):
        return R.of_state(table(s, d, "review"), table(s, d, "business"), "NV")

    @q(
        "avg_by_user_business",
        """SELECT 'user' kind, user_id id, round(avg(stars), 6) avg_stars, count(stars) n FROM train_review WHERE user_id <> '' GROUP BY 2
        UNION ALL SELECT 'business', business_id, round(avg(stars), 6), count(stars) FROM train_review WHERE business_id <> '' GROUP BY 2""",
    )
    def _(s, d):
        rows = table(s, d, "train_review")
        each = lambda k: rows.where(f"{k}_id <> ''").groupBy(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("id")).agg(F.round(F.avg("stars"), 6).alias("avg_stars"), F.count("stars").alias("n"))
        return each("user").unionByName(each("business"))

    @q("token_index", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 idx FROM (SELECT DISTINCT user_id FROM train_review WHERE user_id IS NOT NULL)")
    def _(s, d):
        return R.ranked_ids(table(s, d, "train_review"), "user_id")

    @q("partition_counts", "SELECT ((ascii(business_id) + ascii(right(business_id, 1))) % 8)::INTEGER part, count(*) n FROM review WHERE business_id IS NOT NULL GROUP BY 1")
    def _(s, d):
        return R.partition_sizes(R.by_key_sum(table(s, d, "review").where("business_id is not null").select("business_id"), "business_id", 8))

    @q("partition_probe", "SELECT count(DISTINCT (ascii(business_id) + ascii(right(business_id, 1))) % 8) partitions, count(*) n FROM review WHERE business_id IS NOT NULL")
    def _(s, d):
        sizes = R.partition_sizes(R.by_key_sum(table(s, d, "review").where("business_id is not null").select("business_id"), "business_id", 8))
        return sizes.agg(F.count("*").alias("partitions"), F.sum("n").alias("n"))

    @q("json_field", "SELECT event_id, (props->>'$.k')::INTEGER k FROM events")
    def _(s, d):
        return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))

    for case, (basket, item) in ((1, ("user_id", "business_id")), (2, ("business_id", "user_id"))):

        @q(
            f"baskets_case{case}",
            f"SELECT {basket} basket, string_agg(DISTINCT {item}, ' ' ORDER BY {item}) items, count(DISTINCT {item}) size FROM ub_sample_data WHERE user_id <> '' AND business_id <> '' GROUP BY 1",
        )
        def _(s, d, case=case):
            rows = R.baskets(table(s, d, "ub_sample_data"), case)
            return rows.groupBy("basket").agg(F.array_join(F.sort_array(F.collect_list("item")), " ").alias("items"), F.count("*").alias("size"))

    @q("baskets_gt_k", "WITH " + _UB + " SELECT basket, count(*) size FROM ub GROUP BY 1 HAVING count(*) > 10")
    def _(s, d):
        return R.counted(R.larger_baskets(R.baskets(table(s, d, "ub_sample_data"), 1), 10), "basket", name="size")

    @q("frequent_itemsets_1", _ITEMSETS + " SELECT items AS item, n FROM sets WHERE size = 1")
    def _(s, d):
        return I.frequent_items(R.baskets(table(s, d, "ub_sample_data"), 1), SUPPORT)

    @q("frequent_itemsets_2", "WITH " + _UB + f" SELECT x.item a, y.item b, count(*) n FROM ub x JOIN ub y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= {SUPPORT}")
    def _(s, d):
        return I.frequent_pairs(R.baskets(table(s, d, "ub_sample_data"), 1), SUPPORT)

    for size in (3, 4):

        @q(f"frequent_itemsets_{size}", _ITEMSETS + f" SELECT * FROM sets WHERE size = {size}")
        def _(s, d, size=size):
            return _joined(I.frequent_itemsets(R.baskets(table(s, d, "ub_sample_data"), 1), SUPPORT, up_to=size).where(F.col("size") == size))

    larger = "larger AS (SELECT * FROM ub WHERE basket IN (SELECT basket FROM ub GROUP BY 1 HAVING count(*) > 10))"

    @q("frequent_itemsets_prefiltered", "WITH RECURSIVE " + _UB + ", " + larger + ", " + _mined("larger", str(SUPPORT)) + ", " + _SETS + " SELECT * FROM sets")
    def _(s, d):
        rows = R.larger_baskets(R.baskets(table(s, d, "ub_sample_data"), 1), 10)
        return _joined(I.frequent_itemsets(rows, SUPPORT))

    chunked = f"""WITH RECURSIVE {_UB}, c0 AS (SELECT *, (ascii(basket) + ascii(right(basket, 1))) % {_CHUNKS} chunk FROM ub),
        z AS (SELECT chunk, greatest(floor({_CHUNKS * SUPPORT} * count(DISTINCT basket) / (SELECT count(DISTINCT basket) FROM ub)), 1) least FROM c0 GROUP BY 1),
        c AS (SELECT c0.*, least FROM c0 JOIN z USING (chunk)), """
    local = _mined("c", "any_value(least) OVER (PARTITION BY chunk)", "chunk").replace("basket, chunk FROM c", "basket, chunk, least FROM c").replace("l.basket, l.chunk FROM", "l.basket, l.chunk, l.least FROM")
    candidates = ", cand AS (SELECT DISTINCT items cand_items FROM mined)"

    @q("son_candidates", chunked + local + candidates + " SELECT array_to_string(cand_items, ' ') items, len(cand_items)::INTEGER size FROM cand")
    def _(s, d):
        return _joined(I.partitioned_candidates(R.baskets(table(s, d, "ub_sample_data"), 1), _CHUNKS * SUPPORT, _CHUNKS))

    @q(
        "son_candidate_counts",
        chunked + local + candidates + """, held AS (SELECT cand_items, unnest(cand_items) item FROM cand)
        SELECT chunk, array_to_string(cand_items, ' ') items, count(*) n FROM (SELECT chunk, cand_items, basket FROM held JOIN c0 USING (item) GROUP BY ALL HAVING count(*) = len(cand_items)) GROUP BY chunk, cand_items""",
    )
    def _(s, d):
        rows = R.baskets(table(s, d, "ub_sample_data"), 1)
        return _joined(I.candidate_counts(rows, I.partitioned_candidates(rows, _CHUNKS * SUPPORT, _CHUNKS), _CHUNKS))

    @q("son_itemsets", "WITH RECURSIVE " + _UB + ", " + _mined("ub", str(_CHUNKS * SUPPORT)) + ", " + _SETS + " SELECT * FROM sets")
    def _(s, d):
        return _joined(I.partitioned_itemsets(R.baskets(table(s, d, "ub_sample_data"), 1), _CHUNKS * SUPPORT, _CHUNKS))

    @q("fpgrowth_itemsets", _ITEMSETS + " SELECT * FROM sets")
    def _(s, d):
        return _joined(I.fp_growth(R.baskets(table(s, d, "ub_sample_data"), 1), SUPPORT))

    @q("miner_intersection", _ITEMSETS + ' SELECT count(*) AS "first", count(*) AS "second", count(*) AS "both" FROM sets')
    def _(s, d):
        rows = stage(R.baskets(table(s, d, "ub_sample_data"), 1), "baskets")
        return I.agreement(I.frequent_itemsets(rows, SUPPORT), I.fp_growth(rows, SUPPORT))
