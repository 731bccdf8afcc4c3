import pytest
from pyspark.sql import functions as F

from kilnwork.functions import text as X
from kilnwork.operators import itemsets as I
from kilnwork.operators import relational as R
from kilnwork.operators.pairs import common_counts

REVIEWS = [
    ("u1", "b1", 5.0, "2017-01-02 03:04:05", "Good, good food"), ("u1", "b2", None, "2018-01-01 00:00:00", "bad"),
    ("u2", "b1", 4.0, "2017-12-31 23:59:59", "(food) Good"), (None, None, None, "broken", None),
]


@pytest.fixture
def review(spark):
    return spark.createDataFrame(REVIEWS, "user_id string, business_id string, stars double, date string, text string")


@pytest.fixture
def business(spark):
    return spark.createDataFrame([("b1", "Pizza, Bars", "NV"), ("b2", None, "NV"), ("b3", "Bars", "AZ")], "business_id string, categories string, state string")


BASKETS = {"a": "123", "b": "12", "c": "13", "d": "23", "e": "123"}


@pytest.fixture
def baskets(spark):
    return spark.createDataFrame([(k, i) for k, v in BASKETS.items() for i in v], "basket string, item string")


def test_year(review):
    assert R.in_year(review, "date", 2017).count() == 2


def test_category_average(review, business, rows):
    assert rows(R.category_averages(review, business)) == [("Bars", 4.5), ("Pizza", 4.5)]


def test_word_counts_split_at_any_white_space(spark, review, rows):
    stop = spark.createDataFrame([(" bad ",)], "value string")
    assert rows(R.word_counts(review, "text", stop)) == [("(food)", 1), ("food", 1), ("good", 2), ("good,", 1)]


def test_top_breaks_ties_by_id(review):
    got = R.top(R.counted(review.where("user_id is not null"), "user_id"), 5, "n", "user_id").collect()
    assert [tuple(r) for r in got] == [("u1", 2), ("u2", 1)]


def test_semi_join_and_having(review, business, rows):
    assert len(rows(R.of_state(review, business, "NV"))) == 3
    assert rows(R.having_more(review, "business_id", 1)) == [("b1", 2)]


def test_baskets_by_case(spark, rows):
    df = spark.createDataFrame([("u", "b"), ("u", "b"), ("u", ""), (None, "b"), ("v", "b")], "user_id string, business_id string")
    assert rows(R.baskets(df, 1)) == [("u", "b"), ("v", "b")]
    assert rows(R.baskets(df, 2)) == [("b", "u"), ("b", "v")]
    with pytest.raises(ValueError):
        R.baskets(df, 3)


def test_ranked_ids_are_dense_over_partitions(spark):
    df = spark.createDataFrame([(f"k{i % 500:04d}",) for i in range(1500)] + [(None,)], "k string")
    got = {r["k"]: r["idx"] for r in R.ranked_ids(df, "k").collect()}
    assert got == {f"k{i:04d}": i for i in range(500)}


def test_partitioner_puts_rows_where_the_key_says(spark):
    df = spark.createDataFrame([(c + "x" + c,) for c in "abcdefgh"] + [("",)], "k string")
    placed = R.by_key_sum(df, "k", 4).select("k", F.spark_partition_id().alias("p")).collect()
    assert all(r["p"] == ((ord(r["k"][0]) + ord(r["k"][-1])) % 4 if r["k"] else 0) for r in placed)
    assert sum(r["n"] for r in R.partition_sizes(R.by_key_sum(df, "k", 4)).collect()) == 9


def test_frequent_itemsets(baskets, rows):
    got = {tuple(r["items"]): r["n"] for r in I.frequent_itemsets(baskets, 2).collect()}
    assert got == {("1",): 4, ("2",): 4, ("3",): 4, ("1", "2"): 3, ("1", "3"): 3, ("2", "3"): 3, ("1", "2", "3"): 2}
    assert {tuple(r["items"]) for r in I.fp_growth(baskets, 2).collect()} == set(got)


def test_partitioned_candidates_hold_all_frequent_sets(baskets):
    for chunks in (1, 2, 3):
        found = {tuple(r["items"]) for r in I.partitioned_candidates(baskets, 3, chunks).collect()}
        assert {tuple(r["items"]) for r in I.frequent_itemsets(baskets, 3).collect()} <= found


def test_miners_agree(baskets, rows):
    assert rows(I.agreement(I.frequent_itemsets(baskets, 3), I.fp_growth(baskets, 3))) == [(6, 6, 6)]


def test_itemsets_of_every_size(spark, rows):
    """Three baskets of five items and some noise: all 31 subsets are frequent, by every miner."""
    data = [(f"k{i}", x) for i in range(3) for x in "abcde"] + [("m", "a"), ("m", "f"), ("n", "f"), ("o", "b")]
    df = spark.createDataFrame(data, "basket string, item string")
    got = rows(I.frequent_itemsets(df, 3), "items", "size", "n")
    assert len(got) == 31 and max(size for _, size, _ in got) == 5
    assert rows(I.fp_growth(df, 3), "items", "size", "n") == got
    for chunks in (1, 2):
        assert rows(I.partitioned_itemsets(df, 3, chunks), "items", "size", "n") == got


def test_fp_growth_takes_frequent_pairs_not_whole_baskets(spark, rows, monkeypatch):
    """Large baskets of frequent items with few frequent pairs: the model gets those only, and the itemsets are whole."""
    import random

    from pyspark.ml.fpm import FPGrowth

    draw, seen, fit = random.Random(2), [], FPGrowth.fit
    baskets = [{*draw.sample(range(1000), 200)} | ({2000, 2001, 2002} if i < 5 else {2000 + i % 3}) for i in range(30)]
    df = spark.createDataFrame([(f"k{i}", f"i{x}") for i, b in enumerate(baskets) for x in b], "basket string, item string")

    def spied(self, data):
        seen.append(max(len(r["items"]) for r in data.collect()))
        return fit(self, data)

    monkeypatch.setattr(FPGrowth, "fit", spied)
    got = rows(I.fp_growth(df, 5), "items", "size", "n")
    assert got == rows(I.frequent_itemsets(df, 5), "items", "size", "n") and (["i2000", "i2001", "i2002"], 3, 5) in got
    assert seen[0] < 100


def test_common_counts_with_large_groups(spark, rows):
    """Groups of over a thousand items, masked and blockwise, against brute force."""
    import random
    from collections import Counter
    from itertools import combinations

    draw = random.Random(1)
    groups = {f"g{i}": draw.sample(range(900), 700 if i < 6 else 12) for i in range(60)}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x int")
    for least in (1, 3, 5):
        brute = Counter(p for v in groups.values() for p in combinations(sorted(v), 2))
        assert rows(common_counts(df, "g", "x", least)) == sorted((*p, n) for p, n in brute.items() if n >= least)


def test_candidates_of_an_item_in_all_pairs_are_few(spark, rows, monkeypatch):
    """An item that is frequent with 60 others, which aren't among each other, must not be the prefix of 1,770 candidates."""
    data = [(f"k{i}_{j}", x) for i in range(60) for j in range(3) for x in ("!hot", f"x{i:02}")]
    df = spark.createDataFrame(data, "basket string, item string")
    seen, made = [], I._candidates

    def spied(sets, size):
        pairs = sets.groupBy(F.slice("items", 1, size - 1)).agg(F.count("*").alias("n"))
        seen.append(pairs.agg(F.max("n")).first()[0])
        return made(sets, size)

    monkeypatch.setattr(I, "_candidates", spied)
    assert len(rows(I.frequent_itemsets(df, 3), "items", "size", "n")) == 121
    assert seen == [1]


def test_pairs_counted_where_the_rows_are_held(spark, rows, monkeypatch):
    """No pair is shuffled; the same counts as by blocks, with large groups or without."""
    import random

    from kilnwork.operators import pairs

    draw = random.Random(5)
    groups = {f"g{i}": draw.sample(range(300), 250 if i < 3 else 30) for i in range(40)}
    df = spark.createDataFrame([(g, f"x{x}") for g, v in groups.items() for x in v], "g string, x string")
    for least in (1, 2, 5, 9):
        want = rows(common_counts(df, "g", "x", least))
        with monkeypatch.context() as m:
            m.setattr(pairs, "common_counts", None)
            assert rows(pairs.held_common_counts(df, "g", "x", least)) == want
        with monkeypatch.context() as m:
            m.setattr(pairs, "HELD_ROWS", 0)
            assert rows(pairs.held_common_counts(df, "g", "x", least)) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "basket string, item string")
    assert I.frequent_itemsets(empty, 2).collect() == []
    assert I.fp_growth(empty, 2).collect() == []
    assert common_counts(empty, "basket", "item", 2).collect() == []


def test_text_functions(spark):
    df = spark.createDataFrame([("Phönix",), ("",), ("Las Vegas",)], "s string")
    for r in df.select("s", X.bytes_mod(F.col("s"), 1_000_003).alias("h")).collect():
        assert r["h"] == int.from_bytes(r["s"].encode(), "big") % 1_000_003
    zeros = {r["id"]: r["z"] for r in spark.range(40).select("id", X.trailing_zeros(F.col("id")).alias("z")).collect()}
    assert zeros == {i: (i & -i).bit_length() - 1 if i else 0 for i in range(40)}
