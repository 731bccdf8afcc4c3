"""Distinctive, frequent and counted terms against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.llm import distinctive as D
from kilnwork.llm import frequency as Q
from kilnwork.llm import heavy as H
from kilnwork.llm.terms import one_each, terms

STOP = ["the", "a"]


def _terms(t):
    return [w for w in re.sub(r"[^a-z \t\r\n]", "", (t or "").lower()).split() if w not in STOP]


TEXTS = ["The Red-hot SOUP\r\nand\tsoup!", "", None, "café Über 123 İstanbul K", "a the", "x" * 50_000, "  b  b\n\n\nc "]


def test_terms_of_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert [list(r[0]) for r in df.select(terms(F.col("text"), STOP)).collect()] == [_terms(t) for t in TEXTS]


def _reviews(seed=1, n=600):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        b = "hot" if i % 3 == 0 else f"b{draw.randrange(25)}"
        text = " ".join([*draw.choices(words[:30], k=draw.randint(0, 12)), *draw.choices(words, k=3), *(["own" + b.translate(str.maketrans("0123456789", "abcdefghij"))] * draw.randint(0, 2))])
        rows.append((i, b if i % 50 else None, text if i % 40 else None, i % 7))
    return rows + rows[:80]


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in _reviews()], "id long, record string, text string, loaded int, term string, n int")


def _counts():
    seen, tf, inside, parts = set(), defaultdict(Counter), defaultdict(Counter), Counter()
    for i, b, t, _ in _reviews():
        if i in seen or b is None:
            continue
        seen.add(i)
        parts[b] += 1
        tf[b].update(_terms(t))
        inside[b].update(set(_terms(t)))
    return tf, inside, parts


def _plain_em(n, background, weight=D.WEIGHT, rounds=20_000):
    p = n / n.sum()
    for _ in range(rounds):
        e = n * weight * p / np.maximum((1 - weight) * background + weight * p, 1e-300)
        p = e / e.sum()
    return p


def test_solution_is_the_fixed_point_of_plain_em():
    draw = np.random.default_rng(2)
    n = draw.integers(1, 12, 40).astype(float)
    background = draw.dirichlet(np.full(40, 0.3)) * 0.9
    got = D.solve(n, background, np.zeros(40, int), 1)
    assert got.sum() == pytest.approx(1.0)
    assert got == pytest.approx(_plain_em(n, background), abs=2e-4)
    assert D.solve(np.array([3.0]), np.array([0.9]), np.zeros(1, int), 1) == pytest.approx([1.0])


@pytest.mark.parametrize(("hot", "limit"), [(10_000, 10_000), (60, 10_000), (10_000, 0), (60, 0)])
def test_distinctive_terms_on_every_path(spark, reviews, hot, limit):
    tf, inside, parts = _counts()
    occurrences, records = Counter(), Counter()
    for c in tf.values():
        occurrences.update(c)
        records.update(c.keys())
    out, number = D.distinctive_terms(reviews, "record", "id", "text", "loaded", STOP, hot=hot, limit=limit)
    got = {(r["record"], r["term"]): r for r in out.collect()}
    assert number == sum(1 for c in tf.values() if c)
    assert set(got) == {(b, t) for b, c in tf.items() for t in c}
    total = sum(occurrences.values())
    for b, c in tf.items():
        names = sorted(c)
        p = D.solve(np.array([c[t] for t in names], float), np.array([occurrences[t] / total for t in names]), np.zeros(len(names), int), 1) if names else []
        for t, x in zip(names, p, strict=True):
            r = got[b, t]
            assert (r["n"], r["in_parts"], r["records"], r["most"], r["parts"]) == (c[t], inside[b][t], records[t], max(c.values()), parts[b])
            assert r["p"] == pytest.approx(x, abs=1e-9)
    ranked = sorted((r for (b, _), r in got.items() if b == "hot"), key=lambda r: -r["p"])
    assert ranked[0]["term"] == "ownhot"


def test_distinctive_filters_and_empty(spark, reviews):
    out, _ = D.distinctive_terms(reviews, "record", "id", "text", "loaded", STOP, min_in_parts=2, min_parts=5)
    assert all(r["in_parts"] >= 2 and r["parts"] >= 5 for r in out.collect())
    none, number = D.distinctive_terms(reviews.where("record is null"), "record", "id", "text", "loaded", STOP)
    assert none.collect() == [] and number == 0


def test_one_each_keeps_one_row(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (None, 1, "d"), (None, 1, "d")], "id int, at int, v string")
    assert sorted(r["v"] for r in one_each(df, ["at"], "id").collect()) == ["a", "c", "d"]


def _heavy(seed, n):
    draw = random.Random(seed)
    return [f"h{int(draw.paretovariate(0.8)) % 5000}" if draw.random() < 0.9 else f"rare{draw.random()}" for _ in range(n)]


@pytest.mark.parametrize("share", [0.002, 0.02])
def test_frequent_values_are_exact(spark, share):
    items, other = _heavy(1, 30_000), _heavy(2, 30_000)
    df = spark.createDataFrame([([a], [b, b] if i % 3 else None) for i, (a, b) in enumerate(zip(items, other, strict=True))] + [([None], [])], "one array<string>, two array<string>").repartition(6)
    two = Counter(b for i, b in enumerate(other) if i % 3 for _ in range(2))
    one = Counter(items)
    want = {("one", k, v) for k, v in one.items() if v >= share * len(items)} | {("two", k, v) for k, v in two.items() if v >= share * sum(two.values())}
    got = H.frequent_values(df, {"one": F.col("one"), "two": F.col("two")}, {"one": share, "two": share}).collect()
    assert {(r["field"], r["item"], r["n"]) for r in got} == want
    assert all(r["bound"] >= r["n"] for r in got)


def test_frequent_values_when_the_sketch_is_far_too_small(spark, monkeypatch):
    """Light cells above the threshold are recounted whole."""
    items = _heavy(3, 20_000)
    df = spark.createDataFrame([([a], ["x"]) for a in items], "one array<string>, two array<string>").repartition(3)
    monkeypatch.setattr(H, "sketch_size", lambda share: (2, 4))
    got = H.frequent_values(df, {"one": F.col("one"), "two": F.col("two")}, {"one": 0.01, "two": 0.5}).collect()
    want = {("one", k, n) for k, n in Counter(items).items() if n >= 200} | {("two", "x", 20_000)}
    assert {(r["field"], r["item"], r["n"]) for r in got} == want
    sketch = H.HeavyLight(2, 1, 4)
    keys = np.arange(1, 500, dtype=np.int64)
    counts = np.arange(1, 500, dtype=np.int64)
    sketch.add(keys, counts)
    assert sketch.votes.sum() + sketch.light.sum() == counts.sum()


def test_sketch_bounds_hold_over_batches():
    sketch, truth = H.HeavyLight(8, 2, 64), Counter()
    draw = np.random.default_rng(1)
    for _ in range(20):
        keys, counts = np.unique(draw.zipf(1.3, 500) % 1000 + 1, return_counts=True)
        truth.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        sketch.add(keys.astype(np.int64), counts)
    for key, n in truth.items():
        k = np.array([key], np.int64)
        b = H.bucket_of(k, 8)[0]
        held = sketch.votes[b][sketch.keys[b] == key].sum()
        assert held <= n <= held + sketch.light[H.cell_of(k, 64)[0]]
    assert sketch.votes.sum() + sketch.light.sum() == sum(truth.values())


def test_memory_follows_from_the_share():
    assert H.sketch_size(0.005) == (512, 8192) and H.sketch_size(1e-4) == (8192, 131072)
    with pytest.raises(ValueError):
        H.sketch_size(1e-8)


def test_shares_below_the_smallest_sketch_are_exact(spark):
    draw = random.Random(6)
    items = [f"v{draw.randrange(60_000)}" for _ in range(60_000)] + [f"h{i % 40}" for i in range(2_000)]
    df = spark.createDataFrame([([a],) for a in items], "one array<string>").repartition(4)
    got = H.frequent_values(df, {"one": F.col("one")}, {"one": 1 / 2_000}).collect()
    assert {r["item"]: r["n"] for r in got} == {k: n for k, n in Counter(items).items() if n >= len(items) / 2_000} and len(got) >= 40


def test_approximate_top_has_bounds_around_the_counts(spark):
    items = _heavy(4, 30_000)
    truth = Counter(items)
    df = spark.createDataFrame([([a],) for a in items] + [([None],), (None,)], "one array<string>").repartition(5)
    got = H.approximate_top(df, F.col("one"), 5, 0.01).collect()
    assert [r["item"] for r in got][:3] == [k for k, _ in sorted(truth.items(), key=lambda x: (-x[1], x[0]))][:3]
    assert len(got) == 5 and all(r["least"] <= truth[r["item"]] <= r["most"] for r in got)


def test_no_values(spark):
    df = spark.createDataFrame([], "one array<string>")
    assert H.frequent_values(df, {"one": F.col("one")}, {"one": 0.5}).collect() == []


@pytest.mark.parametrize("leaf", [Q.LEAF, 40])
def test_term_frequencies(spark, leaf):
    texts = [t for _, _, t, _ in _reviews(5, 900)] + TEXTS
    n, records = Counter(w for t in texts for w in _terms(t)), Counter(w for t in texts for w in set(_terms(t)))
    df = spark.createDataFrame([(_terms(t), "x") for t in texts] + [(None, "x"), ([None, "q"], "x")], "terms array<string>, term string").repartition(5)
    n["q"] += 1
    records["q"] += 1
    got = Q.term_frequencies(df, "terms", partitions=3, leaf=leaf)
    assert {(r["term"], r["n"], r["records"]) for r in got.collect()} == {(t, n[t], records[t]) for t in n}
    marks = {r["term"]: r["mark"] for r in Q.marked(got, len(texts)).collect()}
    assert all(marks[t] == ("rare" if records[t] < 3 else "common" if records[t] > 0.05 * len(texts) else None) for t in marks)


def test_one_term_larger_than_a_leaf(spark):
    df = spark.createDataFrame([(["same"] * 7,)] * 300, "terms array<string>").repartition(40)
    assert [tuple(r) for r in Q.term_frequencies(df, "terms", partitions=2, leaf=5).collect()] == [("same", 2100, 300)]
    assert Q.term_frequencies(df.limit(0), "terms").collect() == []
