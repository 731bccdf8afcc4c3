"""Co-occurrence, top N and the set similarity join against brute force, with dirty rows."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kilnwork.llm import cooccurrence as O
from kilnwork.llm import setjoin as S
from kilnwork.llm.topn import top_per_group


def _baskets(seed, large=4, n=120):
    draw = random.Random(seed)
    out = {f"u{i}": set(draw.sample(range(400), 300 if i < large else draw.randint(1, 12))) for i in range(n)}
    for i in range(large, 40):
        out[f"u{i}"] |= {1, 2} | ({3} if i % 2 else set())
    return out


def _frame(spark, baskets):
    rows = [(u, f"x{x}", 1) for u, v in baskets.items() for x in v]
    dirty = [(None, "x1", 1), ("", "x1", 1), ("u1", None, 1), ("u1", "", 1)]
    return spark.createDataFrame(rows + rows[:500] + dirty, "user string, item string, n int")


@pytest.mark.parametrize("least", [1, 3, 8])
def test_pair_counts_are_exact(spark, least):
    baskets = _baskets(least)
    brute = Counter(p for v in baskets.values() for p in itertools.combinations(sorted(f"x{x}" for x in v), 2))
    got = {(r["b1"], r["b2"]): r for r in O.pair_surprise(_frame(spark, baskets), "user", "item", least).collect()}
    assert {p: r["n"] for p, r in got.items()} == {p: n for p, n in brute.items() if n >= least}
    size = Counter(f"x{x}" for v in baskets.values() for x in v)
    for (a, b), r in got.items():
        assert (r["n1"], r["n2"], r["baskets"]) == (size[a], size[b], len(baskets))
        assert r["lift"] == pytest.approx(r["n"] * len(baskets) / (size[a] * size[b]))


def test_lift_pruning_loses_nothing(spark):
    df = _frame(spark, _baskets(2))
    keep = lambda rows: {(r["b1"], r["b2"]) for r in rows if r["lift"] >= 2}
    assert keep(O.pair_surprise(df, "user", "item", 3).collect()) == keep(O.pair_surprise(df, "user", "item", 3, min_lift=2).collect())


def test_planted_pair_is_the_most_surprising(spark):
    rows = O.pair_surprise(_frame(spark, _baskets(7, large=0)), "user", "item", 3).collect()
    best = max(rows, key=lambda r: r["surprise"])
    assert {best["b1"], best["b2"]} == {"x1", "x2"} and best["fdr"] < 0.01
    for r in rows:
        assert 0 <= r["fdr"] <= 1 and r["surprise"] >= 0


def test_null_keeps_degrees():
    items, n_items = np.array([1.0, 4.0, 20.0]), np.array([30.0, 10.0, 2.0])
    sizes, n_sizes = np.array([2.0, 5.0, 12.0]), np.array([20.0, 10.0, 0.0 + (110 - 90) / 12])
    p = O.fit_null(items, n_items, sizes, n_sizes)
    assert (p * n_sizes).sum(1) == pytest.approx(items, rel=1e-4)
    assert (p * n_items[:, None]).sum(0) == pytest.approx(sizes, rel=1e-4)


def test_tails_against_exact_convolution():
    draw = np.random.default_rng(1)
    q, count = draw.uniform(0.001, 0.2, (6, 9)), np.array([1, 2, 30, 4, 5, 60, 7, 8, 9.0])
    for n in (1, 5, 20, 40):
        mean, log_tail = O.log10_tail(q, count, np.full(6, n))
        for i in range(6):
            pmf = np.ones(1)
            for p, c in zip(q[i], count, strict=True):
                for _ in range(int(c)):
                    pmf = np.convolve(pmf, [1 - p, p])
            exact = pmf[n:].sum()
            assert mean[i] == pytest.approx((q[i] * count).sum())
            assert log_tail[i] == pytest.approx(math.log10(exact), abs=0.03)


def test_no_baskets(spark):
    empty = spark.createDataFrame([(None, "x")], "user string, item string")
    assert O.pair_surprise(empty, "user", "item").collect() == []


def _top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s + 0.0)
    groups = defaultdict(list)
    for (g, i), s in best.items():
        groups[g].append((-s, i))
    return sorted((g, i, -s, k + 1) for g, v in groups.items() for k, (s, i) in enumerate(sorted(v)[:n]))


@pytest.mark.parametrize("bands", [(), (0.5,), (0.1, 0.3, 0.7)])
@pytest.mark.parametrize("limit", [None, 0])
def test_top_per_group(spark, bands, limit):
    draw = random.Random(4)
    scores = [1.0, 0.5, 0.25, -0.5, 0.0, -0.0, float("nan"), None, float("inf"), float("-inf")]
    rows = [(f"g{int(draw.paretovariate(0.7)) % 60}", f"i{draw.randrange(90)}", draw.choice(scores) if draw.random() < 0.5 else draw.random()) for _ in range(4000)]
    rows += [("hot", f"i{k % 700}", float(k % 13)) for k in range(2000)] + [(None, "i", 1.0), ("g1", None, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, i string, s double, have string, place int")
    got = sorted(tuple(r) for r in top_per_group(df, "g", "i", "s", 4, bands, limit).collect())
    assert got == _top(rows, 4)


def test_top_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, i string, s double")
    assert top_per_group(empty, "g", "i", "s").collect() == []
    same = spark.createDataFrame([("g", f"i{k}", 1.0) for k in range(50)] * 2, "g string, i string, s double")
    assert [r["i"] for r in top_per_group(same, "g", "i", "s", 3).orderBy("place").collect()] == ["i0", "i1", "i10"]


def _sets(seed, hot=True):
    draw = random.Random(seed)
    base = [draw.sample(range(500), draw.randint(1, 30)) for _ in range(60)]
    out = {}
    for i in range(400):
        v = {f"t{x if draw.random() < 0.85 else draw.randrange(500)}" for x in base[draw.randrange(60)]}
        if hot and draw.random() < 0.6:
            v |= {"hot"}
        if hot and draw.random() < 0.3:
            v |= {"warm"}
        out[f"r{i:03d}"] = frozenset(v)
    for i in range(20):
        out[f"copy{i}"] = out["r001"]
        out[f"small{i}"] = frozenset({"hot", f"t{i}", f"t{i + 1}"})
    return out


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("giant", [S.GIANT, 12])
def test_set_join_finds_all_pairs(spark, threshold, giant):
    sets = _sets(int(threshold * 10))
    rows = [(k, t, 0) for k, v in sets.items() for t in v]
    df = spark.createDataFrame(rows + rows[:300] + [(None, "t", 0), ("", "t", 0), ("r1", None, 0), ("r1", "", 0)], "record string, token string, size int")
    brute = {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2) if len(x & y) >= threshold * len(x | y) - 1e-12}
    pairs, members = S.similar_sets(df, "record", "token", threshold, 1, giant)
    got = [tuple(r) for r in S.expanded(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute
    assert {r["record"] for r in members.collect()} == {k for k, v in sets.items() if v}


def test_set_join_minimum_size_and_empty(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("c", "2")], "record string, token string")
    assert S.expanded(*S.similar_sets(df, "record", "token", 0.5, 2)).collect() == []
    assert S.expanded(*S.similar_sets(df.limit(0), "record", "token", 0.5)).collect() == []
    with pytest.raises(ValueError):
        S.similar_sets(df, "record", "token", 0)


@pytest.mark.parametrize("giant", [S.GIANT, 12])
@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_join_between_two_tables(spark, threshold, giant):
    draw, all_ = random.Random(8), _sets(7)
    one = {k: v for k, v in all_.items() if draw.random() < 0.6 and v}
    other = {k: v for k, v in all_.items() if draw.random() < 0.6 and v}  # records of both, too
    table = lambda d, *names: spark.createDataFrame([(k, t, 1) for k, v in d.items() for t in v], f"{names[0]} string, {names[1]} string, left int")
    got = [tuple(r) for r in S.similar_between(table(one, "r", "t"), table(other, "id", "tag"), "r", "t", threshold, 2, giant, "id", "tag").collect()]
    brute = {(a, b, len(x & y)) for a, x in one.items() for b, y in other.items() if len(x) > 1 < len(y) and len(x & y) >= threshold * len(x | y) - 1e-12}
    assert len(got) == len(set(got)) and set(got) == brute and any(a == b for a, b, _ in brute)
    assert S.similar_between(table(one, "r", "t"), table(other, "r", "t").limit(0), "r", "t").collect() == []


def test_small_sets_within_larger_ones_at_low_thresholds(spark):
    small, large = ["1", "2"], ["1", "2", "3", "4", "5", "6"]
    rows = [(r, t) for r, v in (("a", small), ("b", large)) for t in v] + [(f"x{i}", t) for i in range(60) for t in ("1", "2", f"y{i}", f"z{i}", f"w{i}", f"v{i}", f"u{i}")]
    pairs, members = S.similar_sets(spark.createDataFrame(rows, "r string, t string"), "r", "t", 0.3)
    assert ("a", "b") in {(r["r1"], r["r2"]) for r in S.expanded(pairs, members).collect()}


def test_thresholds_are_taken_as_written(spark):
    """1601 of 2000 common tokens are 0.8005 exactly, and 321 / 401 more."""
    rows = [("a", str(i)) for i in range(2000)] + [("b", str(i)) for i in range(1601)] + [("c", str(i)) for i in range(1600)]
    df = spark.createDataFrame(rows, "r string, t string")
    got = {tuple(r)[:2] for r in S.expanded(*S.similar_sets(df, "r", "t", 0.8005)).collect()}
    assert got == {("a", "b"), ("b", "c")}
