"""Items that appear together: exact pair counts against a bipartite configuration null.

Counts. Baskets are sets. Items too rare to reach `min_count`, or (with `min_lift`) too frequent to reach the lift even if all
their rarer partner's baskets held them, are left out first; neither can take part in a pair that is asked for. The
`min_count - 1` largest baskets are never expanded: a pair of `min_count` baskets lies in at least one other basket, so pairs
come from the others, and each item carries one bit for each large basket it is in; the bits common to both items complete the
count. Other baskets are cut into blocks of about `BLOCK` items, expanded block by block and block pair by block pair, so no
task holds a whole basket, and counted with map-side combining.

Null. Each item x and basket u have weights a and b with P(x in u) = ab / (1 + ab), fitted so that every item keeps its
frequency and every basket its size. The number of common baskets of x and y is then Poisson-binomial over baskets with
probabilities P(x in u) P(y in u). Equal frequencies and sizes have equal weights, so the fit runs over classes: degrees up to
`EXACT_DEGREE` are classes of their own, beyond it they are binned at steps of 2 %. The tail is taken by the lattice
saddlepoint formula (relative error about 1 %); surprise is -log10 of it. The false-discovery rate is controlled over all
pairs of items frequent enough, untested pairs counting as not surprising; tails are binned upwards at steps of 10^0.01.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage

BLOCK = 256
EXACT_DEGREE = 256
SCHEMA = "b1 string, b2 string, n long, n1 long, n2 long, baskets long, lift double, expected double, surprise double, fdr double"


def _classes(degrees: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean degree and member count of each class, from (class, members, sum of degrees)."""
    a = np.array(sorted(degrees), dtype=float).reshape(-1, 3)
    return a[:, 2] / a[:, 1], a[:, 1]


def _class_of(degree: F.Column) -> F.Column:
    step = F.floor(F.log(degree / F.lit(float(EXACT_DEGREE))) / math.log(1.02)).cast("int")
    return F.when(degree <= EXACT_DEGREE, degree.cast("int")).otherwise(step + EXACT_DEGREE + 1)


def fit_null(item_degree: np.ndarray, item_count: np.ndarray, basket_size: np.ndarray, basket_count: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """P(item of class i in basket of class j) of the bipartite configuration model with these mean degrees, to a relative 1e-9.

    Some 45 rounds are usual; more than `rounds` are an error.
    """
    total = float((item_degree * item_count).sum())
    a, b = item_degree / math.sqrt(total), basket_size / math.sqrt(total)
    for _ in range(rounds):
        ab = 1 + a[:, None] * b[None, :]
        new_a = item_degree / ((b * basket_count)[None, :] / ab).sum(1)
        ab = 1 + new_a[:, None] * b[None, :]
        new_b = basket_size / ((new_a * item_count)[:, None] / ab).sum(0)
        moved = max(np.abs(new_a / a - 1).max(), np.abs(new_b / b - 1).max())
        a, b = new_a, new_b
        if moved < 1e-9:
            break
    else:
        raise ValueError(f"the null hasn't converged in {rounds} rounds (last change {moved:g})")
    ab = a[:, None] * b[None, :]
    return ab / (1 + ab)


def _log_normal_tail(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the normal density at w, and the ratio of the tail beyond w to it."""
    log_density = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
    near = np.clip(w, -30, 30)
    ratio = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in near]) / np.exp(-0.5 * near * near - 0.5 * math.log(2 * math.pi))
    far = 1 / np.maximum(w, 1) * (1 - 1 / np.maximum(w, 1) ** 2 + 3 / np.maximum(w, 1) ** 4 - 15 / np.maximum(w, 1) ** 6)
    return log_density, np.where(w > 20, far, ratio)


def log10_tail(q: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation and log10 P(S >= n) of sums S of `count` Bernoulli variables of probability q, one row of q for each n."""
    mean = (q * count).sum(1)
    variance = (q * (1 - q) * count).sum(1)
    n = n.astype(float)
    top = float(count.sum())
    aim = np.minimum(n, top - 0.5)
    s = np.log(np.maximum(aim, 1e-300) / np.maximum(mean, 1e-300))
    low, high = np.full_like(s, -60.0), np.full_like(s, 800.0)
    for _ in range(60):  # Newton, kept between bounds
        e = np.exp(np.clip(s, -700, 700))[:, None]
        t = q * e / (1 - q + q * e)
        k1 = (t * count).sum(1)
        k2 = np.maximum((t * (1 - t) * count).sum(1), 1e-300)
        low, high = np.where(k1 < aim, s, low), np.where(k1 > aim, s, high)
        step = s - (k1 - aim) / k2
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        done = np.abs(k1 - aim) < 1e-9 * np.maximum(aim, 1)
        s = np.where(done, s, new)
        if done.all():
            break
    e = np.exp(np.clip(s, -700, 700))[:, None]
    k0 = (np.log1p(q * (e - 1)) * count).sum(1)
    t = q * e / (1 - q + q * e)
    k2 = np.maximum((t * (1 - t) * count).sum(1), 1e-300)
    w = np.sign(s) * np.sqrt(np.maximum(2 * (s * aim - k0), 0))
    u = -np.expm1(-s) * np.sqrt(k2)
    plain = np.abs(w) < 1e-3  # n is about the mean: the formula is singular there
    log_density, ratio = _log_normal_tail(np.where(plain, (n - 0.5 - mean) / np.sqrt(np.maximum(variance, 1e-300)), w))
    with np.errstate(divide="ignore", invalid="ignore"):
        bracket = np.where(plain, ratio, ratio + np.where(plain, 0, 1 / u - 1 / w))
    out = (log_density + np.log(np.maximum(bracket, 1e-300))) / math.log(10)
    return mean, np.where(n <= 0, 0.0, np.minimum(out, 0.0))


def pair_surprise(df: DataFrame, basket: str, item: str, min_count: int = 8, min_lift: float | None = None) -> DataFrame:
    """Pairs of items in at least `min_count` common baskets, with counts, lift, expectation, surprise and false-discovery rate.

    Columns: b1 < b2, n (baskets with both), n1, n2 (with either), baskets (all), lift = n baskets / (n1 n2), expected (under
    the null), surprise (-log10 of the tail), fdr. Rows with a null or empty basket or item don't count; a repeated row counts
    once; other columns are not read. No baskets: no rows. With min_lift, only pairs of at least that lift are sure to be there.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    spark = df.sparkSession
    rows = df.select(F.col(basket).cast("string").alias("u"), F.col(item).cast("string").alias("x")).where("u <> '' and x <> ''").distinct()
    rows = stage(rows, "baskets")
    sizes = stage(rows.groupBy("u").agg(F.count("*").alias("d")).withColumn("k", _class_of(F.col("d"))), "sizes")
    freqs = stage(rows.groupBy("x").agg(F.count("*").alias("d")).withColumn("k", _class_of(F.col("d"))), "freqs")
    in_class = lambda t: [tuple(r) for r in t.groupBy("k").agg(F.count("*"), F.sum("d")).collect()]  # noqa: E731  at most some 1,500 classes
    item_classes, basket_classes = in_class(freqs), in_class(sizes)
    baskets = sum(c for _, c, _ in basket_classes)
    if not baskets:
        return spark.createDataFrame([], SCHEMA)
    frequent = freqs.where(F.col("d") >= min_count)
    frequent_items = frequent.count()
    wanted = frequent.where(F.col("d") * min_lift <= baskets) if min_lift else frequent

    masked = min(min_count - 1, 40)
    largest = [r[0] for r in sizes.orderBy(F.desc("d"), "u").limit(masked).collect()]
    numbered = stage(wanted.withColumn("id", F.monotonically_increasing_id()), "items")
    bit = F.coalesce(*[F.when(F.col("u") == u, F.lit(1 << i)) for i, u in enumerate(largest)], F.lit(0)).cast("long") if largest else F.lit(0).cast("long")
    bits = rows.where(F.col("u").isin(largest)).groupBy("x").agg(F.bit_or(bit).alias("bits"))
    coded = stage(numbered.join(bits, "x", "left").select("x", "d", "k", "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")), "coded")
    n_coded = coded.count()
    kept = rows.where(~F.col("u").isin(largest)) if largest else rows
    item_key = F.struct("id", "bits")
    kept = kept.join(small(coded.select("x", "id", "bits"), n_coded), "x").join(sizes.where(F.col("d") > BLOCK).select("u", F.ceil(F.col("d") / BLOCK).alias("blocks")), "u", "left")
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = kept.groupBy("u", block.alias("block"), F.col("blocks").isNotNull().alias("cut")).agg(F.sort_array(F.collect_list(item_key)).alias("items"))
    within = blocks.select(F.posexplode("items").alias("i", "p"), "items").select("p", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("q"))
    cut = blocks.where("cut")
    across = (
        cut.alias("l").join(cut.alias("r"), (F.col("l.u") == F.col("r.u")) & (F.col("l.block") < F.col("r.block")))
        .select(F.explode("l.items").alias("p"), F.col("r.items").alias("right")).select("p", F.explode("right").alias("q"))
        .select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    )
    pairs = (
        within.unionByName(across).select(F.col("p.id").alias("i1"), F.col("q.id").alias("i2"), (F.col("p.bits").bitwiseAND(F.col("q.bits"))).alias("common"))
        .groupBy("i1", "i2", "common").agg(F.count("*").alias("others"))
        .select("i1", "i2", (F.col("others") + F.bit_count("common")).alias("n")).where(F.col("n") >= min_count)
    )
    side = lambda i: small(coded.select(F.col("id").alias(f"i{i}"), F.col("x").alias(f"x{i}"), F.col("d").alias(f"d{i}"), F.col("k").alias(f"k{i}")), n_coded)
    named = pairs.join(side(1), "i1").join(side(2), "i2")
    turned = F.col("x1") > F.col("x2")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    named = named.select(pick("x1", "x2").alias("b1"), pick("x2", "x1").alias("b2"), "n", pick("d1", "d2").alias("n1"), pick("d2", "d1").alias("n2"), pick("k1", "k2").alias("k1"), pick("k2", "k1").alias("k2"))

    item_degree, item_count = _classes(item_classes)
    basket_size, basket_count = _classes(basket_classes)
    row_of = {k: i for i, (k, _, _) in enumerate(sorted(item_classes))}
    model = spark.sparkContext.broadcast((fit_null(item_degree, item_count, basket_size, basket_count), basket_count, row_of))

    def tails(batches):
        p, count, rows_by_class = model.value
        for b in batches:
            triples = b[["k1", "k2", "n"]].copy()
            triples["lo"], triples["hi"] = triples[["k1", "k2"]].min(axis=1), triples[["k1", "k2"]].max(axis=1)
            codes, found = pd.factorize(pd.MultiIndex.from_frame(triples[["lo", "hi", "n"]]))
            mean, log_tail = np.empty(len(found)), np.empty(len(found))
            for at in range(0, len(found), 256):
                some = found[at : at + 256]
                q = p[[rows_by_class[k] for k in some.get_level_values(0)]] * p[[rows_by_class[k] for k in some.get_level_values(1)]]
                mean[at : at + 256], log_tail[at : at + 256] = log10_tail(q, count, some.get_level_values(2).to_numpy())
            b["expected"], b["surprise"] = mean[codes], -log_tail[codes] + 0.0
            yield b.drop(columns=["k1", "k2"])

    scored = stage(named.mapInPandas(tails, "b1 string, b2 string, n long, n1 long, n2 long, expected double, surprise double"), "surprise")
    possible = frequent_items * (frequent_items - 1) / 2
    step = F.floor(F.least("surprise", F.lit(400.0)) * 100).cast("int")  # downwards in surprise, so upwards in the tail
    bins = sorted((tuple(r) for r in scored.groupBy(step.alias("bin")).agg(F.count("*")).collect()), reverse=True)  # at most 40,001
    rates, seen = [], 0
    for at, members in bins:
        seen += members
        rates.append([at, min(1.0, possible * 10 ** (-at / 100) / seen)])
    for i in range(len(rates) - 2, -1, -1):
        rates[i][1] = min(rates[i][1], rates[i + 1][1])
    fdr = spark.createDataFrame([(int(a), float(b)) for a, b in rates], "bin int, fdr double")
    lift = F.col("n") * F.lit(float(baskets)) / (F.col("n1") * F.col("n2"))
    return (
        scored.withColumn("bin", step).join(F.broadcast(fdr), "bin")
        .select("b1", "b2", "n", "n1", "n2", F.lit(baskets).cast("long").alias("baskets"), lift.alias("lift"), "expected", "surprise", "fdr")
    )
