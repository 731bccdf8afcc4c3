"""All similar pairs of sets by pigeonhole partitioning, with an exact way for the sets it doesn't suit.

Two sets of sizes s <= l with Jaccard similarity of at least t differ in at most H = floor(2 l (1 - t) / (1 + t)) tokens. For each
class of lengths the token universe is cut into segments by a hash of token and class. The larger set picks segments worth
H + 1 units in all: a segment that must be equal counts one, a segment of two or more tokens that may differ in one token counts
two. If the sets are similar, one picked segment must match. The smaller set offers, for every length class it may be probed
from, its segments and their one-deletions; segment sums of token hashes make both, a deletion being a subtraction. The units
are picked by cost, the frequency of the rarest token of what is matched, so frequent tokens are left out wherever there are
enough others.

Where that costs more than `PREFER` times as much, as in small sets with a very frequent token, or has too few units, the larger
set probes with pairs of tokens instead: similar sets share at least two tokens if ceil(t l) >= 2, and then their first two common
tokens, in order of frequency, are among the first (size - least overlap + 2) of either. Above `PAIRS` tokens single tokens of
such a prefix serve. Smaller sets offer these keys only in sizes that were probed so. Sets of more than `giant` tokens, and
partners that may be similar to them, are counted token by token instead of being gathered. Nothing is left out in any case.

Sets with no partner of fitting size are dropped first; equal sets are one class, joined once. Candidates are verified exactly.
Between two tables only candidates with a set of either are kept.
"""

from __future__ import annotations

from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.operators.pairs import expanded as expanded_groups
from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage

PREFER, PAIRS, GIANT = 8, 64, 20_000
#: Bytes of the table of sets up to which it is broadcast for verification.
BROADCAST_BYTES = 32_000_000
_U = np.uint64


@cache
def length_classes(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper length and number of segments of each length class, up to `longest`."""
    upper = [1]
    while upper[-1] < longest:
        upper.append(max(upper[-1] + 1, int((upper[-1] + 1) * 1.35)))
    upper = np.array(upper)
    return upper, np.where(upper <= 12, 2 * upper, -(-2 * upper // 3))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U((int(salt) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


def _bounds(t: Fraction, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units needed, and least overlap with a smaller or equal similar set, of sets of size l that probe."""
    p, q = t.numerator, t.denominator
    return 2 * l * (q - p) // (q + p) + 1, -(-p * l // q)


class _Batch:
    """Sets as flat arrays: of (set), token (hash), freq, ordered by set and then by frequency and token."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.size = pdf["tokens"].str.len().to_numpy(dtype=np.int64)
        self.of = np.repeat(np.arange(len(pdf)), self.size)
        self.token = np.concatenate([np.asarray(x, np.int64) for x in pdf["tokens"]]).view(_U) if len(pdf) else np.zeros(0, _U)
        self.freq = np.concatenate([np.asarray(x, np.int64) for x in pdf["freqs"]]) if len(pdf) else np.zeros(0, np.int64)
        order = np.lexsort((self.token, self.freq, self.of))
        self.token, self.freq = self.token[order], self.freq[order]
        self.rank = np.arange(len(self.of)) - np.repeat(np.cumsum(self.size) - self.size, self.size)

    def segments(self, chosen: np.ndarray, at: int, cells: int):
        """Tokens of the chosen sets by segment of class `at`: token places, start of each segment, its key sum, its set."""
        place = np.flatnonzero(chosen[self.of])
        cell = _mix(self.token[place], 2 * at + 3) % _U(cells)
        order = np.lexsort((self.freq[place], cell, self.of[place]))
        place, cell = place[order], cell[order]
        if not len(place):
            return place, np.zeros(0, int), np.zeros(0, _U), np.zeros(0, int)
        owner = self.of[place]
        start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])])
        sums = np.add.reduceat(_mix(self.token[place], 1), start) + _mix(cell[start], 2 * at + 4)
        return place, start, sums, owner[start]

    def prefix_keys(self, chosen: np.ndarray, least: np.ndarray, single: bool):
        """Set and key of every pair of tokens (or every token) in the prefix that the least overlap leaves."""
        length = self.size - least + (1 if single else 2)
        inside = np.flatnonzero(chosen[self.of] & (self.rank < length[self.of]))
        if single:
            return self.of[inside], _mix(self.token[inside], 1_000_001)
        owners, keys = [], []
        start = np.flatnonzero(np.r_[True, self.of[inside][1:] != self.of[inside][:-1]]) if len(inside) else []
        for a, b in zip(start, np.r_[start[1:], len(inside)] if len(inside) else [], strict=True):
            i, j = np.triu_indices(b - a, 1)
            tokens = self.token[inside[a:b]]
            keys.append(_mix(tokens[i], 1_000_003) + _mix(tokens[j], 1_000_003))
            owners.append(np.full(len(i), self.of[inside[a]]))
        return (np.concatenate(owners), np.concatenate(keys)) if keys else (np.zeros(0, int), np.zeros(0, _U))


_EQUAL, _LESS = 0x51ED270B, 0x2545F491  # of a key: the offered segment itself, or with one token left out


def _probe(t: Fraction, longest: int):
    def probe(batches):
        upper, cells = length_classes(longest)
        for pdf in batches:
            b = _Batch(pdf)
            need, least = _bounds(t, b.size)
            by_pairs = (least >= 2) & (b.size <= PAIRS)
            of_class = np.searchsorted(upper, b.size)
            sets, keys, cost = [], [], np.full(len(b.size), np.inf)
            picked = []
            for at in np.unique(of_class):
                place, start, sums, owner = b.segments(of_class == at, int(at), int(cells[at]))
                count = np.diff(np.r_[start, len(place)])
                freq = b.freq[place].astype(float)
                first = freq[start]  # the rarest token of the segment comes first
                second = np.where(count > 1, freq[np.minimum(start + 1, max(len(freq) - 1, 0))], np.inf)
                loose = np.where(count > 1, first * (count - 1) + second, np.inf)  # one deletion costs the second, the others the first
                units = pd.DataFrame({"set": np.r_[owner, owner], "cost": np.r_[first, loose], "segment": np.r_[np.arange(len(start)), np.arange(len(start))]})
                units = units[np.isfinite(units["cost"])].sort_values(["set", "cost", "segment"], kind="stable")
                units["nth"] = units.groupby("set").cumcount()
                units = units[units["nth"].to_numpy() < need[units["set"].to_numpy()]]
                total = units.groupby("set")["cost"].agg(["sum", "size"])
                enough = total["size"].to_numpy() == need[total.index.to_numpy()]
                cost[total.index.to_numpy()[enough]] = total["sum"].to_numpy()[enough]
                picked.append((place, start, sums, owner, count, units.groupby("segment").size()))
            length = np.where(by_pairs, b.size - least + 2, b.size - least + 1)
            weight = np.where(by_pairs[b.of], np.maximum(length[b.of] - 1 - b.rank, 0), b.rank < length[b.of])
            other = np.bincount(b.of, b.freq * weight, len(b.size))
            rest = ~np.isfinite(cost) | (by_pairs & (cost > PREFER * np.maximum(other, 1)))
            for place, start, sums, owner, count, times in picked:
                segment, times = times.index.to_numpy(), times.to_numpy()
                keep = ~rest[owner[segment]]
                segment, times = segment[keep], times[keep]
                sets.append(owner[segment])
                keys.append(sums[segment] + _U(_EQUAL))
                segment = segment[times == 2]
                sets.append(owner[segment])
                keys.append(sums[segment] + _U(_LESS))
                chosen = np.zeros(len(start), bool)
                chosen[segment] = True
                of_segment = np.repeat(np.arange(len(start)), count)
                inside = np.flatnonzero(chosen[of_segment])
                sets.append(owner[of_segment[inside]])
                keys.append(sums[of_segment[inside]] - _mix(b.token[place[inside]], 1) + _U(_EQUAL))
            for single in (False, True):
                some = rest & (by_pairs != single)
                s, k = b.prefix_keys(some, least, single)
                sets.append(s)
                keys.append(k)
            s, k = np.concatenate(sets).astype(int), np.concatenate(keys)
            kind = np.where(rest, np.where(by_pairs, 2, 1), 0)
            yield pd.DataFrame({"key": k.view(np.int64), "id": pdf["id"].to_numpy()[s], "size": b.size[s], "sides": pdf["sides"].to_numpy()[s], "kind": kind[s]})

    return probe


def _offer(t: Fraction, longest: int, probed: dict[int, list[int]]):
    def offer(batches):
        upper, cells = length_classes(longest)
        for pdf in batches:
            b = _Batch(pdf)
            top = np.minimum(b.size * t.denominator // t.numerator, longest)
            low, high = np.searchsorted(upper, b.size), np.searchsorted(upper, top)
            sets, keys = [], []
            for at in range(int(low.min()), int(high.max()) + 1) if len(b.size) else ():
                place, start, sums, owner = b.segments((low <= at) & (at <= high), at, int(cells[at]))
                count = np.diff(np.r_[start, len(place)])
                sets.append(owner)
                keys.append(sums + _U(_EQUAL))
                of_segment = np.repeat(np.arange(len(start)), count)
                inside = np.flatnonzero(count[of_segment] > 1)
                sets.append(owner[of_segment[inside]])
                keys.append(sums[of_segment[inside]] - _mix(b.token[place[inside]], 1) + _U(_LESS))
            p, q = t.numerator, t.denominator
            least = -(-2 * p * b.size // (p + q))  # the overlap with a larger or equal similar set
            for single, kind in ((False, 2), (True, 1)):
                asked = np.array(sorted(probed.get(kind, [])), dtype=np.int64)
                some = np.searchsorted(asked, b.size) < np.searchsorted(asked, top, side="right")
                # who probes by pairs shares two tokens at least, whatever the least overlap of this size is
                s, k = b.prefix_keys(some & (b.size > (not single)), np.maximum(least, 1 if single else 2), single)
                sets.append(s)
                keys.append(k)
            s, k = (np.concatenate(sets).astype(int), np.concatenate(keys)) if sets else (np.zeros(0, int), np.zeros(0, _U))
            yield pd.DataFrame({"key": k.view(np.int64), "id": pdf["id"].to_numpy()[s], "size": b.size[s], "sides": pdf["sides"].to_numpy()[s]})

    return offer


def similar_sets(df: DataFrame, record: str, token: str, threshold: float | Fraction = 0.5, min_size: int = 1, giant: int = GIANT) -> tuple[DataFrame, DataFrame]:
    """All pairs of sets with Jaccard similarity >= threshold (0 < threshold <= 1, taken as it is written), as classes of equal sets.

    Returns (pairs, members). pairs: r1 < r2 (the classes' representatives), common, size1, size2 (long). members: record,
    representative, size, copies (records of its class); the representative is the least record of a class. Records of one class are similar pairwise, too, and
    have no row in pairs. Rows with a null or empty record or token don't count, repeated rows count once, sets of fewer than
    min_size tokens don't take part; an empty table has no rows. Other columns are not read.
    """
    pairs, members = _similar(_rows(df, record, token, 3), threshold, min_size, giant)
    return pairs, members.drop("sides")


def similar_between(
    left: DataFrame, right: DataFrame, record: str, token: str, threshold: float | Fraction = 0.5, min_size: int = 1, giant: int = GIANT, right_record: str | None = None, right_token: str | None = None
) -> DataFrame:
    """All pairs of a set of the left table and one of the right with Jaccard similarity >= threshold: left, right, common (long).

    Sets of one table are not compared with one another. right_record, right_token: the columns of the right table, where they are
    called otherwise. A record may occur in both tables, as a set in each. Else as similar_sets; equal sets are expanded.
    """
    rows = _rows(left, record, token, 1).unionByName(_rows(right, right_record or record, right_token or token, 2))
    # the same record in both tables is two sets
    rows = rows.withColumn("record", F.concat(F.col("sides").cast("string"), "record"))
    pairs, members = _similar(rows, threshold, min_size, giant)
    m = members.select("record", "representative", "sides", "size")
    side = lambda n, r: m.where(F.substring("record", 1, 1) == str(n)).select(F.expr("substring(record, 2)").alias("left" if n == 1 else "right"), F.col("representative").alias(r), *(["size"] if n == 1 and r == "r" else []))
    both_ways = pairs.select("r1", "r2", "common").unionByName(pairs.select(F.col("r2").alias("r1"), F.col("r1").alias("r2"), "common"))
    across = both_ways.join(side(1, "r1"), "r1").join(side(2, "r2"), "r2").select("left", "right", "common")
    equal = side(1, "r").join(side(2, "r"), "r").select("left", "right", F.col("size").alias("common"))
    return across.unionByName(equal)


def _rows(df: DataFrame, record: str, token: str, sides: int) -> DataFrame:
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(token).cast("string").alias("token"))
    return rows.where("record <> '' and token <> ''").distinct().withColumn("sides", F.lit(sides))


def _similar(rows: DataFrame, threshold: float | Fraction, min_size: int, giant: int) -> tuple[DataFrame, DataFrame]:
    """Class pairs and members (with sides) of rows (record, token, sides). sides: 1 and 2 for the tables of a join between two, 3 within one."""
    t = threshold if isinstance(threshold, Fraction) else Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    p, q = t.numerator, t.denominator
    rows = stage(rows, "sets")
    sizes = stage(rows.groupBy("record", "sides").agg(F.count("*").alias("size")).where(F.col("size") >= min_size), "sizes")
    # at most as many distinct sizes as the square root of twice the rows
    counts = sorted((r[0], r[1]) for r in sizes.groupBy("size").agg(F.count("*")).collect())
    near = [i for i, (n, c) in enumerate(counts) if c > 1 or (i and counts[i - 1][0] * q >= p * n) or (i + 1 < len(counts) and p * counts[i + 1][0] <= q * n)]
    fits_some = set(near)
    lonely = [n for i, (n, _) in enumerate(counts) if i not in fits_some]
    fitting = sizes.where(~F.col("size").isin(lonely)) if lonely else sizes
    longest = max((counts[i][0] for i in near), default=1)

    rows = rows.drop("sides")
    frequency = rows.join(fitting.select("record"), "record", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    gathered = fitting.where(F.col("size") <= giant)
    parts = rows.join(gathered, "record").join(frequency, "token")
    sets = (
        parts.groupBy("record", "sides").agg(F.sort_array(F.collect_list(F.struct("token", "freq"))).alias("t"))
        .select("record", "sides", F.col("t.token").alias("tokens"), F.col("t.freq").alias("freqs"))
    )
    classes = stage(
        sets.groupBy("tokens").agg(
            F.min("record").alias("id"), F.first("freqs").alias("freqs"), F.bit_or("sides").alias("sides"), F.collect_list(F.struct("record", "sides")).alias("records")
        ), "classes"
    )
    hashed = classes.select("id", "sides", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"), "freqs")
    probes = stage(hashed.mapInPandas(_probe(t, min(longest, giant)), "key long, id string, size long, sides int, kind int"), "probes")
    probed: dict[int, list[int]] = {}
    for kind, size in probes.where("kind > 0").select("kind", "size").distinct().collect():  # sizes again
        probed.setdefault(kind, []).append(size)
    offers = hashed.mapInPandas(_offer(t, min(longest, giant), probed), "key long, id string, size long, sides int")
    fits = (F.col("o.size") * q >= p * F.col("x.size")) & ((F.col("o.size") < F.col("x.size")) | (F.col("o.size") == F.col("x.size")) & (F.col("x.id") < F.col("o.id")))
    across = lambda a, b: F.col(a).bitwiseOR(F.col(b)) == 3
    candidates = (
        probes.alias("x").join(offers.alias("o"), (F.col("x.key") == F.col("o.key")) & fits & across("x.sides", "o.sides"))
        .select(F.least("x.id", "o.id").alias("r1"), F.greatest("x.id", "o.id").alias("r2")).distinct()
    )
    length = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16)
    taken = classes.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long")).first()[0]
    side = lambda i: small(classes.select(F.col("id").alias(f"r{i}"), F.col("tokens").alias(f"t{i}")), taken, BROADCAST_BYTES)
    verified = candidates.join(side(1), "r1").join(side(2), "r2").select(
        "r1", "r2", F.size(F.array_intersect("t1", "t2")).cast("long").alias("common"), F.size("t1").cast("long").alias("size1"), F.size("t2").cast("long").alias("size2")
    )
    similar = F.col("common") * q >= p * (F.col("size1") + F.col("size2") - F.col("common"))
    pairs = verified.where(similar)
    members = classes.select(F.explode("records").alias("m"), F.col("id").alias("representative"), F.size("tokens").cast("long").alias("size"), F.size("records").alias("copies")).select("m.record", "representative", "size", "copies", "m.sides")
    own = lambda d: d.select("record", F.col("record").alias("representative"), "size", F.lit(1).alias("copies"), "sides")
    if longest > giant:
        # a set within the bound stands for its class: pairs of a giant with the others of a class follow from the representative's
        big = classes.select(F.col("id").alias("record"), "sides", F.size("tokens").cast("long").alias("size")).unionByName(fitting.where(F.col("size") > giant))
        big = big.where(F.col("size") * q >= p * giant)
        member = F.struct(F.col("record").alias("r"), F.col("size").alias("s"), F.col("sides").alias("t"))
        # tokens' records in blocks, so that a frequent token's pairs are made by many tasks
        over = expanded_groups(rows.join(big, "record").select(F.col("token").alias("g"), member.alias("p")))
        over = (
            over.where((F.greatest("p.s", "q.s") > giant) & across("p.t", "q.t")).groupBy(F.col("p.r").alias("r1"), F.col("q.r").alias("r2"), F.col("p.s").alias("size1"), F.col("q.s").alias("size2"))
            .agg(F.count("*").alias("common")).select("r1", "r2", "common", "size1", "size2").where(similar)
        )
        pairs = pairs.unionByName(over)
        members = members.unionByName(own(fitting.where(F.col("size") > giant)))
    alone = sizes.where(F.col("size").isin(lonely)) if lonely else sizes.limit(0)
    return pairs, members.unionByName(own(alone))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All similar pairs of records, r1 < r2, from class pairs and members. Members of one class are paired in blocks."""
    m = members.select("record", "representative")
    between = (
        pairs.select("r1", "r2").join(m.select(F.col("record").alias("a"), F.col("representative").alias("r1")), "r1")
        .join(m.select(F.col("record").alias("b"), F.col("representative").alias("r2")), "r2").select("a", "b")
    )
    within = expanded_groups(members.where("copies > 1").select(F.col("representative").alias("g"), F.struct("record").alias("p"))).select(F.col("p.record").alias("a"), F.col("q.record").alias("b"))
    return between.unionByName(within).select(F.least("a", "b").alias("r1"), F.greatest("a", "b").alias("r2"))
