"""How distinctive a term is of its record: a parsimonious language model against the whole collection.

A record's occurrences of a term come from the record's own model with weight w or from the background (the term's share of all
occurrences) with 1 - w. Expectation-maximisation moves the mass that the background explains out of the record's model; at its
fixed point p(t) = max(0, n(t) / S - (1 - w) / w * background(t)), where S, the expected number of occurrences of the record's
own, makes the p of a record sum to 1. Each sweep takes S from the terms still in the model and then drops those whose p is 0;
it starts from all terms, the set only shrinks, and when it stays the same the probabilities are converged, exactly.

Layout. One shuffle brings a record's texts together; records of more than `hot` texts are salted, whatever share of all they are.
Terms are counted while the texts stream through a task in record order, and a record is staged as one row with arrays. Whole
records are swept in numpy. If the background table has at most `limit` terms it is broadcast to the tasks that sweep; if it is
larger, rows (record, term) are joined with it by term and brought back together by record, two shuffles for all sweeps. Only
salted records are swept as rows, with one sum per record and sweep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.terms import one_each, terms
from kilnwork.sources.bounds import BROADCAST_ROWS, small
from kilnwork.sources.staging import release, stage

#: Weight of the record's own model.
WEIGHT = 0.1
#: Texts of a record from which it is salted.
HOT = 20_000
OUT = "record string, term string, n long, in_parts long, records long, most long, parts long, p double"


def _documents(batches):
    """Batches of (record, salt, hot, terms), records together, to rows of arrays by record and salt."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        start = _starts(t)
        last = int(start[-1])
        held = t.slice(last)
        if last:
            yield _arrays(t.slice(0, last), start[:-1])
    if held is not None and held.num_rows:
        yield _arrays(held, np.zeros(1, np.int64))


def _starts(t: pa.Table) -> np.ndarray:
    record, salt = t["record"].combine_chunks(), t["salt"].to_numpy()
    code = record.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (salt[1:] != salt[:-1])])


def _arrays(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
    lists = t["terms"].combine_chunks()
    words = lists.flatten().dictionary_encode()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    document = np.repeat(np.arange(len(start)), np.diff(np.r_[start, t.num_rows]))
    part = np.repeat(np.arange(t.num_rows), length)
    size = max(len(words.dictionary), 1)
    key, times = np.unique(part * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)  # by text and term
    key, at = np.unique(document[key // size] * size + key % size, return_inverse=True)  # by record and term
    offsets = pa.array(np.searchsorted(key, np.arange(len(start) + 1) * size), pa.int32())
    as_list = lambda v: pa.ListArray.from_arrays(offsets, v)
    head = t.select(["record", "salt", "hot"]).take(pa.array(start)).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [
            *[head[c].combine_chunks() for c in ("record", "salt", "hot")], pa.array(np.diff(np.r_[start, t.num_rows]), pa.int64()),
            as_list(words.dictionary.take(pa.array(key % size)).cast(pa.string())), as_list(pa.array(np.bincount(at, times, len(key)).astype(np.int64))), as_list(pa.array(np.bincount(at, minlength=len(key)))),
        ],
        names=["record", "salt", "hot", "parts", "term", "n", "in_parts"],
    )


def solve(n: np.ndarray, background: np.ndarray, record: np.ndarray, records: int, weight: float = WEIGHT) -> np.ndarray:
    """Converged probabilities of all (record, term) rows; record: the row's record, from 0."""
    c = (1 - weight) / weight
    kept = np.ones(len(n), bool)
    while True:
        mass = np.bincount(record[kept], n[kept], records) / (1 + c * np.bincount(record[kept], background[kept], records))
        p = n / mass[record] - c * background
        fewer = kept & (p > 0)
        if (fewer == kept).all():
            return np.where(kept, p, 0.0)
        kept = fewer


def _swept(weight: float, total: int, vocabulary, min_in_parts: int, min_parts: int):
    def swept(batches):
        known, count, records = vocabulary.value
        for b in batches:
            lists = b.column("term")
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten()
            if not len(words):
                continue
            coded = words.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=known).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
            n, in_parts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n", "in_parts"))
            record = np.repeat(np.arange(b.num_rows), length)
            p = solve(n.astype(float), count[place] / total, record, b.num_rows, weight)
            most = np.zeros(b.num_rows, np.int64)
            np.maximum.at(most, record, n)
            parts = b.column("parts").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero((in_parts >= min_in_parts) & (parts[record] >= min_parts))
            of = record[keep]
            yield pa.RecordBatch.from_arrays(
                [b.column("record").take(pa.array(of)), words.take(pa.array(keep)), *map(pa.array, (n[keep], in_parts[keep], records[place[keep]], most[of], parts[of], p[keep]))],
                names=["record", "term", "n", "in_parts", "records", "most", "parts", "p"],
            )

    return swept


def _swept_sorted(weight: float, total: int, min_in_parts: int, min_parts: int):
    """The same sweeps over rows (id, record, term, n, in_parts, records, occurrences, parts) that stand together by id.

    The first row of an id has the record's name and counts of 0, the others have no name.
    """

    def rows_of(t: pa.Table, start: np.ndarray) -> pa.RecordBatch | None:
        n, in_parts, records, occurrences, parts = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("n", "in_parts", "records", "occurrences", "parts"))
        size = np.diff(np.r_[start, t.num_rows])
        record = np.repeat(np.arange(len(start)), size)
        p = solve(n.astype(float), occurrences / total, record, len(start), weight)
        most = np.maximum.reduceat(n, start)[record]
        keep = np.flatnonzero((in_parts >= max(min_in_parts, 1)) & (parts >= min_parts))
        if not len(keep):
            return None
        of = t["record"].combine_chunks().take(pa.array(start[record[keep]]))
        return pa.RecordBatch.from_arrays(
            [of, t["term"].combine_chunks().take(pa.array(keep)), *map(pa.array, (n[keep], in_parts[keep], records[keep], most[keep], parts[keep], p[keep]))],
            names=["record", "term", "n", "in_parts", "records", "most", "parts", "p"],
        )

    def swept(batches):
        held: list[pa.RecordBatch] = []  # the last record seen, whose rows may go on
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            if held and ids[0] == ids[-1] == held[-1].column("id")[0].as_py():
                held.append(b)  # all of one record: no need to look at it again
                continue
            t = pa.Table.from_batches([*held, b])
            ids = t["id"].to_numpy()
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            last = int(start[-1])
            held = t.slice(last).to_batches()
            if last and (out := rows_of(t.slice(0, last), start[:-1])) is not None:
                yield out
        if held and (out := rows_of(pa.Table.from_batches(held), np.zeros(1, np.int64))) is not None:
            yield out

    return swept


def _swept_rows(flat: DataFrame, weight: float, total: int) -> DataFrame:
    """The same sweeps over rows (record, term, n, occurrences): adds p. One table of sums per sweep, until no term is dropped."""
    c = (1 - weight) / weight
    flat = flat.withColumn("background", F.col("occurrences") / F.lit(float(total)))
    old, mass, before = None, None, -1
    while True:  # the kept terms only shrink
        rows = flat if mass is None else flat.join(mass, "record").where(F.col("n") / F.col("mass") > c * F.col("background"))
        new = stage(rows.groupBy("record").agg((F.sum("n") / (1 + c * F.sum("background"))).alias("mass"), F.count("*").alias("kept")), "mass")
        now = new.agg(F.sum("kept")).first()[0]
        if old is not None:
            release(old)
        old, mass = new, new.select("record", "mass")
        if now == before:
            break
        before = now
    return flat.join(mass, "record").withColumn("p", F.greatest(F.col("n") / F.col("mass") - c * F.col("background"), F.lit(0.0))).drop("mass", "background")


def distinctive_terms(
    df: DataFrame, record: str, part: str, text: str, order: str, stop: list[str], min_in_parts: int = 1, min_parts: int = 1,
    weight: float = WEIGHT, hot: int = HOT, limit: int = BROADCAST_ROWS,
) -> tuple[DataFrame, int]:
    """Every term of every record with its converged probability p, and the number of records with any term.

    Columns: record, term, n (occurrences in the record), in_parts (of its texts with the term), records (with the term), most
    (greatest n of the record), parts (texts of the record, with or without terms), p. A record is made of the texts of all rows
    with its key; rows of one `part` id are copies, the first by `order` counts. Rows with a null record don't count, null and
    empty texts have no terms; an empty table has no rows. min_in_parts and min_parts leave out rows of the result only: counts
    and probabilities always stand on all terms. Other columns are not read. limit: number of terms, and of salted records, that are
    broadcast at most.
    """
    spark = df.sparkSession
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(part).alias("part"), F.col(text).alias("text"), F.col(order).alias("order")).where("record is not null")
    large = rows.groupBy("record").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("record", F.ceil(F.col("rows") / hot).cast("int").alias("salts"))
    large = stage(large, "large")
    number = large.count()
    salted = rows.join(small(large, number, limit), "record", "left") if number else rows.withColumn("salts", F.lit(None).cast("int"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("part"), F.coalesce("salts", F.lit(1))).cast("int")).withColumn("hot", F.col("salts").isNotNull()).drop("salts")
    each = one_each(salted, ["order"], "part", ["record", "salt"]).select("record", "salt", "hot", terms(F.col("text"), stop).alias("terms"))
    documents = stage(
        each.mapInArrow(_documents, "record string, salt int, hot boolean, parts long, term array<string>, n array<long>, in_parts array<long>")
        .withColumn("id", F.monotonically_increasing_id()), "documents"
    )
    cold = documents.where("not hot")
    flat = lambda d: d.select("record", "parts", F.explode(F.arrays_zip("term", "n", "in_parts")).alias("t")).select("record", "parts", "t.*")
    merged = None
    if number:
        parts = documents.where("hot").groupBy("record").agg(F.sum("parts").alias("parts"))
        merged = flat(documents.where("hot")).groupBy("record", "term").agg(F.sum("n").alias("n"), F.sum("in_parts").alias("in_parts"))
        merged = stage(merged.join(small(parts, number, limit), "record"), "merged")
    once = flat(cold).select("term", "n")
    if merged is not None:
        once = once.unionByName(merged.select("term", "n"))
    vocabulary = stage(once.groupBy("term").agg(F.count("*").alias("records"), F.sum("n").alias("occurrences")), "vocabulary")
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    with_terms = cold.where(F.size("term") > 0).count() + (merged.select("record").distinct().count() if merged is not None else 0)
    if not size:
        return spark.createDataFrame([], OUT), with_terms

    if size <= limit:
        t = vocabulary.toArrow().combine_chunks()
        model = spark.sparkContext.broadcast((t["term"].combine_chunks().cast(pa.string()), t["occurrences"].to_numpy(), t["records"].to_numpy()))
        out = cold.mapInArrow(_swept(weight, total, model, min_in_parts, min_parts), OUT)
    else:
        # a number stands for the record's name, which goes along once, in a first row
        each_term = cold.select("id", "parts", F.explode(F.arrays_zip("term", "n", "in_parts")).alias("t")).select("id", "parts", "t.*")
        order = ("id", "record", "term", "n", "in_parts", "records", "occurrences", "parts")
        known = each_term.join(vocabulary, "term").withColumn("record", F.lit(None).cast("string")).select(*order)
        none = F.lit(0).cast("long")
        heads = cold.where(F.size("term") > 0).select("id", "record", F.lit(None).cast("string").alias("term"), *[none.alias(c) for c in ("n", "in_parts", "records", "occurrences")], "parts")
        rows_by_id = known.unionByName(heads).repartition("id").sortWithinPartitions("id", F.col("record").isNull())
        out = rows_by_id.mapInArrow(_swept_sorted(weight, total, min_in_parts, min_parts), OUT)
    if merged is not None:
        joined = stage(merged.join(small(vocabulary, size, limit), "term"), "background")
        most = joined.groupBy("record").agg(F.max("n").alias("most"))
        by_rows = _swept_rows(joined, weight, total).where((F.col("in_parts") >= min_in_parts) & (F.col("parts") >= min_parts))
        out = out.unionByName(by_rows.join(most, "record").select("record", "term", "n", "in_parts", "records", "most", "parts", "p"))
    return out, with_terms
