"""Frequency of every distinct term: recursive radix spilling with DuckDB aggregation.

Tasks first count the terms of their own rows, flushing whenever `FLUSH` distinct terms are held. Partial counts are partitioned
by the top bits of a 64-bit hash of the term. Each partition is spilled to files by the next bits of the hash as it arrives;
a file of more than `LEAF` rows is split again by the bits below, and each leaf is aggregated by DuckDB, one thread, with a memory
limit and its own spill folder. So memory depends on FLUSH, LEAF and the batch size only. Rows of one term can't be split by
hash bits; after the last bits, or where a split leaves all rows together, DuckDB aggregates the file as it is, out of core.

Files go below the cluster's shared folder, which must be mounted as a path on every machine, into a folder that the task makes and
deletes when it ends; nothing outside the task reads them, so a lost executor loses no more than its tasks.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.sources.staging import mounted_dir

FLUSH, LEAF, BITS, MEMORY = 300_000, 2_000_000, 4, "256MB"
_PARTIAL = pa.schema([("hash", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("records", pa.int64())])


def _counted(batches):
    """Batches of (terms list<string>), one row a record, to partial counts (term, n, records)."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        lists = batch.column(0)
        words = lists.flatten()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        if not len(words):
            continue
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        record = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        size = len(coded.dictionary)
        each = np.unique(record * size + code) % size
        held.append(pa.table({"term": coded.dictionary.cast(pa.string()), "n": np.bincount(code, minlength=size), "records": np.bincount(each, minlength=size)}))
        rows += size
        if rows > 2 * FLUSH:
            held = [_summed(held)]
            rows = held[0].num_rows
            if rows > FLUSH:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _summed(held).to_batches()


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum"), ("records", "sum")])
    return pa.table({"term": t["term"], "n": t["n_sum"].cast(pa.int64()), "records": t["records_sum"].cast(pa.int64())})


class _Spill:
    """Files of partial counts by BITS bits of the hash, below `shift`."""

    def __init__(self, folder: str, shift: int) -> None:
        self.folder, self.shift, self.rows = tempfile.mkdtemp(dir=folder), shift, [0] * (1 << BITS)
        self.writers: dict[int, pq.ParquetWriter] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        part = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(self.shift)) & np.uint64((1 << BITS) - 1)
        for p in np.unique(part):
            some = batch.filter(pa.array(part == p))
            if p not in self.writers:
                self.writers[p] = pq.ParquetWriter(self.path(p), _PARTIAL, compression="zstd")
            self.writers[p].write_batch(some)
            self.rows[p] += some.num_rows

    def path(self, p: int) -> str:
        return f"{self.folder}/{p}.parquet"

    def close(self) -> None:
        for w in self.writers.values():
            w.close()


def _aggregate(path: str, folder: str):
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": f"{folder}/duckdb", "preserve_insertion_order": False}) as c:
        yield from c.sql("SELECT term, sum(n)::BIGINT n, sum(records)::BIGINT records FROM read_parquet($path) GROUP BY term", params={"path": path}).to_arrow_reader(65_536)


def _leaves(spill: _Spill, folder: str, leaf: int):
    for p, rows in enumerate(spill.rows):
        if not rows:
            continue
        path = spill.path(p)
        if rows > leaf and spill.shift >= BITS:
            deeper = _Spill(folder, spill.shift - BITS)
            with pq.ParquetFile(path) as f:
                for b in f.iter_batches(65_536):
                    deeper.add(b)
            deeper.close()
            os.remove(path)
            yield from _leaves(deeper, folder, leaf)
        else:
            yield from _aggregate(path, folder)
            os.remove(path)


def _totals(leaf: int, first_shift: int, shared: str):
    def totals(batches):
        os.makedirs(shared, exist_ok=True)
        folder = tempfile.mkdtemp(prefix="radix-", dir=shared)
        try:
            spill = _Spill(folder, first_shift)
            for b in batches:
                spill.add(pa.RecordBatch.from_arrays([b.column(n) for n in _PARTIAL.names], schema=_PARTIAL))
            spill.close()
            yield from _leaves(spill, folder, leaf)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return totals


def term_frequencies(df: DataFrame, terms: str, partitions: int | None = None, leaf: int = LEAF) -> DataFrame:
    """Of rows with an array of terms, one row a record: term, n (occurrences), records (with the term), each term once.

    Null and empty arrays have no terms; null terms don't count; an empty table has no rows. Other columns are not read.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = df.select(F.filter(F.col(terms), lambda t: t.isNotNull()).alias("t")).mapInArrow(_counted, "term string, n long, records long")
    # the top 16 bits choose the partition, the bits below the files
    hashed = partial.withColumn("hash", F.xxhash64("term"))
    top = F.pmod(F.shiftrightunsigned("hash", 48), F.lit(n)).cast("int")
    return hashed.repartitionById(n, top).mapInArrow(_totals(leaf, 44, mounted_dir(spark, "radix")), "term string, n long, records long")


def marked(freq: DataFrame, records: int, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
    """freq with mark: `rare` in fewer than rare_below records, `common` in more than common_above of all, else null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * records, "common")
    return freq.withColumn("mark", mark)
