"""Structured Streaming forms: sources, hopping windows with watermarks, Flajolet-Martin windows, Bloom filtering, a sample and its tags.

Every function takes a streaming DataFrame and gives one, or the writer that ends it. State is bounded: windows are given out and
dropped once the watermark has passed their end (append mode), a sample holds its size a part. Credentials and addresses of live
sources come from the caller.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kilnwork.functions.text import id_number
from kilnwork.operators.sketch import BLOOM_HASHES, fm_estimate, fm_zeros, hashes, hopping, top_dense
from kilnwork.sources.staging import delete_on_exit, shared_dir
from kilnwork.sources.writers import estimate_lines, tag_snapshot

#: Set bits of a Bloom filter that go to every task as a map.
MOST_BITS = 5_000_000


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Text lines of a TCP source (for trials: such a source can't be replayed after a failure)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files; the schema is that of what is there.

    Files of one batch can't be late for one another, those of a later batch can.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def json_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def tracked(statuses: DataFrame, text: str, lang: str, track: list[str], languages: list[str]) -> DataFrame:
    """Statuses in one of the languages that mention one of the words."""
    mention = F.lit(False)
    for w in track:
        mention = mention | F.lower(F.col(text)).contains(w.lower())
    return statuses.where(F.col(lang).isin(languages) & mention)


def window_estimates(stream: DataFrame, ts: str, key: Column, length: str, slide: str, late: str) -> DataFrame:
    """start, n, users (exact), estimate (Flajolet-Martin) of each window once it is closed: for append mode.

    Rows are first counted by window and key, then the keys of a window: its state is a row a key, spread over all tasks, until the
    watermark passes the window's end. Rows later than `late` behind the latest are dropped, nulls are no users.
    """
    w = stream.withWatermark(ts, late).groupBy(hopping(F.col(ts), length, slide).alias("w"), key.alias("key")).agg(F.count("*").alias("n"))
    closed = fm_zeros(w.select("w", "n", "key", id_number(F.col("key")).alias("x")), "w", [F.sum("n").alias("n"), F.count("key").alias("users")])
    return fm_estimate(closed.select(F.col("w.start").alias("start"), "n", "users", "zeros"))


def bloom_filtered(stream: DataFrame, key: str, bits: DataFrame, size: int) -> DataFrame:
    """The stream's rows with member 0 / 1.

    A filter of up to MOST_BITS set bits goes to every task as a map (checked); with a larger one each key's hashes are joined with the
    bit table, a static one, batch by batch.
    """
    on = [r[0] for r in bits.limit(MOST_BITS + 1).collect()]
    if len(on) > MOST_BITS:
        rows = stream
        for i in range(BLOOM_HASHES):  # a left join a hash, so no row is split and no state is kept
            at = bits.select(F.col("bit").alias("__bit"), F.lit(1).alias(f"__on{i}"))
            rows = rows.withColumn("__bit", F.element_at(hashes(id_number(F.col(key)), BLOOM_HASHES), i + 1) % size).join(at, "__bit", "left").drop("__bit")
        every = F.forall(F.array(*[F.col(f"__on{i}") for i in range(BLOOM_HASHES)]), lambda v: v.isNotNull())
        member = F.when(F.coalesce(F.col(key), F.lit("")) == "", 0).otherwise(every.cast("int"))
        return rows.withColumn("member", member).drop(*[f"__on{i}" for i in range(BLOOM_HASHES)])
    words: dict[int, int] = {}
    for b in on:
        words[b // 62] = words.get(b // 62, 0) | (1 << (b % 62))
    held = stream.sparkSession.createDataFrame(sorted(words.items()) or [(0, 0)], "w long, v long").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("__bits"))
    probe = F.transform(hashes(id_number(F.col(key)), BLOOM_HASHES), lambda h: h % size)
    bit = lambda h: F.getbit(F.coalesce(F.element_at("__bits", F.floor(h / 62)), F.lit(0).cast("long")), (h % 62).cast("int")) == 1
    member = F.when(F.coalesce(F.col(key), F.lit("")) == "", 0).otherwise(F.forall(probe, bit).cast("int"))
    return stream.crossJoin(F.broadcast(held)).withColumn("member", member).drop("__bits")  # one row


def reservoir(stream: DataFrame, item: str, size: int = 100, value: Column | None = None, parts: int = 16) -> DataFrame:
    """hash, item, value: what enters a uniform sample of `size` rows, of all that were seen.

    The sample is that of the `size` least hashes of their items. Each of `parts` parts of the hashes keeps its own least ones as its
    state, a batch at a time, and gives out those that enter; `held_by` takes the least of all parts, so no task sees the whole stream. Items
    tell rows apart; a null item is none, an item seen twice enters once.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = list(state.get[0]) if state.exists else []
        known = set(least)
        new = pd.concat(list(batches)).sort_values("hash").drop_duplicates("hash")
        new = new[~new["hash"].isin(known)].head(size)
        if len(least) == size:
            new = new[new["hash"] < least[-1]]
        least = sorted([*least, *new["hash"]])[:size]
        state.update((least,))
        kept = set(least)
        yield new[new["hash"].isin(kept)][["hash", "item", "value"]]

    text = F.col(item).cast("string")
    keyed = stream.select(text.alias("item"), (value if value is not None else text).cast("string").alias("value")).where("item is not null").withColumn("hash", F.md5("item"))
    return keyed.withColumn("part", F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")).groupBy("part").applyInPandasWithState(step, "hash string, item string, value string", "least array<string>", "append", GroupStateTimeout.NoTimeout)


def held_by(changes: DataFrame, size: int = 100) -> DataFrame:
    """item, value: the sample after all that entered it (a batch table of it)."""
    return changes.dropDuplicates(["hash"]).orderBy("hash").limit(size).select("item", "value")


def tag_snapshots(stream: DataFrame, item: str, tag: Column, path: str, size: int = 100, ranks: int = 3) -> DataStreamWriter:
    """A writer that, after every batch, counts the tags of a sample of `size` tagged rows and adds a snapshot of the most frequent.

    Below `path`: `sample`, what entered the sample, and `snapshots`, the text of each batch, as sources.writers.tag_snapshot has it.
    """
    tagged = stream.where(tag.isNotNull())

    def snapshot(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/sample/batch={number}")  # a repeated batch replaces itself
        sample = held_by(spark.read.schema(batch.schema).parquet(f"{path}/sample"), size)
        ranked = top_dense(sample.groupBy(F.col("value").alias("tag")).agg(F.count("*").alias("n")), "tag", ranks=ranks)
        tag_snapshot(ranked, sample.count()).write.mode("overwrite").text(f"{path}/snapshots/batch={number}")

    return reservoir(tagged, item, size, tag).writeStream.foreachBatch(snapshot)


def estimate_log(stream: DataFrame, ts: str, key: Column, length: str, slide: str, late: str, path: str) -> DataStreamWriter:
    """A writer that appends Time, Ground Truth, Estimation of every window that a batch closes, as CSV below `path`."""
    rows = window_estimates(stream, ts, key, length, slide, late)
    return rows.writeStream.foreachBatch(lambda batch, number: estimate_lines(batch).write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode over all that is there, then stop: the result as a table in the shared folder, written exactly once."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, base)
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def written(writer: Callable[[str], DataStreamWriter], spark: SparkSession, name: str) -> str:
    """Run a writer that is made for a folder over all that is there, then stop: the folder, below the shared one."""
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, base)
    writer(f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/out"
