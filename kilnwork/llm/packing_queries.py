"""Queries of container filling and source mixing over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm.mixing import mixed, rates, shares, sized_sources
from kilnwork.llm.packing import filling, invariants, pack, sized
from kilnwork.plans.registry import Registry
from kilnwork.sources.staging import stage
from kilnwork.sources.tables import table


#: Kinds of containers that are read to the driver at most; more are refused.
MOST_KINDS = 10_000


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    rows = table(spark, folder, "container_sizes").limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    return {r["container_kind"]: r["capacity_tokens"] for r in rows}


def p8_pack(spark: SparkSession, folder: str, kind: str = "medium") -> DataFrame:
    sizes = sized(table(spark, folder, "documents"), "doc_id", "text")
    capacity = _capacities(spark, folder)[kind]
    return pack(sizes, "doc_id", "n_tokens", capacity).withColumns({"container_kind": F.lit(kind), "capacity_tokens": F.lit(capacity)})


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """How well containers of each kind are filled."""
    sizes = sized(table(spark, folder, "documents"), "doc_id", "text")
    each = [filling(pack(sizes, "doc_id", "n_tokens", c), c).withColumn("container_kind", F.lit(k)) for k, c in sorted(_capacities(spark, folder).items())]
    return reduce(DataFrame.unionByName, each)


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind of container, how many documents and rules that packing must keep are broken: a row of zeros is right."""
    sizes = sized(table(spark, folder, "documents"), "doc_id", "text")
    out = []
    for kind, c in sorted(_capacities(spark, folder).items()):
        packed = stage(pack(sizes, "doc_id", "n_tokens", c), "packed")
        out.append(invariants(packed, sizes, "doc_id", "n_tokens", c).drop("tokens").withColumn("container_kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


def _rated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = sized_sources(table(spark, folder, "documents"), "doc_id", "source", "text")
    return sizes, rates(sizes, table(spark, folder, "source_mix"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where(F.col("text").isNotNull())
    return mixed(documents, "doc_id", "source", _rated(spark, folder)[1], ["text"])


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of every source."""
    sizes, rate = _rated(spark, folder)
    return shares(sizes, "doc_id", rate)


def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For each listed source its documents and the rules of mixing that are broken: documents with another number of copies than the rate's floor
    or one more, a rate above the cap, an uncapped source whose expected tokens miss its share of what is reached by more than 1 in 10^9."""
    sizes, rate = _rated(spark, folder)
    documents = table(spark, folder, "documents").where(F.col("text").isNotNull())
    copies = mixed(documents, "doc_id", "source", rate, []).groupBy("source", "doc_id").agg(F.count("*").alias("copies"))
    rated = sizes.join(F.broadcast(rate.select("source", "rate")), "source").join(copies, ["source", "doc_id"], "left")  # a row a source
    wrong = F.count_if(~F.coalesce("copies", F.lit(0)).isin(0) & ~F.col("copies").between(F.floor("rate"), F.floor("rate") + 1) | F.col("copies").isNull() & (F.col("rate") >= 1))
    each = rated.groupBy("source").agg(F.count("*").alias("own"), wrong.alias("wrong_copies"))
    expected = F.col("rate") * F.col("tokens")
    ratio = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0) & ~F.col("capped"), expected / F.col("target_share"))
    spread = rate.agg(F.min(ratio).alias("low"), F.max(ratio).alias("high"))
    off = (F.col("high") > F.col("low") * (1 + 1e-9)).cast("int")
    out = rate.join(each, "source", "left").join(F.broadcast(spread))  # one row
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return out.select("source", F.col("documents"), zero("wrong_copies", "long").alias("wrong_copies"), (F.col("rate") > F.col("max_repeats")).cast("int").alias("over_cap"), zero(off, "int").alias("off_target"))


def register(out: Registry) -> None:
    out.add("p8_pack")(p8_pack)
    out.add("p8_filling")(p8_filling)
    out.add(
        "p8_invariants",
        """SELECT container_kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) items, 0::BIGINT over_capacity, 0::BIGINT misplaced, 0::BIGINT lost, 0::BIGINT doubled, 0 wasteful
        FROM container_sizes""",
    )(p8_invariants)
    out.add("p9_mix")(p9_mix)
    out.add("p9_shares")(p9_shares)
    out.add("p9_rules", "SELECT lower(trim(source)) source, count(DISTINCT doc_id) documents, 0::BIGINT wrong_copies, 0 over_cap, 0 off_target FROM source_mix LEFT JOIN (SELECT doc_id, lower(trim(source)) s FROM documents WHERE text IS NOT NULL) ON s = lower(trim(source)) GROUP BY 1")(p9_rules)
