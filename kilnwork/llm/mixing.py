"""Mixing sources to target weights.

Tokens are summed per source; a source's rate is the tokens it should give over those it has, at most its cap on repeats. Each
document is emitted floor(rate) times, and once more with the rate's fraction as probability, decided by a hash of its id and a
seed, so a repeated run or a lost task gives the same collection. Rates are a table as long as the list of sources; documents
aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.tokens import token_sizes
from kilnwork.sources.bounds import small
from kilnwork.sources.staging import stage


def source_name(c: Column) -> Column:
    """Case and outer blanks don't tell sources apart."""
    return F.lower(F.trim(c))


def _copies(rate: Column, item: Column, seed: int) -> Column:
    draw = F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(sizes: DataFrame, mix: DataFrame, total: float | None = None) -> DataFrame:
    """Per listed source: source, target_share, max_repeats, documents, tokens, rate, capped (its target is out of reach).

    sizes: source (as source_name gives it), n_tokens. mix: source, target_share, max_repeats; rows that name one source
    are one, of the sum of shares and the least cap; null shares count 0, a null cap is one copy. total: tokens the collection should have; by default
    as many as all sources that have any tokens can give in proportion without repeating a document more than their cap.
    A source without tokens has rate 0 and is capped if it has a share.
    """
    listed = mix.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    listed = listed.where("source is not null").groupBy("source").agg(F.sum("share").alias("target_share"), F.min("cap").cast("int").alias("max_repeats"))
    has = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    both = stage(
        listed.join(has, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("documents", "tokens")}), "rates"
    )
    if total is None:
        limit = F.min(F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share")))
        total = both.agg(limit).first()[0] or 0.0
    asked = F.when(F.col("tokens") > 0, F.col("target_share") * F.lit(float(total)) / F.col("tokens")).otherwise(F.lit(0.0))
    capped = (F.col("tokens") == 0) & (F.col("target_share") > 0) | (asked > F.col("max_repeats") * (1 + 1e-12))
    return both.withColumn("rate", F.least(asked, F.col("max_repeats").cast("double"))).withColumn("capped", capped)


def mixed(df: DataFrame, item: str, source: str, rate: DataFrame, keep: list[str], seed: int = 0) -> DataFrame:
    """The collection: item, source, copy (int, from 1) and the columns `keep` of every copy of every chosen document.

    Documents with a null text are no documents if the caller drops them before; null and unlisted sources give no rows.
    """
    number = rate.count()
    named = df.select(item, source_name(F.col(source)).alias("__source"), *keep)
    joined = named.join(small(rate.select(F.col("source").alias("__source"), "rate"), number), "__source")
    copies = joined.withColumn("__copies", _copies(F.col("rate"), F.col(item), seed)).where("__copies > 0")
    return copies.select(item, F.col("__source").alias("source"), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"), *keep)


def shares(sizes: DataFrame, item: str, rate: DataFrame, seed: int = 0) -> DataFrame:
    """What the collection reaches, per listed source: rate's columns, emitted (documents), emitted_tokens, reached_share."""
    number = rate.count()
    copies = sizes.join(small(rate.select("source", "rate"), number), "source").withColumn("copies", _copies(F.col("rate"), F.col(item), seed))
    got = copies.groupBy("source").agg(F.sum("copies").alias("emitted"), F.sum(F.col("copies") * F.col("n_tokens")).alias("emitted_tokens"))
    all_ = got.agg(F.sum("emitted_tokens").alias("all"))
    out = rate.join(got, "source", "left").join(F.broadcast(all_))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    reached = F.coalesce(F.col("emitted_tokens") / F.nullif("all", F.lit(0)), F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "documents", "tokens", F.round("rate", 6).alias("rate"), "capped", zero("emitted"), zero("emitted_tokens"), F.round(reached, 6).alias("reached_share"))


def sized_sources(df: DataFrame, item: str, source: str, text: str, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Staged item, source (by name) and n_tokens of every row with a text and a source."""
    named = df.select(F.col(item), source_name(F.col(source)).alias("source"), F.col(text).alias("__whole")).where("source is not null")
    return stage(token_sizes(named, [item, "source"], "__whole", vocabulary), "sizes")
