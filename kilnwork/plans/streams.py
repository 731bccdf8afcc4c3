"""Queries of sketches, samples and windows, in batch and as streams, over events and business.city."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnwork.functions.text import NUMBER_SQL, affine_sql, coefficients
from kilnwork.operators import sketch as K
from kilnwork.plans.registry import Registry
from kilnwork.sources.tables import table
from kilnwork.streaming import streams as X

LENGTH, SLIDE, LATE = "30 hours", "10 hours", "1 hour"
_W = """w AS (SELECT make_timestamp((k * 36000 * 1000000)::BIGINT) start, user_id, event_id FROM (
SELECT *, unnest([floor(epoch(ts) / 36000)::BIGINT, floor(epoch(ts) / 36000)::BIGINT - 1, floor(epoch(ts) / 36000)::BIGINT - 2]) k FROM events WHERE ts IS NOT NULL))"""
_Z = ", ".join(f"max(CASE WHEN {h} = 0 THEN 0 ELSE bit_count(({h} & -{h}) - 1) END) z{i}" for i, h in enumerate(affine_sql("x", a, b) for a, b in coefficients(K.FM_HASHES)))
_FM = _W + f", x AS (SELECT start, {NUMBER_SQL.format('user_id::VARCHAR')} x FROM w WHERE user_id IS NOT NULL), z AS (SELECT start, {_Z} FROM x GROUP BY 1)"
_MEANS = ", ".join("(" + " + ".join(f"pow(2.0, z{i})" for i in range(g, K.FM_HASHES, K.FM_GROUPS)) + f") / {len(range(g, K.FM_HASHES, K.FM_GROUPS))}" for g in range(K.FM_GROUPS))
_MEDIAN = f"floor(list_median([{_MEANS}]))::BIGINT"
_EST = _FM + f" SELECT start, {_MEDIAN} estimate FROM z"
_BITS = ", ".join(affine_sql("{x}", a, b) + " % (SELECT n FROM n)" for a, b in coefficients(K.BLOOM_HASHES))
_BLOOM = f"""f AS (SELECT DISTINCT city FROM business WHERE upper(state) = 'NV' AND city <> ''), n AS (SELECT greatest(count(*), 1) * {K.BITS_PER_KEY} n FROM f),
b AS (SELECT DISTINCT unnest([{_BITS.format(x=NUMBER_SQL.format("city"))}]) bit FROM f),
c AS (SELECT DISTINCT coalesce(city, '') city FROM business), q AS (SELECT city, unnest([{_BITS.format(x=NUMBER_SQL.format("city"))}]) bit FROM c WHERE city <> ''),
h AS (SELECT city, min(CASE WHEN b.bit IS NULL THEN 0 ELSE 1 END) member FROM q LEFT JOIN b USING (bit) GROUP BY 1),
m AS (SELECT city, coalesce(member, 0)::INTEGER member FROM c LEFT JOIN h USING (city))"""


def _members(s, d):
    business = table(s, d, "business")
    bits, size = K.bloom_bits(business.where(F.upper("state") == "NV"), "city")
    return K.bloom_members(business, "city", bits, size)


def _events(s, d):
    return table(s, d, "events").where("ts is not null")


def _stream(s, d):
    """events with the zoneless time as an instant in UTC, whatever the session's zone; _zoneless takes a result back."""
    instant = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts))")
    return X.table_stream(s, f"{d}/events.parquet").where("ts is not null").withColumn("ts", instant)


def _windows(s, d):
    return X.window_estimates(_stream(s, d), "ts", F.col("user_id").cast("string"), LENGTH, SLIDE, LATE)


def _zoneless(df):
    return df.withColumn("start", F.expr("timestampadd(MICROSECOND, unix_micros(start), TIMESTAMP_NTZ '1970-01-01')"))


def register(out: Registry) -> None:
    q = out.add

    @q("bloom_membership", "WITH " + _BLOOM + " SELECT city, member FROM m")
    def _(s, d):
        return _members(s, d)

    @q("bloom_flags_line", "WITH " + _BLOOM + " SELECT string_agg(member, ' ' ORDER BY city) flags FROM m")
    def _(s, d):
        return K.flags_line(_members(s, d), "city")

    @q("window_distinct", "WITH " + _W + " SELECT start, count(DISTINCT user_id) users FROM w GROUP BY 1")
    def _(s, d):
        return K.window_counts(_events(s, d), "ts", "user_id", LENGTH, SLIDE).select("start", "users")

    @q("hopping_window_count", "WITH " + _W + " SELECT start, count(*) n FROM w GROUP BY 1")
    def _(s, d):
        return K.window_counts(_events(s, d), "ts", "user_id", LENGTH, SLIDE).select("start", "n")

    @q("fm_sketch", "WITH " + _FM + " SELECT start, concat_ws(' ', " + ", ".join(f"z{i}" for i in range(K.FM_HASHES)) + ") zeros FROM z")
    def _(s, d):
        rows = K.fm_sketch(_events(s, d), "ts", F.col("user_id").cast("string"), LENGTH, SLIDE)
        return rows.select("start", F.array_join(F.col("zeros").cast("array<string>"), " ").alias("zeros"))

    @q("fm_estimate", "WITH " + _EST)
    def _(s, d):
        return K.fm_estimate(K.fm_sketch(_events(s, d), "ts", F.col("user_id").cast("string"), LENGTH, SLIDE))

    @q("reservoir_bottom_k", "SELECT event_id, event_type FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100")
    def _(s, d):
        return K.bottom_sample(table(s, d, "events").select("event_id", "event_type"), "event_id", 100)

    tags = "t AS (SELECT props->>'$.k' tag, count(*) n FROM (SELECT * FROM events ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100) WHERE props->>'$.k' IS NOT NULL GROUP BY 1)"

    @q("top3_dense_rank", "WITH " + tags + ', r AS (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC)::INTEGER "rank" FROM t) SELECT * FROM r WHERE "rank" <= 3')
    def _(s, d):
        sample = K.bottom_sample(table(s, d, "events"), "event_id", 100)
        counts = sample.select(F.get_json_object("props", "$.k").alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
        return K.top_dense(counts, "tag")

    # what a stream gives out: the windows that the watermark closes
    closed = "start + INTERVAL 30 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"

    @q("stream_window_counts", "WITH " + _W + f" SELECT start, count(*) n, count(DISTINCT user_id) users FROM w GROUP BY 1 HAVING {closed}")
    def _(s, d):
        return _zoneless(X.finished(_windows(s, d).select("start", "n", "users"), "windows"))

    @q("stream_fm_estimate", "WITH " + _FM + f" SELECT start, {_MEDIAN} estimate FROM z WHERE {closed}")
    def _(s, d):
        return _zoneless(X.finished(_windows(s, d).select("start", "estimate"), "fm"))

    @q(
        "stream_estimate_log",
        "WITH " + _FM + f""" SELECT strftime(start, '%Y-%m-%d %H:%M:%S') "Time", users "Ground Truth", {_MEDIAN} "Estimation"
        FROM z JOIN (SELECT start, count(DISTINCT user_id) users FROM w GROUP BY 1) USING (start) WHERE {closed}""",
    )
    def _(s, d):
        log = X.written(lambda path: X.estimate_log(_stream(s, d), "ts", F.col("user_id").cast("string"), LENGTH, SLIDE, LATE, path), s, "log")
        return s.read.schema("`Time` string, `Ground Truth` long, `Estimation` long").option("header", True).csv(log).select("`Time`", "`Ground Truth`", "`Estimation`")

    @q("stream_tracked", "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND (contains(lower(text), 'refund') OR contains(lower(text), 'mesa'))")
    def _(s, d):
        return X.finished(X.tracked(X.table_stream(s, f"{d}/documents.parquet"), "text", "lang", ["refund", "mesa"], ["en", "es"]).select("doc_id"), "tracked")

    @q("stream_bloom", "WITH " + _BLOOM + " SELECT business_id, city, CASE WHEN coalesce(city, '') = '' THEN 0 ELSE member END member FROM business LEFT JOIN m USING (city)")
    def _(s, d):
        business = table(s, d, "business")
        bits, size = K.bloom_bits(business.where(F.upper("state") == "NV"), "city")
        rows = X.table_stream(s, f"{d}/business.parquet").select("business_id", "city")
        return X.finished(X.bloom_filtered(rows, "city", bits, size), "bloom")

    @q("stream_reservoir", "SELECT event_id::VARCHAR item FROM (SELECT DISTINCT event_id FROM events WHERE ts IS NOT NULL) ORDER BY md5(event_id::VARCHAR) LIMIT 100")
    def _(s, d):
        return X.held_by(X.finished(X.reservoir(_stream(s, d), "event_id", 100), "reservoir")).select("item")

    sampled = "t AS (SELECT props->>'$.k' tag, count(*) n FROM (SELECT * FROM events WHERE ts IS NOT NULL AND props->>'$.k' IS NOT NULL ORDER BY md5(event_id::VARCHAR), event_id LIMIT 100) GROUP BY 1)"

    @q("stream_top_tags", "WITH " + sampled + ', r AS (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC)::INTEGER "rank" FROM t) SELECT * FROM r WHERE "rank" <= 3')
    def _(s, d):
        out = X.written(lambda path: X.tag_snapshots(_stream(s, d), "event_id", F.get_json_object("props", "$.k"), path), s, "tags")
        sample = X.held_by(s.read.schema("hash string, item string, value string").parquet(f"{out}/sample"))
        return K.top_dense(sample.groupBy(F.col("value").alias("tag")).agg(F.count("*").alias("n")), "tag")
