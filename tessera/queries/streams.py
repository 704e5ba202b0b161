"""Streams over the events table, drained and compared with their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.queries.activity import LATEST
from tessera.registry import query
from tessera.storage import stored
from tessera.streaming import latest, usage

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, d):
    """The events table as a stream, bound as in the batch queries."""
    return bound(usage.event_stream(spark, f"{d}/events.parquet", EVENTS))


def bound(raw):
    return raw.select(
        "event_id",
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("cid"),
        b.tagged("W", "user_id").alias("wallet"),
        b.millis("ts").alias("at_ms"),
        F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "signup", F.lit(None)).otherwise(True).alias("ok"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
    )


def in_batches(spark, d, batches=6, files=4):
    """The events as files of rising times, ``files`` of them a batch of the stream or as many as the events need, in the shared folder."""
    rows = b.table(spark, d, "events")
    files = max(files, -(-b.shares(spark, d, "events") // batches))

    def build(path):
        # by time, not by id: an event of a later file is not older than those before
        bounds = rows.agg(F.min(b.millis("ts")).alias("lo"), F.max(b.millis("ts")).alias("hi")).first()
        width = (bounds["hi"] - bounds["lo"]) // batches + 1
        at = F.coalesce(b.millis("ts"), F.lit(bounds["lo"]))
        for k in range(batches):
            low = bounds["lo"] + k * width
            rows.filter((at >= low) & (at < low + width)).repartition(files).write.mode("append").parquet(path)

    path = stored(spark, "event-batches", [f"{d}/events.parquet"], build)
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return bound(raw)


@query("w1_stream_latest", b.with_frames("access", "").rstrip() + f", {LATEST} SELECT cid, wallet, last_access_at, last_ok FROM latest2")
def w1(spark, d):
    done = latest.latest_to_end(in_batches(spark, d), 90 * b.DAY_MS)
    return done.select("cid", "wallet", F.col("at_ms").alias("last_access_at"), F.col("ok").alias("last_ok"))


@query(
    "w5_retention",
    b.with_frames("access", "").rstrip() + f", {LATEST} SELECT cid, wallet, last_access_at, last_ok FROM latest2 WHERE last_access_at >= (SELECT max(at_ms) FROM access) - {10 * b.DAY_MS}",
)
def w5(spark, d):
    done = latest.latest_to_end(in_batches(spark, d), 10 * b.DAY_MS)
    return done.select("cid", "wallet", F.col("at_ms").alias("last_access_at"), F.col("ok").alias("last_ok"))


@query(
    "w2_sliding_activity",
    b.with_frames("access", """, w AS (SELECT cid, ok, unnest(range((at_ms // 86400000 - 6) * 86400000, (at_ms // 86400000 + 1) * 86400000, 86400000)) AS window_start FROM access)
  SELECT cid, window_start, count(*) AS accesses, count(*) FILTER (ok) AS ok FROM w GROUP BY ALL"""),
)
def w2(spark, d):
    return usage.run_to_end(usage.windowed_activity(events(spark, d)), "complete")


@query("w3_stream_rate", b.with_frames("http_log", "SELECT path, at_ms // 300000 * 300000 AS window_start, round(count(*) / 300.0, 6) AS rate FROM http_log GROUP BY ALL"))
def w3(spark, d):
    return usage.run_to_end(usage.request_rate(events(spark, d)), "complete")


def spaced(key: str, every_ms: int, name: str) -> str:
    """SQL of events at least ``every_ms`` apart by key: each next one is the first that is far enough from the last."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, epoch_us(ts) // 1000 AS at_ms, min(event_id) AS event_id FROM events GROUP BY ALL),
  w(k, at_ms, event_id) AS (SELECT k, min(at_ms), arg_min(event_id, at_ms) FROM e GROUP BY k
    UNION ALL SELECT e.k, min(e.at_ms), arg_min(e.event_id, e.at_ms) FROM w JOIN e ON e.k = w.k AND e.at_ms >= w.at_ms + {every_ms} GROUP BY e.k)
  SELECT k AS {name}, at_ms, event_id FROM w"""


@query("w6_drop_replays", spaced("'n' || event_id % 37", 600_000, "nonce"))
def w6(spark, d):
    nonce = F.concat(F.lit("n"), (F.col("event_id") % 37).cast("string"))
    return usage.run_to_end(usage.rate_limited(in_batches(spark, d).withColumn("nonce", nonce), "nonce", 600_000), "append")


@query("w8_rate_limit", spaced("'W' || user_id", 86_400_000, "wallet"))
def w8(spark, d):
    return usage.run_to_end(usage.rate_limited(in_batches(spark, d), "wallet", 86_400_000), "append")


@query("w10_balance_gate", b.with_frames("access", """SELECT event_id, a.wallet FROM access a JOIN (SELECT 'W' || c_custkey AS wallet FROM customer WHERE c_acctbal >= 1000) USING (wallet)"""))
def w10(spark, d):
    balances = b.table(spark, d, "customer").select(b.tagged("W", "c_custkey").alias("wallet"), F.col("c_acctbal").alias("balance"))
    return usage.run_to_end(usage.gated(events(spark, d), balances, 1000.0).select("event_id", "wallet"), "append")
