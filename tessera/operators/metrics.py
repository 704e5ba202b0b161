"""Request metrics: counters, latencies, rates and the text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status").agg(F.count(F.lit(1)).alias("requests"))


def request_latency(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("duration_ms").alias("sum_ms"), F.max("duration_ms").alias("max_ms")
    )


def window_start(at: str, seconds: int) -> Column:
    return (F.floor(F.col(at) / (seconds * 1000)) * (seconds * 1000)).cast("bigint")


def event_rate(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events per second of every key in windows of ``seconds``."""
    per = events.groupBy(key, window_start("at_ms", seconds).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(key, "window_start", F.round(F.col("n") / float(seconds), 6).alias("rate"))


def counter_rate(samples: DataFrame, key: str, value: str, seconds: int) -> DataFrame:
    """The increase per second of a counter; a fall is a reset, after which the value counts from zero."""
    rows = samples.withColumn("window_start", window_start("at_ms", seconds))
    before = F.lag(value).over(Window.partitionBy(key, "window_start").orderBy("at_ms", "event_id"))
    step = F.when(before.isNull(), 0).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    per = rows.withColumn("step", step).groupBy(key, "window_start").agg(F.sum("step").alias("n"))
    return per.select(key, "window_start", F.round(F.col("n") / float(seconds), 6).alias("rate"))


def exposition(rows: DataFrame, name: str, labels: dict[str, str], value: str) -> DataFrame:
    """K2: one text line per row, ``name{label="value",...} number``."""
    pairs = [F.concat(F.lit(f'{label}="'), F.col(c).cast("string"), F.lit('"')) for label, c in labels.items()]
    line = F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string"))
    return rows.select(line.alias("line"))


#: Routes whose last part is an id, by prefix, with the name that stands for them; fixed values.
INDEX_ROUTES = (("/cid/", "/cid/:cid"), ("/children/", "/children/:cid"), ("/parents/", "/parents/:cid"))
API_ROUTES = (("/admin/wallet/", "/admin/wallet/:wallet"), ("/ipfs/", "/ipfs/:cid"), ("/ipns/", "/ipns/:name"))


def route_template(path: Column) -> Column:
    """A request path without its query, ids of known routes by their names; ``/`` for none."""
    base = F.coalesce(F.nullif(F.substring_index(path, "?", 1), F.lit("")), F.lit("/"))
    named = F.when(base.startswith("/wallet/") & base.endswith("/usage"), "/wallet/:wallet/usage")
    for prefix, name in (*INDEX_ROUTES, *API_ROUTES):
        named = named.when(base.startswith(prefix), name)
    return named.otherwise(base)


def chunks(docs: DataFrame, key: str, text: str, size: int = 4_000, most: int = 10) -> DataFrame:
    """(key, chunk, text): a text's first ``most`` chunks of ``size`` characters, as taggers read it."""
    rows = docs.select(key, F.trim(text).alias("text")).filter("text <> ''")
    n = F.least(F.ceil(F.length("text") / size), F.lit(most)).cast("int")
    parts = rows.select(key, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return parts.select(key, "chunk", F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size)).alias("text"))


def mean_scores(chunk_scores: DataFrame, key: str) -> DataFrame:
    """(key, label, mean): a label's scores over all of a text's chunks; chunks without the label count as 0.

    ``chunk_scores`` has (key, chunk, scores), scores being (label, score) pairs of which positive ones count.
    """
    total = chunk_scores.groupBy(key).agg(F.count_distinct("chunk").alias("_n"))
    rows = chunk_scores.select(key, F.explode("scores").alias("s")).select(key, F.lower(F.trim("s.label")).alias("label"), F.col("s.score").alias("score"))
    sums = rows.filter("label <> '' AND score > 0").groupBy(key, "label").agg(F.sum("score").alias("_sum"))
    return sums.join(total, key).select(key, "label", (F.col("_sum") / F.col("_n")).alias("mean"))


def node_stats(wallets: DataFrame, pins: DataFrame) -> DataFrame:
    """One row of registry totals: wallets, their pins and the items pinned."""
    return wallets.agg(F.count_distinct("wallet").alias("wallets")).crossJoin(
        pins.agg(F.count(F.lit(1)).alias("pins"), F.count_distinct("cid").alias("pinned_items"))
    )  # one row each


def state_snapshot(items: DataFrame, edges: DataFrame, counters: DataFrame) -> DataFrame:
    """One row of live counts with the stored counters (name, value, at_ms) beside them; times in whole seconds."""
    live = items.agg(F.count(F.lit(1)).alias("items"), F.count_if("present").alias("present")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    held = counters.agg(
        F.sum(F.when(F.col("name") == "types_indexed", F.col("value")).otherwise(0)).alias("types_indexed"),
        F.sum(F.when(F.col("name") == "dirs_expanded", F.col("value")).otherwise(0)).alias("dirs_expanded"),
        F.floor(F.max("at_ms") / 1000).cast("bigint").alias("last_at_seconds"),
    )
    return live.crossJoin(held)  # one row each
