"""Access streams: latest state, sliding activity, replay dedupe, rate limits, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.storage import new_folder

DAY = "1 day"
#: Groups that the keys of a limit are dealt to.
KEY_GROUPS = 512
#: Stands for no time, before all others.
NEVER = -(1 << 62)


def event_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream; as a pattern, for which either will do."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def latest_access(events: DataFrame) -> DataFrame:
    """Last access of every (cid, wallet) by event time, ties by event id; update or complete mode.

    State is one row per key, not the events; a late event doesn't overwrite a newer one.
    """
    last = F.max_by(F.struct("ok", "at_ms"), F.struct("at_ms", "event_id")).alias("last")
    return events.groupBy("cid", "wallet").agg(last).select("cid", "wallet", F.col("last.at_ms").alias("last_access_at"), F.col("last.ok").alias("last_ok"))


def windowed_activity(events: DataFrame, width: str = "7 days", slide: str = DAY, late: str = "90 days") -> DataFrame:
    """Accesses by item in sliding windows; state older than the watermark is dropped."""
    rows = events.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    per = rows.groupBy(F.window("ts", width, slide), "cid").agg(F.count(F.lit(1)).alias("accesses"), F.count_if("ok").alias("ok"))
    start = F.unix_millis(F.col("window.start"))
    return per.select("cid", start.alias("window_start"), "accesses", "ok")


def request_rate(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests per second by path in tumbling windows."""
    rows = log.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", late)
    per = rows.groupBy(F.window("ts", width), "path").agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_millis("window.end") - F.unix_millis("window.start")) / 1000.0
    return per.select("path", F.unix_millis("window.start").alias("window_start"), F.round(F.col("n") / seconds, 6).alias("rate"))


def drop_replays(requests: DataFrame, within: str = "10 minutes") -> DataFrame:
    """W6 by the engine's own state: a nonce that comes again within the window is dropped.

    Copies that stand farther apart may be dropped too if they come in one batch; ``rate_limited``
    by nonce keeps to the window exactly.
    """
    return requests.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", within).dropDuplicatesWithinWatermark(["nonce"])


def spaced_rows(code: np.ndarray, at: np.ndarray, last: np.ndarray, every_ms: int) -> np.ndarray:
    """The places of the rows let through, of rows in order of (code, at); all codes take their next row at once.

    ``last`` holds each code's last time let through, ``NEVER`` if there is none, and is brought up to date.
    """
    times, place = np.unique(at, return_inverse=True)
    # code and time as one number, so a search over all rows ends within a code's rows or right behind them
    width = len(times) + 1
    ordered, ends = code * width + place, np.searchsorted(code, np.arange(len(last)), side="right")
    kept, codes = [np.empty(0, np.int64)], np.unique(code)
    while len(codes):
        i = np.searchsorted(ordered, codes * width + np.searchsorted(times, last[codes] + every_ms))
        found = i < ends[codes]
        codes, i = codes[found], i[found]
        last[codes] = at[i]
        kept.append(i)
    return np.sort(np.concatenate(kept))


def rate_limited(events: DataFrame, key: str, every_ms: int, late: str = "10 minutes", groups: int = KEY_GROUPS) -> DataFrame:
    """At most one event of a key in ``every_ms``, by event time.

    Keys are dealt to ``groups`` by hash; a group's state has the last time let through of each of its
    keys, dropped when the watermark has passed its window. A batch calls Python once a group, not once a
    key, and a group's keys are searched together.
    """

    def let_through(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        keys, held = state.get if state.exists else ([], [])
        code_of, parts = {k: i for i, k in enumerate(keys)}, []
        for b in batches:
            codes, found = pd.factorize(b[key], use_na_sentinel=False)
            own = np.array([code_of.setdefault(None if pd.isna(k) else k, len(code_of)) for k in found], np.int64)
            parts.append((own[codes], b["at_ms"].to_numpy(), b["event_id"].to_numpy()))
        code, at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, at, code))
        code, at, ids = code[order], at[order], ids[order]
        last = np.full(len(code_of), NEVER, np.int64)
        last[: len(held)] = held
        i = spaced_rows(code, at, last, every_ms)
        names, now = np.array(list(code_of), object), state.getCurrentWatermarkMs()
        live = last + every_ms > now
        state.update((names[live].tolist(), last[live].tolist()))
        state.setTimeoutTimestamp(max(int(last.max()) + every_ms, now + 1))
        yield pd.DataFrame({key: names[code[i]], "at_ms": at[i], "event_id": ids[i]})

    schema = f"{key} string, at_ms bigint, event_id bigint"
    timed = events.select(key, "at_ms", "event_id", F.timestamp_millis("at_ms").alias("ts")).withWatermark("ts", late)
    dealt = timed.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandasWithState(let_through, schema, "keys array<string>, lasts array<bigint>", "append", "EventTimeTimeout")


def redeemed(issued: DataFrame, used: DataFrame, ttl_ms: int = 600_000) -> DataFrame:
    """(token, used_at, event_id): the first use of each token within its time to live; later uses find it gone.

    ``issued`` has (token, issued_at), ``used`` (token, used_at, event_id).
    """
    rows = used.join(issued, "token").filter((F.col("used_at") >= F.col("issued_at")) & (F.col("used_at") - F.col("issued_at") <= ttl_ms))
    first = F.min(F.struct("used_at", "event_id")).alias("u")
    return rows.groupBy("token").agg(first).select("token", "u.used_at", "u.event_id")


def ingest_requests(bodies: DataFrame, column: str) -> DataFrame:
    """(wallet, plan_id, est_bytes, display_name) of upload requests; those without a wallet are refused.

    A size must be a positive number and is rounded down; the name stands under the first of its
    spellings that is given.
    """
    named = ("displayName", "display_name", "name", "fileName", "filename")
    rows = bodies.select(F.from_json(column, "struct<wallet:string,planId:string,estBytes:double>").alias("b"), column)
    # two of the names differ in case alone, so they are read by path
    name = F.coalesce(*(F.get_json_object(column, f"$.{n}") for n in named))
    size = F.when(F.col("b.estBytes") > 0, F.floor("b.estBytes")).cast("bigint")
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(empty(F.col("b.wallet")).alias("wallet"), empty(F.col("b.planId")).alias("plan_id"), size.alias("est_bytes"), empty(name).alias("display_name")).filter(
        "wallet IS NOT NULL"
    )


def import_roots(lines: DataFrame, column: str) -> DataFrame:
    """K4: (upload, cid) of an import's JSON lines, each root of an upload once; lines without a root are skipped."""
    root = F.get_json_object(column, "$.Root.Cid['/']")
    return lines.select("upload", F.trim(root).alias("cid")).filter("cid <> ''").dropDuplicates(["upload", "cid"])


def gated(events: DataFrame, balances: DataFrame, least: float) -> DataFrame:
    """Events of wallets with the balance asked; a stream joined with a static table."""
    rich = balances.filter(F.col("balance") >= least).select("wallet")
    return events.join(rich, "wallet", "left_semi")


def run_to_end(stream: DataFrame, mode: str, merge: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drain what is there (``availableNow``) and return the result as a batch frame.

    Batches go to the shared folder under their number, so a batch that is done again replaces
    itself. In complete mode the last batch is the result, in append mode all are.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        if merge:
            merge(batch, number)
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if mode == "complete":
        out = out.filter(F.col("batch") == out.agg(F.max("batch").alias("m")).first()["m"])
    return out.drop("batch")
