"""Access by day as mergeable states: any window of days is a union of days, a late event changes its day alone.

A state row holds what a pair of item and wallet did on a day: how often, how often well, and its last access. Days
are folders, so a window opens its own days and a change writes those of its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.usage import usage_stats
from tessera.storage import kept

DAY_MS = 86_400_000
SCHEMA = "cid string, wallet string, accesses bigint, good bigint, last_at bigint, last_id bigint, last_ok boolean, day int"
PAIR = ("day", "cid", "wallet")


def day_of(at_ms: Column) -> Column:
    return F.floor(at_ms / DAY_MS).cast("int")


def merged(states: DataFrame) -> DataFrame:
    """States of the same day, item and wallet as one; counts add up, the last access by time stays, ties by event id."""
    last = F.max_by(F.struct("last_at", "last_id", "last_ok"), F.struct("last_at", "last_id")).alias("l")
    per = states.groupBy(*PAIR).agg(F.sum("accesses").alias("accesses"), F.sum("good").alias("good"), last)
    return per.select("cid", "wallet", "accesses", "good", "l.*", "day")


def states_of(events: DataFrame) -> DataFrame:
    """The states of events (cid, wallet, at_ms, event_id, ok); each event's id is its own."""
    one = events.select(
        "cid", "wallet", F.lit(1).cast("bigint").alias("accesses"), F.coalesce("ok", F.lit(False)).cast("bigint").alias("good"),
        F.col("at_ms").alias("last_at"), F.col("event_id").alias("last_id"), F.col("ok").alias("last_ok"), day_of(F.col("at_ms")).alias("day"),
    )
    return merged(one)


def read_days(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The states of the days from ``first`` to ``last``; other days' files are not opened."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("day") >= first)
    return rows if last is None else rows.filter(F.col("day") <= last)


def add(spark: SparkSession, path: str, events: DataFrame, old: bool = True) -> None:
    """Merge new events into their days; with ``old`` false there is no table yet. New states are whole before a day is replaced."""
    fresh = kept(states_of(events), "states")
    if old:
        days = [r["day"] for r in fresh.select("day").distinct().collect()]  # as many as there are days
        fresh = kept(merged(fresh.unionByName(read_days(spark, path).filter(F.col("day").isin(days)))), "days")
    dealt = fresh.hint("rebalance", "day").sortWithinPartitions("day", "cid")
    dealt.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def usage_from_days(spark: SparkSession, path: str, since_day: int) -> DataFrame:
    """A6 from the days since ``since_day``: the last access of each pair, then wallets by item."""
    last = F.max_by("last_ok", F.struct("last_at", "last_id")).alias("last_ok")
    pairs = read_days(spark, path, since_day).groupBy("cid", "wallet").agg(F.max("last_at").alias("last_access_at"), last)
    return usage_stats(pairs, since_day * DAY_MS)


def wallets_from_days(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(cid, wallets): distinct wallets by item in a window of days, as A5 has them for owners."""
    return read_days(spark, path, first, last).groupBy("cid").agg(F.count_distinct("wallet").alias("wallets"))


def activity_from_days(spark: SparkSession, path: str, days: int = 7) -> DataFrame:
    """(cid, window_start, accesses, ok) of all windows of ``days`` days, one beginning a day, from counts by day."""
    per = read_days(spark, path).groupBy("cid", "day").agg(F.sum("accesses").alias("n"), F.sum("good").alias("g"))
    starts = F.explode(F.sequence(F.col("day") - (days - 1), F.col("day"))).alias("start")
    rows = per.select("cid", "n", "g", starts).groupBy("cid", "start").agg(F.sum("n").alias("accesses"), F.sum("g").alias("ok"))
    return rows.select("cid", (F.col("start").cast("bigint") * DAY_MS).alias("window_start"), "accesses", "ok")
