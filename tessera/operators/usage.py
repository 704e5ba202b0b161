"""Ownership, replication and access aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.bindings import dealt


def roots_summary(roots: DataFrame) -> DataFrame:
    """A4: a wallet's roots, active roots, and bytes of all of them."""
    return roots.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("roots"), F.count_if(F.col("status") == "active").alias("active"), F.sum("bytes_estimated").alias("bytes")
    )


def ownership(roots: DataFrame, pins: DataFrame) -> DataFrame:
    """(cid, wallet, created_at) of active roots and pins, repeats kept."""
    active = roots.filter("status = 'active'").select(F.col("root_cid").alias("cid"), "wallet", "created_at")
    return active.unionByName(pins.select("cid", "wallet", "created_at"))


def replication(roots: DataFrame, pins: DataFrame, since: int | None = None, parts: int | None = None) -> DataFrame:
    """A5: distinct wallets of every item, optionally of rows created since then; pairs are made distinct in ``parts``."""
    rows = ownership(roots, pins)
    if since is not None:
        rows = rows.filter(F.col("created_at") >= since)
    pairs = dealt(rows.select("cid", "wallet"), parts, "cid", "wallet").distinct()
    return pairs.groupBy("cid").agg(F.count("wallet").alias("wallets"))


def owners(roots: DataFrame, pins: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (cid, wallet) of active roots and pins."""
    return dealt(ownership(roots, pins).select("cid", "wallet"), parts, "cid", "wallet").distinct()


def latest_access(events: DataFrame, parts: int | None = None) -> DataFrame:
    """The last access of every (cid, wallet) by time, ties by the larger event id."""
    last = F.max_by(F.struct("ok", "at_ms"), F.struct("at_ms", "event_id")).alias("last")
    return dealt(events, parts, "cid", "wallet").groupBy("cid", "wallet").agg(last).select("cid", "wallet", F.col("last.at_ms").alias("last_access_at"), F.col("last.ok").alias("last_ok"))


def usage_stats(latest: DataFrame, since: int) -> DataFrame:
    """Wallets of every item in the window, and those whose last access was good or bad; null is neither."""
    return latest.filter(F.col("last_access_at") >= since).groupBy("cid").agg(
        F.count(F.lit(1)).alias("wallets"), F.count_if("last_ok").alias("ok_wallets"), F.count_if(~F.col("last_ok")).alias("bad_wallets")
    )


def wallet_items(roots: DataFrame, pins: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (cid, created_at) pairs of a wallet's roots and pins, with their display names."""
    rows = roots.select("wallet", F.col("root_cid").alias("cid"), "created_at").union(pins.select("wallet", "cid", "created_at"))
    return rows.distinct().join(names, ["wallet", "cid"], "left")


def pin_state(asked: DataFrame, roots: DataFrame, pins: DataFrame) -> DataFrame:
    """For each (wallet, cid) whether the wallet has it as an active root, has pinned it, and whether anyone has."""
    active = roots.filter("status = 'active'").select("wallet", F.col("root_cid").alias("cid")).distinct().withColumn("_root", F.lit(True))
    own = pins.select("wallet", "cid").distinct().withColumn("_pin", F.lit(True))
    any_ = pins.select("cid").distinct().withColumn("_any", F.lit(True))
    rows = asked.join(active, ["wallet", "cid"], "left").join(own, ["wallet", "cid"], "left").join(any_, "cid", "left")
    flags = {"has_root": "_root", "has_pin": "_pin", "pinned_anywhere": "_any"}
    return rows.select("wallet", "cid", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))


def logical_refcount(roots: DataFrame, pins: DataFrame, parts: int | None = None) -> DataFrame:
    """Pins plus distinct owners (pins count twice), the count without that, and the unpin decision."""
    per_pin = pins.groupBy("cid").agg(F.count(F.lit(1)).alias("pins"))
    per_owner = owners(roots, pins, parts).groupBy("cid").agg(F.count(F.lit(1)).alias("owners"))
    rows = per_owner.join(per_pin, "cid", "full").select("cid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pins", "owners")))
    refs = F.col("pins") + F.col("owners")
    decision = F.when(refs == 0, "noop").when(refs > 1, "drop_own").otherwise("release")
    return rows.select("cid", "pins", "owners", refs.alias("refcount"), F.col("owners").alias("true_refcount"), decision.alias("decision"))


def best_contract(contracts: DataFrame) -> DataFrame:
    """A client's contract, active ones first, then the largest id."""
    active = F.contains("status", F.lit("ACTIVE"))
    return contracts.groupBy("client").agg(F.max_by(F.struct(*contracts.columns), F.struct(active, "id")).alias("c")).select("c.*")


def plan_of(storage_gb: Column, start: Column, months: Column, month_seconds: int = 2_592_000) -> Column:
    """A contract's bytes and its end in epoch milliseconds."""
    return F.struct(
        (storage_gb * 1024 * 1024 * 1024).cast("bigint").alias("total_bytes"),
        ((start + months * month_seconds) * 1000).cast("bigint").alias("expires_at"),
    )


def quota(used: Column, total: Column) -> Column:
    """What is left, never below zero."""
    return F.greatest(total - used, F.lit(0)).cast("bigint")
