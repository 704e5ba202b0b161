"""Snapshot diffs and keyed merges as pure functions from old and new rows to the next state.

A table format with MERGE is not assumed: each function returns the whole next state, which
the caller writes beside the old one and swaps in. Merges join by key, so both sides are
partitioned alike and the work grows with the rows, not with their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import id_variants

DETECTED = ("mime", "ext_guess", "kind", "confidence", "source")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "cid") -> DataFrame:
    """(key, change) with change one of new, kept, gone."""
    a = old.select(key).distinct().withColumn("o", F.lit(True))
    b = new.select(key).distinct().withColumn("n", F.lit(True))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").otherwise("kept")
    return a.join(b, key, "full").select(key, change.alias("change"))


def sync_pins(catalog: DataFrame, snapshot: DataFrame, now: int) -> DataFrame:
    """M1: pins of the snapshot become present; pins that it lacks become removed; others stay.

    ``first_seen_at`` is kept for old items; ``last_seen_at`` moves to ``now`` for every pin.
    """
    pins = snapshot.select("cid").distinct().withColumn("pinned", F.lit(True))
    rows = catalog.withColumn("known", F.lit(True)).join(pins, "cid", "full")
    pinned, known = F.col("pinned").isNotNull(), F.col("known").isNotNull()
    lost = ~pinned & F.col("present") & (F.col("present_source") == "pinls")
    return rows.select(
        "cid",
        F.when(pinned, True).when(lost, False).otherwise(F.col("present")).alias("present"),
        F.when(pinned, "pinls").otherwise(F.col("present_source")).alias("present_source"),
        F.when(known, F.col("first_seen_at")).otherwise(F.lit(now)).alias("first_seen_at"),
        F.when(pinned, F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(pinned, F.lit(None)).when(lost, F.lit(now)).otherwise(F.col("removed_at")).cast("bigint").alias("removed_at"),
    )


def upsert_children(catalog: DataFrame, links: DataFrame, now: int) -> DataFrame:
    """M2: children of expanded directories; many parents give the least depth, a pin stays a pin."""
    found = links.groupBy(F.col("child_cid").alias("cid")).agg(F.min("depth").alias("depth"))
    rows = catalog.join(found, "cid", "full")
    seen = F.col("depth").isNotNull()
    return rows.select(
        "cid",
        F.when(seen, True).otherwise(F.col("present")).alias("present"),
        F.when(seen, F.coalesce("present_source", F.lit("expanded"))).otherwise(F.col("present_source")).alias("present_source"),
        F.when(seen, F.lit(now)).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.least("expand_depth", "depth").cast("int").alias("expand_depth"),
        F.when(seen, F.lit(None)).otherwise(F.col("removed_at")).cast("bigint").alias("removed_at"),
    )


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """M3: first seen is the least, last seen the newest; one aggregate over both, combined before the shuffle."""
    return old.unionByName(new).groupBy("parent_cid", "child_cid").agg(
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def upsert_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """M4: leaf and depth from the new row, the MIME hint from whichever has one."""
    n = new.select("root_cid", "path", *(F.col(c).alias(f"n_{c}") for c in ("leaf_cid", "depth", "mime_hint")))
    rows = old.join(n, ["root_cid", "path"], "full")
    return rows.select("root_cid", "path", *(F.coalesce(f"n_{c}", c).alias(c) for c in ("leaf_cid", "depth", "mime_hint")))


def prune_edges(edges: DataFrame, listing: DataFrame) -> DataFrame:
    """M5: edges of listed parents that the listing lacks go; a parent with an empty listing keeps its edges."""
    listed = listing.select("parent_cid").distinct().withColumn("_listed", F.lit(True))
    kept = listing.select("parent_cid", "child_cid").distinct().withColumn("_kept", F.lit(True))
    rows = edges.join(listed, "parent_cid", "left").join(kept, ["parent_cid", "child_cid"], "left")
    return rows.filter("_listed IS NULL OR _kept").drop("_listed", "_kept")


def flip_orphans(catalog: DataFrame, before: DataFrame, after: DataFrame, now: int) -> DataFrame:
    """M5: expanded items that have lost their last parent are no longer present."""
    lost = orphans(before, after).select(F.col("child_cid").alias("cid")).withColumn("_lost", F.lit(True))
    rows = catalog.join(lost, "cid", "left")
    gone = F.col("_lost") & (F.col("present_source") == "expanded")
    return rows.withColumns(
        {
            "present": F.when(gone, False).otherwise(F.col("present")),
            "removed_at": F.when(gone, F.lit(now)).otherwise(F.col("removed_at")).cast("bigint"),
        }
    ).drop("_lost")


def orphans(before: DataFrame, after: DataFrame) -> DataFrame:
    """M5: children that had a parent and have none."""
    return before.select("child_cid").distinct().join(after.select("child_cid").distinct(), "child_cid", "left_anti")


def replace_tokens(index: DataFrame, fresh: DataFrame, cids: DataFrame) -> DataFrame:
    """M6: tokens of the items crawled anew are replaced, also where the crawl found none."""
    return index.join(cids.select("cid").distinct(), "cid", "left_anti").unionByName(fresh)


def upsert_wallets(old: DataFrame, new: DataFrame) -> DataFrame:
    """M8: a plan is overwritten by a known one only."""
    n = new.select("wallet", F.col("plan_id").alias("n_plan"))
    return old.join(n, "wallet", "full").select("wallet", F.coalesce("n_plan", "plan_id").alias("plan_id"))


def split_bytes(uploads: DataFrame) -> DataFrame:
    """M9: (wallet, root_cid, created_at, bytes_estimated): an upload's bytes, spread evenly over its distinct roots.

    ``uploads`` has (wallet, roots, created_at, total_bytes); an upload without a known size gives none.
    """
    roots = F.array_distinct(F.filter(F.transform("roots", lambda r: F.trim(r)), lambda r: r != ""))
    rows = uploads.withColumn("roots", roots)
    share = F.when(F.col("total_bytes") > 0, F.floor(F.col("total_bytes") / F.size("roots"))).cast("bigint")
    return rows.select("wallet", F.explode("roots").alias("root_cid"), "created_at", share.alias("bytes_estimated"))


def upsert_roots(old: DataFrame, new: DataFrame) -> DataFrame:
    """M9: a root that comes again is active, keeps its first time, and takes a known size."""
    n = new.groupBy("wallet", "root_cid").agg(F.min("created_at").alias("n_at"), F.max("bytes_estimated").alias("n_bytes"))
    return old.join(n, ["wallet", "root_cid"], "full").select(
        "wallet",
        "root_cid",
        F.least("created_at", "n_at").alias("created_at"),
        F.coalesce("n_bytes", "bytes_estimated").alias("bytes_estimated"),
        F.when(F.col("n_at").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
    )


def insert_pins(old: DataFrame, new: DataFrame) -> DataFrame:
    """A pin keeps its first time."""
    return old.unionByName(new).groupBy("wallet", "cid").agg(F.min("created_at").alias("created_at"))


def rename(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The last name given stands, of equal times the largest; an empty one removes the entry."""
    last = changes.groupBy("wallet", "cid").agg(
        F.max_by("display_name", F.struct("updated_at", "display_name")).alias("n_name"), F.max("updated_at").alias("n_at")
    )
    rows = old.join(last, ["wallet", "cid"], "full")
    name = F.when(F.col("n_at").isNotNull(), F.nullif(F.trim("n_name"), F.lit(""))).otherwise(F.col("display_name"))
    merged = rows.select("wallet", "cid", name.alias("display_name"), F.greatest("n_at", "updated_at").alias("updated_at"))
    return merged.filter("display_name IS NOT NULL")


def rename_variants(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Renames under any spelling of an id reach the names kept under all of them."""
    spelled = changes.withColumn("cid", F.explode(id_variants("cid")))
    done = rename(old, spelled)
    # a spelling that the state doesn't hold gets no entry of its own where another one has it
    held = old.select("wallet", "cid").withColumn("_held", F.lit(True))
    given = changes.select("wallet", F.col("cid")).distinct().withColumn("_given", F.lit(True))
    rows = done.join(held, ["wallet", "cid"], "left").join(given, ["wallet", "cid"], "left")
    return rows.filter("_held OR _given").drop("_held", "_given")


def repair(catalog: DataFrame) -> DataFrame:
    """What is present has not been removed."""
    return catalog.withColumn("removed_at", F.when(~F.col("present"), F.col("removed_at")))


def prune_tokens(index: DataFrame, least: int = 3) -> DataFrame:
    """Index rows of tokens that are too short go."""
    return index.filter(F.length("token") >= least)


def touch_plans(wallets: DataFrame, checked: DataFrame, now: int) -> DataFrame:
    """The time of the last plan check moves to ``now`` for the wallets checked."""
    done = checked.select("wallet").distinct().withColumn("_done", F.lit(True))
    rows = wallets.join(done, "wallet", "left")
    return rows.withColumn("plan_checked_at", F.when(F.col("_done"), F.lit(now)).otherwise(F.col("plan_checked_at")).cast("bigint")).drop("_done")


def delete_roots(roots: DataFrame, gone: DataFrame) -> DataFrame:
    """Roots less those removed, by wallet and root."""
    return roots.join(gone.select("wallet", "root_cid").distinct(), ["wallet", "root_cid"], "left_anti")


def add_pins(pins: DataFrame, requests: DataFrame) -> DataFrame:
    """Pin requests with an item and a wallet are appended; the first time of a pin stays."""
    cid, wallet = F.trim("cid"), F.trim("wallet")
    valid = requests.select(wallet.alias("wallet"), cid.alias("cid"), "created_at").filter("cid <> '' AND wallet <> ''")
    return insert_pins(pins, valid)


def detect_update(catalog: DataFrame, results: DataFrame, now: int, version: str) -> DataFrame:
    """M7: what detection found replaces the item's type columns and clears its error; a failure sets the error alone.

    ``results`` has (cid, mime, ext_guess, kind, confidence, source, failure), one row an item; an
    item without a result stays as it was.
    """
    found = results.select("cid", *(F.col(c).alias(f"_{c}") for c in DETECTED), F.col("failure").alias("_failure"), F.lit(True).alias("_done"))
    rows = catalog.join(found, "cid", "left")
    done, failed = F.col("_done").isNotNull(), F.col("_failure").isNotNull()
    columns = {c: F.when(done & ~failed, F.col(f"_{c}")).otherwise(F.col(c)) for c in DETECTED}
    columns["indexed_at"] = F.when(done & ~failed, F.lit(now)).otherwise(F.col("indexed_at")).cast("bigint")
    columns["error"] = F.when(done, F.col("_failure")).otherwise(F.col("error"))
    columns["detector_version"] = F.when(done, F.lit(version)).otherwise(F.col("detector_version"))
    return rows.withColumns(columns).select(*catalog.columns)


def add_missing_columns(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """K5: columns that an older state lacks, as (type, default)."""
    for name, (kind, value) in defaults.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(kind))
    return rows
