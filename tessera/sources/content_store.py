"""The catalog, its edges and its paths as stored tables, kept in step by the crawler's merges.

Edges stand by parent and by child, paths by root and by leaf, so that either side is found by its key. Each
merge reads and writes the buckets of the keys that it is about.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import merge
from tessera.sources.keyed import BUCKETS, KeyedTable, change, create, rows_of
from tessera.storage import kept


class ContentStore(NamedTuple):
    catalog: KeyedTable
    children: KeyedTable
    parents: KeyedTable
    paths: KeyedTable
    leaves: KeyedTable


def create_store(catalog: DataFrame, edges: DataFrame, paths: DataFrame, folder: str, buckets: int = BUCKETS) -> ContentStore:
    """``catalog`` by cid, ``edges`` (parent_cid, child_cid, first_seen_at, last_seen_at) and ``paths`` (root_cid, path, leaf_cid, depth, mime_hint) both ways."""
    return ContentStore(
        create(catalog, f"{folder}/catalog", "cid", buckets),
        create(edges, f"{folder}/children", "parent_cid", buckets),
        create(edges, f"{folder}/parents", "child_cid", buckets),
        create(paths, f"{folder}/paths", "root_cid", buckets),
        create(paths, f"{folder}/leaves", "leaf_cid", buckets),
    )


def upsert_children(spark: SparkSession, store: ContentStore, links: DataFrame, now: int) -> None:
    """M2: ``links`` (child_cid, depth) come to the catalog; its other columns stay, and are null for new items."""
    state = ["present", "present_source", "last_seen_at", "expand_depth", "removed_at"]

    def merged(old: DataFrame) -> DataFrame:
        rest = old.drop(*state)
        return merge.upsert_children(old.select("cid", *state), links, now).join(rest, "cid", "left")

    change(spark, store.catalog, links.select("child_cid"), merged)


def upsert_edges(spark: SparkSession, store: ContentStore, edges: DataFrame) -> None:
    """M3, by parent and by child."""
    new = kept(edges.select("parent_cid", "child_cid", "first_seen_at", "last_seen_at"), "edges")
    for table in (store.children, store.parents):
        change(spark, table, new.select(table.by), lambda old: merge.upsert_edges(old, new))


def prune_edges(spark: SparkSession, store: ContentStore, listing: DataFrame, now: int) -> None:
    """M5: what listed parents have lost goes from both sides; expanded items without a parent left are no longer present."""
    listed = listing.select("parent_cid", "child_cid").distinct()
    before = rows_of(spark, store.children, listed)
    gone = before.join(merge.prune_edges(before, listed).select("parent_cid", "child_cid"), ["parent_cid", "child_cid"], "left_anti")
    gone = kept(gone.select("parent_cid", "child_cid"), "gone")
    for table in (store.children, store.parents):
        change(spark, table, gone.select(table.by), lambda old: old.join(gone, ["parent_cid", "child_cid"], "left_anti"))
    lost = gone.select("child_cid").distinct()
    left = rows_of(spark, store.parents, lost)
    lost = kept(lost.join(left.select("child_cid"), "child_cid", "left_anti"), "lost")
    change(spark, store.catalog, lost, lambda old: merge.flip_orphans(old, lost, lost.limit(0), now))


def upsert_paths(spark: SparkSession, store: ContentStore, new: DataFrame) -> None:
    """M4, by root and by leaf: a path that has got another leaf leaves the old one's rows."""
    key = ["root_cid", "path"]
    new = kept(new.select(*key, "leaf_cid", "depth", "mime_hint"), "new")
    old = kept(rows_of(spark, store.paths, new).join(new.select(*key), key, "left_semi"), "old")
    now = kept(merge.upsert_paths(old, new), "now")
    replaced = lambda rows: rows.join(now.select(*key), key, "left_anti").unionByName(now)
    change(spark, store.paths, new.select("root_cid"), replaced)
    leaves = old.select("leaf_cid").unionByName(now.select("leaf_cid"))
    change(spark, store.leaves, leaves, replaced)
