"""Merges over the bound frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import merge
from tessera.registry import query

NOW = b.RANK_AT
STATE = """state AS (SELECT cid, present, present_source, 1704067200000 AS first_seen_at, last_seen_at, CASE WHEN present THEN NULL ELSE 1704067300000 END AS removed_at,
    CAST(CASE WHEN size_bytes % 4 = 0 THEN size_bytes % 5 END AS INTEGER) AS expand_depth FROM catalog)"""
SNAP = "snap AS (SELECT 'doc-' || doc_id AS cid FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT 'new-' || doc_id FROM documents WHERE doc_id % 50 = 0)"
BASE = f"WITH catalog AS ({b.SQL['catalog']}), {STATE}, {SNAP}"


def state(spark, d):
    depth = F.when(F.col("size_bytes") % 4 == 0, F.col("size_bytes") % 5).cast("int")
    removed = F.when(~F.col("present"), F.lit(1_704_067_300_000)).cast("bigint")
    rows = b.catalog(spark, d)
    return rows.select(
        "cid", "present", "present_source", F.lit(b.EPOCH_2024).alias("first_seen_at"), "last_seen_at", removed.alias("removed_at"), depth.alias("expand_depth")
    )


def snapshot(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id")
    return docs.filter("doc_id % 7 <> 0").select(b.tagged("doc-", "doc_id").alias("cid")).unionByName(
        docs.filter("doc_id % 50 = 0").select(b.tagged("new-", "doc_id").alias("cid"))
    )


@query(
    "j10_snapshot_diff",
    f"{BASE} SELECT cid, CASE WHEN s.cid IS NULL THEN 'new' WHEN n.cid IS NULL THEN 'gone' ELSE 'kept' END AS change FROM state s FULL JOIN snap n USING (cid)",
)
def j10(spark, d):
    return merge.snapshot_diff(state(spark, d), snapshot(spark, d))


@query(
    "m1_pin_sync",
    f"""{BASE} SELECT cid,
  CASE WHEN n.cid IS NOT NULL THEN true WHEN s.present AND s.present_source = 'pinls' THEN false ELSE s.present END AS present,
  CASE WHEN n.cid IS NOT NULL THEN 'pinls' ELSE s.present_source END AS present_source,
  CASE WHEN s.cid IS NOT NULL THEN s.first_seen_at ELSE {NOW} END AS first_seen_at,
  CASE WHEN n.cid IS NOT NULL THEN {NOW} ELSE s.last_seen_at END AS last_seen_at,
  CASE WHEN n.cid IS NOT NULL THEN NULL WHEN s.present AND s.present_source = 'pinls' THEN {NOW} ELSE s.removed_at END AS removed_at
  FROM state s FULL JOIN snap n USING (cid)""",
)
def m1(spark, d):
    return merge.sync_pins(state(spark, d), snapshot(spark, d), NOW)


@query("j9_pins_gone", f"{BASE} SELECT cid FROM state WHERE present AND present_source = 'pinls' AND cid NOT IN (SELECT cid FROM snap)")
def j9(spark, d):
    rows = state(spark, d).filter("present AND present_source = 'pinls'")
    return rows.join(snapshot(spark, d), "cid", "left_anti").select("cid")


LINKS = "links AS (SELECT 'doc-' || l_partkey AS child_cid, l_linenumber AS depth FROM lineitem)"


@query(
    "m2_child_upsert",
    f"""{BASE}, {LINKS}, f AS (SELECT child_cid AS cid, min(depth) AS depth FROM links GROUP BY 1)
  SELECT cid, CASE WHEN depth IS NOT NULL THEN true ELSE present END AS present,
    CASE WHEN depth IS NOT NULL THEN coalesce(present_source, 'expanded') ELSE present_source END AS present_source,
    CASE WHEN depth IS NOT NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at,
    CAST(least(expand_depth, depth) AS INTEGER) AS expand_depth, CASE WHEN depth IS NULL THEN removed_at END AS removed_at
  FROM state FULL JOIN f USING (cid)""",
)
def m2(spark, d):
    links = b.table(spark, d, "lineitem").select(b.tagged("doc-", "l_partkey").alias("child_cid"), F.col("l_linenumber").alias("depth"))
    return merge.upsert_children(state(spark, d), links, NOW)


EDGE_ROWS = "SELECT parent_cid, child_cid, 100 + length(child_cid) AS first_seen_at, 200 + length(parent_cid) AS last_seen_at FROM edges"


def edge_rows(spark, d, offset=0):
    return b.edges(spark, d).select(
        "parent_cid", "child_cid", (100 + offset + F.length("child_cid")).cast("bigint").alias("first_seen_at"), (200 + offset + F.length("parent_cid")).cast("bigint").alias("last_seen_at")
    )


@query(
    "m3_edge_upsert",
    b.with_frames("edges", f""", o AS ({EDGE_ROWS} WHERE child_cid NOT LIKE '%3'), n AS (SELECT parent_cid, child_cid, first_seen_at - 50 AS first_seen_at, last_seen_at - 50 AS last_seen_at FROM ({EDGE_ROWS}) WHERE child_cid NOT LIKE '%5')
  SELECT parent_cid, child_cid, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY ALL"""),
)
def m3(spark, d):
    old = edge_rows(spark, d).filter("child_cid NOT LIKE '%3'")
    return merge.upsert_edges(old, edge_rows(spark, d, -50).filter("child_cid NOT LIKE '%5'"))


@query(
    "m4_path_upsert",
    b.with_frames("paths", """, n AS (SELECT root_cid, path, 'moved-' || leaf_cid AS leaf_cid, depth + 1 AS depth, CAST(NULL AS VARCHAR) AS mime_hint FROM paths WHERE leaf_cid LIKE '%4'
    UNION ALL SELECT root_cid, path || '.bak', leaf_cid, depth, 'text/plain' FROM paths WHERE leaf_cid LIKE '%7')
  SELECT root_cid, path, coalesce(n.leaf_cid, o.leaf_cid) AS leaf_cid, CAST(coalesce(n.depth, o.depth) AS INTEGER) AS depth, coalesce(n.mime_hint, o.mime_hint) AS mime_hint
  FROM paths o FULL JOIN n USING (root_cid, path)"""),
)
def m4(spark, d):
    old = b.paths(spark, d)
    moved = old.filter("leaf_cid LIKE '%4'").select(
        "root_cid", "path", F.concat(F.lit("moved-"), "leaf_cid").alias("leaf_cid"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("mime_hint")
    )
    copies = old.filter("leaf_cid LIKE '%7'").withColumns({"path": F.concat("path", F.lit(".bak")), "mime_hint": F.lit("text/plain")})
    return merge.upsert_paths(old, moved.unionByName(copies))


LISTING = "listing AS (SELECT parent_cid, child_cid FROM edges WHERE parent_cid LIKE 'O%' AND child_cid NOT LIKE '%7' AND parent_cid NOT LIKE '%9')"
KEPT = """kept AS (SELECT e.parent_cid, e.child_cid FROM edges e LEFT JOIN (SELECT DISTINCT parent_cid, true AS listed FROM listing) p ON p.parent_cid = e.parent_cid
    LEFT JOIN (SELECT DISTINCT parent_cid, child_cid, true AS kept FROM listing) l ON l.parent_cid = e.parent_cid AND l.child_cid = e.child_cid WHERE listed IS NULL OR kept)"""


def listing(spark, d):
    return b.edges(spark, d).filter("parent_cid LIKE 'O%' AND child_cid NOT LIKE '%7' AND parent_cid NOT LIKE '%9'")


@query("m5_edge_prune", b.with_frames("edges", f", {LISTING}, {KEPT} SELECT parent_cid, child_cid FROM kept"))
def m5(spark, d):
    return merge.prune_edges(b.edges(spark, d), listing(spark, d))


@query("m5_orphans", b.with_frames("edges", f", {LISTING}, {KEPT} SELECT child_cid FROM edges EXCEPT SELECT child_cid FROM kept"))
def m5_orphans(spark, d):
    edges = b.edges(spark, d)
    return merge.orphans(edges, merge.prune_edges(edges, listing(spark, d)))


@query(
    "m6_token_replace",
    """WITH o AS (SELECT 'd' || doc_id AS cid, lang AS token, 1 AS n FROM documents), f AS (SELECT 'd' || doc_id AS cid, source AS token, 2 AS n FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0)
  SELECT cid, token, n FROM o WHERE CAST(substr(cid, 2) AS BIGINT) % 3 <> 0 UNION ALL SELECT * FROM f""",
)
def m6(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", "lang", "source", b.tagged("d", "doc_id").alias("cid"))
    old = docs.select("cid", F.col("lang").alias("token"), F.lit(1).alias("n"))
    fresh = docs.filter("doc_id % 6 = 0").select("cid", F.col("source").alias("token"), F.lit(2).alias("n"))
    return merge.replace_tokens(old, fresh, docs.filter("doc_id % 3 = 0"))


@query(
    "m8_wallet_upsert",
    """WITH o AS (SELECT 'W' || c_custkey AS wallet, c_mktsegment AS plan_id FROM customer WHERE c_custkey % 3 <> 0),
  n AS (SELECT 'W' || c_custkey AS wallet, CASE WHEN c_custkey % 2 = 0 THEN 'pro' END AS plan_id FROM customer WHERE c_custkey % 5 = 0)
  SELECT wallet, coalesce(n.plan_id, o.plan_id) AS plan_id FROM o FULL JOIN n USING (wallet)""",
)
def m8(spark, d):
    rows = b.table(spark, d, "customer").select("c_custkey", "c_mktsegment", b.tagged("W", "c_custkey").alias("wallet"))
    old = rows.filter("c_custkey % 3 <> 0").select("wallet", F.col("c_mktsegment").alias("plan_id"))
    new = rows.filter("c_custkey % 5 = 0").select("wallet", F.when(F.col("c_custkey") % 2 == 0, "pro").alias("plan_id"))
    return merge.upsert_wallets(old, new)


@query(
    "m9_root_upsert",
    b.with_frames("wallet_roots", """, n AS (SELECT wallet, root_cid, created_at - 5 AS created_at, CASE WHEN bytes_estimated % 2 = 0 THEN bytes_estimated * 2 END AS bytes_estimated
    FROM wallet_roots WHERE root_cid LIKE '%1' UNION ALL SELECT wallet || 'x', root_cid, created_at, bytes_estimated FROM wallet_roots WHERE root_cid LIKE '%22')
  SELECT wallet, root_cid, least(o.created_at, n.created_at) AS created_at, coalesce(n.bytes_estimated, o.bytes_estimated) AS bytes_estimated,
    CASE WHEN n.created_at IS NOT NULL THEN 'active' ELSE o.status END AS status FROM wallet_roots o FULL JOIN n USING (wallet, root_cid)"""),
)
def m9(spark, d):
    old = b.wallet_roots(spark, d)
    again = old.filter("root_cid LIKE '%1'").select(
        "wallet", "root_cid", (F.col("created_at") - 5).alias("created_at"), F.when(F.col("bytes_estimated") % 2 == 0, F.col("bytes_estimated") * 2).alias("bytes_estimated")
    )
    fresh = old.filter("root_cid LIKE '%22'").select(F.concat("wallet", F.lit("x")).alias("wallet"), "root_cid", "created_at", "bytes_estimated")
    return merge.upsert_roots(old, again.unionByName(fresh))


@query(
    "m10_pin_insert",
    b.with_frames("wallet_pins", "SELECT wallet, cid, min(created_at) AS created_at FROM (SELECT * FROM wallet_pins UNION ALL SELECT wallet, cid, created_at - 9 FROM wallet_pins WHERE cid LIKE '%8') GROUP BY ALL"),
)
def m10(spark, d):
    pins = b.wallet_pins(spark, d)
    return merge.insert_pins(pins, pins.filter("cid LIKE '%8'").withColumn("created_at", F.col("created_at") - 9))


@query(
    "m11_rename",
    """WITH o AS (SELECT 'W' || s_nationkey AS wallet, 'P' || s_suppkey AS cid, s_name AS display_name, 10 AS updated_at FROM supplier WHERE s_suppkey % 4 <> 0),
  c AS (SELECT 'W' || s_nationkey AS wallet, 'P' || s_suppkey AS cid, CASE WHEN s_suppkey % 6 = 0 THEN ' ' ELSE 'n' || s_suppkey END AS display_name, 20 AS updated_at FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'W' || s_nationkey, 'P' || s_suppkey, 'late', 30 FROM supplier WHERE s_suppkey % 9 = 0),
  l AS (SELECT wallet, cid, arg_max(display_name, updated_at) AS n_name, max(updated_at) AS n_at FROM c GROUP BY ALL),
  m AS (SELECT wallet, cid, CASE WHEN n_at IS NOT NULL THEN nullif(trim(n_name), '') ELSE display_name END AS display_name, CAST(greatest(n_at, updated_at) AS INTEGER) AS updated_at FROM o FULL JOIN l USING (wallet, cid))
  SELECT * FROM m WHERE display_name IS NOT NULL""",
)
def m11(spark, d):
    rows = b.table(spark, d, "supplier").select("s_suppkey", "s_name", b.tagged("W", "s_nationkey").alias("wallet"), b.tagged("P", "s_suppkey").alias("cid"))
    old = rows.filter("s_suppkey % 4 <> 0").select("wallet", "cid", F.col("s_name").alias("display_name"), F.lit(10).alias("updated_at"))
    name = F.when(F.col("s_suppkey") % 6 == 0, " ").otherwise(b.tagged("n", "s_suppkey"))
    changes = rows.filter("s_suppkey % 3 = 0").select("wallet", "cid", name.alias("display_name"), F.lit(20).alias("updated_at"))
    late = rows.filter("s_suppkey % 9 = 0").select("wallet", "cid", F.lit("late").alias("display_name"), F.lit(30).alias("updated_at"))
    return merge.rename(old, changes.unionByName(late))


@query("m13_retention", b.with_frames("access", f"SELECT cid, wallet, at_ms FROM access WHERE at_ms >= {NOW} - 20 * 86400000"))
def m13(spark, d):
    return b.access(spark, d).filter(F.col("at_ms") >= NOW - 20 * b.DAY_MS).select("cid", "wallet", "at_ms")


@query("m14_repair", f"{BASE} SELECT cid, present, CASE WHEN NOT present THEN removed_at END AS removed_at FROM state")
def m14(spark, d):
    return merge.repair(state(spark, d)).select("cid", "present", "removed_at")


@query("k5_add_columns", "SELECT doc_id, lang, 'none' AS region, CAST(0 AS BIGINT) AS version FROM documents")
def k5(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", "lang")
    return merge.add_missing_columns(rows, {"lang": ("string", "x"), "region": ("string", "none"), "version": ("bigint", 0)})
