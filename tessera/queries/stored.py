"""Stored tables: the catalog, edges and paths by their keys, the token index in segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera import storage
from tessera.functions import text
from tessera.operators import graph, index
from tessera.plans import search
from tessera.queries.activity import LATEST
from tessera.queries.merges import BASE, NOW, state
from tessera.queries.relational import POLICY, TOKENS
from tessera.queries.texts import DOC_TEXTS, HISTOGRAM, index_path, stored_counts, stored_tokens
from tessera.registry import query
from tessera.sources import content_store, day_states, segments, token_index
from tessera.sources.keyed import create, rows_of, stored_rows

BUCKETS = 16
LINKED = "linked AS (SELECT parent_cid, cid AS child_cid, place, 100 + place AS first_seen_at, 200 + place AS last_seen_at FROM listings)"
#: Edges after M3 and M5: the second place of every other parent is no longer listed.
STEPPED = f"""{LINKED}, old AS (SELECT * FROM linked WHERE place <= 3), new AS (SELECT parent_cid, child_cid, place, first_seen_at - 50 AS first_seen_at, last_seen_at + 50 AS last_seen_at FROM linked WHERE place >= 2),
  up AS (SELECT parent_cid, child_cid, place, CAST(min(first_seen_at) AS BIGINT) AS first_seen_at, CAST(max(last_seen_at) AS BIGINT) AS last_seen_at FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL),
  stepped AS (SELECT * FROM up WHERE NOT (place = 2 AND CAST(substr(parent_cid, 5) AS BIGINT) % 16 = 0))"""


def linked(spark, d):
    return b.listings(spark, d).select(
        "parent_cid", F.col("cid").alias("child_cid"), "place", (F.lit(100) + F.col("place")).cast("bigint").alias("first_seen_at"), (F.lit(200) + F.col("place")).cast("bigint").alias("last_seen_at")
    )


def stepped_store(spark, d):
    """A store of the items and their links after an upsert of edges and a prune."""
    links = linked(spark, d)
    store = content_store.create_store(state(spark, d), links.filter("place <= 3").drop("place"), b.paths(spark, d), storage.new_folder(spark, "store"), BUCKETS)
    again = links.filter("place >= 2").withColumns({"first_seen_at": F.col("first_seen_at") - 50, "last_seen_at": F.col("last_seen_at") + 50})
    content_store.upsert_edges(spark, store, again)
    listed = links.filter("place <> 2").filter(F.substring("parent_cid", 5, 20).cast("bigint") % 16 == 0)
    content_store.prune_edges(spark, store, listed, NOW)
    return store


@query(
    "s9_m3_m5_edges",
    b.with_frames("listings", f", {STEPPED} SELECT side, parent_cid, child_cid, first_seen_at, last_seen_at FROM stepped, (VALUES ('parent'), ('child')) s(side)"),
)
def s9_edges(spark, d):
    store = stepped_store(spark, d)
    sides = [stored_rows(spark, t).withColumn("side", F.lit(side)) for t, side in ((store.children, "parent"), (store.parents, "child"))]
    return sides[0].unionByName(sides[1]).select("side", "parent_cid", "child_cid", "first_seen_at", "last_seen_at")


@query(
    "s9_m5_orphans",
    f"""{BASE}, listings AS ({b.SQL['listings']}), {STEPPED}, lost AS (SELECT child_cid FROM up EXCEPT SELECT child_cid FROM stepped)
  SELECT cid, present AND NOT (child_cid IS NOT NULL AND present_source = 'expanded') AS present, CASE WHEN child_cid IS NOT NULL AND present_source = 'expanded' THEN {NOW} ELSE removed_at END AS removed_at
  FROM state LEFT JOIN lost ON child_cid = cid""",
)
def s9_orphans(spark, d):
    return stored_rows(spark, stepped_store(spark, d).catalog).select("cid", "present", "removed_at")


@query(
    "s9_j11_stored",
    b.with_frames("listings", f""", {STEPPED}, c AS (SELECT parent_cid, child_cid, row_number() OVER (PARTITION BY parent_cid ORDER BY last_seen_at DESC, child_cid) AS r FROM stepped WHERE CAST(substr(parent_cid, 5) AS BIGINT) % 24 = 0)
  SELECT 'children' AS side, parent_cid, child_cid FROM c WHERE r <= 2 UNION ALL SELECT 'parents', parent_cid, child_cid FROM stepped WHERE CAST(substr(child_cid, 5) AS BIGINT) % 10 = 4"""),
)
def s9_j11(spark, d):
    store = stepped_store(spark, d)
    docs = b.table(spark, d, "documents").select("doc_id", b.tagged("doc-", "doc_id").alias("cid"))
    below = graph.top_children(rows_of(spark, store.children, docs.filter("doc_id % 24 = 0").select("cid")), "last_seen_at", 2)
    # children may stand behind the last document
    asked = linked(spark, d).filter(F.substring("child_cid", 5, 20).cast("bigint") % 10 == 4).select("child_cid")
    above = rows_of(spark, store.parents, asked)
    return below.select(F.lit("children").alias("side"), "parent_cid", "child_cid").unionByName(above.select(F.lit("parents").alias("side"), "parent_cid", "child_cid"))


M2 = f"""links AS (SELECT 'doc-' || l_partkey AS child_cid, l_linenumber AS depth FROM lineitem), f AS (SELECT child_cid AS cid, min(depth) AS depth FROM links GROUP BY 1),
  merged AS (SELECT cid, CASE WHEN depth IS NOT NULL THEN true ELSE present END AS present, CASE WHEN depth IS NOT NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at,
    CAST(least(expand_depth, depth) AS INTEGER) AS expand_depth, first_seen_at FROM state FULL JOIN f USING (cid))"""


@query(
    "s9_m2_s8_lookup",
    f"""{BASE}, {M2}, q AS (SELECT 'ask-' || doc_id AS q, unnest(['gone-' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE 'x' || doc_id END, 'doc-' || (doc_id // 2)]) AS cid, unnest([0, 1, 2]) AS o FROM documents WHERE doc_id % 20 = 0)
  SELECT q, cid, present, last_seen_at, expand_depth, first_seen_at FROM (SELECT q, arg_min(cid, o) AS cid FROM q JOIN merged USING (cid) GROUP BY q) JOIN merged USING (cid)""",
)
def s9_lookup(spark, d):
    empty = linked(spark, d).drop("place").limit(0)
    store = content_store.create_store(state(spark, d), empty, b.paths(spark, d).limit(0), storage.new_folder(spark, "store"), BUCKETS)
    links = b.table(spark, d, "lineitem").select(b.tagged("doc-", "l_partkey").alias("child_cid"), F.col("l_linenumber").alias("depth"))
    content_store.upsert_children(spark, store, links, NOW)
    i = F.col("doc_id")
    second = F.when(i % 3 == 0, b.tagged("doc-", "doc_id")).otherwise(b.tagged("x", "doc_id"))
    spelled = F.array(b.tagged("gone-", "doc_id"), second, F.concat(F.lit("doc-"), F.floor(i / 2).cast("bigint").cast("string")))
    asked = b.table(spark, d, "documents").filter("doc_id % 20 = 0").select(b.tagged("ask-", "doc_id").alias("q"), spelled.alias("variants"))
    rows = rows_of(spark, store.catalog, asked.select(F.explode("variants").alias("cid")))
    return search.lookup(asked, rows).join(rows, "cid").select("q", "cid", "present", "last_seen_at", "expand_depth", "first_seen_at")


@query(
    "s9_m4_paths",
    b.with_frames("paths", """, n AS (SELECT root_cid, path, 'moved-' || leaf_cid AS leaf_cid, depth + 1 AS depth, CAST(NULL AS VARCHAR) AS mime_hint FROM paths WHERE leaf_cid LIKE '%4'
    UNION ALL SELECT root_cid, path || '.bak', leaf_cid, depth, 'text/plain' FROM paths WHERE leaf_cid LIKE '%7')
  SELECT side, root_cid, path, coalesce(n.leaf_cid, o.leaf_cid) AS leaf_cid, CAST(coalesce(n.depth, o.depth) AS INTEGER) AS depth, coalesce(n.mime_hint, o.mime_hint) AS mime_hint
  FROM paths o FULL JOIN n USING (root_cid, path), (VALUES ('root'), ('leaf')) s(side)"""),
)
def s9_paths(spark, d):
    old = b.paths(spark, d)
    moved = old.filter("leaf_cid LIKE '%4'").select(
        "root_cid", "path", F.concat(F.lit("moved-"), "leaf_cid").alias("leaf_cid"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("mime_hint")
    )
    copies = old.filter("leaf_cid LIKE '%7'").withColumns({"path": F.concat("path", F.lit(".bak")), "mime_hint": F.lit("text/plain")})
    store = content_store.create_store(state(spark, d).limit(0), linked(spark, d).drop("place").limit(0), old, storage.new_folder(spark, "store"), BUCKETS)
    content_store.upsert_paths(spark, store, moved.unionByName(copies))
    sides = [stored_rows(spark, t).withColumn("side", F.lit(side)) for t, side in ((store.paths, "root"), (store.leaves, "leaf"))]
    return sides[0].unionByName(sides[1])


@query(
    "s9_q9_stored_hits",
    b.with_frames("items listings", """, asked AS (SELECT cid AS q FROM items WHERE CAST(substr(cid, 5) AS BIGINT) % 16 < 3), kids AS (SELECT parent_cid, cid AS child_cid, row_number() OVER (PARTITION BY parent_cid ORDER BY cid) AS n FROM listings),
  e AS (SELECT k.parent_cid AS cid, arg_min(l.name, k.n * 1000 + length(l.name)) AS entry_path FROM kids k JOIN listings l ON l.parent_cid = k.parent_cid AND l.cid = k.child_cid AND l.name LIKE '%.html' WHERE n <= 20 GROUP BY 1),
  p AS (SELECT DISTINCT parent_cid AS cid FROM listings)
  SELECT q, i.cid, CASE WHEN is_directory OR p.cid IS NOT NULL THEN entry_path IS NOT NULL ELSE coalesce(ext_guess = 'html', false) END AS is_site,
    CASE WHEN is_directory OR p.cid IS NOT NULL THEN entry_path END AS entry_path FROM asked JOIN items i ON i.cid = q LEFT JOIN e ON e.cid = i.cid LEFT JOIN p ON p.cid = i.cid"""),
)
def s9_q9(spark, d):
    folder, items, links = storage.new_folder(spark, "store"), b.items(spark, d), b.listings(spark, d)
    catalog = create(items, f"{folder}/catalog", "cid", BUCKETS)
    children = create(linked(spark, d).drop("place"), f"{folder}/children", "parent_cid", BUCKETS)
    paths = create(links.select(F.col("parent_cid").alias("root_cid"), F.col("name").alias("path"), F.col("cid").alias("leaf_cid")), f"{folder}/paths", "root_cid", BUCKETS)
    asked = b.table(spark, d, "documents").filter("doc_id % 16 < 3").select(b.tagged("doc-", "doc_id").alias("q"), F.array(b.tagged("doc-", "doc_id")).alias("variants"))
    keys = asked.select("q")
    return search.direct_hits(asked, rows_of(spark, catalog, keys), rows_of(spark, children, keys), rows_of(spark, paths, keys))


@query(
    "s9_j2_stored_search",
    f"""WITH catalog AS ({b.SQL['catalog']}), paths AS ({b.SQL['paths']}), {DOC_TEXTS}, {HISTOGRAM}
  SELECT cid, matched_tokens, token_score, kind, root_cid, path FROM (SELECT cid, count(*) AS matched_tokens, CAST(sum(least("count", 50)) AS BIGINT) AS token_score FROM tokens WHERE {' OR '.join(f"starts_with(token, '{t}')" for t in TOKENS)} GROUP BY cid)
  JOIN catalog USING (cid) LEFT JOIN (SELECT leaf_cid AS cid, min(root_cid) AS root_cid, min(path) AS path FROM paths GROUP BY 1) USING (cid) WHERE {POLICY}""",
)
def s9_search(spark, d):
    folder = storage.new_folder(spark, "store")
    catalog, leaves = create(b.catalog(spark, d), f"{folder}/catalog", "cid", BUCKETS), create(b.paths(spark, d), f"{folder}/leaves", "leaf_cid", BUCKETS)
    matched = storage.kept(index.matches(stored_tokens(spark, d), TOKENS), "matched")
    hits = matched.join(rows_of(spark, catalog, matched.select("cid")).filter(index.policy()), "cid")
    hits = hits.join(index.first_paths(rows_of(spark, leaves, matched.select("cid"))), "cid", "left")
    return hits.select("cid", "matched_tokens", "token_score", "kind", "root_cid", "path")


@query("s9_build_index", f'WITH {DOC_TEXTS}, {HISTOGRAM} SELECT cid, token, "count" FROM tokens')
def s9_build(spark, d):
    path = storage.new_folder(spark, "index")
    token_index.write(text.index_tokens(stored_counts(spark, d), "cid"), path)
    return token_index.read(spark, path)


@query(
    "s9_m6_stored_index",
    f"""WITH {DOC_TEXTS}, {HISTOGRAM} SELECT cid, token, "count" FROM tokens WHERE CAST(substr(cid, 5) AS BIGINT) % 4 <> 0
  UNION ALL SELECT 'doc-' || doc_id, 'fresh', 7 FROM documents WHERE doc_id % 8 = 0""",
)
def s9(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", b.tagged("doc-", "doc_id").alias("cid"))
    fresh = docs.filter("doc_id % 8 = 0").select("cid", F.lit("fresh").alias("token"), F.lit(7).cast("bigint").alias("count"))
    whole = segments.first_segment(index_path(spark, d))
    return segments.read(spark, segments.replace(spark, whole, fresh, docs.filter("doc_id % 4 = 0"), storage.new_folder(spark, "segment")))


@query(
    "m6_search_segments",
    f"""WITH {DOC_TEXTS}, {HISTOGRAM}, o AS (SELECT *, CAST(substr(cid, 5) AS BIGINT) AS i FROM tokens),
  live AS (SELECT token, cid, "count" FROM o WHERE i % 40 >= 6 UNION ALL SELECT token || 'x', cid, "count" + i % 40 FROM o WHERE i % 40 < 6)
  SELECT cid, count(*) AS matched_tokens, CAST(sum(least("count", 50)) AS BIGINT) AS token_score FROM live WHERE {' OR '.join(f"starts_with(token, '{t}')" for t in TOKENS)} GROUP BY cid""",
)
def m6_search(spark, d):
    """Six crawls, each of a fortieth of the items and again of the one before, then merges as they fall due."""
    found, i = segments.first_segment(index_path(spark, d)), F.substring("cid", 5, 20).cast("bigint") % 40
    old = stored_tokens(spark, d)
    docs = b.table(spark, d, "documents").select(b.tagged("doc-", "doc_id").alias("cid"))
    for k in range(6):
        fresh = old.filter(i.isin(k, k - 1)).withColumns({"token": F.concat("token", F.lit("x")), "count": F.col("count") + i})
        found = segments.replace(spark, found, fresh, docs.filter(i.isin(k, k - 1)), storage.new_folder(spark, "segment"))
        while segments.due(found):
            found = segments.compacted(spark, found, storage.new_folder(spark, "merged"))
    return index.matches(segments.read(spark, found), TOKENS)


def stored_days(spark, d):
    """The accesses as states by day; built from two thirds of the events, into which the rest, of all days, come late."""

    def build(path):
        rows = b.access(spark, d)
        day_states.add(spark, path, rows.filter("event_id % 3 > 0"), old=False)
        day_states.add(spark, path, rows.filter("event_id % 3 = 0"))

    return storage.stored(spark, "days", [f"{d}/events.parquet"], build)


@query(
    "a6_usage_from_days",
    b.with_frames("access", "").rstrip() + f""", {LATEST}, w AS (SELECT CAST(unnest([7, 15, 30]) AS BIGINT) AS d)
  SELECT CAST(d AS INTEGER) AS days, cid, count(*) AS wallets, count(*) FILTER (last_ok) AS ok_wallets, count(*) FILTER (NOT last_ok) AS bad_wallets FROM latest2, w WHERE last_access_at >= {b.RANK_AT} - d * 86400000 GROUP BY ALL""",
)
def a6_days(spark, d):
    found, path = None, stored_days(spark, d)
    for days in (7, 15, 30):
        rows = day_states.usage_from_days(spark, path, b.RANK_AT // b.DAY_MS - days).withColumn("days", F.lit(days))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "a5_wallets_from_days",
    b.with_frames("access", f"SELECT cid, count(DISTINCT wallet) AS wallets FROM access WHERE at_ms // 86400000 BETWEEN {b.RANK_AT // b.DAY_MS - 20} AND {b.RANK_AT // b.DAY_MS - 10} GROUP BY cid"),
)
def a5_days(spark, d):
    return day_states.wallets_from_days(spark, stored_days(spark, d), b.RANK_AT // b.DAY_MS - 20, b.RANK_AT // b.DAY_MS - 10)


@query(
    "w2_activity_from_days",
    b.with_frames("access", """, w AS (SELECT cid, ok, unnest(range((at_ms // 86400000 - 6) * 86400000, (at_ms // 86400000 + 1) * 86400000, 86400000)) AS window_start FROM access)
  SELECT cid, window_start, count(*) AS accesses, count(*) FILTER (ok) AS ok FROM w GROUP BY ALL"""),
)
def w2_days(spark, d):
    return day_states.activity_from_days(spark, stored_days(spark, d))
