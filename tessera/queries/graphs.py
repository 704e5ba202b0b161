"""Graph walks, path indexes, entry pages and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import graph, sites
from tessera.registry import query

REACH = """WITH RECURSIVE edges AS ({edges}), walk(owner, cid) AS (SELECT cid, cid FROM (VALUES ('R0'), ('R1'), ('C5'), ('none')) t(cid)
  UNION SELECT owner, child_cid FROM walk JOIN edges ON cid = parent_cid)"""


def asked_roots(spark):
    return spark.sql("SELECT cid AS owner, cid FROM VALUES ('R0'), ('R1'), ('C5'), ('none') AS t(cid)")


@query("g1_reachable", REACH.format(edges=b.SQL["edges"]) + " SELECT owner, cid FROM walk")
def g1(spark, d):
    return graph.reachable(asked_roots(spark), b.edges(spark, d))


@query("g1_reachable_count", REACH.format(edges=b.SQL["edges"]) + " SELECT owner, least(count(*), 10000) AS nodes, count(*) > 10000 AS truncated FROM walk GROUP BY 1")
def g1_count(spark, d):
    return graph.reachable_counts(asked_roots(spark), b.edges(spark, d))


LISTED = """listing AS (SELECT parent_cid, child_cid AS cid, CASE WHEN child_cid[1] IN ('N', 'C') THEN lower(child_cid) ELSE lower(child_cid) || '.html' END AS name,
    CASE WHEN child_cid[1] IN ('N', 'C') THEN 'dir' ELSE 'file' END AS type, CAST(length(child_cid) AS BIGINT) AS size FROM edges)"""


def listing(spark, d):
    child = F.col("child_cid")
    is_dir = F.substring(child, 1, 1).isin("N", "C")
    return b.edges(spark, d).select(
        "parent_cid",
        child.alias("cid"),
        F.when(is_dir, F.lower(child)).otherwise(F.concat(F.lower(child), F.lit(".html"))).alias("name"),
        F.when(is_dir, "dir").otherwise("file").alias("type"),
        F.length(child).cast("bigint").alias("size"),
    )


@query(
    "g2_path_index",
    f"""WITH edges AS ({b.SQL['edges']}), {LISTED}, l1 AS (SELECT parent_cid AS root_cid, cid, type, name AS path, 1 AS depth FROM listing WHERE parent_cid IN ('R0', 'R1')),
  l2 AS (SELECT root_cid, l.cid, l.type, path || '/' || name AS path, 2 AS depth FROM l1 JOIN listing l ON l1.cid = l.parent_cid AND l1.type = 'dir'),
  l3 AS (SELECT root_cid, l.cid, l.type, path || '/' || name AS path, 3 AS depth FROM l2 JOIN listing l ON l2.cid = l.parent_cid AND l2.type = 'dir'),
  f AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
  SELECT root_cid, path, cid AS leaf_cid, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY root_cid ORDER BY depth, path) AS r FROM f WHERE type = 'file') WHERE r <= 1000""",
)
def g2(spark, d):
    roots = spark.sql("SELECT * FROM VALUES ('R0'), ('R1') AS t(cid)")
    return graph.path_index(listing(spark, d), roots, max_depth=3)


@query(
    "j11_top_children",
    b.with_frames("edges", "SELECT parent_cid, child_cid, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY parent_cid ORDER BY last_seen_at DESC, child_cid) AS r FROM (SELECT *, CAST(length(child_cid) AS INTEGER) AS last_seen_at FROM edges)) WHERE r <= 5"),
)
def j11(spark, d):
    rows = b.edges(spark, d).withColumn("last_seen_at", F.length("child_cid"))
    return graph.top_children(rows, "last_seen_at", 5)


@query(
    "j11_top_parents",
    b.with_frames("edges", "SELECT child_cid, parent_cid FROM (SELECT *, row_number() OVER (PARTITION BY child_cid ORDER BY parent_cid) AS r FROM edges) WHERE r <= 3"),
)
def j11_parents(spark, d):
    flipped = b.edges(spark, d).select(F.col("child_cid").alias("parent_cid"), F.col("parent_cid").alias("child_cid"), F.lit(0).alias("seen"))
    return graph.top_children(flipped, "seen", 3).select(F.col("parent_cid").alias("child_cid"), F.col("child_cid").alias("parent_cid"))


ENTRY = """500 + CASE WHEN p IN ('index.html', 'index.htm', 'index.xhtml') THEN 2000 ELSE 0 END + CASE WHEN regexp_matches(p, '/index\\.(html|htm|xhtml)$') THEN 1500 ELSE 0 END
  + CASE WHEN p = 'home.html' OR p LIKE '%/home.html' THEN 1200 ELSE 0 END + CASE WHEN p = 'default.html' OR p LIKE '%/default.html' THEN 1100 ELSE 0 END
  - len(string_split(p, '/')) - least(length(p), 256) / 128.0"""


@query(
    "t5_entry_pages",
    b.with_frames("paths", f""", s AS (SELECT root_cid, path, leaf_cid, {ENTRY} AS score, row_number() OVER (PARTITION BY root_cid ORDER BY depth, length(path), path) AS near
    FROM (SELECT *, lower(path) AS p FROM paths) WHERE depth <= 2 AND regexp_matches(p, '^.+\\.(html|htm|xhtml)$'))
  SELECT root_cid, path, leaf_cid, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY root_cid ORDER BY score DESC, near) AS b FROM s WHERE near <= 500) WHERE b = 1"""),
)
def t5(spark, d):
    return graph.entry_pages(b.paths(spark, d))


@query(
    "t6_listing_entries",
    f"""WITH edges AS ({b.SQL['edges']}), {LISTED} SELECT parent_cid, cid, name, 80 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_cid ORDER BY size DESC, name) AS f FROM listing WHERE name LIKE '%.html') WHERE f = 1""",
)
def t6(spark, d):
    return graph.listing_entries(listing(spark, d))


@query(
    "p28_domain_match",
    b.with_frames("domain_records", """SELECT DISTINCT domain, CAST(round(0.8 * least((CASE WHEN contains(l, 'nation') THEN 6 ELSE 0 END + CASE WHEN contains(l, 'web') THEN 3 ELSE 0 END) / greatest(length(l), 1), 1.0)
    + 0.2 * CASE WHEN e IN ('nation', 'web') THEN 1 ELSE 0 END, 6) AS DOUBLE) AS score FROM (SELECT domain, split_part(domain, '.', 1) AS l, split_part(domain, '.', 2) AS e FROM domain_records)"""),
)
def p28(spark, d):
    domains = b.domain_records(spark, d).select("domain").distinct()
    return domains.select("domain", F.round(sites.domain_match(F.col("domain"), ["nation", "web"]), 6).alias("score"))


CANDIDATES = "cand AS (SELECT 'P' || p_partkey AS cid, round(p_retailprice % 97, 2) AS score FROM part WHERE p_partkey % 3 = 0)"


def candidates(spark, d):
    parts = b.table(spark, d, "part").filter("p_partkey % 3 = 0")
    return parts.select(b.tagged("P", "p_partkey").alias("cid"), F.round(F.col("p_retailprice") % 97, 2).alias("score"))
