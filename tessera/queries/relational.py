"""Catalog, index and path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import index
from tessera.plans import search
from tessera.queries.texts import DOC_TEXTS, HISTOGRAM, stored_tokens
from tessera.registry import query

TOKENS = ("enan", "her")
POLICY = "(mime IS NULL OR mime <> 'application/octet-stream') AND kind IN (" + ", ".join(f"'{k}'" for k in index.KINDS) + ")"
MATCHES = f"""{DOC_TEXTS}, {HISTOGRAM},
  matches AS (SELECT cid, count(*) AS matched_tokens, CAST(sum(least("count", 50)) AS BIGINT) AS token_score FROM tokens
    WHERE starts_with(token, 'enan') OR starts_with(token, 'her') GROUP BY cid),
  first_paths AS (SELECT leaf_cid AS cid, min(root_cid) AS root_cid, min(path) AS path, min(mime_hint) AS path_mime_hint FROM paths GROUP BY 1)"""
HIT = "cid, matched_tokens, token_score, kind, mime, size_bytes, present, present_source, last_seen_at, root_cid, path, path_mime_hint"


@query("a1_token_matches", f"WITH paths AS ({b.SQL['paths']}), {MATCHES} SELECT cid, matched_tokens, token_score FROM matches")
def a1(spark, d):
    return index.matches(stored_tokens(spark, d), TOKENS)


@query("f6_prefix_rows", f"WITH {DOC_TEXTS}, {HISTOGRAM} SELECT cid, token, \"count\" FROM tokens WHERE starts_with(token, 'enan') OR starts_with(token, 'her')")
def f6(spark, d):
    return stored_tokens(spark, d).filter(index.prefix_match(TOKENS))


@query(
    "j1_search_total",
    f"WITH paths AS ({b.SQL['paths']}), catalog AS ({b.SQL['catalog']}), {MATCHES} SELECT count(*) AS total FROM matches JOIN catalog USING (cid) WHERE {POLICY}",
)
def j1(spark, d):
    hits = index.matches(stored_tokens(spark, d), TOKENS).join(b.catalog(spark, d).filter(index.policy()), "cid")
    return hits.agg(F.count(F.lit(1)).alias("total"))


@query(
    "j2_search_tokens",
    f"""WITH paths AS ({b.SQL['paths']}), catalog AS ({b.SQL['catalog']}), {MATCHES}
  SELECT {HIT} FROM matches JOIN catalog USING (cid) LEFT JOIN first_paths USING (cid) WHERE {POLICY}
  ORDER BY matched_tokens DESC, token_score DESC, last_seen_at DESC NULLS LAST, cid LIMIT 50""",
)
def j2(spark, d):
    hits = index.search(stored_tokens(spark, d), b.catalog(spark, d), b.paths(spark, d), TOKENS)
    return index.ranked_page(hits.select(*HIT.split(", ")))


@query(
    "j3_recency_feed",
    f"""WITH paths AS ({b.SQL['paths']}), catalog AS ({b.SQL['catalog']}),
  first_paths AS (SELECT leaf_cid AS cid, min(root_cid) AS root_cid, min(path) AS path, min(mime_hint) AS path_mime_hint FROM paths GROUP BY 1)
  SELECT * FROM catalog LEFT JOIN first_paths USING (cid) WHERE {POLICY} ORDER BY last_seen_at DESC NULLS LAST, cid LIMIT 50 OFFSET 20""",
)
def j3(spark, d):
    return index.ranked_page(index.feed(b.catalog(spark, d), b.paths(spark, d)), offset=20, by_match=False)


@query("f1_f2_policy", b.with_frames("catalog", f"SELECT cid, kind, mime FROM catalog WHERE {POLICY}"))
def f1(spark, d):
    return b.catalog(spark, d).filter(index.policy()).select("cid", "kind", "mime")


@query(
    "f3_f4_filters",
    b.with_frames("catalog", "SELECT cid, kind, present_source, present FROM catalog WHERE kind = 'text' AND present_source = 'expanded' AND present"),
)
def f3(spark, d):
    rows = index.equality_filters(b.catalog(spark, d), kind="text", mime=None, present_source="expanded")
    return index.flag_filters(rows, present="1").select("cid", "kind", "present_source", "present")


@query(
    "f5_tag_compat",
    b.with_frames("catalog", """SELECT cid, list_contains(tags, 'kind:text') AS exact, tags_json ILIKE '%"KIND:text"%' AS compat FROM (
  SELECT cid, ['kind:' || kind, 'source:' || present_source] AS tags, '{"tags":["kind:' || kind || '","source:' || present_source || '"]}' AS tags_json FROM catalog)"""),
)
def f5(spark, d):
    tags = F.array(F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("source:"), "present_source"))
    rows = b.catalog(spark, d).select("cid", tags.alias("tags")).withColumn("tags_json", F.to_json(F.struct("tags")))
    return rows.select(
        "cid", index.has_tag("tags_json", "kind:text", exact=True).alias("exact"), index.has_tag("tags_json", "KIND:text").alias("compat")
    )


@query("a2_totals", b.with_frames("catalog", "SELECT count(*) AS total, count(*) FILTER (present) AS present FROM catalog"))
def a2(spark, d):
    return b.catalog(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if("present").alias("present"))


@query(
    "a3_first_paths",
    b.with_frames("paths", "SELECT leaf_cid AS cid, min(root_cid) AS root_cid, min(path) AS path, min(mime_hint) AS path_mime_hint FROM paths GROUP BY 1"),
)
def a3(spark, d):
    return index.first_paths(b.paths(spark, d))


@query(
    "j8_token_exists",
    f"""WITH {DOC_TEXTS}, {HISTOGRAM}, asked(q) AS (VALUES ('enan'), ('her'), ('zzzz'))
  SELECT q, EXISTS (SELECT 1 FROM tokens WHERE starts_with(token, q)) AS found FROM asked""",
)
def j8(spark, d):
    asked = spark.sql("SELECT * FROM VALUES ('enan'), ('her'), ('zzzz') AS t(q)")
    hit = search.has_signal(asked.select(F.col("q").alias("id"), F.array("q").alias("tokens")), stored_tokens(spark, d))
    return asked.join(hit.withColumn("found", F.lit(True)), asked.q == hit.id, "left").select("q", F.coalesce("found", F.lit(False)).alias("found"))


@query("t7_recency_sort", b.with_frames("catalog", "SELECT cid, coalesce(last_seen_at, 0) AS activity_at FROM catalog ORDER BY 2 DESC, 1 LIMIT 200"))
def t7(spark, d):
    rows = b.catalog(spark, d).select("cid", F.coalesce("last_seen_at", F.lit(0)).cast("bigint").alias("activity_at"))
    return rows.orderBy(F.desc("activity_at"), "cid").limit(200)


@query(
    "t12_scan_cap",
    b.with_frames("catalog", f"""SELECT kind, cid, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY last_seen_at DESC NULLS LAST, cid) AS r
  FROM catalog WHERE {POLICY}) WHERE r <= 120"""),
)
def t12(spark, d):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc_nulls_last("last_seen_at"), "cid"))
    rows = b.catalog(spark, d).filter(index.policy()).withColumn("r", rank)
    return rows.filter("r <= 120").select("kind", "cid", "last_seen_at")
