"""Crawl candidates, directory rules, expansion and tags of sites over the items frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.functions import detect
from tessera.operators import crawl, graph, merge
from tessera.registry import query

NOW = b.RANK_AT
CUTOFF = b.EPOCH_2024 + 20_000_000


def like(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(tags_json, '')), '{n.lower()}')" for n in needles) + ")"


FAILED = like("doc:epub_parse_failed")


@query(
    "f8_f12_recrawl",
    b.with_frames("items", f"""SELECT cid FROM items WHERE present AND (detector_version IS NULL OR detector_version <> 'v1' OR mime IS NULL OR error IS NOT NULL
  OR (kind = 'text' AND NOT {like('"preview"')}) OR (kind = 'doc' AND {like('"description":"PK')})
  OR (kind = 'doc' AND (ext_guess = 'epub' OR contains(lower(mime), 'epub')) AND NOT {like('doc:epub_text_v2')} AND NOT {FAILED})
  OR (kind = 'doc' AND (tags_json IS NULL OR {like(*crawl.RETRIED)}) AND NOT {FAILED} AND (indexed_at IS NULL OR indexed_at < {CUTOFF})))"""),
)
def f8(spark, d):
    return b.items(spark, d).filter(crawl.needs_crawl("v1", CUTOFF)).select("cid")


@query(
    "f12_json_marks",
    b.with_frames("items", f"SELECT cid, {like('doc:sample')} AS sampled, {FAILED} AS parse_failed, {like('text:head:low_signal')} AS low_signal FROM items"),
)
def f12(spark, d):
    tags = F.col("tags_json")
    marks = {"sampled": "doc:sample", "parse_failed": "doc:epub_parse_failed", "low_signal": "text:head:low_signal"}
    return b.items(spark, d).select("cid", *(crawl.mentions(tags, m).alias(n) for n, m in marks.items()))


UNCLEAR = "coalesce(kind, '') IN ('', 'unknown', 'ipld', 'dag')"


@query(
    "f10_likely_directory",
    b.with_frames("items", f"""SELECT cid, CASE WHEN present_source = 'pinls' AND coalesce(expand_depth, 0) = 0 THEN {UNCLEAR} ELSE {UNCLEAR} OR coalesce(source, '') = '' END AS likely FROM items"""),
)
def f10(spark, d):
    likely = crawl.likely_directory(F.col("kind"), F.col("source"), F.col("present_source"), F.col("expand_depth"))
    return b.items(spark, d).select("cid", likely.alias("likely"))


@query("f11_skip_directory", b.with_frames("items", f"SELECT cid, is_directory AND ({UNCLEAR} OR coalesce(mime, '') = '') AS skipped FROM items"))
def f11(spark, d):
    return b.items(spark, d).select("cid", crawl.skipped_as_directory(F.col("is_directory"), F.col("kind"), F.col("mime")).alias("skipped"))


@query(
    "f9_expand_candidates",
    b.with_frames("items", f"""SELECT cid, expand_depth FROM items WHERE present AND expand_depth < 3
  AND (expanded_at IS NULL OR expanded_at < {b.EPOCH_2024 + 100_000} OR expand_error IS NOT NULL OR (NOT is_directory AND present_source = 'pinls'))
  ORDER BY last_seen_at DESC NULLS LAST, cid LIMIT 50"""),
)
def f9(spark, d):
    return crawl.expansion_candidates(b.items(spark, d), 3, b.EPOCH_2024 + 100_000, 50).select("cid", "expand_depth")


DETECTED = """found AS (SELECT 'doc-' || doc_id AS cid, CASE WHEN doc_id % 5 <> 0 THEN 'text/x' END AS mime, 'x' AS ext_guess, CASE WHEN doc_id % 5 <> 0 THEN 'text' END AS kind,
  0.5::DOUBLE AS confidence, 'probe' AS source, CASE WHEN doc_id % 15 = 0 THEN 'timeout' END AS failure FROM documents WHERE doc_id % 3 = 0)"""


@query(
    "m7_detect_update",
    b.with_frames("items", f""", {DETECTED} SELECT i.cid, CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN f.mime ELSE i.mime END AS mime,
  CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN f.ext_guess ELSE i.ext_guess END AS ext_guess, CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN f.kind ELSE i.kind END AS kind,
  CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN f.confidence ELSE i.confidence END AS confidence, CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN f.source ELSE i.source END AS source,
  CASE WHEN f.cid IS NOT NULL THEN failure ELSE error END AS error, CASE WHEN f.cid IS NOT NULL THEN 'v2' ELSE detector_version END AS detector_version,
  CASE WHEN f.cid IS NOT NULL AND failure IS NULL THEN {NOW} ELSE indexed_at END AS indexed_at FROM items i LEFT JOIN found f ON i.cid = f.cid"""),
)
def m7(spark, d):
    i = F.col("doc_id")
    known = i % 5 != 0
    results = b.table(spark, d, "documents").filter("doc_id % 3 = 0").select(
        b.tagged("doc-", "doc_id").alias("cid"), F.when(known, "text/x").alias("mime"), F.lit("x").alias("ext_guess"), F.when(known, "text").alias("kind"),
        F.lit(0.5).alias("confidence"), F.lit("probe").alias("source"), F.when(i % 15 == 0, "timeout").alias("failure"),
    )
    done = merge.detect_update(b.items(spark, d), results, NOW, "v2")
    return done.select("cid", "mime", "ext_guess", "kind", "confidence", "source", "error", "detector_version", "indexed_at")


@query(
    "m5_orphan_flip",
    b.with_frames("items listings", f""", kept AS (SELECT * FROM listings WHERE place < 3),
  lost AS (SELECT DISTINCT cid FROM listings EXCEPT SELECT cid FROM kept)
  SELECT cid, present AND NOT (l.cid IS NOT NULL AND present_source = 'expanded') AS present,
    CASE WHEN l.cid IS NOT NULL AND present_source = 'expanded' THEN {NOW} ELSE removed_at END AS removed_at FROM items LEFT JOIN lost l USING (cid)"""),
)
def m5_flip(spark, d):
    edges = b.listings(spark, d).select("parent_cid", F.col("cid").alias("child_cid"), "place")
    return merge.flip_orphans(b.items(spark, d), edges, edges.filter("place < 3"), NOW).select("cid", "present", "removed_at")


STEP = f"""batch AS (SELECT cid FROM items WHERE is_directory AND present), asked AS (SELECT i.* FROM items i JOIN batch USING (cid)),
  dirs AS (SELECT cid AS parent_cid, coalesce(expand_depth, 0) + 1 AS depth FROM asked
    WHERE CASE WHEN present_source = 'pinls' AND coalesce(expand_depth, 0) = 0 THEN {UNCLEAR} ELSE {UNCLEAR} OR coalesce(source, '') = '' END),
  links AS (SELECT l.*, depth, row_number() OVER (PARTITION BY l.parent_cid ORDER BY place, l.cid) AS n, count(*) OVER (PARTITION BY l.parent_cid) AS n_links FROM listings l JOIN dirs USING (parent_cid)),
  taken AS (SELECT * FROM links WHERE n <= 3),
  old AS (SELECT parent_cid, cid AS child_cid, 5 AS first_seen_at, 6 AS last_seen_at FROM listings WHERE place > 1),
  merged AS (SELECT parent_cid, child_cid, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM (SELECT * FROM old UNION ALL SELECT DISTINCT parent_cid, cid, {NOW}, {NOW} FROM taken) GROUP BY ALL),
  edges_now AS (SELECT m.* FROM merged m LEFT JOIN (SELECT DISTINCT parent_cid FROM taken) p USING (parent_cid) LEFT JOIN (SELECT DISTINCT parent_cid, cid AS child_cid, true AS k FROM taken) t USING (parent_cid, child_cid)
    WHERE p.parent_cid IS NULL OR t.k)"""


def step(spark, d):
    items = b.items(spark, d)
    old = b.listings(spark, d).filter("place > 1").select(
        "parent_cid", F.col("cid").alias("child_cid"), F.lit(5).cast("bigint").alias("first_seen_at"), F.lit(6).cast("bigint").alias("last_seen_at")
    )
    return crawl.expand(items, old, b.listings(spark, d), items.filter("is_directory AND present"), NOW, 3)


@query("g4_expand_edges", b.with_frames("items listings", f", {STEP} SELECT * FROM edges_now"))
def g4_edges(spark, d):
    return step(spark, d)[1].select("parent_cid", "child_cid", "first_seen_at", "last_seen_at")


@query(
    "g4_expand_items",
    b.with_frames("items listings", f""", {STEP}, kids AS (SELECT cid, min(depth) AS depth FROM taken GROUP BY 1),
  lost AS (SELECT child_cid AS cid FROM merged EXCEPT SELECT child_cid FROM edges_now), sizes AS (SELECT DISTINCT parent_cid, n_links FROM links),
  m AS (SELECT i.cid, i.present, i.present_source, i.last_seen_at, i.expand_depth, i.removed_at,
    CASE WHEN a.cid IS NULL THEN i.is_directory ELSE s.parent_cid IS NOT NULL OR dd.parent_cid IS NOT NULL END AS is_directory,
    CASE WHEN a.cid IS NULL THEN i.expand_error WHEN n_links > 3 THEN 'too_many_children:' || n_links || ' (max=3)' END AS expand_error
    FROM items i LEFT JOIN asked a ON a.cid = i.cid LEFT JOIN dirs dd ON dd.parent_cid = i.cid LEFT JOIN sizes s ON s.parent_cid = i.cid),
  g AS (SELECT cid, CASE WHEN depth IS NOT NULL THEN true ELSE present END AS present, CASE WHEN depth IS NOT NULL THEN coalesce(present_source, 'expanded') ELSE present_source END AS present_source,
    CASE WHEN depth IS NOT NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at, CAST(least(expand_depth, depth) AS INTEGER) AS expand_depth, CASE WHEN depth IS NULL THEN removed_at END AS removed_at,
    is_directory, expand_error FROM m FULL JOIN kids USING (cid))
  SELECT cid, CASE WHEN l.cid IS NOT NULL AND present_source = 'expanded' THEN false ELSE present END AS present, present_source, last_seen_at, expand_depth,
    CASE WHEN l.cid IS NOT NULL AND present_source = 'expanded' THEN {NOW} ELSE removed_at END AS removed_at, is_directory, expand_error FROM g LEFT JOIN lost l USING (cid)"""),
)
def g4_items(spark, d):
    return step(spark, d)[0].select("cid", "present", "present_source", "last_seen_at", "expand_depth", "removed_at", "is_directory", "expand_error")


@query(
    "p42_tags_document",
    b.with_frames("items", """SELECT cid, CAST(to_json({'topics': []::VARCHAR[], 'content_class': CASE kind WHEN 'html' THEN 'site' WHEN 'image' THEN 'image' ELSE 'doc' END, 'lang': 'en',
  'confidence': confidence, 'signals': {'from': []::VARCHAR[], 'bytes_read': 0}, 'tags': ['kind:' || coalesce(kind, 'unknown')]}) AS VARCHAR) AS document FROM items"""),
)
def p42(spark, d):
    meta = F.lit(None).cast("struct<topics:array<string>,content_class:string,lang:string,confidence:double,signals:struct<from:array<string>,bytes_read:bigint>>")
    tags = F.array(F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("unknown"))))
    return b.items(spark, d).select("cid", crawl.tags_document(meta, F.col("kind"), F.col("confidence"), tags).alias("document"))


@query(
    "m16_root_tags",
    b.with_frames("items listings", """, e AS (SELECT parent_cid AS root_cid, arg_min(cid, place) AS cid, arg_min(name, place) AS path FROM listings WHERE type = 'file' GROUP BY 1),
  j AS (SELECT e.*, p.tags_json AS page FROM e JOIN items r ON r.cid = e.root_cid LEFT JOIN items p ON p.cid = e.cid)
  SELECT root_cid, array_to_string(list_filter(list_transform(coalesce(CAST(page::JSON->'$.topics' AS VARCHAR[]), []), lambda x: trim(x)), lambda x: x <> ''), ',') AS topics,
    coalesce(page::JSON->>'$.content_class', 'site') AS content_class,
    'dir_entry:' || path || coalesce(',' || nullif(array_to_string(CAST(page::JSON->'$.signals.from' AS VARCHAR[]), ','), ''), '') AS marks, cid AS derived_cid, path AS derived_path FROM j"""),
)
def m16(spark, d):
    first = F.min_by(F.struct("cid", "name"), "place").alias("e")
    entries = b.listings(spark, d).filter("type = 'file'").groupBy(F.col("parent_cid").alias("root_cid")).agg(first).select("root_cid", "e.cid", F.col("e.name").alias("path"))
    items = b.items(spark, d)
    done = crawl.site_tags_of_roots(items.select(F.col("cid").alias("root_cid")), entries, items)
    return done.select("root_cid", F.array_join("topics", ",").alias("topics"), "content_class", F.array_join("from", ",").alias("marks"), "derived_cid", "derived_path")


@query(
    "m20_entry_updates",
    b.with_frames("listings", """, p AS (SELECT parent_cid AS root_cid, min(cid) AS cid FROM listings WHERE name = 'index.html' AND CAST(substr(parent_cid, 5) AS BIGINT) % 16 = 0 GROUP BY 1),
  l AS (SELECT parent_cid AS root_cid, name, cid, CASE WHEN name = 'index.html' THEN 2500 ELSE 500 END - 1 - length(name) / 128.0 AS score FROM listings WHERE name LIKE '%.html'),
  b AS (SELECT root_cid, name, cid FROM (SELECT *, row_number() OVER (PARTITION BY root_cid ORDER BY score DESC, name, cid) AS r FROM l) WHERE r = 1),
  n AS (SELECT root_cid, coalesce(CASE WHEN p.cid IS NOT NULL THEN 'index.html' END, b.name) AS path, coalesce(p.cid, b.cid) AS cid FROM p FULL JOIN b USING (root_cid))
  SELECT * FROM n WHERE NOT (path = 'index.html' AND CAST(substr(root_cid, 5) AS BIGINT) % 32 = 0)"""),
)
def m20(spark, d):
    listing = b.listings(spark, d)
    number = F.substring("parent_cid", 5, 20).cast("bigint")
    pages = listing.filter((F.col("name") == "index.html") & (number % 16 == 0))
    paths = pages.select(F.col("parent_cid").alias("root_cid"), F.col("name").alias("path"), F.col("cid").alias("leaf_cid"), F.lit(1).alias("depth"))
    current = pages.filter(number % 32 == 0).select(F.col("parent_cid").alias("root_cid"), F.col("name").alias("entry_path"), F.col("cid").alias("entry_cid"))
    return crawl.entry_updates(paths, listing, current)


@query(
    "g3_html_entries",
    b.with_frames("listings", """, roots AS (SELECT DISTINCT parent_cid AS root_cid FROM listings),
  l1 AS (SELECT root_cid, cid, name AS path, type, 1 AS depth FROM roots JOIN listings ON parent_cid = root_cid),
  l2 AS (SELECT root_cid, l.cid, path || '/' || name AS path, l.type, 2 AS depth FROM l1 JOIN listings l ON l.parent_cid = l1.cid AND l1.type IN ('dir', 'unknown')),
  f AS (SELECT *, 100 + CASE WHEN path IN ('index.html', 'index.htm') THEN 1000 ELSE 0 END + CASE WHEN regexp_matches(path, '/index\\.html?$') THEN 500 ELSE 0 END - len(string_split(path, '/')) AS score
    FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE type = 'file' AND path LIKE '%.html')
  SELECT root_cid, path, cid AS leaf_cid, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY root_cid ORDER BY score DESC, depth, path) AS r FROM f) WHERE r = 1"""),
)
def g3(spark, d):
    listing = b.listings(spark, d)
    roots = listing.select(F.col("parent_cid").alias("cid")).distinct()
    return graph.html_entries(listing, roots, max_depth=2)


@query(
    "g5_level_entries",
    b.with_frames("listings", """SELECT parent_cid, name FROM (SELECT *, row_number() OVER (PARTITION BY parent_cid ORDER BY CASE name WHEN 'index.html' THEN 0 WHEN 'index.htm' THEN 1 ELSE 2 END, name) AS r
  FROM listings WHERE type = 'file' AND name LIKE '%.html') WHERE r = 1"""),
)
def g5(spark, d):
    return graph.level_entries(b.listings(spark, d))


@query("f28_indexed_paths", b.with_frames("listings", "SELECT parent_cid, place, regexp_matches(name, '.\\.(html|txt)$') AS indexed FROM listings"))
def f28(spark, d):
    from tessera.functions.hits import is_indexed_path

    return b.listings(spark, d).select("parent_cid", "place", is_indexed_path(F.col("name"), graph.INDEXED).alias("indexed"))


@query("f31_chunk_lists", b.with_frames("listings", "SELECT parent_cid, bool_and(regexp_full_match(replace(replace(name, 'f', ''), '.html', ''), '[0-9]+')) AND NOT bool_or(type = 'dir') AS chunks FROM listings GROUP BY 1"))
def f31(spark, d):
    from tessera.functions.hits import is_chunk_list

    bare = F.replace(F.replace("name", F.lit("f"), F.lit("")), F.lit(".html"), F.lit(""))
    per = b.listings(spark, d).groupBy("parent_cid").agg(F.collect_list(bare).alias("names"), F.collect_list("type").alias("types"))  # a listing's links, a thousand at most
    return per.select("parent_cid", is_chunk_list(F.col("names"), F.col("types")).alias("chunks"))


@query("p19_classes_of_items", b.with_frames("items", "SELECT cid, CASE kind WHEN 'html' THEN 'site' WHEN 'image' THEN 'image' ELSE 'doc' END AS content_class FROM items"))
def p19_items(spark, d):
    return b.items(spark, d).select("cid", detect.content_class(F.col("kind")).alias("content_class"))
