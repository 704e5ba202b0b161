"""Type detection over documents, pages and literal samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.functions import detect, hits
from tessera.registry import query
from tessera.sources import records

BUCKET = "CASE WHEN {0} IS NULL OR {0} < 0 THEN NULL WHEN {0} < 65536 THEN 'xs' WHEN {0} < 1048576 THEN 's' WHEN {0} < 52428800 THEN 'm' WHEN {0} < 524288000 THEN 'l' WHEN {0} < 5368709120 THEN 'xl' ELSE 'xxl' END"
KIND = """CASE WHEN mime IS NULL THEN 'unknown' WHEN starts_with(mime, 'image/') THEN 'image' WHEN mime IN ('text/html', 'application/xhtml+xml') THEN 'html'
  WHEN starts_with(mime, 'text/') THEN 'text' WHEN mime IN ('application/pdf', 'application/epub+zip') OR starts_with(mime, 'application/msword') OR starts_with(mime, 'application/vnd.openxmlformats-officedocument') THEN 'doc'
  WHEN mime IN ('application/zip', 'application/x-tar', 'application/x-7z-compressed', 'application/x-rar-compressed') THEN 'archive' WHEN mime = 'application/vnd.ipld.car' THEN 'ipld' ELSE 'unknown' END"""


@query("p17_size_bucket", f"SELECT o_orderkey, {BUCKET.format('s')} AS bucket FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 30000 + 1)) AS BIGINT) AS s FROM orders)")
def p17(spark, d):
    size = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 30000 + 1)).cast("bigint")
    return b.table(spark, d, "orders").select("o_orderkey", detect.size_bucket(size).alias("bucket"))


@query("p15_kind_of_mime", b.with_frames("items", f"SELECT cid, mime, {KIND} AS kind FROM items"))
def p15(spark, d):
    return b.items(spark, d).select("cid", "mime", detect.kind_of_mime(F.col("mime")).alias("kind"))


@query("p18_confidence", "SELECT event_id, CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT event_id, value / 100 AS c FROM events)")
def p18(spark, d):
    return b.table(spark, d, "events").select("event_id", detect.confidence_bucket(F.col("value") / 100).alias("bucket"))


@query("p19_content_class", b.with_frames("catalog", "SELECT cid, CASE kind WHEN 'html' THEN 'site' WHEN 'image' THEN 'image' ELSE 'doc' END AS content_class FROM catalog"))
def p19(spark, d):
    return b.catalog(spark, d).select("cid", detect.content_class(F.col("kind")).alias("content_class"))


@query(
    "p20_mime_hint",
    b.with_frames("listings paths", """, n AS (SELECT parent_cid AS cid, name FROM listings UNION ALL SELECT leaf_cid, path FROM paths UNION ALL SELECT 'doc-' || doc_id, text FROM documents)
  SELECT cid, name, CASE WHEN e IN ('html','htm','xhtml') THEN 'text/html' WHEN e IN ('txt','md','markdown','srt','vtt') THEN 'text/plain' WHEN e = 'pdf' THEN 'application/pdf'
  WHEN e = 'epub' THEN 'application/epub+zip' WHEN e IN ('jpg','jpeg','png','gif','webp','avif','svg') THEN 'image/*' END AS hint
  FROM (SELECT cid, name, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1, 's')) AS e FROM n)"""),
)
def p20(spark, d):
    """Names of listings, paths of pages, and whole texts as names without an extension that is known."""
    named = b.listings(spark, d).select(F.col("parent_cid").alias("cid"), "name").unionByName(b.paths(spark, d).select(F.col("leaf_cid").alias("cid"), F.col("path").alias("name")))
    texts = b.table(spark, d, "documents").select(b.tagged("doc-", "doc_id").alias("cid"), F.col("text").alias("name"))
    return named.unionByName(texts).select("cid", "name", detect.mime_hint(F.col("name")).alias("hint"))


#: Hexadecimal digits of the first 4,096 bytes, one pair a byte.
BYTES = "list_transform(range(least(length(x), 8192) // 2), lambda i: substr(x, i * 2 + 1, 2))"


@query(
    "f22_mostly_text",
    f"""SELECT page_id, len(bytes) > 0 AND NOT list_contains(bytes, '00') AND len(list_filter(bytes, lambda v: v BETWEEN '20' AND '7E' OR v BETWEEN '09' AND '0D')) > 0.8 * len(bytes) AS plain
  FROM (SELECT page_id, {BYTES} AS bytes FROM (SELECT page_id, hex(encode(html)) AS x FROM pages))""",
)
def f22(spark, d):
    return b.table(spark, d, "pages").select("page_id", detect.is_mostly_text(F.encode("html", "UTF-8")).alias("plain"))


#: Heads of blobs and what they must be found to be: (mime, ext_guess, kind, confidence, source).
OFFICE = "application/vnd.openxmlformats-officedocument"
CASES = {
    "255044462D312E34": ("application/pdf", "pdf", "doc", 0.98, "magic"),
    "202020255044462D312E34": ("application/pdf", "pdf", "doc", 0.95, "container"),
    "504B030414000000776F72642F": (f"{OFFICE}.wordprocessingml.document", "docx", "archive", 0.97, "container"),
    "504B030414000000786C2F": (f"{OFFICE}.spreadsheetml.sheet", "xlsx", "archive", 0.97, "container"),
    "504B0304140000007070742F": (f"{OFFICE}.presentationml.presentation", "pptx", "archive", 0.97, "container"),
    "504B0304140000006170706C69636174696F6E2F657075622B7A6970": ("application/epub+zip", "epub", "doc", 0.97, "container"),
    "504B030414000000636C61737365732E646578": ("application/vnd.android.package-archive", "apk", "package", 0.97, "container"),
    "504B030400000000": ("application/zip", "zip", "archive", 0.9, "container"),
    "89504E470D0A1A0A00": ("image/png", "png", "image", 0.98, "magic"),
    "FFD8FFE000": ("image/jpeg", "jpg", "image", 0.98, "magic"),
    "474946383961": ("image/gif", "gif", "image", 0.98, "magic"),
    "3C68746D6C3E3C626F64793E": ("text/html", "html", "html", 0.9, "container"),
    "0A01000000": ("application/vnd.ipld.car", "car", "ipld", 0.85, "container"),
    "68656C6C6F20776F726C64": ("text/plain", "txt", "text", 0.7, "heuristic"),
    "0001020304": ("application/octet-stream", None, "unknown", 0.4, "heuristic"),
    "": ("application/octet-stream", None, "unknown", 0.4, "heuristic"),
}
#: Every document behind one of these heads, whose type stands in the first bytes.
HEADS = [h for h in CASES if CASES[h][2] not in ("text", "unknown")]


def expected(head: str) -> str:
    mime, ext, kind, confidence, source = CASES[head]
    return f"('{head}', '{mime}', {f"'{ext}'" if ext else 'NULL'}, '{kind}', CAST({confidence} AS DOUBLE), '{source}')"


@query(
    "p11_p14_detect",
    f"""WITH cases(head, mime, ext_guess, kind, confidence, source) AS (VALUES {', '.join(expected(h) for h in CASES)}), places AS (SELECT head, row_number() OVER () - 1 AS k FROM (SELECT unnest({HEADS!r}) AS head))
  SELECT 'case ' || head AS id, mime, ext_guess, kind, confidence, source FROM cases
  UNION ALL SELECT 'doc-' || doc_id, cases.mime, cases.ext_guess, cases.kind, cases.confidence, cases.source FROM documents JOIN places ON k = doc_id % {len(HEADS)} JOIN cases USING (head)""",
)
def p14(spark, d):
    none = F.lit(None).cast("binary")
    cases = spark.createDataFrame([(f"case {h}", h) for h in CASES], "id string, head string").select("id", F.unhex("head").alias("c"))
    head = F.element_at(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    made = b.table(spark, d, "documents").select(b.tagged("doc-", "doc_id").alias("id"), F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("c"))
    rows = cases.unionByName(made)
    return rows.select("id", detect.detect(F.col("c"), none, none).alias("x")).select("id", "x.*")


@query(
    "p14_detect_pages",
    """SELECT page_id, CASE WHEN regexp_matches(h, '<html|<!doctype html|<head|<body') THEN 'text/html' WHEN plain THEN 'text/plain' ELSE 'application/octet-stream' END AS mime,
  CASE WHEN regexp_matches(h, '<html|<!doctype html|<head|<body') THEN 'container' ELSE 'heuristic' END AS source
  FROM (SELECT page_id, lower(substr(html, 1, 262144)) AS h, length(regexp_replace(substr(html, 1, 4096), '[^\\x09-\\x0D\\x20-\\x7E]', '', 'g')) > 0.8 * strlen(substr(html, 1, 4096)) AS plain FROM pages)""",
)
def p14_pages(spark, d):
    s = records.samples(F.encode("html", "UTF-8"))
    rows = b.table(spark, d, "pages").select("page_id", s.alias("s")).select("page_id", detect.detect(F.col("s.head"), F.col("s.middle"), F.col("s.tail")).alias("x"))
    return rows.select("page_id", "x.mime", "x.source")


@query(
    "p16_tags",
    b.with_frames("catalog", f"""SELECT cid, concat_ws(' ', 'kind:' || kind, 'category:' || CASE kind WHEN 'unknown' THEN 'unknown' ELSE 'document' END, 'mime:' || coalesce(mime, 'application/octet-stream'),
  'ext:' || CASE kind WHEN 'html' THEN 'html' WHEN 'text' THEN 'txt' ELSE 'unknown' END, 'detected_by:heuristic', 'confidence:medium', 'size_bucket:' || {BUCKET.format('size_bytes')},
  CASE WHEN kind IN ('html', 'text') THEN 'needs:metadata' END) AS tags FROM catalog"""),
)
def p16(spark, d):
    ext = F.when(F.col("kind") == "html", "html").when(F.col("kind") == "text", "txt")
    tags = detect.tags_of(F.col("kind"), F.col("mime"), ext, F.lit("heuristic"), F.lit(0.7), F.col("size_bytes"))
    return b.catalog(spark, d).select("cid", F.array_join(tags, " ").alias("tags"))


@query(
    "f14_html_site",
    b.with_frames("catalog paths", """, p AS (SELECT leaf_cid AS cid, min(path) AS path FROM paths GROUP BY 1)
  SELECT cid, coalesce(regexp_matches(lower(path), '\\.html?$'), false) OR coalesce(mime = 'text/html', false) AS is_site FROM catalog LEFT JOIN p USING (cid)"""),
)
def f14(spark, d):
    first = b.paths(spark, d).groupBy(F.col("leaf_cid").alias("cid")).agg(F.min("path").alias("path"))
    none = F.lit(None).cast("string")
    rows = b.catalog(spark, d).join(first, "cid", "left")
    return rows.select("cid", hits.is_html_site(F.col("path"), none, F.col("mime"), none).alias("is_site"))


@query(
    "p24_display_name",
    "SELECT p_partkey, nullif(substr(trim(regexp_replace(p_name || chr(10) || chr(9) || p_type, '[\\r\\n\\t]+', ' ', 'g')), 1, 256), '') AS display_name FROM part",
)
def p24(spark, d):
    raw = F.concat("p_name", F.lit("\n\t"), "p_type")
    return b.table(spark, d, "part").select("p_partkey", hits.display_name(raw).alias("display_name"))


@query(
    "p23_entry_path",
    b.with_frames("paths", "SELECT root_cid, path, CASE WHEN trim(path) <> '' AND NOT contains(path, '..') THEN trim(path) END AS entry FROM paths"),
)
def p23(spark, d):
    return b.paths(spark, d).select("root_cid", "path", hits.entry_path(F.concat(F.lit("/"), "path")).alias("entry"))


@query("p41_content_id", "SELECT doc_id, 'cid-sha256-' || sha256(text) AS content_id FROM documents")
def p41(spark, d):
    return b.table(spark, d, "documents").select("doc_id", hits.content_id(F.col("text")).alias("content_id"))


@query("p21_activity_at", b.with_frames("catalog", "SELECT cid, CASE WHEN last_seen_at > 0 THEN last_seen_at ELSE 1704067200000 END AS activity_at FROM catalog"))
def p21(spark, d):
    times = hits.activity_at(F.col("last_seen_at"), F.lit(0), F.lit(b.EPOCH_2024))
    return b.catalog(spark, d).select("cid", times.alias("activity_at"))


@query("p25_record_ids", b.with_frames("domain_records", "SELECT owner, domain, regexp_extract(record_value, 'P[0-9]+$') AS root FROM domain_records"))
def p25(spark, d):
    from tessera.operators.sites import record_id

    return b.domain_records(spark, d).select("owner", "domain", record_id(F.col("record_value")).alias("root"))


SIGNED = ", ".join(f"({k}, '{mime}', '{ext}')" for k, (_, _, mime, ext) in enumerate(detect.MAGIC))


@query(
    "p11_signatures",
    f"""SELECT doc_id, mime, ext_guess, CAST(CASE WHEN mime = 'application/zip' THEN 0.9 ELSE 0.98 END AS DOUBLE) AS confidence
  FROM documents JOIN (VALUES {SIGNED}) s(k, mime, ext_guess) ON k = doc_id % {len(detect.MAGIC)}""",
)
def p11(spark, d):
    """Every text behind the leading bytes of one of the formats, at their offset."""
    heads = F.array(*(F.lit("00" * at + hexed) for hexed, at, _, _ in detect.MAGIC))
    head = F.unhex(F.element_at(heads, (F.col("doc_id") % len(detect.MAGIC) + 1).cast("int")))
    made = b.table(spark, d, "documents").select("doc_id", F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("c"))
    return made.select("doc_id", detect.magic_detect(F.col("c")).alias("x")).select("doc_id", "x.mime", "x.ext_guess", "x.confidence")
