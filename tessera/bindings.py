"""Frames of the data model, derived from the star-schema tables.

Each binding is a function (spark, sf_dir) -> DataFrame; ``SQL`` holds the same frame as a
SELECT for DuckDB, so that a query and its oracle see identical rows. Times are epoch
milliseconds, floored from microseconds and independent of the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00:00Z and the instant at which searches are ranked, 30 days later.
EPOCH_2024 = 1_704_067_200_000
RANK_AT = 1_706_659_200_000
DAY_MS = 86_400_000
#: Rows of a table that a task aggregates or joins.
SHARE = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(rows: int) -> int:
    """Partitions for a shuffle of so many rows."""
    return -(-rows // SHARE)


def shares(spark: SparkSession, sf_dir: str, name: str, by: int = 1) -> int:
    """Partitions for a shuffle of a table's rows, each of which makes ``by``; the rows are counted from the files' footers."""
    return parts_of(table(spark, sf_dir, name).count() * by)


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` by keys in ``parts`` partitions if that is more than a shuffle has, so that a task's share doesn't grow with them."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts and parts > usual else rows


def millis(name: str) -> Column:
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")
    return F.floor(micros / 1000).cast("bigint")


def tagged(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        tagged("doc-", "doc_id").alias("cid"),
        F.when(i % 19 == 0, "unknown").otherwise("text").alias("kind"),
        F.when(i % 19 == 0, "application/octet-stream").when(i % 23 == 0, F.lit(None)).otherwise("text/plain").alias("mime"),
        F.col("n_chars").cast("bigint").alias("size_bytes"),
        (i % 10 != 0).alias("present"),
        F.when(i % 3 == 0, "expanded").otherwise("pinls").alias("present_source"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.lit(EPOCH_2024) + i * 60_000).cast("bigint").alias("last_seen_at"),
    )
    pages = table(spark, sf_dir, "pages").select(
        tagged("page-", "page_id").alias("cid"),
        F.lit("html").alias("kind"),
        F.lit("text/html").alias("mime"),
        F.length("html").cast("bigint").alias("size_bytes"),
        F.lit(True).alias("present"),
        F.lit("pinls").alias("present_source"),
        (F.lit(EPOCH_2024) + F.col("page_id") * 90_000).cast("bigint").alias("last_seen_at"),
    )
    return docs.unionByName(pages)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+/?([^?#]*)", 1).alias("tail"),
    )
    by_host = pages.select(F.col("host").alias("root_cid"), F.col("tail").alias("path"), tagged("page-", "page_id").alias("leaf_cid"))
    mirrors = pages.filter("page_id % 2 = 0").select(
        F.concat(F.lit("mirror-"), (F.col("page_id") % 7).cast("string")).alias("root_cid"),
        F.concat(F.lit("m/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        tagged("page-", "page_id").alias("leaf_cid"),
    )
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    return by_host.unionByName(mirrors).withColumns({"depth": depth.cast("int"), "mime_hint": F.lit("text/html")})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pair(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, sf_dir, name).select(tagged(a, x).alias("parent_cid"), tagged(b, y).alias("child_cid"))

    found = [
        pair("nation", "R", "n_regionkey", "N", "n_nationkey"),
        pair("customer", "N", "c_nationkey", "C", "c_custkey"),
        pair("supplier", "N", "s_nationkey", "S", "s_suppkey"),
        pair("orders", "C", "o_custkey", "O", "o_orderkey"),
        pair("lineitem", "O", "l_orderkey", "P", "l_partkey"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def wallet_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_partkey",
        millis("l_shipdate").alias("at"),
        F.floor("l_extendedprice").cast("bigint").alias("bytes"),
        "l_linestatus",
    )
    keys = "l_suppkey", "l_partkey"
    # the last status is O; flags are aggregated by hash, a string by sorting the rows
    last = F.bool_or(F.col("l_linestatus") == "O") & ~F.bool_or(F.col("l_linestatus") > "O")
    rows = dealt(lines, shares(spark, sf_dir, "lineitem"), *keys).groupBy(*keys).agg(
        F.min("at").alias("created_at"), F.sum("bytes").alias("bytes_estimated"), F.when(last, "active").otherwise("removed").alias("status")
    )
    return rows.select(tagged("W", "l_suppkey").alias("wallet"), tagged("P", "l_partkey").alias("root_cid"), "created_at", "bytes_estimated", "status")


def wallet_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 100).alias("w"), millis("o_orderdate").alias("at")
    )
    parts = shares(spark, sf_dir, "lineitem")
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), parts, "l_orderkey")
    orders = dealt(orders, parts, "o_orderkey")
    joined = dealt(lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("w", "l_partkey", "at"), parts, "w", "l_partkey")
    rows = joined.groupBy("w", "l_partkey").agg(F.min("at").alias("created_at"))
    return rows.select(tagged("W", "w").alias("wallet"), tagged("P", "l_partkey").alias("cid"), "created_at")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("cid"),
        tagged("W", "user_id").alias("wallet"),
        millis("ts").alias("at_ms"),
        F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "signup", F.lit(None)).otherwise(True).alias("ok"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        i.alias("id"),
        F.concat(F.lit("W"), (F.col("o_custkey") % 100).cast("string")).alias("client"),
        F.when(F.col("o_orderstatus") == "O", "CONTRACT_STATUS_ACTIVE")
        .when(F.col("o_orderstatus") == "F", "CONTRACT_STATUS_FINALIZED")
        .otherwise("CONTRACT_STATUS_PENDING")
        .alias("status"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("storage_gb"),
        F.floor(millis("o_orderdate") / 1000).cast("bigint").alias("start_time"),
        (1 + i % 12).cast("bigint").alias("months_total"),
    )


def domain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    label = F.regexp_replace(F.lower("n_name"), "_", "-")
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        tagged("W", "s_suppkey").alias("owner"),
        F.concat(label, F.when(i % 2 == 0, ".web").otherwise(".site")).alias("domain"),
        F.element_at(F.array(*map(F.lit, ("cid", "www", "ipns", "docs"))), (i % 4 + 1).cast("int")).alias("record_key"),
        F.concat(F.lit("/ipfs/P"), i.cast("string")).alias("record_value"),
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        millis("ts").alias("at_ms"),
        F.lit("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_ms"),
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", tagged("q", "quality").alias("label"))
    return docs.join(labels, "doc_id").select("doc_id", "label", "text")


#: Tags documents of items by doc_id modulo 12, ``N`` being the doc_id; the others are ``{}``, number 0 is null.
TAG_SHAPES = {
    1: '{"topics":[" Alpha","beta"],"title":"Title N","preview":"Preview N","tokens":{"alpha":3,"beta":N,"div":9,"ab":4}}',
    2: '{"topics":[],"description":"PK junk N"}',
    3: '{"signals":{"from":["doc:epub_text_v2"],"bytes_read":5},"description":"Some text N","title":"index of N"}',
    4: '{"signals":{"from":["doc:epub_parse_failed"]},"tokens":{"00000":2,"123456":1}}',
    5: '{"signals":{"from":["doc:sample","doc:pdf_url_extract_failed"]},"tokens":{"obj":2,"stream":1,"endobj":1}}',
    6: '{"signals":{"from":["doc:too_large"]},"title":"/ipfs/N"}',
    7: '{"signals":{"from":["doc:full_fetch_failed","text:head:low_signal"]},"tokens":{"pdf":1}}',
    8: '{"signals":{"from":["doc:sample"]},"description":"PKmimetypeapplication/epub+zip N"}',
    9: '{"content_class":"site","topics":["gamma"],"tokens":{"gamma":N,"html":2},"signals":{"from":["x"]}}',
    10: '{"title":"Index of N","description":"A directory of content-addressed files hosted on some gateway"}',
}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as the crawler keeps it, with every column of a row's state."""
    i = F.col("doc_id")

    def cycle(by: int, *values: str | None) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (i % by + 1).cast("int"))

    tags = F.when(i % 12 == 0, F.lit(None).cast("string"))
    for k, shape in TAG_SHAPES.items():
        tags = tags.when(i % 12 == k, F.replace(F.lit(shape), F.lit("N"), i.cast("string")))
    at = F.lit(EPOCH_2024) + i * 60_000
    return table(spark, sf_dir, "documents").select(
        tagged("doc-", "doc_id").alias("cid"),
        cycle(6, "text", "doc", "unknown", None, "html", "image").alias("kind"),
        cycle(7, None, "application/epub+zip", "application/pdf", "text/plain", "text/html", "image/png", "application/octet-stream").alias("mime"),
        cycle(5, "epub", "pdf", "txt", None, "html").alias("ext_guess"),
        ((i % 10) / 10).alias("confidence"),
        cycle(4, None, "magic", "magic", "container").alias("source"),
        cycle(3, None, "v0", "v1").alias("detector_version"),
        F.when(i % 17 == 0, "detect_error").alias("error"),
        (i % 8 == 0).alias("is_directory"),
        F.when(i % 9 != 0, i % 4).cast("int").alias("expand_depth"),
        F.when(i % 3 != 0, F.lit(EPOCH_2024) + i * 1_000).cast("bigint").alias("expanded_at"),
        F.when(i % 13 == 0, "ls_error").alias("expand_error"),
        (i % 10 != 0).alias("present"),
        F.when(i % 3 == 0, "expanded").otherwise("pinls").alias("present_source"),
        F.when(i % 13 != 0, at).cast("bigint").alias("last_seen_at"),
        F.when(i % 10 == 0, F.lit(EPOCH_2024)).cast("bigint").alias("removed_at"),
        F.when(i % 5 != 0, at).cast("bigint").alias("indexed_at"),
        F.when(i % 11 == 0, F.concat(F.lit("d/"), i.cast("string"), F.lit(".html"))).alias("path"),
        F.when(i % 7 == 0, tagged("root-", "doc_id")).alias("root_cid"),
        F.coalesce(tags, F.when(i % 12 == 11, "{}")).alias("tags_json"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of items to others, as a directory service lists them: of every eighth item, the next four by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 8 = 0")
    links = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"))
    child = F.col("doc_id") + F.col("place") * 2
    kind = F.when(child % 8 == 0, "dir").when(child % 6 == 4, "unknown").otherwise("file")
    name = F.when(kind == "file", F.concat(F.lit("f"), child.cast("string"), F.when(child % 3 == 0, ".txt").otherwise(".html"))).otherwise(F.concat(F.lit("d"), child.cast("string")))
    name = F.when((F.col("place") == 3) & (kind == "file"), "index.html").otherwise(name)
    return links.select(
        tagged("doc-", "doc_id").alias("parent_cid"), "place", F.concat(F.lit("doc-"), child.cast("string")).alias("cid"), name.alias("name"),
        kind.alias("type"), (child % 50).cast("bigint").alias("size"),
    )


def _cycle_sql(by: int, *values: str | None) -> str:
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"CASE doc_id % {by} {cases} END"


def _items_sql() -> str:
    shapes = " ".join(f"WHEN {k} THEN replace('{v}', 'N', CAST(doc_id AS VARCHAR))" for k, v in TAG_SHAPES.items())
    at = f"{EPOCH_2024} + doc_id * 60000"
    return f"""
  SELECT 'doc-' || doc_id AS cid, {_cycle_sql(6, "text", "doc", "unknown", None, "html", "image")} AS kind,
    {_cycle_sql(7, None, "application/epub+zip", "application/pdf", "text/plain", "text/html", "image/png", "application/octet-stream")} AS mime,
    {_cycle_sql(5, "epub", "pdf", "txt", None, "html")} AS ext_guess, doc_id % 10 / 10.0::DOUBLE AS confidence, {_cycle_sql(4, None, "magic", "magic", "container")} AS source,
    {_cycle_sql(3, None, "v0", "v1")} AS detector_version, CASE WHEN doc_id % 17 = 0 THEN 'detect_error' END AS error, doc_id % 8 = 0 AS is_directory,
    CAST(CASE WHEN doc_id % 9 <> 0 THEN doc_id % 4 END AS INTEGER) AS expand_depth, CASE WHEN doc_id % 3 <> 0 THEN {EPOCH_2024} + doc_id * 1000 END AS expanded_at,
    CASE WHEN doc_id % 13 = 0 THEN 'ls_error' END AS expand_error, doc_id % 10 <> 0 AS present, CASE WHEN doc_id % 3 = 0 THEN 'expanded' ELSE 'pinls' END AS present_source,
    CASE WHEN doc_id % 13 <> 0 THEN {at} END AS last_seen_at, CASE WHEN doc_id % 10 = 0 THEN {EPOCH_2024} END AS removed_at, CASE WHEN doc_id % 5 <> 0 THEN {at} END AS indexed_at,
    CASE WHEN doc_id % 11 = 0 THEN 'd/' || doc_id || '.html' END AS path, CASE WHEN doc_id % 7 = 0 THEN 'root-' || doc_id END AS root_cid,
    CASE doc_id % 12 {shapes} WHEN 11 THEN '{{}}' END AS tags_json
  FROM documents"""


SQL = {
    "items": _items_sql(),
    "listings": """
  SELECT 'doc-' || doc_id AS parent_cid, CAST(place AS INTEGER) AS place, 'doc-' || child AS cid,
    CASE WHEN type = 'file' AND place = 3 THEN 'index.html' WHEN type = 'file' THEN 'f' || child || CASE WHEN child % 3 = 0 THEN '.txt' ELSE '.html' END ELSE 'd' || child END AS name,
    type, CAST(child % 50 AS BIGINT) AS size
  FROM (SELECT *, CASE WHEN child % 8 = 0 THEN 'dir' WHEN child % 6 = 4 THEN 'unknown' ELSE 'file' END AS type
    FROM (SELECT doc_id, place, doc_id + place * 2 AS child FROM documents, range(1, 5) r(place) WHERE doc_id % 8 = 0))""",
    "catalog": """
  SELECT 'doc-' || doc_id AS cid, CASE WHEN doc_id % 19 = 0 THEN 'unknown' ELSE 'text' END AS kind,
         CASE WHEN doc_id % 19 = 0 THEN 'application/octet-stream' WHEN doc_id % 23 = 0 THEN NULL ELSE 'text/plain' END AS mime,
         CAST(n_chars AS BIGINT) AS size_bytes, doc_id % 10 <> 0 AS present,
         CASE WHEN doc_id % 3 = 0 THEN 'expanded' ELSE 'pinls' END AS present_source,
         CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 1704067200000 + doc_id * 60000 END AS last_seen_at
  FROM documents
  UNION ALL
  SELECT 'page-' || page_id, 'html', 'text/html', CAST(length(html) AS BIGINT), true, 'pinls', 1704067200000 + page_id * 90000 FROM pages""",
    "paths": """
  SELECT root_cid, path, leaf_cid, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth, 'text/html' AS mime_hint
  FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS root_cid, regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) AS path,
               'page-' || page_id AS leaf_cid FROM pages
        UNION ALL
        SELECT 'mirror-' || (page_id % 7), 'm/' || page_id || '.html', 'page-' || page_id FROM pages WHERE page_id % 2 = 0)""",
    "edges": """
  SELECT 'R' || n_regionkey AS parent_cid, 'N' || n_nationkey AS child_cid FROM nation
  UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
  UNION SELECT 'O' || l_orderkey, 'P' || l_partkey FROM lineitem""",
    "wallet_roots": """
  SELECT 'W' || l_suppkey AS wallet, 'P' || l_partkey AS root_cid, min(epoch_us(l_shipdate) // 1000) AS created_at,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes_estimated,
         CASE WHEN max(l_linestatus) = 'O' THEN 'active' ELSE 'removed' END AS status
  FROM lineitem GROUP BY ALL""",
    "wallet_pins": """
  SELECT 'W' || (o_custkey % 100) AS wallet, 'P' || l_partkey AS cid, min(epoch_us(o_orderdate) // 1000) AS created_at
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "access": """
  SELECT event_id, 'P' || json_extract_string(props, '$.k') AS cid, 'W' || user_id AS wallet, epoch_us(ts) // 1000 AS at_ms,
         CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN NULL ELSE true END AS ok
  FROM events""",
    "contracts": """
  SELECT o_orderkey AS id, 'W' || (o_custkey % 100) AS client,
         CASE o_orderstatus WHEN 'O' THEN 'CONTRACT_STATUS_ACTIVE' WHEN 'F' THEN 'CONTRACT_STATUS_FINALIZED' ELSE 'CONTRACT_STATUS_PENDING' END AS status,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS storage_gb, epoch_us(o_orderdate) // 1000000 AS start_time,
         CAST(1 + o_orderkey % 12 AS BIGINT) AS months_total
  FROM orders""",
    "domain_records": """
  SELECT 'W' || s_suppkey AS owner, replace(lower(n_name), '_', '-') || CASE WHEN s_suppkey % 2 = 0 THEN '.web' ELSE '.site' END AS domain,
         ['cid', 'www', 'ipns', 'docs'][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS record_key, '/ipfs/P' || s_suppkey AS record_value
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "http_log": """
  SELECT event_id, epoch_us(ts) // 1000 AS at_ms, 'GET' AS method, '/' || event_type AS path,
         CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms
  FROM events""",
    "training": """
  SELECT d.doc_id, 'q' || quality AS label, text FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def with_frames(names: str, body: str) -> str:
    """``body`` with the named frames in front of it as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body
