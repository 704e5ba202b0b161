"""Sources, sinks and document functions over texts made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera import storage
from tessera.functions import docs, ids
from tessera.operators import intent, merge, metrics
from tessera.registry import query
from tessera.sources import records
from tessera.streaming import usage


def key(prefix: str, at: int):
    return F.concat(F.lit(prefix), (F.col("doc_id") + at).cast("string"))


@query("s1_pin_snapshot", "SELECT DISTINCT 'pin-' || (doc_id + k) AS cid FROM documents, range(3) r(k) WHERE doc_id % 4 <> 3")
def s1(spark, d):
    body = F.concat(*(x for k in range(3) for x in (F.lit('{"Keys":{"' if k == 0 else ',"'), key("pin-", k), F.lit('":{"Type":"recursive"}'))), F.lit("}}"))
    texts = b.table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 3, "broken").otherwise(body).alias("body"))
    return records.pin_snapshot(texts, "body")


@query("s2_directory_links", b.with_frames("listings", "SELECT parent_cid, place - 1 AS place, cid, name, size, type FROM listings WHERE cid NOT LIKE '%4'"))
def s2(spark, d):
    links = b.listings(spark, d)
    cid = F.when(F.col("cid").endswith("4"), "").otherwise(F.col("cid"))
    kind = F.when(F.col("type") == "dir", 1).when(F.col("type") == "file", 2).otherwise(5)
    link = F.struct("place", F.struct(F.col("name").alias("Name"), cid.alias("Hash"), F.col("size").alias("Size"), kind.alias("Type")).alias("l"))
    per = links.groupBy("parent_cid").agg(F.array_sort(F.collect_list(link)).alias("a"))
    shown = F.to_json(F.struct(F.array(F.struct(F.col("parent_cid").alias("Hash"), F.transform("a", lambda x: x["l"]).alias("Links"))).alias("Objects")))
    return records.directory_links(per.select(shown.alias("body")), "body")


#: Bytes of a segment: the source's own, and smaller ones by which the test tables' texts have a tail and a middle.
SEGMENTS = (200, 2_000, records.SAMPLE_BYTES)


@query(
    "s3_samples",
    f"""WITH t AS (SELECT doc_id, s, x, length(x) // 2 AS n FROM (SELECT doc_id, hex(encode(text)) AS x FROM documents), (VALUES {", ".join(f"({n})" for n in SEGMENTS)}) v(s))
  SELECT doc_id, s AS segment, md5(substr(x, 1, s * 2)) AS head, CASE WHEN n > s AND n - s > s - 1 THEN md5(substr(x, (n - s) * 2 + 1, s * 2)) END AS tail,
    CASE WHEN n > 2 * s AND (n - s) // 2 > s - 1 AND (n - s) // 2 + s - 1 < n - s THEN md5(substr(x, (n - s) // 2 * 2 + 1, s * 2)) END AS middle FROM t""",
)
def s3(spark, d):
    rows = b.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("c"))
    taken = F.array(*(F.struct(F.lit(n).alias("segment"), records.samples(F.col("c"), n, 3 * n).alias("s")) for n in SEGMENTS))
    found = rows.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.segment", "x.s.*")
    return found.select("doc_id", "segment", *(F.md5(F.hex(c)).alias(c) for c in ("head", "middle", "tail")))


@query("s5_s13_bodies", "SELECT doc_id, least(n, 900) AS bytes, n > 900 AS truncated, n > 1500 OR doc_id % 5 = 0 AS too_large FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def s5(spark, d):
    body = F.encode("text", "UTF-8")
    declared = F.when(F.col("doc_id") % 5 == 0, 9_999).otherwise(10)
    rows = b.table(spark, d, "documents").select("doc_id", records.capped(body, 900).alias("c"), records.whole(body, declared, 1_500).alias("w"))
    return rows.select("doc_id", F.octet_length("c.bytes").alias("bytes"), "c.truncated", "w.too_large")


@query("s6_labelled_lines", "SELECT 'q' || quality AS label, 'word ' || doc_id AS text FROM labels WHERE doc_id % 4 > 1")
def s6(spark, d):
    i = F.col("doc_id")
    word = F.concat(F.lit("word "), i.cast("string"))
    line = F.when(i % 4 == 0, "   ").when(i % 4 == 1, word).otherwise(F.concat(F.lit("  __label__"), b.tagged("q", "quality"), F.lit("   "), word, F.lit("  ")))
    return records.labelled(b.table(spark, d, "labels").select(line.alias("value")))


@query(
    "k1_s10_saved_model",
    b.with_frames("training", """, words AS (SELECT DISTINCT doc_id, label, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM training) SELECT word, label, count(*) AS n FROM words WHERE word <> '' GROUP BY ALL"""),
)
def k1(spark, d):
    model = intent.train(b.training(spark, d))
    path = storage.new_folder(spark, "model")
    records.save_model(model, path)
    return records.load_model(spark, path)


@query(
    "k1_content_ids",
    """WITH m AS (SELECT n_name AS word, n_regionkey AS n FROM nation) SELECT word, 'cid-sha256-' || sha256('{"word":"' || word || '","counts":{"x":' || n || '}}') AS content_id FROM m""",
)
def k1_ids(spark, d):
    path = storage.new_folder(spark, "model")
    records.save_model(b.table(spark, d, "nation").select(F.col("n_name").alias("word"), F.lit("x").alias("label"), F.col("n_regionkey").alias("n")), path)
    saved = spark.read.schema("body string, content_id string").parquet(path)
    return saved.select(F.get_json_object("body", "$.word").alias("word"), "content_id")


@query("s7_domain_records", b.with_frames("domain_records", "SELECT * FROM domain_records"))
def s7(spark, d):
    rows = b.domain_records(spark, d)
    body = F.to_json(F.struct(F.struct(F.upper("domain").alias("name"), F.array(F.struct(F.col("record_key").alias("key"), F.concat(F.lit(" "), "record_value").alias("value"))).alias("records")).alias("domain")))
    return records.domain_records(rows.select("owner", body.alias("body")), "body", "owner")


@query("s7_contracts", b.with_frames("contracts", "SELECT * FROM contracts"))
def s7_contracts(spark, d):
    body = F.to_json(F.struct("id", "client", "status", F.col("storage_gb").alias("storage_gb_per_month"), "start_time", "months_total"))
    return records.contracts(b.contracts(spark, d).select(body.alias("body")), "body")


@query("s11_prices", "SELECT n_name || '-a' AS id, CAST(n_nationkey AS DOUBLE) AS price FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT n_name || '-b', 2.5 FROM nation WHERE n_nationkey % 3 > 0")
def s11(spark, d):
    plans = F.array(
        F.struct(F.concat("n_name", F.lit("-a")).alias("id"), F.col("n_nationkey").cast("double").alias("price")),
        F.struct(F.concat("n_name", F.lit("-b")).alias("id"), F.lit(2.5).alias("price")),
    )
    config = F.when(F.col("n_nationkey") % 3 == 0, '{"plans":1}').otherwise(F.to_json(plans))
    return records.prices(b.table(spark, d, "nation").select(config.alias("c")), "c")


SQUEEZED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(13), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("p8_document_title", f"""WITH s AS (SELECT doc_id, {SQUEEZED.format("'  ' || coalesce(text, '')")} AS t FROM documents)
  SELECT doc_id, nullif(trim(substr(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 1, 120)), '') AS title,
    nullif(trim(substr(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 280)), '') AS description FROM s""")
def p8(spark, d):
    titled = docs.document_title(F.concat(F.lit("  "), "text"))
    return b.table(spark, d, "documents").select("doc_id", titled.alias("x")).select("doc_id", "x.*")


@query("p9_xml_to_text", f"""SELECT doc_id, {SQUEEZED.format("'  a&b  ' || doc_id || ' ' || replace(text, '<', '(') || '  raw <'")} AS plain FROM documents""".replace("<'", "'"))
def p9_xml(spark, d):
    body = F.replace(F.col("text"), F.lit("<"), F.lit("("))
    xml = F.concat(F.lit("<?xml version='1.0'?><a x='1'>a&amp;b</a>"), F.lit("<b>"), F.col("doc_id").cast("string"), F.lit("</b>"), body, F.lit("<c/><![CDATA[raw]]>"))
    return b.table(spark, d, "documents").select("doc_id", docs.xml_to_text(xml).alias("plain"))


@query("p10_paragraphs", "SELECT doc_id, 'one ' || doc_id || 'x&y' || chr(10) || lang AS body FROM documents")
def p10(spark, d):
    xml = F.concat(
        F.lit('<w:document><w:p a="1"><w:r><w:t xml:space="preserve">one </w:t></w:r><w:r><w:t>'), F.col("doc_id").cast("string"), F.lit("x&amp;y</w:t></w:r></w:p><w:p> </w:p><w:p><w:t> "),
        F.col("lang"), F.lit(" </w:t></w:p></w:document>"),
    )
    return b.table(spark, d, "documents").select("doc_id", docs.paragraphs_text(xml).alias("body"))


@query("p10_package_metadata", "SELECT doc_id, 'T & ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS creator FROM documents")
def p10_meta(spark, d):
    creator = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<creator>"), "lang", F.lit("</creator>"))).otherwise("")
    xml = F.concat(F.lit("<package><metadata><dc:title id='x'> </dc:title><dc:title>T &amp; "), F.col("doc_id").cast("string"), F.lit("</dc:title>"), creator, F.lit("</metadata></package>"))
    return b.table(spark, d, "documents").select("doc_id", docs.package_metadata(xml).alias("m")).select("doc_id", "m.title", "m.creator")


@query("p10_spine", "SELECT doc_id, 'OEBPS/text/b ' || doc_id || '.xhtml,img.html,OEBPS/a.html' AS files FROM documents")
def p10_spine(spark, d):
    xml = F.concat(
        F.lit("<package><manifest><item id='a' href='a.html#x'/><item href=\"text/./b%20"), F.col("doc_id").cast("string"), F.lit(".xhtml?q\" id=\"b\"/><item id='c' href='../img.html'/></manifest>"),
        F.lit("<spine toc='n'><itemref idref='b'/><itemref idref='none'/><itemref idref=\"c\"/><itemref idref='a'/></spine></package>"),
    )
    return b.table(spark, d, "documents").select("doc_id", F.array_join(docs.spine_files(xml, F.lit("/OEBPS/content.opf")), ",").alias("files"))


@query("p25_m21_rename_variants", """WITH o AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'new' ELSE 'old' END AS display_name FROM o WHERE s_suppkey % 3 > 0""")
def m21(spark, d):
    rows = b.table(spark, d, "supplier").select("s_suppkey", F.unhex(F.sha2(F.col("s_suppkey").cast("string"), 256)).alias("digest"))
    rows = rows.select("s_suppkey", ids.version0("digest").alias("v0"))
    rows = rows.withColumn("v1", F.get(ids.id_variants("v0"), F.lit(1)))
    old = rows.select(F.lit("W").alias("wallet"), F.col("v1").alias("cid"), F.lit("old").alias("display_name"), F.lit(1).alias("updated_at"))
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise("new")
    changes = rows.filter("s_suppkey % 3 < 2").select(F.lit("W").alias("wallet"), F.col("v0").alias("cid"), name.alias("display_name"), F.lit(2).alias("updated_at"))
    done = merge.rename_variants(old, changes)
    return done.join(rows, done.cid == rows.v1).select("s_suppkey", "display_name")


@query(
    "m9_split_upload",
    """WITH u AS (SELECT o_orderkey, 'W' || o_custkey AS wallet, o_orderkey % 5 + 1 AS n, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS total FROM orders)
  SELECT wallet, 'r' || o_orderkey || '-' || k AS root_cid, o_orderkey AS created_at, CASE WHEN total > 0 THEN total // n END AS bytes_estimated FROM u, range(5) r(k) WHERE k < n""",
)
def m9_split(spark, d):
    i = F.col("o_orderkey")
    roots = F.transform(F.sequence(F.lit(0).cast("bigint"), i % 5), lambda k: F.concat(F.lit(" r"), i.cast("string"), F.lit("-"), k.cast("string")))
    total = F.when(i % 4 == 0, 0).otherwise(F.floor("o_totalprice")).cast("bigint")
    rows = b.table(spark, d, "orders").select(b.tagged("W", "o_custkey").alias("wallet"), F.concat(roots, F.array(F.lit(" "), F.get(roots, F.lit(0)))).alias("roots"), i.alias("created_at"), total.alias("total_bytes"))
    return merge.split_bytes(rows)


@query("m22_touch_plans", "SELECT 'W' || c_custkey AS wallet, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_custkey END AS plan_checked_at FROM customer")
def m22(spark, d):
    wallets = b.table(spark, d, "customer").select("c_custkey", b.tagged("W", "c_custkey").alias("wallet"), F.col("c_custkey").alias("plan_checked_at"))
    return merge.touch_plans(wallets.drop("c_custkey"), wallets.filter("c_custkey % 3 = 0"), 99)


@query("m22_root_delete", b.with_frames("wallet_roots", "SELECT wallet, root_cid FROM wallet_roots WHERE root_cid NOT LIKE '%5'"))
def m22_delete(spark, d):
    roots = b.wallet_roots(spark, d)
    return merge.delete_roots(roots, roots.filter("root_cid LIKE '%5'")).select("wallet", "root_cid")


@query(
    "m23_pins",
    b.with_frames("wallet_pins", "SELECT wallet, cid, min(created_at) AS created_at FROM (SELECT * FROM wallet_pins UNION ALL SELECT 'W' || user_id, 'P' || event_id % 50, 7 FROM events WHERE event_type = 'click') GROUP BY ALL"),
)
def m23(spark, d):
    clicks = b.table(spark, d, "events").filter("event_type IN ('click', 'view')")
    cid = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat(F.lit(" P"), (F.col("event_id") % 50).cast("string")))
    asked = clicks.select(b.tagged(" W", "user_id").alias("wallet"), cid.alias("cid"), F.lit(7).cast("bigint").alias("created_at"))
    return merge.add_pins(b.wallet_pins(spark, d), asked)


@query("a21_node_stats", b.with_frames("wallet_pins", "SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS wallets, count(*) AS pins, count(DISTINCT cid) AS pinned_items FROM wallet_pins"))
def a21(spark, d):
    return metrics.node_stats(b.table(spark, d, "customer").select(b.tagged("W", "c_custkey").alias("wallet")), b.wallet_pins(spark, d))


@query(
    "a20_state_snapshot",
    b.with_frames("items listings", """SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE present) AS present, (SELECT count(*) FROM listings) AS edges,
  CAST(sum(CASE WHEN event_type = 'click' THEN user_id ELSE 0 END) AS BIGINT) AS types_indexed, CAST(sum(CASE WHEN event_type = 'view' THEN user_id ELSE 0 END) AS BIGINT) AS dirs_expanded, max(epoch_us(ts) // 1000) // 1000 AS last_at_seconds FROM events"""),
)
def a20(spark, d):
    name = F.when(F.col("event_type") == "click", "types_indexed").when(F.col("event_type") == "view", "dirs_expanded").otherwise("other")
    counters = b.table(spark, d, "events").select(name.alias("name"), F.col("user_id").alias("value"), b.millis("ts").alias("at_ms"))
    return metrics.state_snapshot(b.items(spark, d), b.listings(spark, d), counters)


@query(
    "a16_mean_label_score",
    """WITH chunks AS (SELECT doc_id, unnest(range(greatest((length(trim(text)) + 3999) // 4000, 1))) AS k, length(trim(text)) AS n FROM documents WHERE trim(text) <> ''), c AS (SELECT * FROM chunks WHERE k < 10),
  s AS (SELECT doc_id, ['alpha', 'beta'][CAST(k % 2 + 1 AS INTEGER)] AS label, (k + 1) / 10.0 AS score FROM c), t AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
  SELECT doc_id, label, CAST(round(sum(score) / any_value(t.n), 6) AS DOUBLE) AS mean FROM s JOIN t USING (doc_id) GROUP BY ALL""",
)
def a16(spark, d):
    rows = metrics.chunks(b.table(spark, d, "documents"), "doc_id", "text")
    label = F.element_at(F.array(F.lit(" Alpha"), F.lit("beta ")), (F.col("chunk") % 2 + 1).cast("int"))
    scores = rows.select("doc_id", "chunk", F.array(F.struct(label.alias("label"), ((F.col("chunk") + 1) / 10.0).alias("score"))).alias("scores"))
    return metrics.mean_scores(scores, "doc_id").withColumn("mean", F.round("mean", 6))


@query(
    "w12_ingest_requests",
    """SELECT 'W' || user_id AS wallet, CASE WHEN event_id % 3 = 0 THEN 'pro' END AS plan_id, CASE WHEN value >= 1 AND event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) WHEN value > 0 AND event_id % 4 <> 0 THEN 0 END AS est_bytes,
  CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS display_name FROM events WHERE event_id % 7 <> 0""",
)
def w12(spark, d):
    i = F.col("event_id")
    size = F.when(i % 4 == 0, F.lit(-1.0)).otherwise(F.col("value"))
    body = F.to_json(F.struct(
        F.when(i % 7 == 0, " ").otherwise(b.tagged(" W", "user_id")).alias("wallet"), F.when(i % 3 == 0, "pro ").otherwise("").alias("planId"), size.alias("estBytes"),
        F.when(i % 4 == 0, F.concat(F.lit("a"), i.cast("string"))).alias("displayName"), F.when(i % 4 < 2, " b ").alias("name"), F.when(i % 4 == 2, "c").alias("filename"),
    ))
    return usage.ingest_requests(b.table(spark, d, "events").select(body.alias("body")), "body")


@query(
    "k4_import_roots",
    "SELECT DISTINCT user_id AS upload, 'c' || event_id % 40 AS cid FROM events WHERE event_type <> 'error'",
)
def k4(spark, d):
    from tessera.queries.streams import EVENTS

    raw = usage.event_stream(spark, f"{d}/events.parquet", EVENTS)
    line = F.when(F.col("event_type") == "error", '{"Stats":{}}').otherwise(F.concat(F.lit('{"Root":{"Cid":{"/":"c'), (F.col("event_id") % 40).cast("string"), F.lit('"}}}')))
    return usage.run_to_end(usage.import_roots(raw.select(F.col("user_id").alias("upload"), line.alias("line")), "line"), "append")


@query(
    "w7_upload_tokens",
    """WITH i AS (SELECT 'T' || event_id AS token, epoch_us(ts) // 1000 AS issued_at FROM events WHERE event_id % 5 = 0), u AS (SELECT 'T' || (event_id - event_id % 5) AS token, epoch_us(ts) // 1000 AS used_at, event_id FROM events WHERE event_id % 5 > 0)
  SELECT token, used_at, event_id FROM (SELECT u.*, row_number() OVER (PARTITION BY token ORDER BY used_at, event_id) AS r FROM u JOIN i USING (token) WHERE used_at BETWEEN issued_at AND issued_at + 600000) WHERE r = 1""",
)
def w7(spark, d):
    i = F.col("event_id")
    rows = b.table(spark, d, "events").select("event_id", b.millis("ts").alias("at"))
    issued = rows.filter(i % 5 == 0).select(b.tagged("T", "event_id").alias("token"), F.col("at").alias("issued_at"))
    used = rows.filter(i % 5 > 0).select(F.concat(F.lit("T"), (i - i % 5).cast("string")).alias("token"), F.col("at").alias("used_at"), "event_id")
    return usage.redeemed(issued, used)
