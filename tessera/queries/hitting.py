"""Hit projection, tags of sites, and the predicates on hits, ids, names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.functions import detect, hits, text
from tessera.registry import query

#: Hits of the items frame for DuckDB.
HITS = b.with_frames("items", """, h AS (SELECT *, lower(coalesce(mime, '')) AS m, lower(coalesce(ext_guess, '')) AS e, nullif(j->>'$.title', '') AS title,
    nullif(coalesce(CASE WHEN kind = 'text' THEN j->>'$.preview' END, j->>'$.description'), '') AS snippet,
    list_filter(list_transform(coalesce(CAST(j->'$.topics' AS VARCHAR[]), []), lambda x: lower(trim(x))), lambda x: x <> '') AS topics,
    coalesce(CAST(j->'$.signals.from' AS VARCHAR[]), []) AS signals, coalesce(json_keys(j->'$.tokens'), []) AS keys FROM (SELECT *, tags_json::JSON AS j FROM items))""")


def found(spark, d):
    return hits.projected(b.items(spark, d))


def count_of(word: str) -> str:
    return f"coalesce(CAST(j->>'$.tokens.\"{word}\"' AS DOUBLE), 0)"


@query(
    "p22_hit_projection",
    HITS + """ SELECT cid, array_to_string(topics, ',') AS topics, title, snippet, coalesce(root_cid, cid) AS root_cid, CASE WHEN kind IN ('site', 'image') THEN kind ELSE 'all' END AS resource_type FROM h""",
)
def p22(spark, d):
    return found(spark, d).select("cid", F.array_join("topics", ",").alias("topics"), "title", "snippet", "root_cid", "resource_type")


STOPPED = ", ".join(f"'{w}'" for w in hits.TAG_STOP_WORDS)


@query(
    "t4_f29_site_tags",
    HITS + f""", t AS (SELECT cid, unnest(topics) AS tag, unnest(range(len(topics))) AS o FROM h),
  k AS (SELECT cid, k, CAST(json_extract_string(j, '$.tokens."' || k || '"') AS DOUBLE) AS n FROM (SELECT cid, j, unnest(keys) AS k FROM h)),
  r AS (SELECT cid, lower(trim(k)) AS tag, 999 + row_number() OVER (PARTITION BY cid ORDER BY n DESC, lower(trim(k))) AS o FROM k WHERE n > 0),
  a AS (SELECT cid, tag, min(o) AS o FROM (SELECT * FROM t UNION ALL SELECT * FROM r WHERE o < 1050) WHERE length(tag) >= 3 AND tag NOT IN ({STOPPED}) GROUP BY ALL)
  SELECT cid, string_agg(tag, ',' ORDER BY o) AS tags FROM a GROUP BY 1""",
)
def t4(spark, d):
    tags = hits.site_tags(F.col("topics"), F.col("tokens"))
    return found(spark, d).select("cid", F.array_join(tags, ",").alias("tags")).filter("tags <> ''")


@query(
    "f24_strict_type",
    HITS + " SELECT cid, length(cid) % 2 = 1 OR kind = 'image' OR starts_with(m, 'image/') AS passes FROM (SELECT * REPLACE (coalesce(kind, '') AS kind) FROM h)",
)
def f24(spark, d):
    asked = F.when(F.length("cid") % 2 == 0, " Images").otherwise("video")
    return found(spark, d).select("cid", hits.is_of_strict_type(F.col("kind"), F.col("mime"), asked).alias("passes"))


@query(
    "f13_octet_rescue",
    HITS + " SELECT cid, mime FROM h WHERE m <> 'application/octet-stream' OR e IN ('pdf', 'docx', 'epub', 'html', 'htm', 'txt') OR regexp_matches(lower(coalesce(path, '')), '\\.(pdf|docx|epub|html|htm|txt)$')",
)
def f13(spark, d):
    return found(spark, d).filter(hits.is_kept_stream(F.col("mime"), F.col("ext_guess"), F.col("path"))).select("cid", "mime")


SNIP, TITLE = "lower(trim(coalesce(snippet, '')))", "lower(trim(coalesce(title, '')))"
MARKS = " + ".join(f"CAST(({count_of(w)} > 0 OR contains({SNIP}, '{w}')) AS INTEGER)" for w in hits.PDF_WORDS)
STREAMED = " OR ".join(f"{count_of(w)} > 0 OR contains({SNIP}, '{w}')" for w in ("stream", "endstream"))
DICTISH = " OR ".join(f"{count_of(w)} > 0 OR contains({SNIP}, '{w}')" for w in ("flatedecode", "mediabox", "cropbox", "resources", "font", "xobject"))


@query(
    "f16_pdf_internal_hits",
    HITS + f""" SELECT cid, (list_contains(keys, '00000') AND len(list_filter(keys, lambda x: regexp_full_match(x, '[0-9]{{6,12}}'))) >= 8)
    OR CASE WHEN {count_of('obj')} >= 2 OR regexp_matches({SNIP}, '\\b[0-9]+\\s+[0-9]+\\s+obj\\b') THEN {MARKS} >= 2 ELSE ({STREAMED}) AND ({DICTISH}) AND {MARKS} >= 3 END AS internal FROM h""",
)
def f16(spark, d):
    return found(spark, d).select("cid", hits.is_pdf_internal_hit(F.col("title"), F.col("snippet"), F.col("tokens")).alias("internal"))


WORDS = ("flatedecode", "xobject", "colorspace", "bitspercomponent", "mediabox", "cropbox", "resources", "font")


@query(
    "f17_pdf_internal_text",
    f"""WITH s AS (SELECT cid, lower(substr(t, 1, 8192)) AS t FROM (SELECT 'doc-' || doc_id AS cid, text AS t FROM documents UNION ALL SELECT 'page-' || page_id, html FROM pages))
  SELECT cid, (len(regexp_extract_all(t, '\\b[0-9]{{6,12}}\\s+[0-9]{{5}}\\s+[nf]\\b')) >= 3 AND length(regexp_replace(t, '[0-9nf\\s]', '', 'g')) <= 10)
    OR 2 * CAST(regexp_matches(t, '\\b[0-9]+\\s+[0-9]+\\s+obj\\b') AS INTEGER) + {' + '.join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in ('endobj', 'xref', 'trailer', 'stream', 'endstream'))} >= 4
    OR (contains(t, 'stream') AND contains(t, 'endstream') AND {' + '.join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in WORDS)} >= 3) AS internal FROM s""",
)
def f17(spark, d):
    texts = b.table(spark, d, "documents").select(b.tagged("doc-", "doc_id").alias("cid"), F.col("text").alias("t"))
    pages = b.table(spark, d, "pages").select(b.tagged("page-", "page_id").alias("cid"), F.col("html").alias("t"))
    return texts.unionByName(pages).select("cid", detect.is_pdf_internal(F.col("t")).alias("internal"))


def has(*marks: str) -> str:
    return f"list_has_any(signals, [{', '.join(repr(m) for m in marks)}])"


@query(
    "f18_broken_previews",
    HITS + f""" SELECT cid, (e = 'pdf' OR contains(m, 'pdf')) AND {has('doc:pdf_url_extract_failed', 'doc:full_fetch_failed')} AND {has('text:head:low_signal', 'doc:sample')}
      AND len(list_filter(keys, lambda k: lower(trim(k)) NOT IN ('', 'pdf', 'obj', 'endobj', 'xref', 'linearized'))) = 0 AS broken_pdf,
    (e = 'epub' OR contains(m, 'epub') OR ends_with(lower(coalesce(path, '')), '.epub')) AND (starts_with(trim(coalesce(snippet, '')), 'PK') OR regexp_matches({SNIP}, 'mimetypeapplication/epub\\+zip|jfif')
      OR {has('doc:epub_parse_failed')} OR (title IS NULL AND snippet IS NULL AND {has('doc:sample')})) AS broken_epub FROM h""",
)
def f18(spark, d):
    c = F.col
    return found(spark, d).select(
        "cid", hits.is_broken_pdf(c("mime"), c("ext_guess"), c("signals"), c("tokens")).alias("broken_pdf"),
        hits.is_broken_epub(c("mime"), c("ext_guess"), c("path"), c("title"), c("snippet"), c("signals")).alias("broken_epub"),
    )


@query("f19_zip_snippets", HITS + f" SELECT cid, starts_with(trim(coalesce(snippet, '')), 'PK') OR regexp_matches({SNIP}, 'mimetypeapplication/epub\\+zip|jfif') AS zipped FROM h")
def f19(spark, d):
    return found(spark, d).select("cid", hits.is_zip_snippet(F.col("snippet")).alias("zipped"))


@query(
    "f20_low_signal",
    HITS + """ SELECT cid, path IS NULL AND title IS NULL AND snippet IS NULL AND CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda k: trim(k) <> '')) >= 15
      AND len(list_filter(keys, lambda k: regexp_matches(trim(k), '\\s'))) >= 0.8 * len(list_filter(keys, lambda k: trim(k) <> '')) ELSE len(topics) = 0 END AS low FROM h""",
)
def f20(spark, d):
    c = F.col
    return found(spark, d).select("cid", hits.is_low_signal(c("path"), c("title"), c("snippet"), c("tokens"), c("topics")).alias("low"))


@query(
    "f23_listing_pages",
    HITS + f""" SELECT cid, {TITLE} = 'index of' OR starts_with({TITLE}, 'index of ') OR regexp_matches({TITLE}, '^/?ipfs/') OR contains({SNIP}, 'a directory of content-addressed files hosted on') AS listing FROM h""",
)
def f23(spark, d):
    return found(spark, d).select("cid", hits.is_listing(F.col("title"), F.col("snippet")).alias("listing"))


@query(
    "f15_explore_types",
    HITS + f""", x AS (SELECT *, lower(coalesce(path, '')) AS p, {TITLE} = 'index of' OR starts_with({TITLE}, 'index of ') OR regexp_matches({TITLE}, '^/?ipfs/') OR contains({SNIP}, 'a directory of content-addressed files hosted on') AS listing FROM h)
  SELECT cid, CASE WHEN coalesce(kind, '') = 'image' OR starts_with(m, 'image/') THEN 'image' WHEN e = 'pdf' OR contains(m, 'pdf') OR ends_with(p, '.pdf') THEN CASE WHEN confidence >= 0.3 THEN 'pdf' END
    WHEN e = 'epub' OR contains(m, 'epub') OR ends_with(p, '.epub') THEN CASE WHEN confidence >= 0.3 THEN 'epub' END
    WHEN e IN ('html', 'htm') OR regexp_matches(p, '\\.(html|htm|xhtml)$') OR contains(m, 'text/html') THEN CASE WHEN NOT listing THEN 'html' END
    WHEN e = 'txt' OR ends_with(p, '.txt') OR starts_with(m, 'text/plain') THEN CASE WHEN confidence >= 0.3 THEN 'txt' END END AS explore_type FROM x""",
)
def f15(spark, d):
    c = F.col
    kind = hits.explore_type(c("kind"), c("mime"), c("ext_guess"), c("path"), c("title"), c("snippet"), c("confidence") < 0.3)
    return found(spark, d).select("cid", kind.alias("explore_type"))


@query("p35_resource_type", HITS + " SELECT cid, CASE WHEN kind IN ('site', 'image') THEN kind ELSE 'all' END AS resource_type FROM h")
def p35(spark, d):
    return b.items(spark, d).select("cid", hits.resource_type(F.col("kind")).alias("resource_type"))


@query("p36_media_type", b.with_frames("items", "SELECT cid, mime AS media FROM items"))
def p36(spark, d):
    header = F.concat(F.lit(" "), F.upper("mime"), F.lit(" ; charset=UTF-8; x=1"))
    return b.items(spark, d).select("cid", hits.media_type(header).alias("media"))


V0 = "'Qm' || substr(translate(sha256(CAST(doc_id AS VARCHAR)), '0', 'z'), 1, 44)"
V1 = "'b' || translate(sha256(CAST(doc_id AS VARCHAR)), '0189', 'wxyz')"
VALUE = f"CASE doc_id % 8 WHEN 0 THEN {V0} WHEN 1 THEN ' ' || {V1} || ' ' WHEN 2 THEN '/ipfs/' || {V0} || '/a?b' WHEN 3 THEN 'ipns://name' || doc_id WHEN 4 THEN 'k51abcdefghij' || doc_id WHEN 5 THEN '/ipns/other' || doc_id || '/x' WHEN 6 THEN '' ELSE 'word' || doc_id END"


@query(
    "f25_id_values",
    f"""WITH v AS (SELECT doc_id, {VALUE} AS v, {V0} AS v0, {V1} AS v1 FROM documents)
  SELECT doc_id, doc_id % 8 < 2 AS is_id, CASE doc_id % 8 WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v0 END AS id, doc_id % 8 IN (3, 4, 5) AS is_pointer,
    CASE doc_id % 8 WHEN 3 THEN 'name' || doc_id WHEN 5 THEN 'other' || doc_id WHEN 6 THEN NULL ELSE trim(v) END AS pointer FROM v""",
)
def f25(spark, d):
    i = F.col("doc_id")
    hexed = F.sha2(i.cast("string"), 256)
    v0 = F.concat(F.lit("Qm"), F.substring(F.translate(hexed, "0", "z"), 1, 44))
    v1 = F.concat(F.lit("b"), F.translate(hexed, "0189", "wxyz"))
    name = i.cast("string")
    value = (
        F.when(i % 8 == 0, v0).when(i % 8 == 1, F.concat(F.lit(" "), v1, F.lit(" "))).when(i % 8 == 2, F.concat(F.lit("/ipfs/"), v0, F.lit("/a?b")))
        .when(i % 8 == 3, F.concat(F.lit("ipns://name"), name)).when(i % 8 == 4, F.concat(F.lit("k51abcdefghij"), name))
        .when(i % 8 == 5, F.concat(F.lit("/ipns/other"), name, F.lit("/x"))).when(i % 8 == 6, "").otherwise(F.concat(F.lit("word"), name))
    )
    rows = b.table(spark, d, "documents").select("doc_id", value.alias("v"))
    v = F.col("v")
    return rows.select("doc_id", hits.is_id(v).alias("is_id"), hits.id_in_value(v).alias("id"), hits.is_name_pointer(v).alias("is_pointer"), hits.pointer_name(v).alias("pointer"))


@query(
    "f27_f30_addresses",
    """WITH a AS (SELECT event_id, event_id % 230 AS a, event_id // 7 % 300 AS b, event_id % 3 AS c, event_id % 5 AS k FROM events)
  SELECT event_id, b <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) AS public_v4,
    k = 4 AS global_v6, a = 10 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) AS private_remote,
    CASE k WHEN 0 THEN b <= 255 AND NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) WHEN 2 THEN true WHEN 4 THEN true ELSE false END AS usable,
    CASE k WHEN 0 THEN '/ip4/' || a || '.' || b || '.' || c || '.1/tcp/4001' WHEN 1 THEN '/ip4/1.1.1.1/tcp/1/p2p-circuit' WHEN 2 THEN '/dns4/host' || a WHEN 3 THEN '/dns/localhost/tcp/1' ELSE '/ip6/2001::1/tcp/1' END AS bare FROM a""",
)
def f27(spark, d):
    i = F.col("event_id")
    ip = F.concat_ws(".", (i % 230).cast("string"), (F.floor(i / 7) % 300).cast("string"), (i % 3).cast("string"), F.lit("1"))
    v6 = F.element_at(F.array(*map(F.lit, ("::1", "fe80::1", "fc00::2", "2001::1%eth0", "2001::1"))), (i % 5 + 1).cast("int"))
    remote = F.concat(F.when(i % 2 == 0, "::ffff:").otherwise(""), ip)
    address = (
        F.when(i % 5 == 0, F.concat(F.lit("/ip4/"), ip, F.lit("/tcp/4001"))).when(i % 5 == 1, "/ip4/1.1.1.1/tcp/1/p2p-circuit")
        .when(i % 5 == 2, F.concat(F.lit("/dns4/host"), (i % 230).cast("string"))).when(i % 5 == 3, "/dns/localhost/tcp/1").otherwise("/ip6/2001::1/tcp/1")
    )
    with_peer = F.concat(address, F.lit("/p2p/peer"))
    return b.table(spark, d, "events").select(
        "event_id", hits.is_public_v4(ip).alias("public_v4"), hits.is_global_v6(v6).alias("global_v6"), hits.is_private_remote(remote).alias("private_remote"),
        hits.is_usable_multiaddress(with_peer).alias("usable"), hits.without_peer(with_peer).alias("bare"),
    )


@query("f32_path_suffix", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'epub' WHEN 3 THEN 'txt' END AS suffix FROM documents")
def f32(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".docx", ".EPUB ", ".txt", ".pdf.html"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return b.table(spark, d, "documents").select("doc_id", hits.path_suffix(F.concat(F.lit("a/"), ending)).alias("suffix"))


@query("f33_record_value", b.with_frames("domain_records", "SELECT domain, bool_or(record_value IN ('/ipfs/P3', '/ipfs/P44')) AS linked FROM domain_records GROUP BY 1"))
def f33(spark, d):
    per = b.domain_records(spark, d).groupBy("domain").agg(F.collect_set(F.concat(F.lit(" "), "record_value")).alias("values"))
    return per.select("domain", (hits.has_record_value(F.col("values"), F.lit("/ipfs/P3")) | hits.has_record_value(F.col("values"), F.lit("/ipfs/P44"))).alias("linked"))


@query("f34_wallet_syntax", "SELECT c_custkey, c_custkey % 3 = 0 AS valid FROM customer")
def f34(spark, d):
    wallet = F.concat(F.element_at(F.array(*map(F.lit, ("net1a", "Net1a", "net2a"))), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string"))
    return b.table(spark, d, "customer").select("c_custkey", hits.is_address(wallet, "net").alias("valid"))


@query("p27_format_query", b.with_frames("paths", f"SELECT root_cid, path, CASE WHEN w IN ({', '.join(repr(w) for w in text.FORMAT_WORDS)}) THEN w END AS format FROM (SELECT *, lower(split_part(path, '.', 2)) AS w FROM paths)"))
def p27(spark, d):
    word = F.lower(F.coalesce(F.get(F.split("path", r"\."), F.lit(1)), F.lit("")))
    return b.paths(spark, d).select("root_cid", "path", text.format_query(word).alias("format"))


@query(
    "f7_sanitized_tokens",
    "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(x))), lambda x: regexp_full_match(x, '[a-z0-9]+'))[1:12], ' ') AS tokens FROM conversations",
)
def f7(spark, d):
    return b.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.sanitized(F.split("text", " ")), " ").alias("tokens"))


@query("p37_score_pairs", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS first, CASE WHEN p_partkey % 4 > 0 THEN 0.25::DOUBLE END AS score FROM part")
def p37(spark, d):
    labels = F.when(F.col("p_partkey") % 4 > 0, F.array("p_brand", "p_type"))
    scores = F.when(F.col("p_partkey") % 4 == 1, F.array(F.lit(0.25))).otherwise(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = b.table(spark, d, "part").select("p_partkey", hits.score_pairs(labels, scores).alias("s"))
    return rows.select("p_partkey", F.size("s").alias("n"), F.get("s", F.lit(0))["label"].alias("first"), F.get("s", F.lit(0))["score"].alias("score"))


@query("p38_contract_metadata", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END AS INTEGER) AS keys FROM orders")
def p38(spark, d):
    i = F.col("o_orderkey")
    raw = F.when(i % 4 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("status"), i.alias("n")))).when(i % 4 == 1, "no json").when(i % 4 == 2, "")
    rows = b.table(spark, d, "orders").select("o_orderkey", hits.contract_metadata(raw).alias("m"))
    return rows.select("o_orderkey", F.try_element_at("m", F.lit("status")).alias("status"), F.size("m").alias("keys"))


@query(
    "p33_merge_tokens",
    """WITH t AS (SELECT p_partkey, p_brand AS token, 1.0 AS n FROM part UNION ALL SELECT p_partkey, p_type, 2.0 FROM part UNION ALL SELECT p_partkey, p_type, 5.0 FROM part UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR), 1.0 FROM part)
  SELECT p_partkey, token, CAST(sum(n) AS DOUBLE) AS n FROM t GROUP BY ALL""",
)
def p33(spark, d):
    model = F.create_map("p_brand", F.lit(1.0), "p_type", F.lit(2.0))
    words = F.create_map("p_type", F.lit(5.0), F.col("p_size").cast("string"), F.lit(1.0))
    return b.table(spark, d, "part").select("p_partkey", F.explode(text.merged_tokens(model, words)).alias("token", "n"))


@query("p33_merge_topics", "SELECT p_partkey, array_to_string(list_distinct_in_order, ',') AS topics FROM (SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS list_distinct_in_order FROM part)")
def p33_topics(spark, d):
    return b.table(spark, d, "part").select("p_partkey", F.array_join(text.merged_topics(F.array("p_brand"), F.array("p_type", "p_brand")), ",").alias("topics"))
