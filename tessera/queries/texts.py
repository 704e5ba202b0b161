"""Text and HTML functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.bindings import dealt, shares, table
from tessera.functions import docs, html, text
from tessera.registry import query
from tessera.sources import token_index, vocabulary
from tessera.storage import stored

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)

#: The same expressions for DuckDB.
NORMALIZED = (
    "trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x09\\x0A\\x0D\\x20-\\x7E]', ' ', 'g')), "
    "'[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)
HISTOGRAM = f"""
  words AS (SELECT cid, token, pos FROM (
      SELECT cid, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos
      FROM (SELECT cid, string_split(norm, ' ') AS w FROM texts))
    WHERE regexp_full_match(token, '[a-z]{{3,}}') AND token NOT IN ({STOP})),
  firsts AS (SELECT cid, token, min(pos) AS first FROM words GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY first) AS rank FROM firsts),
  ends AS (SELECT cid, max(first) FILTER (rank = 256) AS "end" FROM ranked GROUP BY cid),
  histogram AS (SELECT w.cid, w.token, count(*) AS "count" FROM words w JOIN ranked r ON w.cid = r.cid AND w.token = r.token
    JOIN ends e ON w.cid = e.cid WHERE r.rank <= 256 AND (e."end" IS NULL OR w.pos <= e."end") GROUP BY ALL),
  cut AS (SELECT cid, token, least(1000, "count") AS "count" FROM histogram),
  tokens AS (SELECT cid, token, "count" FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY "count" DESC, token) AS rank FROM cut)
    WHERE rank <= 128)"""
#: The same counts over whole texts.
WHOLE_HISTOGRAM = f"""
  words AS (SELECT cid, token FROM (SELECT cid, unnest(string_split(norm, ' ')) AS token FROM texts)
    WHERE regexp_full_match(token, '[a-z]{{3,}}') AND token NOT IN ({STOP})),
  histogram AS (SELECT cid, token, count(*) AS "count" FROM words GROUP BY ALL)"""
WHOLE_TOKENS = f"""{WHOLE_HISTOGRAM},
  cut AS (SELECT cid, token, least(1000, "count") AS "count" FROM histogram),
  tokens AS (SELECT cid, token, "count" FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY "count" DESC, token) AS rank FROM cut)
    WHERE rank <= 128)"""
DOC_TEXTS = f"texts AS (SELECT 'doc-' || doc_id AS cid, {NORMALIZED.format('text')} AS norm FROM documents)"


def doc_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("cid"), text.normalize_text(F.col("text")).alias("norm"))


def counted(spark, d, most=256):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("cid"), "text")
    # some 20,000 texts a task
    return text.word_counts(dealt(docs, shares(spark, d, "documents", by=25), "cid"), "cid", "text", most, by=text.normalize_text)


def stored_counts(spark, d):
    """Each document's words and counts, stored for the tables made of them: texts are normalised once."""
    path = stored(spark, "word-counts", [f"{d}/documents.parquet"], lambda path: counted(spark, d).write.parquet(path))
    return spark.read.schema("cid string, counts array<struct<token: string, count: bigint>>").parquet(path)


def index_path(spark, d):
    """The stored token index of the documents: built once for a state of the table, then read."""

    def build(path):
        counts = stored_counts(spark, d)
        token_index.write(text.index_tokens(counts, "cid", 128), path, counts.count() * 128)

    return stored(spark, "token-index", [f"{d}/documents.parquet"], build)


def stored_tokens(spark, d):
    return token_index.read(spark, index_path(spark, d))


def vocabulary_path(spark, d):
    """The stored vocabulary of that index."""
    return stored(spark, "vocabulary", [f"{d}/documents.parquet"], lambda path: vocabulary.write(stored_tokens(spark, d), path))


def stored_topics(spark, d):
    def build(path):
        text.topics(stored_counts(spark, d), "cid").write.parquet(path)

    path = stored(spark, "topics", [f"{d}/documents.parquet"], build)
    return spark.read.schema("cid string, topics array<string>").parquet(path)


@query("p1_normalize_text", f"WITH {DOC_TEXTS} SELECT cid, norm FROM texts")
def p1(spark, d):
    return doc_texts(spark, d)


@query(
    "p2_clean_search",
    """SELECT conv_id, turn, clean, has_question_mark, CAST(length(clean) AS INTEGER) AS length FROM (
  SELECT conv_id, turn, strpos(text, '?') > 0 AS has_question_mark,
    trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s?]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean
  FROM conversations)""",
)
def p2(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", text.clean_search(F.col("text")).alias("c")).select("conv_id", "turn", "c.*")


@query(
    "q6_query_tokens",
    """SELECT conv_id, turn, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS INTEGER) AS n FROM (
  SELECT conv_id, turn, list_filter(w, lambda x, i: regexp_full_match(x, '[a-z0-9]+') AND list_position(w, x) = i) AS tokens FROM (
    SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s?]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w
    FROM conversations))""",
)
def q6(spark, d):
    rows = table(spark, d, "conversations")
    tokens = text.query_tokens(text.clean_search(F.col("text"))["clean"])
    return rows.select("conv_id", "turn", tokens.alias("t")).select("conv_id", "turn", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(
    "f21_useful_text",
    """SELECT doc_id, letters > 0 AND letters >= 0.15 * solid AS useful FROM (
  SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '\\s', '', 'g')) AS solid FROM documents)""",
)
def f21(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_useful_text(F.col("text")).alias("useful"))


@query(
    "p7_preview",
    """SELECT doc_id, CASE WHEN length(t) = 0 THEN NULL WHEN length(t) <= 600 THEN t
  ELSE regexp_replace(substr(t, 1, 600), '\\s+$', '') || '…' END AS preview FROM (
  SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[^\\x09\\x0A\\x0D\\x20-\\x7E]', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t
  FROM documents)""",
)
def p7(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_preview(F.col("text")).alias("preview"))


USEFUL = "(length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) >= 0.15 * length(regexp_replace({0}, '\\s', '', 'g')))"


@query(
    "p6_title",
    f"""SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 120)) || '…' ELSE t END AS title FROM (
  SELECT doc_id, trim(regexp_replace(coalesce(h, l), '\\s+', ' ', 'g')) AS t FROM (
    SELECT doc_id,
      list_filter(list_transform(w[1:40], lambda x: regexp_extract(x, '^#{{1,6}}\\s+(.+)$', 1)), lambda x: {USEFUL.format('x')})[1] AS h,
      list_filter(w[1:60], lambda x: {USEFUL.format('x')})[1] AS l
    FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS w
      FROM documents)))""",
)
def p6(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_title(F.col("text")).alias("title"))


@query(
    "p6_description",
    f"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS w FROM documents),
  t AS (SELECT doc_id, w, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 120)) || '…' ELSE t END AS title FROM (SELECT doc_id, w, trim(regexp_replace(coalesce(
      list_filter(list_transform(w[1:40], lambda x: regexp_extract(x, '^#{{1,6}}\\s+(.+)$', 1)), lambda x: {USEFUL.format('x')})[1], list_filter(w[1:60], lambda x: {USEFUL.format('x')})[1]), '\\s+', ' ', 'g')) AS t FROM w)),
  u AS (SELECT doc_id, list_filter(list_transform(w[1:120], lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: {USEFUL.format('x')} AND NOT coalesce(lower(x) = lower(title), false))[1:5] AS u FROM t),
  l AS (SELECT doc_id, array_to_string(CASE WHEN length(u[1]) >= 800 THEN u[1:1] WHEN length(u[1]) + length(u[2]) + 1 >= 800 THEN u[1:2] WHEN length(u[1]) + length(u[2]) + length(u[3]) + 2 >= 800 THEN u[1:3]
    WHEN length(u[1]) + length(u[2]) + length(u[3]) + length(u[4]) + 3 >= 800 THEN u[1:4] ELSE u END, ' ') AS j FROM u)
  SELECT doc_id, CASE WHEN coalesce(j, '') = '' THEN NULL WHEN length(j) > 800 THEN rtrim(substr(j, 1, 800)) || '…' ELSE j END AS description FROM l""",
)
def p6_description(spark, d):
    titled = table(spark, d, "documents").select("doc_id", "text", text.text_title(F.col("text")).alias("title"))
    return titled.select("doc_id", text.text_description(F.col("text"), F.col("title")).alias("description"))


@query("a10_token_histogram", f'WITH {DOC_TEXTS}, {WHOLE_HISTOGRAM} SELECT cid, token, "count" FROM histogram')
def a10(spark, d):
    return counted(spark, d, None).select("cid", text.token_rows("counts")).filter("token IS NOT NULL")


@query("t3_index_tokens", f'WITH {DOC_TEXTS}, {WHOLE_TOKENS} SELECT cid, token, "count" FROM tokens')
def t3(spark, d):
    return text.index_tokens(counted(spark, d, None), "cid")


@query(
    "t2_topics",
    f"""WITH {DOC_TEXTS}, {HISTOGRAM} SELECT cid, string_agg(token, ' ' ORDER BY rank) AS topics FROM (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY "count" DESC, token) AS rank FROM histogram
  WHERE token NOT IN ('file', 'data', 'content')) WHERE rank <= 5 GROUP BY cid""",
)
def t2(spark, d):
    return text.topics(counted(spark, d), "cid").select("cid", F.array_join("topics", " ").alias("topics"))


NUMERIC = "{0}"
DECODED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), "
    "'&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '\"', 'gi'), '&#39;', '''', 'gi')"
)


@query(
    "p3_html_title",
    f"""SELECT page_id, CASE WHEN t <> '' THEN substr(t, 1, 200) END AS title FROM (
  SELECT page_id, trim(regexp_replace({DECODED.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.{0,512}?)</title>', 1), '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS t
  FROM pages)""",
)
def p3(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_metadata(F.col("html")).alias("m")).select("page_id", "m.title")


ATTRIBUTE = "trim(coalesce(nullif(regexp_extract(m, '(?i){0}\\s*=\\s*(\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 2), ''), nullif(regexp_extract(m, '(?i){0}\\s*=\\s*(\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 3), ''), regexp_extract(m, '(?i){0}\\s*=\\s*(\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', 4)))"


@query(
    "p3_html_metadata",
    f"""WITH m AS (SELECT page_id, k, lower(coalesce(nullif({ATTRIBUTE.format('name')}, ''), nullif({ATTRIBUTE.format('property')}, ''))) AS name,
      trim(regexp_replace({DECODED.format(ATTRIBUTE.format('content'))}, '\\s+', ' ', 'g')) AS content
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS m, unnest(range(len(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')))) AS k FROM pages)),
  f AS (SELECT page_id, arg_min(content, k) FILTER (name IN ('og:title', 'twitter:title') AND content <> '') AS t, arg_min(content, k) FILTER (name IN ('description', 'og:description', 'twitter:description') AND content <> '') AS x FROM m GROUP BY 1),
  t AS (SELECT page_id, nullif(trim(regexp_replace({DECODED.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.{0,512}?)</title>', 1), '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')), '') AS own FROM pages)
  SELECT page_id, substr(coalesce(own, t), 1, 200) AS title, substr(x, 1, 300) AS description FROM t LEFT JOIN f USING (page_id)""",
)
def p3_all(spark, d):
    return table(spark, d, "pages").select("page_id", html.html_metadata(F.col("html")).alias("m")).select("page_id", "m.*")


@query(
    "p5_entities",
    f"""SELECT doc_id, {DECODED.format("'&amp;'")} || 'A' || chr(CAST(65 + doc_id % 26 AS INTEGER)) || chr(CAST(97 + doc_id % 26 AS INTEGER)) || '😀  <' || lang || '>''&#xZ;&#-1; &unknown;' AS decoded FROM documents""",
)
def p5(spark, d):
    i = F.col("doc_id") % 26
    raw = F.concat(
        F.lit("&AMP;&#65;&#"), (i + 65).cast("string"), F.lit(";&#x"), F.hex(i + 97), F.lit(";&#x1F600;&nbsp;&#0;&lt;"), "lang", F.lit("&gt;&#39;&#xZ;&#-1; &unknown;")
    )
    return table(spark, d, "documents").select("doc_id", html.decode_entities(raw).alias("decoded"))


@query(
    "p9_html_to_text",
    """SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]{2,}', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS plain FROM (SELECT page_id, """
    + DECODED.format(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>|</div>|</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    )
    + " AS t FROM pages)",
)
def p9_text(spark, d):
    # empty lines, of which two in a row may stay, and blanks at line starts are left out of the comparison
    lines = F.transform(F.split(docs.html_to_text(F.col("html")), "\n"), lambda x: F.trim(x))
    return table(spark, d, "pages").select("page_id", F.array_join(F.filter(lines, lambda x: x != ""), "\n").alias("plain"))


READABLE = "regexp_replace({0}, '(?s)<!--.*?-->', ' ', 'g')"
for _block in ("script", "style", "noscript", "svg"):
    READABLE = f"regexp_replace({READABLE}, '(?is)<{_block}.*?</{_block}>', ' ', 'g')"
READABLE = "trim(regexp_replace(regexp_replace(" + DECODED.format("regexp_replace(" + READABLE + ", '<[^>]+>', ' ', 'g')") + ", '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("p4_readable_text", f"SELECT page_id, {READABLE.format('html')} AS readable FROM pages")
def p4(spark, d):
    return table(spark, d, "pages").select("page_id", html.readable_text(F.col("html")).alias("readable"))


@query("p9_strip_tags", """SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS stripped FROM pages""")
def p9(spark, d):
    return table(spark, d, "pages").select("page_id", text.squeeze(html.strip_tags(F.col("html"))).alias("stripped"))


@query(
    "html_token_histogram",
    f"""WITH texts AS (SELECT page_id AS cid, {NORMALIZED.format(READABLE.format('html'))} AS norm FROM pages), {HISTOGRAM} SELECT cid AS page_id, token, "count" FROM histogram""",
)
def html_tokens(spark, d):
    pages = table(spark, d, "pages").select("page_id", text.normalize_text(html.readable_text(F.col("html"))).alias("norm"))
    return text.token_histogram(pages, "page_id", "norm")
