"""Scores, ranks and pages of the flagship search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import index, intent, rank, usage
from tessera.queries.activity import LATEST, OWNED, SINCE
from tessera.queries.relational import POLICY, TOKENS
from tessera.queries.texts import DOC_TEXTS, HISTOGRAM, stored_tokens, stored_topics, vocabulary_path
from tessera.registry import query
from tessera.sources import tiered_index, vocabulary
from tessera.storage import kept, stored


def near(q: str) -> str:
    n = len(q)
    return f"CASE WHEN token <> '{q}' AND length(token) >= 3 AND (contains(token, '{q}') OR contains('{q}', token)) AND least(length(token), {n}) / {n}.0 >= 0.5 THEN \"count\" * 10.0 * (least(length(token), {n}) / {n}.0) END"


SCORED = f"""scored AS (SELECT cid, sum(CASE WHEN token = 'enan' THEN "count" * 10.0 END) AS e0, max({near('enan')}) AS n0,
    sum(CASE WHEN token = 'her' THEN "count" * 10.0 END) AS e1, max({near('her')}) AS n1 FROM tokens GROUP BY 1),
  parts AS (SELECT cid, CAST(coalesce(e0, n0, 0) + coalesce(e1, n1, 0) AS DOUBLE) AS token_part, coalesce(e0, n0) IS NOT NULL OR coalesce(e1, n1) IS NOT NULL AS any_match FROM scored)"""
TOPICS = """topics AS (SELECT cid, list(token) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY "count" DESC, token) AS r FROM histogram
    WHERE token NOT IN ('file', 'data', 'content')) WHERE r <= 5 GROUP BY cid)"""
CONTENT = f"""{DOC_TEXTS}, {HISTOGRAM}, {SCORED}, {TOPICS},
  content AS (SELECT cid, any_match OR list_contains(topics, 'enan') OR list_contains(topics, 'her') AS matched,
    token_part + CASE WHEN list_contains(topics, 'enan') THEN 100 ELSE 0 END + CASE WHEN list_contains(topics, 'her') THEN 100 ELSE 0 END + 7.0 AS content
    FROM parts LEFT JOIN topics USING (cid))"""
RANKED = f"""WITH catalog AS ({b.SQL['catalog']}), access AS ({b.SQL['access']}), wallet_roots AS ({b.SQL['wallet_roots']}), wallet_pins AS ({b.SQL['wallet_pins']}),
  {CONTENT}, {OWNED}, {LATEST},
  u AS (SELECT cid, count(*) AS wallets, count(*) FILTER (last_ok) AS ok FROM latest2 WHERE last_access_at >= {SINCE} GROUP BY 1),
  r AS (SELECT cid, count(DISTINCT wallet) AS copies FROM owned GROUP BY 1),
  comp AS (SELECT c.cid, CASE WHEN matched AND content > 0 THEN 1 - exp(-content / 120) ELSE 0.0 END AS relevance,
    CASE WHEN coalesce(ok, 0) > 0 THEN ln(1 + least(ok, 10)) / ln(11) ELSE 0.0 END AS usage, CASE WHEN coalesce(copies, 0) > 0 THEN ln(1 + least(copies, 10)) / ln(11) ELSE 0.0 END AS replication,
    CASE WHEN last_seen_at > 0 THEN exp(-greatest({b.RANK_AT} - last_seen_at, 0) / 2592000000.0) ELSE 0.0 END AS freshness,
    CASE WHEN present THEN CASE WHEN present_source = 'pinls' THEN 1.0 ELSE 0.9 END * CASE WHEN coalesce(wallets, 0) > 0 THEN 0.6 + 0.4 * (ok / wallets) ELSE 1.0 END ELSE 0.0 END AS availability
    FROM catalog c JOIN content t ON c.cid = t.cid LEFT JOIN u ON u.cid = 'P' || (CAST(substr(c.cid, 5) AS BIGINT) % 100) LEFT JOIN r ON r.cid = 'P' || (CAST(substr(c.cid, 5) AS BIGINT) % 100)
    WHERE {POLICY} AND matched),
  scored_hits AS (SELECT *, CAST(round(0.3 * (0.6 * usage + 0.4 * replication) + 0.3 * relevance + 0.2 * freshness + 0.1 * availability, 6) AS DOUBLE) AS score FROM comp)"""


def near_rows(spark, d):
    """A function from index rows to those of tokens near the query's, which all that match have."""
    return vocabulary.near_filter(spark, vocabulary_path(spark, d), TOKENS)


def content(spark, d, index_rows):
    """(cid, matched, content) of the documents of the index rows for the query tokens, confidence 0.7."""
    scores = rank.token_scores(index_rows, TOKENS)
    rows = scores.join(stored_topics(spark, d), "cid", "left")
    in_topics = F.coalesce(F.arrays_overlap("topics", F.array(*map(F.lit, TOKENS))), F.lit(False))
    value = rank.content_score(F.col("token_part"), F.col("topics"), F.lit("text"), F.lit(0.7), F.col("cid"), TOKENS)
    return rows.select("cid", (F.col("any_match") | in_topics).alias("matched"), value.alias("content"))


def activity_tables(spark, d):
    """Use in the last days and copies by item, stored once for a state of their tables."""

    def build(path):
        usage.usage_stats(usage.latest_access(b.access(spark, d), b.shares(spark, d, "events")), SINCE).write.parquet(f"{path}/used")
        usage.replication(b.wallet_roots(spark, d), b.wallet_pins(spark, d), parts=b.shares(spark, d, "lineitem")).write.parquet(f"{path}/copies")

    path = stored(spark, "activity", [f"{d}/{t}.parquet" for t in ("events", "lineitem", "orders")], build)
    used = spark.read.schema("cid string, wallets bigint, ok_wallets bigint, bad_wallets bigint").parquet(f"{path}/used")
    return used, spark.read.schema("cid string, wallets bigint").parquet(f"{path}/copies")


def root_of(cid="cid"):
    return F.concat(F.lit("P"), (F.substring(cid, 5, 20).cast("bigint") % 100).cast("string"))


def root_activity(spark, d):
    """Use and copies of the catalog's roots alone, stored once: a page's tiers each join them, and not what all wallets have."""

    def build(path):
        roots = b.catalog(spark, d).select(root_of().alias("cid")).distinct()
        for name, rows in zip(("used", "copies"), activity_tables(spark, d), strict=True):
            rows.join(roots, "cid", "left_semi").write.parquet(f"{path}/{name}")

    path = stored(spark, "root-activity", [f"{d}/{t}.parquet" for t in ("documents", "pages", "events", "lineitem", "orders")], build)
    used = spark.read.schema("cid string, wallets bigint, ok_wallets bigint, bad_wallets bigint").parquet(f"{path}/used")
    return used, spark.read.schema("cid string, wallets bigint").parquet(f"{path}/copies")


def scored(spark, d, found):
    """``found`` (cid, matched, content) with catalog rows, components and score."""
    hits = b.catalog(spark, d).filter(index.policy()).join(found, "cid")
    hits = hits.select(
        "cid", "matched", "content", "present", "present_source", root_of().alias("root_cid"), F.coalesce("last_seen_at", F.lit(0)).alias("activity_at"),
        F.lit(False).alias("failed"), F.lit(False).alias("linked"),
    )
    return rank.with_scores(hits, *root_activity(spark, d), b.RANK_AT)


def ranked(spark, d):
    return scored(spark, d, content(spark, d, near_rows(spark, d)(stored_tokens(spark, d))).filter("matched"))


def tiered_path(spark, d):
    """The stored index in tiers of what items score without a search."""

    def build(path):
        every = b.catalog(spark, d).select("cid", F.lit(False).alias("matched"), F.lit(0.0).alias("content"))
        tiered_index.write(stored_tokens(spark, d), scored(spark, d, every), path)

    return stored(spark, "tiers", [f"{d}/{t}.parquet" for t in ("documents", "pages", "events", "lineitem", "orders")], build)


def early_page(spark, d, limit, cursor=None):
    near = near_rows(spark, d)
    hits = lambda rows: scored(spark, d, content(spark, d, near(rows)).filter("matched"))
    return tiered_index.top_page(spark, tiered_path(spark, d), hits, limit, cursor)


@query("r1_r2_content_score", f"WITH {CONTENT} SELECT cid, coalesce(matched, any_m) AS matched, round(content, 6) AS content FROM (SELECT *, false AS any_m FROM content)")
def r1(spark, d):
    return content(spark, d, stored_tokens(spark, d)).withColumn("content", F.round("content", 6))


NEAR = " OR ".join(f"token = '{q}' OR {near(q)} IS NOT NULL" for q in TOKENS)


@query("j12_near_rows", f'WITH {DOC_TEXTS}, {HISTOGRAM} SELECT token, cid, "count" FROM tokens WHERE {NEAR}')
def j12(spark, d):
    return vocabulary.rows_near(spark, stored_tokens(spark, d), vocabulary_path(spark, d), TOKENS)


COMPONENTS = ("relevance", "usage", "replication", "freshness", "availability")


@query("r3_r9_components", f"{RANKED} SELECT cid, {', '.join(f'CAST(round({c}, 6) AS DOUBLE) AS {c}' for c in COMPONENTS)}, score FROM scored_hits")
def r9(spark, d):
    return ranked(spark, d).select("cid", *(F.round(c, 6).alias(c) for c in COMPONENTS), "score")


@query("t8_final_rank", f"{RANKED} SELECT cid, score FROM scored_hits ORDER BY score DESC, cid DESC LIMIT 100")
def t8(spark, d):
    return rank.page(ranked(spark, d), 100).select("cid", "score")


@query("t8_early_end", f"{RANKED} SELECT cid, score FROM scored_hits ORDER BY score DESC, cid DESC LIMIT 20")
def t8_early(spark, d):
    return early_page(spark, d, 20)[0]


@query(
    "t9_early_cursor",
    f"{RANKED}, cur AS (SELECT cid, score FROM scored_hits ORDER BY score DESC, cid DESC LIMIT 1 OFFSET 19) SELECT r.cid, r.score FROM scored_hits r, cur c WHERE (r.score < c.score OR (r.score = c.score AND r.cid < c.cid)) AND r.cid <> c.cid ORDER BY r.score DESC, r.cid DESC LIMIT 20",
)
def t9_early(spark, d):
    last = early_page(spark, d, 20)[0].orderBy("score", "cid").first()  # one row: the cursor that a client sends back
    return early_page(spark, d, 20, rank.Cursor(last["score"], last["cid"]) if last else None)[0]


@query(
    "t9_cursor_page",
    f"{RANKED}, cur AS (SELECT cid, score FROM scored_hits ORDER BY score DESC, cid DESC LIMIT 1 OFFSET 19) SELECT r.cid, r.score FROM scored_hits r, cur c WHERE (r.score < c.score OR (r.score = c.score AND r.cid < c.cid)) AND r.cid <> c.cid ORDER BY r.score DESC, r.cid DESC LIMIT 20",
)
def t9(spark, d):
    rows = kept(ranked(spark, d).select("cid", "score"), "ranked")  # both pages are of it
    last = rank.page(rows, 1, offset=19).first()  # one row: the cursor that a client sends back
    return rank.page(rows, 20, rank.Cursor(last["score"], last["cid"]) if last else None).select("cid", "score")


@query(
    "t10_page_marks",
    f"""{RANKED}, n AS (SELECT cid, row_number() OVER (ORDER BY score DESC, cid DESC) - 1 AS n FROM scored_hits)
  SELECT CAST(n // 50 AS INTEGER) AS page, arg_min(cid, n) AS first_cid, arg_max(cid, n) AS last_cid, count(*) AS items FROM n GROUP BY 1""",
)
def t10(spark, d):
    return rank.page_marks(ranked(spark, d), 50, 0)


def label_sql(name: str) -> str:
    low, high, labels = rank.SIGNALS[name]
    return f"CASE WHEN {name} >= {high} THEN '{labels[2]}' WHEN {name} >= {low} THEN '{labels[1]}' ELSE '{labels[0]}' END AS {name}"


@query("r10_signals", f"{RANKED} SELECT cid, {', '.join(map(label_sql, COMPONENTS))} FROM scored_hits")
def r10(spark, d):
    return ranked(spark, d).select("cid", *(rank.signal(F.col(c), c).alias(c) for c in COMPONENTS))


SAMPLE_WORDS = "words AS (SELECT DISTINCT doc_id, label, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM training), model AS (SELECT word, label, count(*) AS n FROM words WHERE word <> '' GROUP BY ALL)"


@query("a14_train_model", b.with_frames("training", f", {SAMPLE_WORDS} SELECT word, label, n FROM model"))
def a14(spark, d):
    return intent.train(b.training(spark, d))


@query(
    "a15_predict",
    b.with_frames("training", f""", {SAMPLE_WORDS}, asked AS (SELECT conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'user'),
  w AS (SELECT id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM asked),
  s AS (SELECT id, label, CAST(sum(n) AS BIGINT) AS weight FROM w JOIN model USING (word) GROUP BY ALL),
  t AS (SELECT id, first(label ORDER BY weight DESC, label) AS label, max(weight) / sum(weight) AS c FROM s GROUP BY 1)
  SELECT id, coalesce(label, 'unknown') AS label, CAST(round(coalesce(c, 0), 6) AS DOUBLE) AS confidence FROM asked LEFT JOIN t USING (id)"""),
)
def a15(spark, d):
    asked = b.table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return intent.predict(asked, intent.train(b.training(spark, d)))


@query(
    "q1_classify",
    b.with_frames("training", f""", {SAMPLE_WORDS}, asked AS (SELECT conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'user'),
  w AS (SELECT id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM asked),
  s AS (SELECT id, label, CAST(sum(n) AS BIGINT) AS weight FROM w JOIN model USING (word) GROUP BY ALL),
  t AS (SELECT id, first(label ORDER BY weight DESC, label) AS label, round(max(weight) / sum(weight), 6) AS c FROM s GROUP BY 1)
  SELECT id, CASE WHEN c >= 0.6 THEN label ELSE 'unknown' END AS label, CAST(coalesce(c, 0) AS DOUBLE) AS confidence FROM asked LEFT JOIN t USING (id)"""),
)
def q1(spark, d):
    return intent.accepted(a15(spark, d), "unknown")
