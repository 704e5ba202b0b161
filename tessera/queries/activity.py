"""Ownership, usage, plans and request metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import bindings as b
from tessera.operators import metrics, usage
from tessera.registry import query

SINCE = b.RANK_AT - 7 * b.DAY_MS
OWNED = "owned AS (SELECT root_cid AS cid, wallet, created_at FROM wallet_roots WHERE status = 'active' UNION ALL SELECT cid, wallet, created_at FROM wallet_pins)"
LATEST = """latest2 AS (SELECT cid, wallet, at_ms AS last_access_at, ok AS last_ok FROM (
    SELECT *, row_number() OVER (PARTITION BY cid, wallet ORDER BY at_ms DESC, event_id DESC) AS r FROM access) WHERE r = 1)"""
FULL = b.with_frames("wallet_roots wallet_pins", "")


@query(
    "a4_roots_summary",
    b.with_frames("wallet_roots", "SELECT wallet, count(*) AS roots, count(*) FILTER (status = 'active') AS active, CAST(sum(bytes_estimated) AS BIGINT) AS bytes FROM wallet_roots GROUP BY 1"),
)
def a4(spark, d):
    return usage.roots_summary(b.wallet_roots(spark, d))


@query("a5_replication", f"{FULL}, {OWNED} SELECT cid, count(DISTINCT wallet) AS wallets FROM owned GROUP BY 1")
def a5(spark, d):
    return usage.replication(b.wallet_roots(spark, d), b.wallet_pins(spark, d), parts=b.shares(spark, d, "lineitem"))


@query("a5_replication_since", f"{FULL}, {OWNED} SELECT cid, count(DISTINCT wallet) AS wallets FROM owned WHERE created_at >= 883612800000 GROUP BY 1")
def a5_since(spark, d):
    return usage.replication(b.wallet_roots(spark, d), b.wallet_pins(spark, d), 883_612_800_000, b.shares(spark, d, "lineitem"))


@query("m12_latest_access", b.with_frames("access", "").rstrip() + f", {LATEST} SELECT cid, wallet, last_access_at, last_ok FROM latest2")
def m12(spark, d):
    return usage.latest_access(b.access(spark, d), b.shares(spark, d, "events"))


@query(
    "a6_usage_stats",
    b.with_frames("access", "").rstrip() + f""", {LATEST} SELECT cid, count(*) AS wallets, count(*) FILTER (last_ok) AS ok_wallets, count(*) FILTER (NOT last_ok) AS bad_wallets
  FROM latest2 WHERE last_access_at >= {SINCE} GROUP BY 1""",
)
def a6(spark, d):
    return usage.usage_stats(usage.latest_access(b.access(spark, d), b.shares(spark, d, "events")), SINCE)


@query("a7_pins_per_cid", b.with_frames("wallet_pins", "SELECT cid, count(*) AS pins FROM wallet_pins GROUP BY 1"))
def a7(spark, d):
    return b.wallet_pins(spark, d).groupBy("cid").agg(F.count(F.lit(1)).alias("pins"))


@query("u1_owners", f"{FULL}, {OWNED} SELECT DISTINCT cid, wallet FROM owned")
def u1(spark, d):
    return usage.owners(b.wallet_roots(spark, d), b.wallet_pins(spark, d), b.shares(spark, d, "lineitem"))


def names(spark, d):
    parts = b.table(spark, d, "part").select("p_partkey", b.tagged("P", "p_partkey").alias("cid"), F.col("p_name").alias("display_name"))
    return parts.select(F.concat(F.lit("W"), (F.col("p_partkey") * 7 % 100).cast("string")).alias("wallet"), "cid", "display_name")


@query(
    "u2_j4_wallet_items",
    f"""{FULL}, names AS (SELECT 'W' || (p_partkey * 7 % 100) AS wallet, 'P' || p_partkey AS cid, p_name AS display_name FROM part)
  SELECT r.wallet, r.cid, created_at, display_name FROM (SELECT wallet, root_cid AS cid, created_at FROM wallet_roots UNION SELECT wallet, cid, created_at FROM wallet_pins) r LEFT JOIN names USING (wallet, cid)""",
)
def u2(spark, d):
    return usage.wallet_items(b.wallet_roots(spark, d), b.wallet_pins(spark, d), names(spark, d))


@query("u3_ownership", f"{FULL}, {OWNED} SELECT cid, wallet, created_at FROM owned")
def u3(spark, d):
    return usage.ownership(b.wallet_roots(spark, d), b.wallet_pins(spark, d))


@query(
    "a19_m17_refcount",
    f"""{FULL}, {OWNED}, o AS (SELECT cid, count(*) AS owners FROM (SELECT DISTINCT cid, wallet FROM owned) GROUP BY 1), p AS (SELECT cid, count(*) AS pins FROM wallet_pins GROUP BY 1)
  SELECT cid, coalesce(pins, 0) AS pins, coalesce(owners, 0) AS owners, coalesce(pins, 0) + coalesce(owners, 0) AS refcount, coalesce(owners, 0) AS true_refcount,
    CASE WHEN coalesce(pins, 0) + coalesce(owners, 0) = 0 THEN 'noop' WHEN coalesce(pins, 0) + coalesce(owners, 0) > 1 THEN 'drop_own' ELSE 'release' END AS decision
  FROM o FULL JOIN p USING (cid)""",
)
def a19(spark, d):
    return usage.logical_refcount(b.wallet_roots(spark, d), b.wallet_pins(spark, d), b.shares(spark, d, "lineitem"))


@query(
    "a18_best_contract",
    b.with_frames("contracts", """SELECT id, client, status, storage_gb, start_time, months_total FROM (
  SELECT *, row_number() OVER (PARTITION BY client ORDER BY contains(status, 'ACTIVE') DESC, id DESC) AS r FROM contracts) WHERE r = 1"""),
)
def a18(spark, d):
    return usage.best_contract(b.contracts(spark, d))


@query(
    "p29_contract_plan",
    b.with_frames("contracts", "SELECT id, storage_gb * 1024 * 1024 * 1024 AS total_bytes, (start_time + months_total * 2592000) * 1000 AS expires_at FROM contracts"),
)
def p29(spark, d):
    return b.contracts(spark, d).select("id", usage.plan_of(F.col("storage_gb"), F.col("start_time"), F.col("months_total")).alias("p")).select("id", "p.*")


@query(
    "a17_quota",
    b.with_frames("contracts wallet_roots", """, used AS (SELECT wallet, CAST(sum(bytes_estimated) AS BIGINT) AS used FROM wallet_roots WHERE status = 'active' GROUP BY 1),
  plan AS (SELECT client, arg_max(storage_gb, CASE WHEN contains(status, 'ACTIVE') THEN 1000000000 ELSE 0 END + id) * 1024 AS total FROM contracts GROUP BY 1)
  SELECT client, total, coalesce(used, 0) AS used, greatest(total - coalesce(used, 0), 0) AS remaining FROM plan LEFT JOIN used ON client = wallet"""),
)
def a17(spark, d):
    used = b.wallet_roots(spark, d).filter("status = 'active'").groupBy("wallet").agg(F.sum("bytes_estimated").alias("used"))
    plan = usage.best_contract(b.contracts(spark, d)).select("client", (F.col("storage_gb") * 1024).alias("total"))
    rows = plan.join(used, plan.client == used.wallet, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rows.select("client", "total", "used", usage.quota(F.col("used"), F.col("total")).alias("remaining"))


@query(
    "j14_is_pinned",
    f"""{FULL}, asked AS (SELECT 'W' || (s_suppkey % 60) AS wallet, 'P' || p_partkey AS cid FROM supplier, part WHERE p_partkey % 20 = s_suppkey % 20 GROUP BY ALL)
  SELECT a.wallet, a.cid, r.root_cid IS NOT NULL AS has_root, p.cid IS NOT NULL AS has_pin, g.cid IS NOT NULL AS pinned_anywhere FROM asked a
  LEFT JOIN (SELECT DISTINCT wallet, root_cid FROM wallet_roots WHERE status = 'active') r ON r.wallet = a.wallet AND r.root_cid = a.cid
  LEFT JOIN (SELECT DISTINCT wallet, cid FROM wallet_pins) p ON p.wallet = a.wallet AND p.cid = a.cid LEFT JOIN (SELECT DISTINCT cid FROM wallet_pins) g ON g.cid = a.cid""",
)
def j14(spark, d):
    suppliers = b.table(spark, d, "supplier").select(F.concat(F.lit("W"), (F.col("s_suppkey") % 60).cast("string")).alias("wallet"), (F.col("s_suppkey") % 20).alias("k"))
    parts = b.table(spark, d, "part").select(b.tagged("P", "p_partkey").alias("cid"), (F.col("p_partkey") % 20).alias("k"))
    # many suppliers are one (wallet, k), of which there are 60: met as they come, pairs would grow with suppliers times parts
    asked = suppliers.distinct().join(parts, "k").select("wallet", "cid").distinct()
    return usage.pin_state(asked, b.wallet_roots(spark, d), b.wallet_pins(spark, d))


@query(
    "a8_http_counters",
    b.with_frames("http_log", "SELECT method, path, CAST(status AS INTEGER) AS status, count(*) AS requests FROM http_log GROUP BY ALL"),
)
def a8(spark, d):
    return metrics.request_counts(b.http_log(spark, d))


@query(
    "a8_http_latency",
    b.with_frames("http_log", """SELECT method, path, count(*) AS requests, round(sum(duration_ms), 4) AS sum_ms, max(duration_ms) AS max_ms FROM http_log GROUP BY ALL"""),
)
def a8_latency(spark, d):
    return metrics.request_latency(b.http_log(spark, d)).withColumn("sum_ms", F.round("sum_ms", 4))


@query(
    "w3_rate_5m",
    b.with_frames("http_log", """SELECT path, at_ms // 300000 * 300000 AS window_start, round(count(*) / 300.0, 6) AS rate FROM http_log GROUP BY ALL"""),
)
def w3(spark, d):
    return metrics.event_rate(b.http_log(spark, d), "path", 300)


@query(
    "w3_counter_rate",
    b.with_frames("http_log", """, c AS (SELECT path, at_ms, count(*) OVER (PARTITION BY path ORDER BY at_ms, event_id) % 50 AS v, event_id FROM http_log),
  steps AS (SELECT path, at_ms // 300000 * 300000 AS window_start, v, lag(v) OVER (PARTITION BY path, at_ms // 300000 ORDER BY at_ms, event_id) AS p FROM c)
  SELECT path, window_start, round(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) / 300.0, 6) AS rate FROM steps GROUP BY ALL"""),
)
def w3_counter(spark, d):
    from pyspark.sql.window import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("path").orderBy("at_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return metrics.counter_rate(b.http_log(spark, d).withColumn("value", n % 50), "path", "value", 300)


@query("k2_prometheus_lines", b.with_frames("http_log", """SELECT 'http_requests_total{method="' || method || '",path="' || path || '",code="' || status || '"} ' || count(*) AS line FROM http_log GROUP BY method, path, status"""))
def k2(spark, d):
    return metrics.exposition(metrics.request_counts(b.http_log(spark, d)), "http_requests_total", {"method": "method", "path": "path", "code": "status"}, "requests")


@query(
    "p26_http_path",
    """SELECT page_id, ['/cid/:cid', '/children/:cid', '/parents/:cid', '/wallet/:wallet/usage', '/admin/wallet/:wallet', '/ipfs/:cid', '/ipns/:name', '/ipfs', '/wallet/' || page_id, '/'][CAST(page_id % 10 + 1 AS INTEGER)] AS route FROM pages""",
)
def p26(spark, d):
    i, n = F.col("page_id") % 10, F.col("page_id").cast("string")
    heads = ("/cid/", "/children/", "/parents/", "/wallet/", "/admin/wallet/", "/ipfs/", "/ipns/", "/ipfs", "/wallet/", "")
    head = F.element_at(F.array(*map(F.lit, heads)), (i + 1).cast("int"))
    path = F.concat(head, F.when(~i.isin(7, 9), n).otherwise(""), F.when(i == 3, "/usage").otherwise(""), F.lit("?a=1/2"))
    return b.table(spark, d, "pages").select("page_id", metrics.route_template(path).alias("route"))


@query(
    "j6_linked_domains",
    b.with_frames("domain_records wallet_pins", """, o AS (SELECT DISTINCT cid, wallet FROM wallet_pins)
  SELECT o.cid, arg_min(domain, CAST(len(string_split(domain, '.')) AS VARCHAR) || domain) AS domain FROM o JOIN domain_records r ON r.owner = o.wallet AND r.record_value = '/ipfs/' || o.cid GROUP BY 1"""),
)
def j6(spark, d):
    from tessera.operators.sites import linked_domain

    return linked_domain(b.wallet_pins(spark, d).select("cid", "wallet").distinct(), b.domain_records(spark, d))
