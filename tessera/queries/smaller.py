"""Smaller aggregates, unions and updates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import bindings as b
from tessera.queries.merges import BASE, state
from tessera.queries.ranking import RANKED, ranked
from tessera.registry import query

ROOT = "'P' || (CAST(substr(cid, 5) AS BIGINT) % 100)"


@query("a9_registry_totals", "SELECT count(*) AS wallets, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS balance FROM customer")
def a9(spark, d):
    balance = F.sum(F.floor("c_acctbal").cast("bigint"))
    return b.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("wallets"), balance.alias("balance"))


@query("a11_root_best_score", f"{RANKED} SELECT {ROOT} AS root_cid, max(score) AS best FROM scored_hits GROUP BY 1")
def a11(spark, d):
    return ranked(spark, d).groupBy("root_cid").agg(F.max("score").alias("best"))


@query("a12_root_best_hit", f"{RANKED}, n AS (SELECT cid, {ROOT} AS root_cid, row_number() OVER (PARTITION BY {ROOT} ORDER BY score DESC, cid DESC) AS r FROM scored_hits) SELECT root_cid, cid AS entry FROM n WHERE r = 1")
def a12(spark, d):
    # of equal scores the first in rank order, which is by id descending
    return ranked(spark, d).groupBy("root_cid").agg(F.max_by("cid", F.struct("score", "cid")).alias("entry"))


@query(
    "t11_look_ahead",
    b.with_frames("wallet_pins", "SELECT wallet, least(count(*), 200) AS shown, count(*) > 200 AS has_more FROM wallet_pins GROUP BY 1"),
)
def t11(spark, d):
    rank = F.row_number().over(Window.partitionBy("wallet").orderBy(F.desc("created_at"), "cid"))
    rows = b.wallet_pins(spark, d).withColumn("r", rank).filter("r <= 201")
    return rows.groupBy("wallet").agg(F.count_if(F.col("r") <= 200).alias("shown"), (F.max("r") > 200).alias("has_more"))


@query("t13_top_roots", f"{RANKED} SELECT root_cid, best FROM (SELECT {ROOT} AS root_cid, max(score) AS best FROM scored_hits GROUP BY 1) ORDER BY best DESC, root_cid LIMIT 40")
def t13(spark, d):
    return a11(spark, d).orderBy(F.desc("best"), "root_cid").limit(40)


@query("u4_first_wins_union", b.with_frames("catalog", "SELECT cid, CASE WHEN kind = 'text' THEN 1 ELSE 2 END AS origin FROM catalog WHERE kind = 'text' OR size_bytes % 2 = 0"))
def u4(spark, d):
    rows = b.catalog(spark, d)
    texts = rows.filter("kind = 'text'").select("cid", F.lit(1).alias("origin"))
    even = rows.filter("size_bytes % 2 = 0").select("cid", F.lit(2).alias("origin"))
    return texts.unionByName(even).groupBy("cid").agg(F.min("origin").alias("origin"))


@query("u6_array_union", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ',' || p_type END AS both FROM part")
def u6(spark, d):
    both = F.array_distinct(F.concat(F.array("p_brand"), F.array("p_type", "p_brand")))
    return b.table(spark, d, "part").select("p_partkey", F.array_join(both, ",").alias("both"))


@query("m18_counters", "SELECT event_type AS name, CAST(sum(i) AS BIGINT) AS total FROM (SELECT event_type, CAST(floor(value) AS BIGINT) - 20 AS i FROM events) WHERE i > 0 GROUP BY 1")
def m18(spark, d):
    rows = b.table(spark, d, "events").select(F.col("event_type").alias("name"), (F.floor("value").cast("bigint") - 20).alias("i"))
    return rows.filter("i > 0").groupBy("name").agg(F.sum("i").alias("total"))


@query("m19_last_status", b.with_frames("http_log", "SELECT path, arg_max(status, at_ms) AS status, max(at_ms) AS at_ms FROM http_log GROUP BY 1"))
def m19(spark, d):
    last = F.max_by("status", F.struct("at_ms", "event_id")).alias("status")
    return b.http_log(spark, d).groupBy("path").agg(last, F.max("at_ms").alias("at_ms"))


@query("w4_ratio", "SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def w4(spark, d):
    events = b.table(spark, d, "events")
    total = events.agg(F.count(F.lit(1)).alias("total"))
    per = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)  # one row
    return per.select("event_type", F.round(F.col("n") / F.col("total"), 6).alias("share"))
