"""Multi-signal ranking and stable pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import kept

DECAY_MS = 30 * 86_400_000
#: Weights of popularity, relevance, freshness, availability and of a link; fixed values.
WEIGHTS = {"popularity": 0.3, "relevance": 0.3, "freshness": 0.2, "availability": 0.1, "link": 0.1}
#: Cut-offs and labels of rank signals; fixed values.
SIGNALS = {
    "relevance": (0.33, 0.66, ("low", "medium", "high")),
    "popularity": (0.25, 0.6, ("low", "medium", "high")),
    "usage": (0.25, 0.6, ("low", "medium", "high")),
    "replication": (0.25, 0.6, ("low", "medium", "high")),
    "freshness": (0.4, 0.75, ("old", "recent", "new")),
    "availability": (0.6, 0.85, ("bad", "degraded", "good")),
}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def token_scores(index: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """R1 and R2 from index rows: (cid, token_part, any_match).

    A query token found as it is gives 10 per count; else the best token that holds it or is
    held by it, both of three letters or more and at least half as long, gives its part.
    One aggregate per item over all query tokens, combined before the shuffle.
    """
    parts, hits, aggregates = [], [], []
    for i, q in enumerate(tokens):
        exact = F.col("token") == q
        covers = F.least(F.length("token"), F.lit(len(q))) / float(len(q))
        near = ~exact & (F.length("token") >= 3) & (F.contains("token", F.lit(q)) | F.contains(F.lit(q), F.col("token"))) & (covers >= 0.5)
        if len(q) < 3:
            near = F.lit(False)
        aggregates += [
            F.sum(F.when(exact, F.col("count") * 10.0)).alias(f"exact{i}"),
            F.max(F.when(near, F.col("count") * 10.0 * covers)).alias(f"near{i}"),
        ]
        parts.append(F.coalesce(f"exact{i}", f"near{i}", F.lit(0.0)))
        hits.append(F.coalesce(f"exact{i}", f"near{i}").isNotNull())
    rows = index.groupBy("cid").agg(*aggregates)
    return rows.select("cid", total(parts).alias("token_part"), reduce(lambda a, b: a | b, hits).alias("any_match"))


def content_score(token_part: Column, topics: Column, kind: Column, confidence: Column, cid: Column, tokens: Sequence[str]) -> Column:
    """Tokens, topics, kind, confidence and its penalties, and a search for the id itself."""
    score = F.coalesce(token_part, F.lit(0.0))
    for q in tokens:
        score = score + F.when(F.coalesce(F.array_contains(topics, q), F.lit(False)), 100.0).otherwise(0.0)
    score = score + F.when(kind.isin(*tokens), 200.0).otherwise(0.0)
    penalty = total([F.when(confidence < c, p).otherwise(0.0) for c, p in ((0.3, 1000.0), (0.2, 2000.0), (0.1, 3000.0))])
    score = score + F.coalesce(confidence * 10 - penalty, F.lit(0.0))
    if len(tokens) == 1:
        score = score + F.when(cid == tokens[0], 1000.0).otherwise(0.0)
    return score


def relevance(score: Column, matched: Column) -> Column:
    """R3."""
    return F.when(matched & (score > 0), clamp01(1 - F.exp(-score / 120))).otherwise(0.0)


def saturating(count: Column, cap: int = 10) -> Column:
    """R4 and R5."""
    n = F.coalesce(count, F.lit(0))
    return F.when(n > 0, clamp01(F.log1p(F.least(n, F.lit(cap)).cast("double")) / F.log1p(F.lit(float(cap))))).otherwise(0.0)


def freshness(activity_at: Column, rank_at: int) -> Column:
    """R7; no activity is not fresh."""
    age = F.greatest(F.lit(rank_at) - activity_at, F.lit(0))
    return F.when(activity_at > 0, clamp01(F.exp(-age / float(DECAY_MS)))).otherwise(0.0)


def availability(present: Column, source: Column, failed: Column, ok: Column, wallets: Column) -> Column:
    """A product of what speaks against the item; access counts where there was any."""
    origin = F.when(F.lower(F.trim(F.coalesce(source, F.lit("")))).isin("", "pinls"), 1.0).otherwise(0.9)
    ratio = clamp01(ok / wallets)
    used = F.when(F.coalesce(wallets, F.lit(0)) > 0, 0.6 + 0.4 * ratio).otherwise(1.0)
    score = origin * F.when(failed, 0.7).otherwise(1.0) * used
    return F.when(present, clamp01(score)).otherwise(0.0)


def with_scores(hits: DataFrame, usage: DataFrame, replication: DataFrame, rank_at: int) -> DataFrame:
    """Add every component and ``score``; roots without use or copies count as zero.

    ``hits`` has root_cid, content, matched, activity_at, present, present_source, failed and linked.
    """
    u = usage.select(F.col("cid").alias("root_cid"), "wallets", "ok_wallets")
    r = replication.select(F.col("cid").alias("root_cid"), F.col("wallets").alias("copies"))
    rows = hits.join(u, "root_cid", "left").join(r, "root_cid", "left")
    rows = rows.withColumns(
        {
            "relevance": relevance(F.col("content"), F.col("matched")),
            "usage": saturating(F.col("ok_wallets")),
            "replication": saturating(F.col("copies")),
            "freshness": freshness(F.col("activity_at"), rank_at),
            "availability": availability(F.col("present"), F.col("present_source"), F.col("failed"), F.col("ok_wallets"), F.col("wallets")),
        }
    )
    rows = rows.withColumn("popularity", clamp01(0.6 * F.col("usage") + 0.4 * F.col("replication")))
    base = total([F.col(name) * w for name, w in WEIGHTS.items() if name != "link"])
    score = base + F.when(F.col("linked"), WEIGHTS["link"]).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6)).drop("wallets", "ok_wallets", "copies")


def signal(score: Column, name: str) -> Column:
    """R10."""
    low, high, labels = SIGNALS[name]
    return F.when(score >= high, labels[2]).when(score >= low, labels[1]).otherwise(labels[0])


@dataclass(frozen=True)
class Cursor:
    score: float
    id: str


def after_cursor(cursor: Cursor | None, score: str = "score", key: str = "cid") -> Column:
    """Behind the cursor in order of (score, id) descending; the cursor's own item never comes again."""
    if cursor is None:
        return F.lit(True)
    s, i = F.col(score), F.col(key)
    return ((s < cursor.score) | ((s == cursor.score) & (i < cursor.id))) & (i != cursor.id)


def page(ranked: DataFrame, limit: int = 20, cursor: Cursor | None = None, offset: int = 0, most: int = 200) -> DataFrame:
    """The page behind a cursor, or at an offset; a plain top-k, nothing is numbered."""
    rows = ranked.filter(after_cursor(cursor)).orderBy(F.desc("score"), F.desc("cid"))
    return rows.offset(0 if cursor else max(0, offset)).limit(max(1, min(limit, most)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``n``, their place from 0 in total order.

    Rows are dealt out by ranges of the order and written; a range's place is the sum of the counts
    before it, one number a range, so no task sees more than its own range.
    """
    dealt = kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn("n", F.col("_start") + inside).drop("_range", "_start")


def page_marks(ranked: DataFrame, limit: int, offset: int) -> DataFrame:
    """Per page number its first and last id and its size."""
    rows = numbered(ranked, F.desc("score"), F.desc("cid")).filter(F.col("n") >= offset)
    return rows.groupBy(F.floor((F.col("n") - offset) / limit).cast("int").alias("page")).agg(
        F.min_by("cid", "n").alias("first_cid"), F.max_by("cid", "n").alias("last_cid"), F.count(F.lit(1)).alias("items")
    )
