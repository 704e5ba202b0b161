"""The token index in tiers of what items score without a search, so that a page ends before the lower tiers are read.

An item's popularity, freshness and availability bound its score from above but for its relevance. Its index
rows stand in the tier of that bound, a folder; a search begins with the best tier and ends when no lower one can
reach its page. Bounds hold for as long as no item gains: freshness falls with time, and a gain in use or copies
asks for its rows to be stored anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.rank import WEIGHTS, Cursor, after_cursor
from tessera.sources.token_index import ROW_GROUP, SCHEMA

#: Tiers to a score of one.
STEPS = 40
#: Half a unit of the last place that scores are rounded to, and some.
ROUNDING = 1e-6


def write(index: DataFrame, standing: DataFrame, path: str) -> None:
    """``index`` by tier and in order of the token; ``standing`` has (cid, score) without relevance, others are in tier 0."""
    tier = F.ceil(F.coalesce("score", F.lit(0.0)) * STEPS).cast("int").alias("tier")
    rows = index.join(standing.select("cid", "score"), "cid", "left").select("token", "cid", "count", tier)
    dealt = rows.hint("rebalance", "tier").sortWithinPartitions("tier", "token", "cid")
    dealt.write.partitionBy("tier").option("parquet.block.size", ROW_GROUP).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, tier int").parquet(path)


def tiers(spark: SparkSession, path: str) -> list[int]:
    """The tiers there are, the best first; read from the folders."""
    return sorted((r["tier"] for r in read(spark, path).select("tier").distinct().collect()), reverse=True)


def top_page(
    spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], limit: int = 20, cursor: Cursor | None = None, most: int = 200
) -> tuple[DataFrame, int]:
    """T8 with an early end: the page behind a cursor, as (cid, score) in order, and the number of tiers read.

    ``score`` makes hits (cid, score) of a tier's index rows. The driver holds two pages at most.
    """
    limit = max(1, min(limit, most))
    best: list[tuple[float, str]] = []
    read_tiers = 0
    for tier in tiers(spark, path):
        if len(best) == limit and best[-1][0] > tier / STEPS + WEIGHTS["relevance"] + ROUNDING:
            break
        hits = score(read(spark, path).filter(F.col("tier") == tier).drop("tier")).filter(after_cursor(cursor))
        found = hits.select("score", "cid").orderBy(F.desc("score"), F.desc("cid")).limit(limit).collect()
        best = sorted([*best, *((r["score"], r["cid"]) for r in found)], reverse=True)[:limit]
        read_tiers += 1
    return spark.createDataFrame([(c, s) for s, c in best], "cid string, score double"), read_tiers
