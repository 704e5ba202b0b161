"""The token index as a stored table (S9): written in order of token, searched by prefix.

Rows (token, cid, count) are dealt out by ranges of the token and sorted, so a prefix filter that
reaches the scan skips all files and row groups but those of its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera import bindings

SCHEMA = "token string, cid string, count bigint"
#: Bytes of a row group, small enough that a prefix reads little more than its rows.
ROW_GROUP = 1 << 20


def write(tokens: DataFrame, path: str, most: int | None = None) -> None:
    """``tokens``, ``most`` rows at most (counted if not given), in ranges of ``SHARE`` rows or as many as a shuffle has."""
    rows = tokens.select("token", "cid", "count")
    parts = bindings.parts_of(rows.count() if most is None else most)
    usual = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, "token", "cid") if parts > usual else rows.repartitionByRange("token", "cid")
    ordered = ranges.sortWithinPartitions("token", "cid")
    ordered.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def replace(spark: SparkSession, path: str, fresh: DataFrame, crawled: DataFrame, to: str) -> None:
    """M6 on the stored table: the crawled items' rows are replaced, also where the crawl found none.

    The next state is written beside the old one, so a run that fails leaves the old one whole.
    """
    old = read(spark, path).join(crawled.select("cid").distinct(), "cid", "left_anti")
    write(old.unionByName(fresh.select("token", "cid", "count")), to, read(spark, path).count() + fresh.count())
