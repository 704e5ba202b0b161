"""Stored tables with a key (S9): hashed into buckets by a column, in its order within them, changed bucket by bucket.

A bucket is a folder, so the keys that are asked for say which folders a scan opens, and a change writes the folders
of the keys that it touches. A table that is asked for by two columns is stored twice, once by each.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import delete, kept

#: Bytes of a row group, small enough that a key reads little more than its rows.
ROW_GROUP = 1 << 20
BUCKETS = 64


class KeyedTable(NamedTuple):
    path: str
    schema: str
    by: str
    buckets: int


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def put(rows: DataFrame, table: KeyedTable) -> None:
    """Write the buckets that ``rows`` fall in, over what they held; a bucket of a hot key is spread over several files."""
    dealt = rows.withColumn("bucket", bucket_of(F.col(table.by), table.buckets)).hint("rebalance", "bucket")
    ordered = dealt.sortWithinPartitions("bucket", table.by).write.partitionBy("bucket")
    ordered.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP).parquet(table.path)


def create(rows: DataFrame, path: str, by: str, buckets: int = BUCKETS) -> KeyedTable:
    """Store ``rows`` by the column ``by``; a null key has a bucket like any other."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = KeyedTable(path, schema, by, buckets)
    put(rows, table)
    return table


def stored_rows(spark: SparkSession, table: KeyedTable, buckets: list[int] | None = None) -> DataFrame:
    """All rows, or those of some buckets; the others' files are not opened."""
    rows = spark.read.schema(f"{table.schema}, bucket int").parquet(table.path)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.drop("bucket")


def touched_buckets(table: KeyedTable, keys: DataFrame) -> list[int]:
    """The buckets of the keys in the first column of ``keys``: numbers, as many as there are buckets at most."""
    buckets = keys.select(bucket_of(F.col(keys.columns[0]), table.buckets).alias("bucket")).distinct()
    return sorted(r["bucket"] for r in buckets.collect())


def rows_of(spark: SparkSession, table: KeyedTable, keys: DataFrame) -> DataFrame:
    """The rows whose key is in the first column of ``keys``."""
    asked = keys.select(F.col(keys.columns[0]).alias(table.by)).distinct()
    return stored_rows(spark, table, touched_buckets(table, asked)).join(asked, table.by, "left_semi")


def change(spark: SparkSession, table: KeyedTable, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the rows of the touched keys' buckets by what ``merge`` makes of them.

    The new rows are written apart first, so a run that fails before they are whole leaves the table as it was.
    ``merge`` must leave rows in the buckets that it was given; anything else raises an error.
    """
    buckets = touched_buckets(table, keys)
    if not buckets:
        return
    columns = spark.createDataFrame([], table.schema).columns
    fresh = kept(merge(stored_rows(spark, table, buckets)).select(*columns), "changed")
    filled = set(touched_buckets(table, fresh.select(table.by)))
    if not filled <= set(buckets):
        raise ValueError("a change reaches keys that it was not told of")
    put(fresh, table)
    for empty in set(buckets) - filled:
        delete(spark, f"{table.path}/bucket={empty}")
