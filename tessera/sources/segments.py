"""The token index as segments: a change writes its own rows, reads merge, levels are compacted.

A segment holds index rows in order of the token and the ids that it replaces. A row counts as long as no
later segment replaces its id; so a crawl of a few items writes those items' rows and their ids, and nothing else.
Segments are never changed: every state of the index is a list of them, and older states stay readable.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import bindings
from tessera.sources import token_index

#: Segments of a level that are merged into one of the next.
FANOUT = 4


class Segment(NamedTuple):
    number: int
    level: int
    rows: str
    gone: str | None


Index = tuple[Segment, ...]


def first_segment(path: str, level: int = 8) -> Index:
    """The index whose rows, in order of the token, are stored at ``path``; a high level keeps it out of small merges."""
    return (Segment(0, level, path, None),)


def replace(spark: SparkSession, index: Index, fresh: DataFrame, crawled: DataFrame, folder: str) -> Index:
    """M6: the index in which the items crawled have their fresh rows alone, also where the crawl found none."""
    token_index.write(fresh, f"{folder}/rows")
    crawled.select("cid").distinct().write.parquet(f"{folder}/gone")
    return (*index, Segment(index[-1].number + 1, 0, f"{folder}/rows", f"{folder}/gone"))


def _numbered(spark: SparkSession, index: Index) -> DataFrame:
    return reduce(DataFrame.unionByName, (token_index.read(spark, s.rows).withColumn("_number", F.lit(s.number)) for s in index))


def _replaced(spark: SparkSession, index: Index) -> DataFrame | None:
    """(cid, _last): the last segment that replaces an item."""
    parts = [spark.read.schema("cid string").parquet(s.gone).withColumn("_last", F.lit(s.number)) for s in index if s.gone]
    return reduce(DataFrame.unionByName, parts).groupBy("cid").agg(F.max("_last").alias("_last")) if parts else None


def most_rows(spark: SparkSession, index: Index) -> int:
    """The rows of all segments, those that no longer count included; from the files' footers."""
    return sum(token_index.read(spark, s.rows).count() for s in index)


def read(spark: SparkSession, index: Index) -> DataFrame:
    """The rows that count; a filter on the token reaches every segment's scan."""
    rows, replaced = _numbered(spark, index), _replaced(spark, index)
    if replaced is None:
        return rows.drop("_number")
    rows = bindings.dealt(rows, bindings.parts_of(most_rows(spark, index)), "cid")
    live = rows.join(replaced, "cid", "left").filter("_number >= coalesce(_last, 0)")
    return live.select("token", "cid", "count")


def due(index: Index, fanout: int = FANOUT) -> Index:
    """The segments to be merged next: the oldest ``fanout`` of the lowest level that has as many."""
    for level in sorted({s.level for s in index}):
        found = tuple(s for s in index if s.level == level)
        if len(found) >= fanout:
            return found[:fanout]
    return ()


def compacted(spark: SparkSession, index: Index, folder: str, fanout: int = FANOUT) -> Index:
    """The index after one merge, if one is due: rows that no longer count go.

    The ids that the merged segments replace stay for as long as there are older segments.
    """
    merged = due(index, fanout)
    if not merged:
        return index
    token_index.write(read(spark, merged), f"{folder}/rows", most_rows(spark, merged))
    replaced = _replaced(spark, merged)
    oldest = merged[0] is index[0] or replaced is None
    if not oldest:
        replaced.select("cid").write.parquet(f"{folder}/gone")
    one = Segment(merged[-1].number, merged[0].level + 1, f"{folder}/rows", None if oldest else f"{folder}/gone")
    at = index.index(merged[0])
    return (*index[:at], one, *index[at + len(merged) :])


def save(spark: SparkSession, index: Index, path: str) -> None:
    """The list of segments as a table; it is written last, so a state is seen whole or not at all."""
    spark.createDataFrame(list(index), "number int, level int, rows string, gone string").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.schema("number int, level int, rows string, gone string").parquet(path).collect()
    return tuple(sorted(Segment(r["number"], r["level"], r["rows"], r["gone"]) for r in rows))
