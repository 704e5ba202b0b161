"""The last access of every key as a log of blocks: a batch writes its own keys, reads merge, blocks are folded by level.

Block (level, start) holds the last access of each key among ``FANOUT ** level`` batches from ``start`` on. Which blocks
there are follows from the number of batches alone, so a batch that is done again replaces what it wrote, and nothing
else needs to be noted. Merges drop what is past the retention.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import delete, new_folder

FANOUT = 4
KEY = ("cid", "wallet")
SCHEMA = "cid string, wallet string, at_ms bigint, event_id bigint, ok boolean"


def cover(batches: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The blocks (level, start) that hold the first ``batches`` batches, the largest first."""
    found, start = [], 0
    level = 0
    while fanout ** (level + 1) <= batches:
        level += 1
    while start < batches:
        while start + fanout**level > batches:
            level -= 1
        found.append((level, start))
        start += fanout**level
    return found


def latest(rows: DataFrame) -> DataFrame:
    """The last access of every key by event time, ties by event id, whatever the order in which rows came."""
    last = F.max_by(F.struct("at_ms", "event_id", "ok"), F.struct("at_ms", "event_id")).alias("l")
    return rows.groupBy(*KEY).agg(last).select(*KEY, "l.*")


def within(rows: DataFrame, retention_ms: int) -> DataFrame:
    """Rows as old as the newest one less the retention at most."""
    newest = rows.agg(F.max("at_ms").alias("_newest"))  # one row
    return rows.crossJoin(F.broadcast(newest)).filter(F.col("at_ms") >= F.col("_newest") - retention_ms).drop("_newest")


class LatestLog:
    def __init__(self, spark: SparkSession, retention_ms: int, path: str | None = None):
        self.spark, self.retention_ms, self.path = spark, retention_ms, path or new_folder(spark, "latest")

    def folder(self, level: int, start: int) -> str:
        return f"{self.path}/level={level}/start={start}"

    def rows(self, blocks: list[tuple[int, int]]) -> DataFrame:
        parts = [self.spark.read.schema(SCHEMA).parquet(self.folder(*b)) for b in blocks]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def put(self, batch: DataFrame, number: int) -> None:
        """Write a batch's keys, and fold the blocks that are complete with it into one of the next level.

        What was folded with the batch before goes now, as that batch can't be done again.
        """
        latest(batch.select(*KEY, "at_ms", "event_id", "ok")).write.mode("overwrite").parquet(self.folder(0, number))
        for level, start, parts in self.folds(number):
            within(latest(self.rows(parts)), self.retention_ms).write.mode("overwrite").parquet(self.folder(level, start))
        for _, _, parts in self.folds(number - 1):
            for part in parts:
                delete(self.spark, self.folder(*part))

    def folds(self, number: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(level, start, parts) of the blocks that batch ``number`` completes, lower levels first."""
        found, level = [], 1
        while number >= 0 and (number + 1) % FANOUT**level == 0:
            start, step = number + 1 - FANOUT**level, FANOUT ** (level - 1)
            found.append((level, start, [(level - 1, start + k * step) for k in range(FANOUT)]))
            level += 1
        return found

    def read(self, batches: int) -> DataFrame:
        """(cid, wallet, at_ms, event_id, ok) after the first ``batches`` batches."""
        return within(latest(self.rows(cover(batches))), self.retention_ms)


def latest_to_end(stream: DataFrame, retention_ms: int) -> DataFrame:
    """Drain a stream (``availableNow``) into a log and read it."""
    log, done = LatestLog(stream.sparkSession, retention_ms), [0]

    def put(batch: DataFrame, number: int) -> None:
        log.put(batch, number)
        done[0] = number + 1

    checkpoint = new_folder(stream.sparkSession, "stream")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return log.read(done[0])
