"""Helpers shared by the operators: written intermediates, column picking, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import bound_batches

PROCESS = uuid.uuid4().hex
_cleaned: set[str] = set()
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
#: Rows that one window partition should hold at most, about.
ROWS_PER_BUCKET = 4_096
#: Bytes of text that vectorised kernels take at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a temporary folder serves a local session; a
    cluster without the setting is refused, as its machines share no such folder.
    """
    try:
        found = spark.conf.get("spark.checkpoint.dir", "")
    except Exception:  # the entry has no default in some versions
        found = ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under this process' folder, which goes when the process ends."""
    base = f"{shared_dir(spark)}/tessera/{PROCESS}"
    if base not in _cleaned:
        _cleaned.add(base)
        target = spark._jvm.org.apache.hadoop.fs.Path(base)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_drop_quietly, files, target)
    return f"{base}/{uuid.uuid4().hex}/{name}"


def _drop_quietly(files, target) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        files.delete(target, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Inside a ``scratch`` block the table goes when the block ends, unless it is to be kept.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if not keep:
        drop_later(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_later(path: str) -> None:
    """Let the ``scratch`` block that is open, if any, drop ``path``."""
    paths = _scratch.get()
    if paths is not None:
        paths.append(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that ``materialize`` writes in this block when it ends.

    What the block returns must read kept tables and inputs only.
    """
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns by exact name, first match first, whatever else ``df`` carries.

    ``pick(df, doc_id="bigint", text="string")`` works beside columns such as a second
    ``text`` or a ``TEXT``, which would make a lookup by name ambiguous.
    """
    names = df.columns
    bound_batches(df.sparkSession)
    missing = [n for n in wanted if n not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{names.index(n)}").cast(t).alias(n) for n, t in wanted.items()))


def positional(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... and the names to put back with ``toDF``."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def text_key(*cols: Column) -> Column:
    """128 bits that tell rows apart by content: two hashes of different seeds."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"))


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // per_bucket))


def prefix_sums(
    df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group that stand before this one.

    Rows of a group are ordered by (bucket, *order). No task holds a whole group: totals of
    buckets are summed first, then each bucket is scanned on its own. ``group`` and ``bucket``
    must hold no nulls. Rows alike in all of ``order`` stand in any order.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_in_bucket"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*group, bucket])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset")
    )


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: the row's place from 0 in the total order of ``order``.

    Rows are dealt out by ranges of the order and written; a range's place is the sum of the counts
    before it, one number a range, so no task orders more than its own range.
    """
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.join(F.broadcast(starts), "_range")  # one row a range
    return placed.withColumn(out, (F.col("_start") + inside).cast("bigint")).drop("_range", "_start")


def text_slices(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterable[tuple[int, int]]:
    """Index ranges [start, end) of about ``limit`` characters each; a longer text stands alone."""
    start, held = 0, 0
    i = -1
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if i >= start:
        yield start, i + 1
