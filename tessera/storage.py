"""Tables that the library keeps in the shared folder: written once, read by many queries."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PROCESS = uuid.uuid4().hex
#: Bytes of rows that a Python worker is sent at once; a longer row stands alone.
BATCH_BYTES = 2 << 20
_bases: set[str] = set()
_stored: dict[tuple[str, str, str], str] = {}


def base_folder(spark: SparkSession) -> str:
    """This process' folder under ``spark.checkpoint.dir``; it goes when the process ends.

    A local session without the setting gets a temporary folder; a cluster without it is refused,
    as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/tables-{PROCESS}"
    if own not in _bases:
        _bases.add(own)
        target = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_delete_quietly, files, target)
    return own


def _delete_quietly(files, target) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        files.delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a folder of its own and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under ``path``, by which a change shows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found, at = [], files.listFiles(target, True)
    while at.hasNext():
        f = at.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None]) -> str:
    """The folder of a table that ``build`` writes once for each state of ``inputs`` in this application."""
    key = (spark.sparkContext.applicationId, name, "|".join(stamp(spark, i) for i in inputs))
    if key not in _stored:
        path = new_folder(spark, name)
        build(path)
        _stored[key] = path
    return _stored[key]


def bound_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that Python workers hold at ``BATCH_BYTES`` of rows at most.

    This lowers a setting of the session and leaves a smaller one as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    found = spark.conf.get(key)
    size = 0 if found.startswith("-") else bytes_of(found)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
