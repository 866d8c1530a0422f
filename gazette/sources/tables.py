"""Intermediate tables: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Session and folder of every table that still stands.
_written: list[tuple[SparkSession, str]] = []
#: Shuffle files of a table that has been written are of no use to anyone.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a new local folder in local mode; on a cluster, where executors wouldn't see
    one another's files there, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gazette-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table, deleted when the session's process ends or free() is told to. Folders of one application stand
    together, so that whoever owns the shared folder can clear up after a driver that was killed."""
    at = f"{shared_dir(spark)}/gazette-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    _written.append((spark, at))
    return at


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as a job runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs nothing that was
    written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for free()."""
    return len(_written)


def free(since: int, keep: int = 0) -> None:
    """Delete the tables written since mark(), but for the last `keep` of them. Nothing may still be computed from them."""
    end = len(_written) - keep
    for spark, path in _written[since:end]:
        _delete(spark, path)
    del _written[since:end]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def _clean() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone already; the cluster's owner clears the checkpoint folder
        free(0)


atexit.register(_clean)
