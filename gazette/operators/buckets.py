"""A stored table dealt into buckets by a hash of its key, so that a write touches what it changes and nothing else.

  path/data/<name>/bucket=k      rows of a bucket, as one write left them
  path/deletes/<name>/bucket=k   keys of rows that are gone since
  path/manifests/<name>          for each bucket: the folder of its rows, and those of its deletes
  path/versions                  which manifest is the table, in order

A merge reads and writes only buckets that its batch has keys in; a delete writes keys only, which reading leaves out by an anti join;
compaction rewrites buckets with deletes. Every write ends by naming its manifest, so a writer that dies in between leaves the table
as it was. Keys are spread by hash, so no bucket is hot; a manifest has a row a bucket and a delete, which is what the driver sees.

Defined results: of rows with the same key in one batch the caller keeps one (a merge refuses more); null keys are a bucket's like any
other and match one another; deletes of keys that aren't there count for nothing; an empty batch writes nothing.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import times
from gazette.operators import selection, store
from gazette.sources.tables import materialize

MANIFEST = "bucket int, kind string, folder string"
DATA, DELETES = "data", "deletes"


def bucket(key: str, many: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(many)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The table's parts: bucket, kind (data, deletes), folder."""
    last = store.pointers(spark, path).orderBy(F.desc("version"), F.desc("folder")).first()
    return spark.read.schema(MANIFEST).json(f"{path}/manifests/{last.folder}")


def _point(spark: SparkSession, path: str, parts: list[tuple[int, str, str]]) -> None:
    """Make these parts the table's next version."""
    version, name = (store.current_version(spark, path) or 0) + 1, uuid.uuid4().hex
    spark.createDataFrame(parts, MANIFEST).coalesce(1).write.json(f"{path}/manifests/{name}")
    spark.createDataFrame([(version, name)], store.POINTER).coalesce(1).write.mode("append").json(f"{path}/versions")


def _written(rows: DataFrame, path: str, kind: str, many: int, key: str) -> list[tuple[int, str, str]]:
    """Write rows by bucket, a file each, under a new name; the parts written."""
    name = uuid.uuid4().hex
    dealt = rows.withColumn("bucket", bucket(key, many))
    dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{kind}/{name}")
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{name}")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return [(int(f.getPath().getName().split("=")[1]), kind, name) for f in found if f.isDirectory()]


def _read(spark: SparkSession, path: str, parts: list, kind: str) -> DataFrame | None:
    """Rows of the parts of a kind."""
    folders = [f"{path}/{kind}/{p.folder}/bucket={p.bucket}" for p in parts if p.kind == kind]
    return spark.read.parquet(*folders) if folders else None


def _live(spark: SparkSession, path: str, parts: list, key: str) -> DataFrame:
    """Rows of the parts without those that their deletes name. Only buckets that have deletes are joined."""
    marked = {p.bucket for p in parts if p.kind == DELETES}
    clean = _read(spark, path, [p for p in parts if p.bucket not in marked], DATA)
    dirty = _read(spark, path, [p for p in parts if p.bucket in marked], DATA)
    if dirty is None:
        return clean
    gone = _read(spark, path, parts, DELETES).select(F.col(key).alias("_gone"))
    dirty = dirty.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    return dirty if clean is None else clean.unionByName(dirty)


def create(rows: DataFrame, path: str, many: int = 64, key: str = "id") -> None:
    """Write rows, one a key, as a new table of so many buckets: a bucket is a file and a task's work, so there should be as many as
    make it some hundred megabytes once the table is large. Buckets that have no rows yet have no part."""
    spark = rows.sparkSession
    spark.createDataFrame([(many, key)], "many int, key string").coalesce(1).write.json(f"{path}/layout")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/schema")
    _point(spark, path, _written(rows, path, DATA, many, key))


def layout(spark: SparkSession, path: str) -> tuple[int, str]:
    """How many buckets, and the key."""
    r = spark.read.schema("many int, key string").json(f"{path}/layout").first()
    return r.many, r.key


def load(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets."""
    parts = [p for p in manifest(spark, path).collect() if buckets is None or p.bucket in buckets]
    empty = spark.read.parquet(f"{path}/schema")
    return _live(spark, path, parts, layout(spark, path)[1]).select(*empty.columns) if any(p.kind == DATA for p in parts) else empty


def merge(batch: DataFrame, path: str, as_of: datetime | Column, policy: str = "article") -> list[int]:
    """Upsert a batch by store.upsert's rules; the buckets that were rewritten."""
    spark = batch.sparkSession
    many, key = layout(spark, path)
    batch = materialize(batch, "batch")
    counts = batch.groupBy(bucket(key, many).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(key)).alias("keys")).collect()  # a row a bucket
    if any(r.n != r["keys"] for r in counts):
        raise ValueError("a batch has several rows of one key")
    touched = {r.bucket for r in counts}
    if not touched:
        return []
    parts = manifest(spark, path).collect()
    old = load(spark, path, touched)
    written = _written(store.upsert(old, batch.select(*old.columns), as_of, policy, key), path, DATA, many, key)
    _point(spark, path, [tuple(p) for p in parts if p.bucket not in touched] + written)
    return sorted(touched)


def delete(gone: DataFrame, path: str) -> int:
    """Take out the rows whose key is in gone (a column of the key's name); how many there were."""
    spark = gone.sparkSession
    many, key = layout(spark, path)
    wanted = materialize(gone.select(key).distinct(), "gone")
    touched = {r.bucket for r in wanted.select(bucket(key, many).alias("bucket")).distinct().collect()}
    there = load(spark, path, touched).select(key)
    found = materialize(there.join(wanted.withColumnRenamed(key, "_wanted"), F.col(key).eqNullSafe(F.col("_wanted")), "left_semi"), "deleted")
    n = found.count()
    if n:
        parts = manifest(spark, path).collect()
        _point(spark, path, [tuple(p) for p in parts] + _written(found, path, DELETES, many, key))
    return n


def purge_disabled(spark: SparkSession, path: str, allow: DataFrame | None) -> int:
    """Delete articles of sources no longer allowed, unless bookmarked; how many. Without a filter nothing goes."""
    return 0 if allow is None else delete(selection.denied(load(spark, path).where("not is_bookmarked"), allow), path)


def enforce_retention(spark: SparkSession, path: str, as_of: datetime, days: int = 30) -> int:
    """Delete articles that aren't bookmarked and were taken in longer ago than so many days (one at least); how many."""
    cutoff = times.at(as_of) - F.expr(f"interval {max(1, days)} days")
    return delete(load(spark, path).where(~F.col("is_bookmarked") & (F.col("created_at") < cutoff)), path)


def compact(spark: SparkSession, path: str) -> list[int]:
    """Rewrite the buckets that have deletes without the rows these name; which."""
    many, key = layout(spark, path)
    parts = manifest(spark, path).collect()
    marked = {p.bucket for p in parts if p.kind == DELETES}
    if marked:
        written = _written(load(spark, path, marked), path, DATA, many, key)
        _point(spark, path, [tuple(p) for p in parts if p.bucket not in marked] + written)
    return sorted(marked)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete folders that none of the last `keep` versions name; how many."""
    last = [r.folder for r in store.pointers(spark, path).orderBy(F.desc("version"), F.desc("folder")).limit(keep).collect()]
    used = {(p.kind, p.folder) for name in last for p in spark.read.schema(MANIFEST).json(f"{path}/manifests/{name}").collect()}
    removed = 0
    for kind in (DATA, DELETES):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in files.listStatus(root) if files.exists(root) else []:
            if (kind, f.getPath().getName()) not in used:
                files.delete(f.getPath(), True)
                removed += 1
    return removed
