"""Streams of articles and interactions: deduplication within a watermark, windows, merges into the store."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, times
from gazette.operators import buckets, dedup, store
from gazette.sources.tables import setting


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def plausible(rows: DataFrame, as_of, column: str = "published_at") -> DataFrame:
    """Rows not dated more than five minutes ahead; those without a date pass as ancient."""
    limit = times.at(as_of) + F.expr("interval 300 seconds")
    return rows.where(F.col(column).isNull() | (F.col(column) <= limit))


def unique(rows: DataFrame, key: str = "id", column: str = "published_at", late: str = "24 hours") -> DataFrame:
    """The first row of each key within the watermark; state of older ones is dropped. Watermarks need a time with a zone, so
    that is made of the column and left out again."""
    return rows.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def counts(rows: DataFrame, column: str, by: str, length: str = "24 hours", slide: str | None = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, end, by, n over sliding windows; start and end are of the column's type."""
    kind = rows.schema[column].dataType
    window = F.window("_at", length, slide) if slide else F.window("_at", length)
    out = rows.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), by, "n")


def first_of_day(rows: DataFrame, column: str, keys: list[str], order: str, late: str = "1 day") -> DataFrame:
    """keys, day and first (column, order) of each key and day, to be written in update mode: a batch gives the days that it changed,
    and days before the watermark leave the state."""
    dated = rows.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", late)
    out = dated.groupBy(F.window("_at", "1 day").alias("w"), *keys).agg(F.min(F.struct(column, order)).alias("first"))
    return out.select(*keys, F.col("w.start").alias("day"), "first")


def panes(articles: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """pane, token, df: in how many articles of each hour a token is, and, for '', how many articles there are; to be written in update
    mode, as first_of_day()."""
    words = F.array_distinct(F.concat(F.array(F.lit("")), text.tokens(F.col("title"), F.col("summary_short"))))
    rows = articles.select(F.col("published_at").cast("timestamp").alias("_at"), words.alias("words")).withWatermark("_at", late)
    counted = rows.select("_at", F.explode("words").alias("token")).groupBy(F.window("_at", length).alias("w"), "token").agg(F.count(F.lit(1)).alias("df"))
    return counted.select(F.col("w.start").alias("pane"), "token", "df")


def day_of_panes(written: DataFrame, many: int = 24) -> DataFrame:
    """token, df over the last so many panes of an hour: sums of panes, so no article is counted again. Of a pane that several batches
    changed the last state counts, which is the greatest."""
    last = written.groupBy("pane", "token").agg(F.max("df").alias("df"))
    newest = written.agg(F.max("pane").alias("newest"))
    recent = last.join(F.broadcast(newest), F.col("pane") > F.col("newest") - F.make_dt_interval(hours=F.lit(many)))
    return recent.groupBy("token").agg(F.sum("df").alias("df"))


def batches(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer whose every batch has a folder, so that one that runs again replaces itself."""
    return lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/batch={k}")


def run_available(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Process what is there, batch by batch, and stop. conf: session settings that hold while the stream starts and runs."""
    with contextlib.ExitStack() as held:
        for key, value in (conf or {}).items():
            held.enter_context(setting(rows.sparkSession, key, value))
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def merge_into(path: str, as_of) -> Callable[[DataFrame, int], None]:
    """A batch writer that merges articles into the store at path, of each id in a batch the newest row; a batch that was merged
    already changes nothing but updated_at, as rows are matched by id."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = newest_of(batch)
        if store.current_version(spark, path) is None:
            store.save(newest, path)
        else:
            old = store.load(spark, path)
            store.save(store.upsert(old, newest.select(*old.columns), as_of), path)

    return write


def merge_into_buckets(path: str, as_of, many: int = 64, policy: str = "article") -> Callable[[DataFrame, int], None]:
    """As merge_into(), for a bucketed store: a batch rewrites only the buckets that it has ids in. A batch that was merged already
    changes nothing but updated_at."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if store.current_version(spark, path) is None:
            buckets.create(batch.limit(0), path, many)
        buckets.merge(newest_of(batch), path, as_of, policy)

    return write


def newest_of(batch: DataFrame) -> DataFrame:
    """Of each id the newest row."""
    dated = F.unix_micros(F.coalesce(F.col("published_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp"))
    return dedup.latest_by(batch, F.col("id"), -dated, F.to_json(F.struct("*")))


def surviving(write: Callable[[DataFrame, int], None], failed: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer whose failure doesn't stop the stream: what it said is added to failed."""

    def safe(batch: DataFrame, k: int) -> None:
        try:
            write(batch, k)
        except Exception as e:  # the caller decides what a failed write means
            failed.append(f"batch {k}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")

    return safe
