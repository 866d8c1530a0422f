"""Feed health: counts by status, outlet and region, and reports of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import text

#: Six statuses as a report folds them to four.
FOLDED = {"success": "success", "empty": "empty", "parse_failed": "failed", "network_failed": "failed", "invalid_url": "failed", "not_checked": "pending"}


def bucket(status: Column) -> Column:
    """The report's name of a status; one that isn't known is failed."""
    out = F.lit("failed")
    for name, kept in FOLDED.items():
        out = F.when(status == name, kept).otherwise(out)
    return out


def by_status(checks: DataFrame) -> DataFrame:
    """bucket, feeds."""
    return checks.groupBy(bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("feeds"))


def by_outlet(articles: DataFrame) -> DataFrame:
    """source_name, articles, with_image, with_body."""
    return articles.groupBy("source_name").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("hero_image_url").isNotNull()).alias("with_image"), F.count_if(F.trim("cleaned_content") != "").alias("with_body"))


def by_region(checks: DataFrame) -> DataFrame:
    """region, feeds, ok, failed, articles."""
    b = bucket(F.col("status"))
    return checks.groupBy("region").agg(F.count(F.lit(1)).alias("feeds"), F.count_if(b == "success").alias("ok"), F.count_if(b == "failed").alias("failed"), F.sum("articles_count").alias("articles"))


def outlets_per_region(catalogue: DataFrame) -> DataFrame:
    """region, outlets."""
    return catalogue.groupBy("region").agg(F.count(F.lit(1)).alias("outlets"))


def degraded(checks: DataFrame) -> DataFrame:
    """Successful feeds with articles of which fewer than half (one at least) have a body, or an image."""
    half = F.greatest(F.lit(1), F.floor(F.col("articles_count") / 2))
    return checks.where((F.col("status") == "success") & (F.col("articles_count") > 0) & ((F.col("articles_with_body") < half) | (F.col("articles_with_image") < half)))


def outcome(checks: DataFrame) -> DataFrame:
    """One row: loaded, failed (nothing loaded, no success, a failure) or empty."""
    b = bucket(F.col("status"))
    sums = checks.agg(F.coalesce(F.sum("articles_count"), F.lit(0)).alias("articles"), F.count_if(b == "success").alias("ok"), F.count_if(b == "failed").alias("failed"))
    return sums.select("*", F.when(F.col("articles") > 0, "loaded").when((F.col("ok") == 0) & (F.col("failed") > 0), "failed").otherwise("empty").alias("outcome"))


def text_report(checks: DataFrame) -> DataFrame:
    """value: a line for each feed, to be written with write.text."""
    line = F.format_string("[%s] %s (%s) articles=%d images=%d bodies=%d %dms \"%s\"", bucket(F.col("status")), "outlet", "region", "articles_count", "articles_with_image", "articles_with_body", "elapsed_ms", text.report_escape(F.coalesce("message", F.lit(""))))
    return checks.orderBy("region", F.lower("outlet"), "source_id").select(line.alias("value"))


def json_report(checks: DataFrame) -> DataFrame:
    """value: a JSON object for each feed."""
    return checks.orderBy("region", F.lower("outlet"), "source_id").select(F.to_json(F.struct("source_id", "outlet", "region", "is_main", "feed_url", bucket(F.col("status")).alias("status"), "articles_count", "articles_with_image", "articles_with_body", "elapsed_ms", "message")).alias("value"))
