"""Newest article of each canonical URL, within a feed and across feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import urls


def latest_by(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key. As a minimum over a struct it is combined before the shuffle, so a hot key costs a row a task."""
    packed = rows.select(key.alias("_key"), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_order"), F.struct("*").alias("_row"))
    return packed.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def in_feed(articles: DataFrame) -> DataFrame:
    """One article for each canonical URL (its id, where it has none): the latest, the first in the feed (pos) on ties."""
    key = F.coalesce(urls.canonical(F.col("article_url")), F.col("id").cast("string"))
    return latest_by(articles, F.struct("source_id", key), -F.unix_micros(F.coalesce("published_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp")), F.col("pos"))


def across_feeds(articles: DataFrame) -> DataFrame:
    """The same over all feeds; ties go to the first by region, outlet and place."""
    key = F.coalesce(urls.canonical(F.col("article_url")), F.col("id").cast("string"))
    return latest_by(articles, key, -F.unix_micros(F.coalesce("published_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).cast("timestamp")), F.col("region"), F.lower("outlet_name"), F.col("pos"))


def first_use_groups(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Of (group_pos, item_pos, id): ids that are known, each in the first group that names it (repeats within it stay), in
    groups of two or more."""
    seen = groups.join(known.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
    first = seen.withColumn("_first", F.min("group_pos").over(Window.partitionBy("id"))).where("group_pos = _first").drop("_first")
    return first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("group_pos"))).where("_n >= 2").drop("_n")


def first_use_picks(picks: DataFrame, known: DataFrame, least: int = 25) -> DataFrame:
    """Of (pos, id, interest, relevance): known ids, the first pick of each, then those of `least` relevance or more."""
    seen = picks.join(known.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left_semi")
    return latest_by(seen, F.col("id"), F.col("pos")).where(F.col("relevance") >= least)


def resolved_picks(picks: DataFrame, articles: DataFrame, most: int = 30) -> DataFrame:
    """Picks with their articles (the first row of an id), by falling relevance."""
    one = latest_by(articles, F.col("id"), F.col("pos"))
    return picks.withColumnRenamed("pos", "pick_pos").join(one, "id").orderBy(F.desc("relevance"), "pick_pos").limit(most)
