"""Ranking by preferences, caps and samples by source, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.operators.selection import Preferences


def score(p: Preferences) -> Column:
    """3 for the category, 2 for each tag among the topics, 4 for a favourite source, 1 for the language; case is ignored."""
    low = lambda values: [v.lower() for v in values]
    has = lambda c, values: F.lower(c).isin(low(values)) if values else F.lit(False)
    one = lambda condition, n: F.when(condition, n).otherwise(0)
    tags = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: has(t, p.preferred_topics)))
    language = F.lower("language") == (p.preferred_language or "").lower() if p.preferred_language else F.lit(False)
    return one(has(F.col("category"), p.preferred_categories), 3) + 2 * tags + one(has(F.col("source_name"), p.favorite_sources), 4) + one(language, 1)


def rank(articles: DataFrame, p: Preferences | None, limit: int | None = None) -> DataFrame:
    """Visible articles by score, date and place (pos); without any signal as they came."""
    if p is None or not p.has_signal():
        out = articles.orderBy("pos")
    else:
        hidden = [h.lower() for h in p.hidden_sources]
        seen = articles.where(~F.lower("source_name").isin(hidden)) if hidden else articles
        out = seen.withColumn("score", score(p)).orderBy(F.desc("score"), F.desc("published_at"), "pos")
    return out if limit is None else out.limit(limit)


def source_key() -> Column:
    """source_id, or the name where there is none."""
    return F.coalesce("source_id", "source_name")


def capped(articles: DataFrame, cap: int = 20, order: tuple = ("pos",)) -> DataFrame:
    """The first `cap` rows of each source. row_number() under a limit keeps only so many of a source in each task, before the
    shuffle."""
    at = F.row_number().over(Window.partitionBy(source_key()).orderBy(*order))
    return articles.withColumn("_at", at).where(F.col("_at") <= cap).drop("_at")


def top_by_date(articles: DataFrame, n: int = 30) -> DataFrame:
    """The newest n of each source."""
    return capped(articles, n, (F.desc("published_at"), F.col("id")))


def balanced(articles: DataFrame, limit: int = 100) -> DataFrame:
    """A round-robin over sources in order of first appearance; the input as it is when it isn't larger than the limit. Only
    the first `limit` rows of a source can be in it."""
    if articles.limit(limit + 1).count() <= limit:
        return articles.orderBy("pos")
    by = Window.partitionBy(source_key())
    rows = articles.withColumn("_round", F.row_number().over(by.orderBy("pos"))).where(F.col("_round") <= limit)
    first = rows.withColumn("_first", F.min("pos").over(by))
    return first.orderBy("_round", "_first").limit(limit).drop("_round", "_first")


def within_budget(articles: DataFrame, eligible: Column, n: int = 3) -> DataFrame:
    """`enriched` for the first n eligible rows of each source in order (pos, then id). Only eligible rows are ranked,
    n of a source in each task, so a source with most rows costs no more than others."""
    turn = F.row_number().over(Window.partitionBy("_source").orderBy("pos", "id"))
    first = articles.where(eligible).select(source_key().alias("_source"), "pos", "id").withColumn("_turn", turn).where(F.col("_turn") <= n)
    last = first.groupBy("_source").agg(F.max(F.struct("pos", "id")).alias("_last"))
    rows = articles.join(last, source_key().eqNullSafe(F.col("_source")), "left")
    return rows.withColumn("enriched", F.coalesce(eligible & (F.struct("pos", "id") <= F.col("_last")), F.lit(False))).drop("_source", "_last")


def drop_link_runs(paragraphs: DataFrame, share: float = 0.85, run: int = 3) -> DataFrame:
    """Paragraphs (page_id, pos, chars, link_chars, links) without runs of three or more in a row that are one link and hardly
    anything else."""
    single = (F.col("links") == 1) & (F.col("chars") > 0) & (F.col("link_chars") > 0) & (F.col("link_chars") >= F.col("chars") * share)
    page = Window.partitionBy("page_id")
    rows = paragraphs.withColumn("_single", single)
    island = F.row_number().over(page.orderBy("pos")) - F.row_number().over(Window.partitionBy("page_id", "_single").orderBy("pos"))
    rows = rows.withColumn("_island", island)
    length = F.count(F.lit(1)).over(Window.partitionBy("page_id", "_single", "_island"))
    return rows.withColumn("_length", length).where(~(F.col("_single") & (F.col("_length") >= run))).drop("_single", "_island", "_length")
