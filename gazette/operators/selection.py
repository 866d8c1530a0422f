"""Which sources and articles a reader sees: catalogue views, source resolution, allow-lists, hidden sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preferences:
    """A reader's settings; sources are hidden by id, ranked down by name."""

    preferred_categories: list[str] = field(default_factory=list)
    preferred_topics: list[str] = field(default_factory=list)
    hidden_sources: list[str] = field(default_factory=list)
    favorite_sources: list[str] = field(default_factory=list)
    preferred_language: str | None = None
    enabled_regions: list[str] = field(default_factory=list)
    has_completed_onboarding: bool = False

    def has_signal(self) -> bool:
        return bool(self.preferred_categories or self.preferred_topics or self.hidden_sources or self.favorite_sources or self.preferred_language)


def sources(catalogue: DataFrame, mode: str = "all", region: str | None = None) -> DataFrame:
    """all, main, or by_region (no region: none), by region, then outlet without regard to case."""
    keep = {"all": F.lit(True), "main": F.col("is_main"), "by_region": F.col("region") == F.lit(region) if region is not None else F.lit(False)}[mode]
    return catalogue.where(keep).orderBy("region", F.lower("outlet_name"), "id")


def available_regions(catalogue: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions (region, ordinal) with a source, in order."""
    return regions.join(catalogue, "region", "left_semi").orderBy("ordinal")


def resolve_sources(catalogue: DataFrame, preferences: Preferences | None) -> DataFrame:
    """Without preferences the main outlets; else those of enabled regions (none enabled: all) that aren't hidden, by id."""
    if preferences is None:
        return catalogue.where("is_main")
    out = catalogue.where(~F.col("id").isin(preferences.hidden_sources)) if preferences.hidden_sources else catalogue
    return out.where(F.col("region").isin(preferences.enabled_regions)) if preferences.enabled_regions else out


def allow_list(catalogue: DataFrame, preferences: Preferences | None) -> DataFrame | None:
    """The resolved sources, or None where no filter is set."""
    if preferences is None or not (preferences.enabled_regions or preferences.hidden_sources):
        return None
    return resolve_sources(catalogue, preferences)


def allowed(articles: DataFrame, sources_allowed: DataFrame | None) -> DataFrame:
    """Articles whose source_id is allowed, or, where they have none, whose source_name is. None allows all."""
    if sources_allowed is None:
        return articles
    ids = sources_allowed.select(F.col("id").alias("_id")).distinct()
    names = sources_allowed.select(F.col("outlet_name").alias("_name")).distinct()
    by_id = articles.where("source_id is not null").join(ids, F.col("source_id") == F.col("_id"), "left_semi")
    return by_id.unionByName(articles.where("source_id is null").join(names, F.col("source_name") == F.col("_name"), "left_semi"))


def denied(articles: DataFrame, sources_allowed: DataFrame | None) -> DataFrame:
    """The articles that allowed() leaves out."""
    if sources_allowed is None:
        return articles.limit(0)
    ids = sources_allowed.select(F.col("id").alias("_id")).distinct()
    names = sources_allowed.select(F.col("outlet_name").alias("_name")).distinct()
    by_id = articles.where("source_id is not null").join(ids, F.col("source_id") == F.col("_id"), "left_anti")
    return by_id.unionByName(articles.where("source_id is null").join(names, F.col("source_name") == F.col("_name"), "left_anti"))


def without_hidden(articles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Articles whose source_name, lower-cased, isn't among hidden (name)."""
    names = hidden.select(F.lower("name").alias("_name")).distinct()
    return articles.join(names, F.lower("source_name") == F.col("_name"), "left_anti")


def existing(rows: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (article_id, ...) whose article exists, and the others."""
    ids = articles.select(F.col("id").alias("_id")).distinct()
    on = F.col("article_id") == F.col("_id")
    return rows.join(ids, on, "left_semi"), rows.join(ids, on, "left_anti")


def toggled(values, value):
    """A list without the value (a string or a column) where it has it, with it at the end where it hasn't."""
    v = F.lit(value)
    return F.when(F.array_contains(values, v), F.array_remove(values, v)).otherwise(F.concat(values, F.array(v)))


def custom_interests(selected, suggestions):
    """Selected interests that no suggestion equals, without regard to case."""
    return F.filter(selected, lambda s: ~F.exists(suggestions, lambda g: F.lower(g) == F.lower(s)))
