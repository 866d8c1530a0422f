"""The article query: a value that is lowered to one predicate, an order and a limit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import text, times

ORDERS = {"published_desc": ("published_at", False), "published_asc": ("published_at", True), "created_desc": ("created_at", False), "updated_desc": ("updated_at", False)}


@dataclass(frozen=True)
class ArticleQuery:
    """None means no condition; an empty list of sources matches nothing; both dates are inclusive."""

    published_after: datetime | None = None
    published_before: datetime | None = None
    source_names: list[str] | None = None
    only_bookmarked: bool = False
    only_unread: bool = False
    search: str | None = None
    order: str = "published_desc"
    limit: int | None = None

    def conditions(self) -> list[Column]:
        """Conditions that a scan can take, then the one on text."""
        found = []
        if self.published_after is not None:
            found.append(F.col("published_at") >= times.at(self.published_after))
        if self.published_before is not None:
            found.append(F.col("published_at") <= times.at(self.published_before))
        if self.source_names is not None:
            found.append(F.col("source_name").isin(self.source_names) if self.source_names else F.lit(False))
        if self.only_bookmarked:
            found.append(F.col("is_bookmarked"))
        if self.only_unread:
            found.append(~F.col("is_read"))
        wanted = (self.search or "").strip()
        if wanted:
            needle = text.fold(F.lit(wanted))
            found.append(F.contains(text.fold(F.col("title")), needle) | F.contains(text.fold(F.coalesce("cleaned_content", F.lit(""))), needle))
        return found

    def __call__(self, articles: DataFrame) -> DataFrame:
        conditions = self.conditions()
        out = articles.where(reduce(lambda a, b: a & b, conditions)) if conditions else articles
        column, rising = ORDERS[self.order]
        out = out.orderBy(F.col(column).asc() if rising else F.col(column).desc(), "id")
        return out if self.limit is None else out.limit(max(0, self.limit))


def recent(articles: DataFrame, limit: int, since: datetime | None = None) -> DataFrame:
    """The newest articles, one at least."""
    return ArticleQuery(published_after=since, limit=max(1, limit))(articles)


def by_id(articles: DataFrame, wanted: str) -> DataFrame:
    """The article with an id, or none."""
    return articles.where(F.col("id") == wanted).limit(1)


def favourites(articles: DataFrame) -> DataFrame:
    """Bookmarked articles, latest change first."""
    return ArticleQuery(only_bookmarked=True, order="updated_desc")(articles)


def history(interactions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest opens."""
    return interactions.where("action_type = 'open'").orderBy(F.desc("ts"), "id").limit(max(0, limit))
