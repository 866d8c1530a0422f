"""Whole flows: refreshing a reader's feed, topics of the day, picks, and replaying both from what was saved."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import text, times
from gazette.operators import dedup, enrich, pages, query, ranking, selection, store
from gazette.operators import topics as clustering
from gazette.operators.selection import Preferences
from gazette.sources import feeds
from gazette.sources.tables import materialize

CORPUS, SAMPLE, SHOWN, PER_SOURCE, PER_FEED, BUDGET, PICKS = 800, 100, 50, 20, 30, 3, 30


def refreshed(raw: DataFrame, catalogue: DataFrame, page_table: DataFrame, preferences: Preferences | None) -> DataFrame:
    """Articles of payloads of the reader's sources: parsed, deduplicated by feed, the newest thirty of each, the first three
    eligible of each enriched from their pages, deduplicated over all feeds."""
    sources = selection.resolve_sources(catalogue, preferences)
    wanted = raw.join(sources.select(F.col("id").alias("_id")), F.col("source_id") == F.col("_id"), "left_semi")
    fresh = ranking.capped(dedup.in_feed(feeds.articles(feeds.items(wanted), catalogue)), PER_FEED, (F.desc_nulls_last("published_at"), F.col("id")))
    eligible = text.wants_enrichment(F.col("article_url"), F.col("content_source"), F.col("content_word_count"), F.col("is_content_likely_complete"))
    marked = materialize(ranking.within_budget(fresh, eligible, BUDGET), "marked")
    better = pages.enriched(marked.where("enriched"), page_table).unionByName(marked.where("not enriched")).drop("enriched")
    return dedup.across_feeds(better)


def persisted(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """The store after retention and the merge of refreshed articles."""
    blank = {c: F.lit(None).cast(t) for c, t in old.dtypes if c not in new.columns}
    now = times.at(as_of)
    full = new.withColumns(blank | {"is_bookmarked": F.lit(False), "is_read": F.lit(False), "created_at": now, "updated_at": now})
    return store.upsert(store.retained(old, as_of), full.select(*old.columns), as_of)


def refreshed_and_kept(raw: DataFrame, catalogue: DataFrame, page_table: DataFrame, preferences: Preferences | None, path: str, as_of: datetime) -> tuple[DataFrame, str | None]:
    """refreshed(), and what kept it from being stored under path, or None: a write that fails never fails the read."""
    new = materialize(refreshed(raw, catalogue, page_table, preferences), "refreshed")
    spark, now = new.sparkSession, times.at(as_of)
    try:
        if store.current_version(spark, path) is None:
            store.save(new.withColumns({"is_bookmarked": F.lit(False), "is_read": F.lit(False), "created_at": now, "updated_at": now}), path)
        else:
            store.save(persisted(store.load(spark, path), new, as_of), path)
    except Exception as e:  # reported, not raised: the reader still gets the articles
        return new, str(e).splitlines()[0] if str(e) else type(e).__name__
    return new, None


def shown(articles: DataFrame, preferences: Preferences | None, allow: DataFrame | None) -> DataFrame:
    """What is displayed from the store: three times as many of the newest, allowed ones, ranked, cut to fifty."""
    newest = query.recent(articles, 3 * SHOWN)
    return ranking.rank(selection.allowed(newest, allow).withColumn("pos", F.row_number().over(_newest())), preferences, SHOWN)


def _newest():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("published_at"), "id")


def topic_corpus(articles: DataFrame, as_of: datetime, allow: DataFrame | None) -> DataFrame:
    """The newest 800 of a day, allowed, twenty of a source."""
    newest = clustering.windowed(articles, as_of, False).orderBy(F.desc("published_at"), "id").limit(CORPUS)
    return ranking.top_by_date(selection.allowed(newest, allow), PER_SOURCE)


def topics_of_day(articles: DataFrame, mains: DataFrame, as_of: datetime, allow: DataFrame | None, provider: enrich.Provider | None = None) -> DataFrame:
    """Clusters of the corpus: by the provider's groups over a balanced sample, or, without one that groups, by words."""
    corpus = materialize(topic_corpus(articles, as_of, allow), "corpus")
    groups = None
    if provider is not None:
        lines = ranking.balanced(corpus.withColumn("pos", F.row_number().over(_newest())), SAMPLE).select(text.headline(F.col("id").cast("string"), F.col("title")).alias("line"))
        try:
            found = enrich.read_answer(articles.sparkSession, provider.group([r.line for r in lines.collect()]), enrich.groups)  # SAMPLE lines at most
            groups = [(g, k, i) for g, ids in enumerate(found) for k, i in enumerate(ids)]
        except NotImplementedError:
            groups = None
    if groups is None:
        return clustering.aggregate(corpus, mains, as_of)
    rows = corpus.sparkSession.createDataFrame(groups, "group_pos int, item_pos int, id string").withColumn("id", F.col("id").cast(corpus.schema["id"].dataType))
    return clustering.from_groups(dedup.first_use_groups(rows, corpus).select("group_pos", "id").distinct(), corpus, mains, as_of)


def saved_groups(clusters: DataFrame, as_of: datetime) -> DataFrame:
    """group_pos, id, saved_at of clusters of two or more, to be kept for twelve hours."""
    rows = clusters.where("is_aggregated").select(F.col("pos").alias("group_pos"), F.explode(F.concat(F.array("lead_id"), "member_ids")).alias("id"))
    return rows.withColumn("saved_at", times.at(as_of))


def rehydrated_topics(cache: DataFrame, articles: DataFrame, mains: DataFrame, as_of: datetime, allow: DataFrame | None) -> DataFrame | None:
    """Clusters of saved groups over the day before they were saved; None when the cache is a miss."""
    fresh = store.fresh_groups(cache, as_of)
    saved = fresh.agg(F.max("saved_at")).first()[0]
    if saved is None:
        return None
    return clustering.from_groups(fresh.where(F.col("saved_at") == times.at(saved)).select("group_pos", "id"), topic_corpus(articles, saved, allow), mains, saved)


def topics(cache: DataFrame, articles: DataFrame, mains: DataFrame, as_of: datetime, allow: DataFrame | None, provider: enrich.Provider | None = None) -> DataFrame:
    """Clusters of saved groups; made anew where these are stale, or none of their articles is there any more."""
    saved = rehydrated_topics(cache, articles, mains, as_of, allow)
    if saved is not None:
        saved = materialize(saved, "saved")
        if not saved.where("is_aggregated").isEmpty():
            return saved
    return topics_of_day(articles, mains, as_of, allow, provider)


def for_you(articles: DataFrame, interests: list[str], as_of: datetime, allow: DataFrame | None, provider: enrich.Provider) -> DataFrame:
    """Picks for a reader's interests, with their articles; none without interests."""
    corpus = materialize(topic_corpus(articles, as_of, allow).withColumn("pos", F.row_number().over(_newest())), "corpus")
    spark = corpus.sparkSession
    picks = []
    if interests:
        lines = ranking.balanced(corpus, SAMPLE).select(text.headline(F.col("id").cast("string"), F.col("title")).alias("line"))
        picks = enrich.read_answer(articles.sparkSession, provider.pick(interests, [r.line for r in lines.collect()]), enrich.picks)  # SAMPLE lines at most
    rows = spark.createDataFrame([(k, p["id"], p["interest"], p["relevance"]) for k, p in enumerate(picks)], "pos int, id string, interest string, relevance int")
    rows = rows.withColumn("id", F.col("id").cast(corpus.schema["id"].dataType))
    return dedup.resolved_picks(dedup.first_use_picks(rows, corpus), corpus, PICKS)


def rehydrated_picks(cache: DataFrame, articles: DataFrame, as_of: datetime, allow: DataFrame | None) -> DataFrame | None:
    """Saved picks (pos, id, interest, relevance, saved_at) with their articles; None when the cache is a miss."""
    fresh = store.fresh_groups(cache, as_of)
    saved = fresh.agg(F.max("saved_at")).first()[0]
    if saved is None:
        return None
    corpus = topic_corpus(articles, saved, allow).withColumn("pos", F.row_number().over(_newest()))
    return dedup.resolved_picks(fresh.drop("saved_at"), corpus, PICKS)
