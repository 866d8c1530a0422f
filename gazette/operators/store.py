"""The article store's writes as set operations: the new state of a table from the old one and a change. save() swaps a
version in, so that a table is never overwritten while it is read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import times

from gazette.operators import selection

#: What a reader did to an article; a refresh never overwrites it.
KEPT = ("is_bookmarked", "is_read", "created_at")
#: What enrichment adds: an incoming null doesn't erase it.
COALESCED = ("source_id", "ai_summary_short", "ai_summary_bullets", "cluster_id")
#: What the store's own upsert leaves to enrichment, once an article is there.
DISTILLED = ("external_id", "author_name", "hero_image_url", "distilled_body_html", "distiller_version", "content_source", "content_word_count", "is_content_likely_complete")
POLICIES = {"article": KEPT, "store": KEPT + DISTILLED}


def upsert(old: DataFrame, new: DataFrame, as_of: datetime | Column, policy: str = "article", key: str = "id") -> DataFrame:
    """Rows of either side by key: an incoming article replaces all but KEPT, and COALESCED where it has a value; updated_at is
    as_of. policy "store": it leaves DISTILLED as it is too. Columns are those of old."""
    kept = POLICIES[policy]
    now = as_of if isinstance(as_of, Column) else times.at(as_of)
    one, two = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = one.join(two, F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full_outer")
    both, only_old = F.col("_old").isNotNull() & F.col("_new").isNotNull(), F.col("_new").isNull()

    def value(c: str) -> Column:
        was, comes = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(was, comes)
        if c == "updated_at":
            return F.when(only_old, was).otherwise(now)
        if c in kept:
            return F.when(F.col("_old").isNotNull(), was).otherwise(comes)
        return F.when(only_old, was).when(both, F.coalesce(comes, was) if c in COALESCED else comes).otherwise(comes)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def with_summary(articles: DataFrame, summaries: DataFrame, as_of: datetime) -> DataFrame:
    """Articles with AI summaries (article_id, short, bullets) written in."""
    s = summaries.select(F.col("article_id").alias("_aid"), F.col("short").alias("_s"), F.col("bullets").alias("_b"))
    found = F.col("_aid").isNotNull()
    out = articles.join(s, F.col("id") == F.col("_aid"), "left")
    changed = {"ai_summary_short": F.when(found, F.col("_s")).otherwise(F.col("ai_summary_short")), "ai_summary_bullets": F.when(found, F.col("_b")).otherwise(F.col("ai_summary_bullets")), "updated_at": F.when(found, times.at(as_of)).otherwise(F.col("updated_at"))}
    return out.withColumns(changed).select(*articles.columns)


def bookmark_state(events: DataFrame) -> DataFrame:
    """article_id, is_bookmarked, updated_at from a whole log of toggles: an odd number of them is on."""
    toggles = events.where("action_type = 'bookmark_toggle'")
    return toggles.groupBy("article_id").agg((F.count(F.lit(1)) % 2 == 1).alias("is_bookmarked"), F.max("ts").alias("updated_at"))


def read_state(events: DataFrame) -> DataFrame:
    """article_id, is_read, first_read_at: reading is idempotent, only the first mark changes anything."""
    marks = F.col("action_type").isin("mark_read", "open")
    return events.groupBy("article_id").agg(F.bool_or(marks).alias("is_read"), F.min(F.when(marks, F.col("ts"))).alias("first_read_at"))


def read_interactions(marks: DataFrame, articles: DataFrame) -> DataFrame:
    """The marks (article_id, ts) that change an unread article: the first of each."""
    unread = articles.where("not is_read").select(F.col("id").alias("_id"))
    return marks.join(unread, F.col("article_id") == F.col("_id"), "left_semi").groupBy("article_id").agg(F.min("ts").alias("ts"))


def with_events(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Articles after toggles and marks of a batch of interactions."""
    e = events.groupBy(F.col("article_id").alias("_aid")).agg(F.count_if(F.col("action_type") == "bookmark_toggle").alias("_t"), F.bool_or(F.col("action_type").isin("mark_read", "open")).alias("_r"), F.max("ts").alias("_at"))
    out = articles.join(e, F.col("id") == F.col("_aid"), "left")
    flip = F.coalesce("_t", F.lit(0)) % 2 == 1
    return out.withColumns({"is_bookmarked": F.when(flip, ~F.col("is_bookmarked")).otherwise(F.col("is_bookmarked")), "is_read": F.col("is_read") | F.coalesce("_r", F.lit(False)), "updated_at": F.coalesce("_at", "updated_at")}).select(*articles.columns)


def recorded_opens(opens: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opens as interactions, and those whose article doesn't exist."""
    rows = opens.select(F.sha2(F.concat_ws("|", "article_id", F.col("ts").cast("string")), 256).alias("id"), "article_id", F.lit("open").alias("action_type"), "ts", "reading_duration", "scroll_depth")
    return selection.existing(rows, articles)


def without_history(interactions: DataFrame) -> DataFrame:
    """All but opens."""
    return interactions.where("action_type <> 'open'")


def purge_disabled(articles: DataFrame, allow: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes: articles of sources no longer allowed, unless bookmarked; without a filter nothing goes."""
    if allow is None:
        return articles, articles.limit(0)
    loose = articles.where("not is_bookmarked")
    return articles.where("is_bookmarked").unionByName(selection.allowed(loose, allow)), selection.denied(loose, allow)


def retained(articles: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Bookmarked articles and those taken in within so many days (one at least)."""
    cutoff = times.at(as_of) - F.expr(f"interval {max(1, days)} days")
    return articles.where(F.col("is_bookmarked") | (F.col("created_at") >= cutoff))


def patched(preferences: dict, patch: dict) -> tuple[dict, bool]:
    """Preferences with the patch's non-null values, lists in order without repeats, and whether anything was written."""
    clean = {k: list(dict.fromkeys(v)) if isinstance(v, list) else v for k, v in patch.items() if v is not None}
    return ({**preferences, **clean}, True) if clean else (preferences, False)


def patched_rows(preferences: DataFrame, patches: DataFrame) -> DataFrame:
    """patched() for the preferences of many readers: rows of preferences (id, ...) with what their patch (id and some of the columns)
    has that isn't null, lists in order without repeats, and `changed`."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    kinds = dict(preferences.dtypes)
    clean = lambda c: F.array_distinct(f"_{c}") if kinds[c].startswith("array") else F.col(f"_{c}")
    changed = F.lit(False)
    for c in fields:
        changed = changed | F.col(f"_{c}").isNotNull()
    out = preferences.join(p, F.col("id") == F.col("_id"), "left").withColumn("changed", F.coalesce(changed, F.lit(False)))
    return out.select(*[F.coalesce(clean(c), F.col(c)).alias(c) if c in fields else c for c in preferences.columns], "changed")


DEFAULTS = {"preferred_categories": [], "preferred_topics": [], "hidden_sources": [], "favorite_sources": [], "preferred_language": None, "enabled_regions": [], "has_completed_onboarding": False}


def load_preferences(spark: SparkSession, path: str) -> dict:
    """The stored preferences; the defaults are stored first where there are none."""
    if current_version(spark, path) is None:
        return reset_preferences(spark, path)
    import json

    return json.loads(load(spark, path).first().settings)


def _store_preferences(spark: SparkSession, path: str, preferences: dict) -> dict:
    import json

    save(spark.createDataFrame([(json.dumps(preferences, sort_keys=True),)], "settings string").coalesce(1), path)
    return preferences


def update_preferences(spark: SparkSession, path: str, patch: dict) -> dict:
    """Preferences after a patch; a patch without values writes nothing."""
    new, changed = patched(load_preferences(spark, path), patch)
    return _store_preferences(spark, path, new) if changed else new


def reset_preferences(spark: SparkSession, path: str) -> dict:
    """Store the defaults."""
    return _store_preferences(spark, path, dict(DEFAULTS))


def save(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write the next version of a table, then point to it; returns the version's folder. A version has a folder of its own
    name, which only a written pointer names, so a writer that dies in between leaves nothing that a later one stumbles over.
    The last `keep` versions stay for readers, older ones go."""
    import uuid

    spark = df.sparkSession
    version, folder = (current_version(spark, path) or 0) + 1, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/{folder}")
    spark.createDataFrame([(version, folder)], POINTER).coalesce(1).write.mode("append").json(f"{path}/versions")
    for old in pointers(spark, path).where(F.col("version") <= version - keep).collect():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{old.folder}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return f"{path}/data/{folder}"


POINTER = "version int, folder string"


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """version and folder of every version that was ever pointed to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], POINTER)
    return spark.read.schema(POINTER).json(f"{path}/versions")


def current_version(spark: SparkSession, path: str) -> int | None:
    """The latest complete version of a table of save()."""
    return pointers(spark, path).agg(F.max("version")).first()[0]


def load(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a table of save(); of two writers of one version, the one whose folder's name comes last."""
    last = pointers(spark, path).orderBy(F.desc("version"), F.desc("folder")).first()
    return spark.read.parquet(f"{path}/data/{last.folder}")


def current_run(cache: DataFrame) -> DataFrame:
    """Rows of the newest run (run, ...): what a superseded run has still written is discarded."""
    newest = cache.agg(F.max("run").alias("_run"))
    return cache.join(F.broadcast(newest), F.col("run") == F.col("_run")).drop("_run")


def without_reader(cache: DataFrame, readers: DataFrame) -> DataFrame:
    """The cache (reader, ...) without rows of readers (reader) whose interests changed."""
    return cache.join(readers.select(F.col("reader").alias("_reader")).distinct(), F.col("reader") == F.col("_reader"), "left_anti")


def decodable(cache: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Rows of a cache whose payload is JSON, and those whose isn't, which are to be deleted."""
    good = F.try_parse_json(payload).isNotNull()
    return cache.where(good), cache.where(~good)


def fresh_groups(cache: DataFrame, as_of: datetime, hours: int = 12) -> DataFrame:
    """Cached rows saved within so many hours before as_of; future ones are a miss too."""
    at = times.at(as_of)
    return cache.where((F.col("saved_at") <= at) & (F.col("saved_at") >= at - F.expr(f"interval {hours} hours")))
