"""Queries over articles: search, ranking, selection, deduplication, sampling, store maintenance, reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, times, urls
from gazette.operators import buckets, dedup, query, ranking, reports, selection, store
from gazette.plans.bindings import (
    BUCKET, CANONICAL, CATALOGUE, CHECKS, DOCUMENT_ARTICLES, EVENT_ARTICLES, INTERACTIONS, PAGE_ARTICLES, SUPPLIERS, as_of, checks, document_articles, event_articles, interactions, page_articles, read, supplier_sources,
)
from gazette.sources import catalogue, rules, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
READER = selection.Preferences(preferred_categories=["Purchase"], preferred_topics=["k3", "K7"], favorite_sources=["OUTLET 03"], hidden_sources=["outlet 09"], preferred_language="EN")
REGIONAL = selection.Preferences(hidden_sources=["src0"], enabled_regions=["italy", "germany"])
ALLOWED = "al AS (SELECT * FROM cat WHERE region IN ('italy', 'germany') AND id <> 'src0')"


def register(sql: str | None = None):
    """Add a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@register(f"""WITH {EVENT_ARTICLES}, n AS (SELECT max(ts) AS now FROM events)
SELECT id, title, source_name, published_at FROM ev, n WHERE published_at >= now - INTERVAL 7 DAY AND published_at <= now - INTERVAL 1 DAY AND source_name IN ('Outlet 01', 'Outlet 02', 'Outlet 03', 'Outlet 05') AND NOT is_read
ORDER BY published_at DESC, id LIMIT 100""")
def feed_query_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread articles of four outlets within six days, the newest hundred."""
    now = as_of(spark, sf_dir)
    q = query.ArticleQuery(now - timedelta(days=7), now - timedelta(days=1), ["Outlet 01", "Outlet 02", "Outlet 03", "Outlet 05"], only_unread=True, limit=100)
    return q(event_articles(spark, sf_dir)).select("id", "title", "source_name", "published_at")


@register(f"""WITH {DOCUMENT_ARTICLES}
SELECT id, title, published_at FROM dc WHERE contains(lower(strip_accents(title)), 'eaue') OR contains(lower(strip_accents(coalesce(cleaned_content, ''))), 'eaue')
ORDER BY published_at DESC, id LIMIT 50""")
def feed_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty articles with a text, without regard to case and marks."""
    return query.ArticleQuery(search=" Éaué ", limit=50)(document_articles(spark, sf_dir)).select("id", "title", "published_at")


@register(f"""WITH {EVENT_ARTICLES}
SELECT id, published_at, (CASE WHEN lower(category) = 'purchase' THEN 3 ELSE 0 END + 2 * len(list_filter(tags, lambda t: lower(t) IN ('k3', 'k7'))) + CASE WHEN lower(source_name) = 'outlet 03' THEN 4 ELSE 0 END + CASE WHEN lower(language) = 'en' THEN 1 ELSE 0 END)::INT AS score
FROM ev WHERE lower(source_name) <> 'outlet 09' ORDER BY score DESC, published_at DESC, pos LIMIT 50""")
def feed_rank_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best for a reader."""
    return ranking.rank(event_articles(spark, sf_dir), READER, 50).select("id", "published_at", F.col("score").cast("int").alias("score"))


@register(f"WITH {EVENT_ARTICLES} SELECT id, source_name FROM ev WHERE lower(source_name) NOT IN ('outlet 01', 'outlet 02')")
def feed_hidden_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of sources that aren't hidden."""
    hidden = spark.createDataFrame([("OUTLET 01",), ("Outlet 02",)], "name string")
    return selection.without_hidden(event_articles(spark, sf_dir), hidden).select("id", "source_name")


@register(f"""WITH {EVENT_ARTICLES}, {CATALOGUE}, {ALLOWED}
SELECT id, source_id, source_name FROM ev WHERE CASE WHEN source_id IS NOT NULL THEN source_id IN (SELECT id FROM al) ELSE source_name IN (SELECT outlet_name FROM al) END""")
def allowlist_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of allowed sources, by id, or by name where there is none."""
    allow = selection.allow_list(catalogue.sample(spark), REGIONAL)
    return selection.allowed(event_articles(spark, sf_dir), allow).select("id", "source_id", "source_name")


@register(f"SELECT page_id, {CANONICAL.format(x='url')} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs of pages."""
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@register(f"""WITH {PAGE_ARTICLES} SELECT id, article_url FROM (SELECT *, row_number() OVER (PARTITION BY source_id, canonical ORDER BY published_at DESC, id) AS k FROM pa) WHERE k = 1""")
def dedup_latest_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest article of each URL of a feed."""
    return dedup.in_feed(page_articles(spark, sf_dir)).select("id", "article_url")


@register(f"""WITH {PAGE_ARTICLES} SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY published_at DESC, region, lower(source_id), id) AS k FROM pa) WHERE k = 1""")
def dedup_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest article of each URL of all feeds."""
    return dedup.across_feeds(page_articles(spark, sf_dir)).select("id", "source_id")


@register(f"SELECT page_id, sha256('src' || (page_id % 20) || '|' || coalesce(CASE WHEN page_id % 2 = 0 THEN 'g' || page_id END, '') || '|' || {CANONICAL.format(x='url')} || '|' || lower(coalesce(regexp_extract(html, '<title>([^<]*)', 1), ''))) AS id FROM pages")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of pages; half of them have no guid."""
    guid = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("g"), F.col("page_id").cast("string")))
    source = F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", urls.stable_id(source, guid, F.col("url"), F.regexp_extract("html", "<title>([^<]*)", 1)).alias("id"))


@register(f"WITH {EVENT_ARTICLES} SELECT id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY pos) AS k FROM ev) WHERE k <= 20")
def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty articles of each source."""
    return ranking.capped(event_articles(spark, sf_dir), 20).select("id", "source_name")


@register(f"""WITH {EVENT_ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY pos) AS k, min(pos) OVER (PARTITION BY coalesce(source_id, source_name)) AS f FROM ev)
SELECT id, source_name FROM r ORDER BY k, f LIMIT 100""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred articles, sources in turn."""
    return ranking.balanced(event_articles(spark, sf_dir), 100).select("id", "source_name")


@register(f"WITH {EVENT_ARTICLES} SELECT id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS k FROM ev) WHERE k <= 30")
def top30_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest thirty of each source."""
    return ranking.top_by_date(event_articles(spark, sf_dir), 30).select("id", "source_name")


@register(f"""WITH {EVENT_ARTICLES}, h AS (SELECT max(published_at) AS now FROM ev)
SELECT id FROM ev, h WHERE published_at >= now - INTERVAL 1 DAY ORDER BY published_at DESC, id LIMIT 800""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest articles of a day, 800 at most."""
    return query.recent(event_articles(spark, sf_dir), 800, as_of(spark, sf_dir) - timedelta(days=1)).select("id")


@register(f"WITH {EVENT_ARTICLES} SELECT id, published_at FROM ev WHERE is_bookmarked ORDER BY created_at DESC, id")
def favourite_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarked articles."""
    return query.favourites(event_articles(spark, sf_dir).withColumn("updated_at", F.col("created_at"))).select("id", "published_at")


@register(f"""WITH {DOCUMENT_ARTICLES}, e AS (SELECT id, source_name, pos, CASE id % 3 WHEN 0 THEN 'feed_content' WHEN 1 THEN 'feed_summary' ELSE 'article_page' END AS src, length(cleaned_content) % 400 AS n, id % 2 = 0 AS complete, CASE WHEN id % 5 = 0 THEN 'http://a.example/' ELSE 'HTTPS://a.example/' END AS url FROM dc),
f AS (SELECT *, lower(url[1:8]) = 'https://' AND NOT ((src = 'article_page' AND n >= 180) OR (complete AND n >= 220) OR (src = 'feed_content' AND n >= 350)) AS ok FROM e)
SELECT id, ok AND sum(ok::INT) OVER (PARTITION BY source_name ORDER BY pos) <= 3 AS enriched FROM f""")
def enrichment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which articles are enriched: the first three eligible of each source."""
    d = document_articles(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("feed_content", "feed_summary", "article_page"))), (F.col("id") % 3 + 1).cast("int"))
    url = F.when(F.col("id") % 5 == 0, "http://a.example/").otherwise("HTTPS://a.example/")
    return ranking.within_budget(d, text.wants_enrichment(url, kind, F.length("cleaned_content") % 400, F.col("id") % 2 == 0), 3).select("id", "enriched")


@register("""WITH e AS (SELECT doc_id, length(text) % 300 AS o, length(text) // 7 % 400 AS n, CASE WHEN doc_id % 3 = 0 THEN 'feed_summary' ELSE 'feed_content' END AS src, doc_id % 4 = 0 AS complete FROM documents)
SELECT doc_id, CASE WHEN n <= 0 THEN false WHEN o = 0 THEN true WHEN src = 'feed_summary' THEN n >= o + 15 WHEN complete THEN n >= o + 80 WHEN o < 120 THEN n >= o + 20 ELSE n >= o + 35 OR n >= 180 END AS replaced FROM e""")
def replace_content_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's text replaces an article's."""
    n = F.length("text")
    rule = text.replace_content(F.floor(n / 7) % 400, n % 300, F.when(F.col("doc_id") % 3 == 0, "feed_summary").otherwise("feed_content"), F.col("doc_id") % 4 == 0)
    return read(spark, sf_dir, "documents").select("doc_id", rule.alias("replaced"))


@register(f"WITH {SUPPLIERS} SELECT id, outlet_name, region FROM sup WHERE is_main")
def main_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main outlets of the catalogue, which hold without preferences; suppliers are sources."""
    return selection.resolve_sources(supplier_sources(spark, sf_dir), None).select("id", "outlet_name", "region")


@register(f"""WITH {SUPPLIERS} SELECT id, outlet_name FROM sup WHERE region = 'europe' ORDER BY region, lower(outlet_name), id""")
def sources_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a region."""
    return selection.sources(supplier_sources(spark, sf_dir), "by_region", "europe").select("id", "outlet_name")


@register(f"""WITH {SUPPLIERS} SELECT DISTINCT region FROM sup""")
def available_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with a source, by the table's order."""
    regions = read(spark, sf_dir, "region").select(F.lower("r_name").alias("region"), F.col("r_regionkey").alias("ordinal"))
    return selection.available_regions(supplier_sources(spark, sf_dir), regions).select("region")


HOST_RULES = [("generic", ["example.com", "example.org"]), ("blogs", ["thertion.example.org", "blog.ththan.example.net"]), ("net", ["example.net"]), ("look", ["xample.net"]), ("spam", ["spam-farm.example.org"])]


@register("""WITH h AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages),
r AS (SELECT * FROM (VALUES ('generic', 'example.com'), ('generic', 'example.org'), ('blogs', 'thertion.example.org'), ('blogs', 'blog.ththan.example.net'), ('net', 'example.net'), ('look', 'xample.net'), ('spam', 'spam-farm.example.org')) v(rule_id, rh)),
m AS (SELECT page_id, arg_max(rule_id, length(rh)) AS rule_id FROM h JOIN r ON host = rh OR suffix(host, '.' || rh) GROUP BY page_id)
SELECT page_id, host, rule_id FROM h LEFT JOIN m USING (page_id)""")
def host_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific rule of each page's host."""
    table = rules.table(spark, [{"id": k, "hosts": h} for k, h in HOST_RULES])
    pages = read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return rules.for_hosts(pages, table).select("page_id", "host", "rule_id")


@register(f"""WITH {INTERACTIONS}, a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT id, article_id FROM ia WHERE article_id NOT IN (SELECT doc_id FROM a)""")
def orphan_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions whose article doesn't exist."""
    articles = read(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    return selection.existing(interactions(spark, sf_dir), articles)[1].select("id", "article_id")


GROUPS = "gr AS (SELECT value::BIGINT % 30 AS group_pos, event_id AS item_pos, event_id % 400 AS id FROM events)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select((F.rint("value").cast("long") % 30).alias("group_pos"), F.col("event_id").alias("item_pos"), (F.col("event_id") % 400).alias("id"))


@register(f"""WITH {GROUPS}, k AS (SELECT * FROM gr WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)), f AS (SELECT *, min(group_pos) OVER (PARTITION BY id) AS first_pos FROM k),
s AS (SELECT *, count(*) OVER (PARTITION BY group_pos) AS n FROM f WHERE group_pos = first_pos)
SELECT group_pos, item_pos, id FROM s WHERE n >= 2""")
def validate_groups_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of known ids, each id in the first group that names it."""
    known = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return dedup.first_use_groups(_groups(spark, sf_dir), known)


@register("""WITH p AS (SELECT event_id AS pos, event_id % 700 AS id, event_type AS interest, greatest(1, least(100, value::BIGINT)) AS relevance FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM p WHERE id IN (SELECT doc_id FROM documents))
SELECT id, interest, relevance, source AS source_name FROM k JOIN documents ON doc_id = id WHERE r = 1 AND relevance >= 25 ORDER BY relevance DESC, pos LIMIT 30""")
def resolve_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty most relevant picks with their articles."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") % 700).alias("id"), F.col("event_type").alias("interest"), F.greatest(F.lit(1), F.least(F.lit(100), F.rint("value").cast("long"))).alias("relevance"))
    articles = document_articles(spark, sf_dir).select("id", "pos", "source_name")
    return dedup.resolved_picks(dedup.first_use_picks(rows, articles), articles).select("id", "interest", "relevance", "source_name")


@register(f"WITH {INTERACTIONS} SELECT id, article_id, ts FROM ia WHERE action_type = 'open' ORDER BY ts DESC, id LIMIT 50")
def history_recent_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fifty opens."""
    return query.history(interactions(spark, sf_dir)).select("id", "article_id", "ts")


@register(f"WITH {INTERACTIONS} SELECT article_id, count(*) % 2 = 1 AS is_bookmarked, max(ts) AS updated_at FROM ia WHERE action_type = 'bookmark_toggle' GROUP BY article_id")
def bookmark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks after a log of toggles."""
    return store.bookmark_state(interactions(spark, sf_dir))


@register(f"WITH {INTERACTIONS} SELECT article_id, bool_or(action_type IN ('open', 'mark_read')) AS is_read, min(ts) FILTER (action_type IN ('open', 'mark_read')) AS first_read_at FROM ia GROUP BY article_id")
def mark_read_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been read, and since when."""
    return store.read_state(interactions(spark, sf_dir))


@register(f"WITH {INTERACTIONS} SELECT action_type, count(*) AS n FROM ia WHERE action_type <> 'open' GROUP BY 1")
def clear_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of interactions without opens."""
    return store.without_history(interactions(spark, sf_dir)).groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {EVENT_ARTICLES}, n AS (SELECT max(ts) AS now FROM events) SELECT id FROM ev, n WHERE is_bookmarked OR created_at >= now - INTERVAL 7 DAY")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week's retention keeps."""
    return store.retained(event_articles(spark, sf_dir), as_of(spark, sf_dir), 7).select("id")


@register(f"""WITH {EVENT_ARTICLES}, {CATALOGUE}, {ALLOWED}
SELECT id FROM ev WHERE is_bookmarked OR CASE WHEN source_id IS NOT NULL THEN source_id IN (SELECT id FROM al) ELSE source_name IN (SELECT outlet_name FROM al) END""")
def purge_disabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after purging sources that are off."""
    return store.purge_disabled(event_articles(spark, sf_dir), selection.allow_list(catalogue.sample(spark), REGIONAL))[0].select("id")


@register("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS title, o_custkey AS source_id, o_orderkey % 2 = 0 AS is_read, o_totalprice AS content FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey + 1 END AS source_id, false AS is_read, o_totalprice * 2 AS content FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.id IS NULL THEN o.source_id ELSE coalesce(n.source_id, o.source_id) END AS source_id, coalesce(o.is_read, n.is_read) AS is_read, CASE WHEN n.id IS NULL THEN o.content ELSE n.content END AS content
FROM o FULL JOIN n ON o.id = n.id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a batch of changed and new rows."""
    rows = read(spark, sf_dir, "orders")
    old = rows.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 2 == 0).alias("is_read"), F.col("o_totalprice").alias("content"))
    new = rows.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") + 1).alias("source_id"), F.lit(False).alias("is_read"), (F.col("o_totalprice") * 2).alias("content"))
    return store.upsert(old, new, F.lit(None))


STORED = ["id", "title", "source_name", "source_id", "content_source", "content_word_count", "hero_image_url", "cleaned_content", "is_bookmarked", "is_read", "created_at", "updated_at"]


def bucketed(spark: SparkSession, sf_dir: str, many: int = 16) -> str:
    """A bucketed store of articles made of events; its folder."""
    path = tables.scratch(spark, "buckets")
    buckets.create(stored_articles(spark, sf_dir), path, many)
    return path


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_articles(spark, sf_dir).withColumns({"content_source": F.lit("article_page"), "content_word_count": F.lit(300), "is_read": F.lit(False), "updated_at": F.col("created_at")})
    return rows.select(*STORED)


STORED_SQL = "s AS (SELECT id, title, source_name, source_id, 'article_page' AS content_source, 300 AS content_word_count, hero_image_url, cleaned_content, is_bookmarked, false AS is_read, created_at, created_at AS updated_at FROM ev)"


@register(f"""WITH {EVENT_ARTICLES}, {STORED_SQL}, now AS (SELECT max(ts) AS now FROM events), b AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 10000000 END AS id, 'new ' || title AS title, source_name FROM s WHERE id % 100 < 3)
SELECT coalesce(s.id, b.id) AS id, coalesce(b.title, s.title) AS title, coalesce(b.source_name, s.source_name) AS source_name, s.source_id, CASE WHEN s.id IS NULL THEN 'feed_summary' ELSE s.content_source END AS content_source, CASE WHEN s.id IS NULL THEN 20 ELSE s.content_word_count END::INT AS content_word_count, s.hero_image_url,
  CASE WHEN b.id IS NULL THEN s.cleaned_content ELSE 'short' END AS cleaned_content, coalesce(s.is_bookmarked, false) AS is_bookmarked, coalesce(s.is_read, false) AS is_read, coalesce(s.created_at, now) AS created_at, CASE WHEN b.id IS NULL THEN s.updated_at ELSE now END AS updated_at FROM s FULL JOIN b ON s.id = b.id, now""")
def bucketed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed store after a batch of known and new articles, by the rules of the store's own upsert."""
    path, now = bucketed(spark, sf_dir), as_of(spark, sf_dir)
    known = stored_articles(spark, sf_dir).where("id % 100 < 3")
    batch = known.withColumns({"id": F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(10_000_000), "title": F.concat(F.lit("new "), "title"), "source_id": F.lit(None).cast("string"), "content_source": F.lit("feed_summary"), "content_word_count": F.lit(20), "hero_image_url": F.lit(None).cast("string"), "cleaned_content": F.lit("short"), "is_bookmarked": F.lit(False), "created_at": times.at(now)})
    buckets.merge(batch, path, now, "store")
    return buckets.load(spark, path)


@register(f"""WITH {EVENT_ARTICLES}, {CATALOGUE}, {ALLOWED}, {STORED_SQL}, n AS (SELECT max(ts) AS now FROM events),
g AS (SELECT *, CASE WHEN is_bookmarked THEN 0 WHEN created_at < now - INTERVAL 7 DAY THEN 1 WHEN CASE WHEN source_id IS NOT NULL THEN source_id IN (SELECT id FROM al) ELSE source_name IN (SELECT outlet_name FROM al) END THEN 0 ELSE 2 END AS gone FROM s, n)
SELECT id, title, (SELECT count(*) FROM g WHERE gone = 1)::BIGINT AS too_old, (SELECT count(*) FROM g WHERE gone = 2)::BIGINT AS disabled FROM g WHERE gone = 0""")
def bucketed_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a bucketed store after retention, a purge of disabled sources, and compaction; and how many went."""
    path = bucketed(spark, sf_dir)
    old = buckets.enforce_retention(spark, path, as_of(spark, sf_dir), 7)
    disabled = buckets.purge_disabled(spark, path, selection.allow_list(catalogue.sample(spark), REGIONAL))
    buckets.compact(spark, path)
    return buckets.load(spark, path).select("id", "title", F.lit(old).cast("long").alias("too_old"), F.lit(disabled).cast("long").alias("disabled"))


@register(f"WITH {CHECKS} SELECT {BUCKET} AS bucket, count(*) AS feeds FROM ck GROUP BY 1")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by folded status."""
    return reports.by_status(checks(spark, sf_dir))


@register(f"WITH {EVENT_ARTICLES} SELECT source_name, count(*) AS articles, count(hero_image_url) AS with_image, count(*) FILTER (trim(cleaned_content) <> '') AS with_body FROM ev GROUP BY 1")
def outlet_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, images and bodies by outlet."""
    return reports.by_outlet(event_articles(spark, sf_dir))


@register(f"WITH {CHECKS} SELECT region, count(*) AS feeds, count(*) FILTER ({BUCKET} = 'success') AS ok, count(*) FILTER ({BUCKET} = 'failed') AS failed, sum(articles_count)::BIGINT AS articles FROM ck GROUP BY 1")
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds by region."""
    return reports.by_region(checks(spark, sf_dir))


@register(f"WITH {CHECKS} SELECT source_id, outlet FROM ck WHERE status = 'success' AND articles_count > 0 AND (articles_with_body < greatest(1, articles_count // 2) OR articles_with_image < greatest(1, articles_count // 2))")
def degraded_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that succeed with few bodies or images."""
    return reports.degraded(checks(spark, sf_dir)).select("source_id", "outlet")


@register(f"WITH {CHECKS}, s AS (SELECT coalesce(sum(articles_count), 0)::BIGINT AS articles, count(*) FILTER ({BUCKET} = 'success') AS ok, count(*) FILTER ({BUCKET} = 'failed') AS failed FROM ck) SELECT *, CASE WHEN articles > 0 THEN 'loaded' WHEN ok = 0 AND failed > 0 THEN 'failed' ELSE 'empty' END AS outcome FROM s")
def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a batch of checks ended."""
    return reports.outcome(checks(spark, sf_dir))


@register("SELECT r_name AS region, count(*) AS outlets FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def outlets_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets (nations) of each region."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.outlets_per_region(rows)


@register("""WITH n AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_orderpriority, o_orderkey) AS pr, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN k IS NULL THEN c_mktsegment ELSE st || ',' || pr END AS categories, CASE WHEN k % 2 = 0 THEN 'n1' ELSE 'n' || c_nationkey END AS favorites, CASE WHEN price > 100000 THEN 'de' ELSE 'en' END AS language, k IS NOT NULL AS changed FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def preference_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers' preferences after a patch each: customers' segments and nations, patched by their newest orders."""
    readers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("preferred_categories"), F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("favorite_sources"), F.lit("en").alias("preferred_language"))
    newest = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderkey").alias("o"))
    patches = newest.select("id", F.array("o.o_orderstatus", "o.o_orderpriority", "o.o_orderstatus").alias("preferred_categories"), F.when(F.col("o.o_orderkey") % 2 == 0, F.array(F.lit("n1"), F.lit("n1"))).alias("favorite_sources"), F.when(F.col("o.o_totalprice") > 100000, "de").alias("preferred_language"))
    out = store.patched_rows(readers, patches)
    return out.select("id", F.array_join("preferred_categories", ",").alias("categories"), F.array_join("favorite_sources", ",").alias("favorites"), F.col("preferred_language").alias("language"), "changed")
