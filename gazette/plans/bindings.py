"""How the given tables stand for articles, interactions and checks; each binding as a DataFrame and as SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, urls

REGIONS = "['italy', 'germany', 'france', 'spain', 'united_kingdom', 'world']"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after(seconds: Column) -> Column:
    """So many seconds into 2024, in no time zone."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The latest event: queries never look at the clock."""
    return read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as articles of twenty outlets; one in seven has no source_id."""
    k, outlet = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("user_id") % 20
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("pos"), F.concat(F.col("event_type"), F.lit(" "), k.cast("string")).alias("title"), F.concat(F.lit("Outlet "), F.lpad(outlet.cast("string"), 2, "0")).alias("source_name"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("src"), outlet.cast("string"))).alias("source_id"), F.col("ts").alias("published_at"), F.col("event_type").alias("category"),
        F.array(F.concat(F.lit("K"), (k % 10).cast("string")), F.col("event_type")).alias("tags"), F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "it"))), (F.col("user_id") % 4 + 1).cast("int")).alias("language"),
        (F.col("value") > 90).alias("is_bookmarked"), (F.col("event_id") % 3 == 0).alias("is_read"), F.col("ts").alias("created_at"), F.when(F.col("value") > 50, F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".jpg"))).alias("hero_image_url"), F.concat(F.lit("body "), F.col("props")).alias("cleaned_content"), "value",
    )


EVENT_ARTICLES = """ev AS (SELECT event_id AS id, event_id AS pos, event_type || ' ' || regexp_extract(props, '([0-9]+)', 1) AS title, 'Outlet ' || lpad((user_id % 20)::VARCHAR, 2, '0') AS source_name,
  CASE WHEN event_id % 7 <> 0 THEN 'src' || (user_id % 20) END AS source_id, ts AS published_at, event_type AS category, ['K' || (regexp_extract(props, '([0-9]+)', 1)::INT % 10), event_type] AS tags,
  (['en', 'de', 'fr', 'it'])[user_id % 4 + 1] AS language, value > 90 AS is_bookmarked, event_id % 3 = 0 AS is_read, ts AS created_at, CASE WHEN value > 50 THEN 'https://img.example/' || regexp_extract(props, '([0-9]+)', 1) || '.jpg' END AS hero_image_url,
  'body ' || props AS cleaned_content, value FROM events)"""

CATALOGUE = f"""cat AS (SELECT 'src' || k AS id, 'Outlet ' || lpad(k::VARCHAR, 2, '0') AS outlet_name, ({REGIONS})[k % 6 + 1] AS region, k % 4 = 0 AS is_main FROM range(20) r(k))"""


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles."""
    return articles_of(read(spark, sf_dir, "documents"))


def articles_of(documents: DataFrame) -> DataFrame:
    """Documents, a table or a stream, as articles: the first line is the title, a minute passes between ids."""
    at = _after(F.col("doc_id") * 60)
    return documents.withColumn("_clean", text.sanitize(F.col("text"))).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.substring(F.element_at(F.split("text", "\n"), 1), 1, 120).alias("title"), F.col("source").alias("source_name"), F.col("source").alias("source_id"), F.col("text").alias("cleaned_content"), F.lit(None).cast("string").alias("raw_content"),
        F.col("lang").alias("language"), at.alias("published_at"), F.lit(None).cast("string").alias("hero_image_url"), text.feed_summary(F.lit(None).cast("string"), F.col("_clean")).alias("summary_short"),
    )


SANITIZED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"""
DOCUMENT_ARTICLES = f"""dc0 AS (SELECT *, {SANITIZED.format(x="text")} AS clean FROM documents),
dc AS (SELECT doc_id AS id, doc_id AS pos, substr(string_split(text, chr(10))[1], 1, 120) AS title, source AS source_name, source AS source_id, text AS cleaned_content, lang AS language, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS published_at,
  CASE WHEN clean = '' THEN NULL WHEN length(clean) <= 280 THEN clean ELSE trim(substr(clean, 1, 280)) || '…' END AS summary_short FROM dc0)"""
WORDS = r"len(list_filter(string_split_regex({x}, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what readers did: views open, clicks toggle a bookmark, purchases mark as read; 200 articles."""
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "bookmark_toggle").when(F.col("event_type") == "purchase", "mark_read").otherwise("other")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("article_id"), kind.alias("action_type"), "ts", F.col("value").alias("reading_duration"), (F.col("value") / 100).alias("scroll_depth"))


INTERACTIONS = """ia AS (SELECT event_id AS id, event_id % 200 AS article_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'bookmark_toggle' WHEN 'purchase' THEN 'mark_read' ELSE 'other' END AS action_type, ts, value AS reading_duration FROM events)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as feeds that were checked; their parts' lines are articles."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region")
    feeds = read(spark, sf_dir, "supplier").join(F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).cast("int").alias("c"), F.count_if(F.col("l_discount") > 0.05).cast("int").alias("i"), F.count_if(F.col("l_tax") > 0.04).cast("int").alias("b"))
    key = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, ("success", "success", "success", "empty", "parse_failed", "network_failed", "not_checked"))), (key % 7 + 1).cast("int"))
    got = lambda c: F.when(key % 7 < 3, F.coalesce(c, F.lit(0))).otherwise(0)
    return feeds.join(lines, key == F.col("l_suppkey"), "left").select(key.cast("string").alias("source_id"), F.col("s_name").alias("outlet"), F.col("r_name").alias("region"), (key % 4 == 0).alias("is_main"), F.concat(F.lit("https://feeds.example/"), key.cast("string")).alias("feed_url"), status.alias("status"), got(F.col("c")).alias("articles_count"), got(F.col("i")).alias("articles_with_image"), got(F.col("b")).alias("articles_with_body"), (key % 900).cast("int").alias("elapsed_ms"), F.lit(None).cast("string").alias("message"))


CHECKS = """ln AS (SELECT l_suppkey, count(*) AS c, count(*) FILTER (l_discount > 0.05) AS i, count(*) FILTER (l_tax > 0.04) AS b FROM lineitem GROUP BY 1),
ck AS (SELECT s_suppkey::VARCHAR AS source_id, s_name AS outlet, r_name AS region, (['success', 'success', 'success', 'empty', 'parse_failed', 'network_failed', 'not_checked'])[s_suppkey % 7 + 1] AS status,
  (CASE WHEN s_suppkey % 7 < 3 THEN coalesce(c, 0) ELSE 0 END)::INT AS articles_count, (CASE WHEN s_suppkey % 7 < 3 THEN coalesce(i, 0) ELSE 0 END)::INT AS articles_with_image, (CASE WHEN s_suppkey % 7 < 3 THEN coalesce(b, 0) ELSE 0 END)::INT AS articles_with_body
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN ln ON l_suppkey = s_suppkey)"""
BUCKET = "CASE status WHEN 'success' THEN 'success' WHEN 'empty' THEN 'empty' WHEN 'not_checked' THEN 'pending' ELSE 'failed' END"


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles, each twice: as it is, and with a tracking parameter, later for even ids."""
    p = read(spark, sf_dir, "pages")
    one = p.select((F.col("page_id") * 2).alias("id"), F.col("url").alias("article_url"), _after(F.col("page_id") * 60).alias("published_at"))
    again = _after(F.col("page_id") * 60 + F.when(F.col("page_id") % 2 == 0, 30).otherwise(0))
    tracked = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("UTM_medium=feed#frag"))
    two = p.select((F.col("page_id") * 2 + 1).alias("id"), tracked.alias("article_url"), again.alias("published_at"))
    rows = one.unionByName(two)
    return rows.withColumn("source_id", urls.host(F.col("article_url"))).withColumns({"pos": F.col("id"), "region": F.element_at(F.split("source_id", r"\."), -1), "outlet_name": F.col("source_id")})


HOST = "regexp_replace(regexp_replace(lower(trim(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))), ':[0-9]*$', ''), '\\.+$', '')"
CANONICAL = """(SELECT lower(CASE WHEN rest = '' THEN base ELSE base || '?' || rest END) FROM (SELECT regexp_replace(regexp_replace({x}, '#.*$', ''), '\\?.*$', '') AS base,
  array_to_string(list_filter(string_split(CASE WHEN contains(regexp_replace({x}, '#.*$', ''), '?') THEN regexp_replace(regexp_replace({x}, '#.*$', ''), '^[^?]*\\?', '') ELSE '' END, '&'),
  lambda p: NOT (lower(regexp_replace(p, '=.*$', '')) IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'))), '&') AS rest) q)"""
PAGE_ARTICLES = f"""pa0 AS (SELECT page_id * 2 AS id, url AS article_url, TIMESTAMP '2024-01-01' + to_seconds(page_id * 60) AS published_at FROM pages
  UNION ALL SELECT page_id * 2 + 1, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'UTM_medium=feed#frag', TIMESTAMP '2024-01-01' + to_seconds(page_id * 60 + CASE WHEN page_id % 2 = 0 THEN 30 ELSE 0 END) FROM pages),
pa AS (SELECT *, {HOST.format(x="article_url")} AS source_id, {CANONICAL.format(x="article_url")} AS canonical, string_split({HOST.format(x="article_url")}, '.')[-1] AS region FROM pa0)"""


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a catalogue of sources: their regions are regions, those with a balance above 5000 are main outlets."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    return rows.select(F.concat(F.lit("s"), key).alias("id"), F.col("s_name").alias("outlet_name"), F.lower("r_name").alias("region"), F.concat(F.lit("https://feeds.example/"), key).alias("feed_url"), (F.col("s_acctbal") > 5000).alias("is_main"), F.lit("en").alias("language"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("note"))


SUPPLIERS = "sup AS (SELECT 's' || s_suppkey AS id, s_name AS outlet_name, lower(r_name) AS region, s_acctbal > 5000 AS is_main FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
