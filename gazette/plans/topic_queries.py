"""Queries over topics, stories and streams, and the flagship pipeline."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, times, urls
from gazette.operators import buckets, dedup, enrich, ranking, topics
from gazette.operators.selection import Preferences
from gazette.plans import pipelines
from gazette.plans.bindings import CATALOGUE, DOCUMENT_ARTICLES, EVENT_ARTICLES, articles_of, as_of, document_articles, event_articles, read
from gazette.sources import catalogue, tables
from gazette.streaming import cache
from gazette.streaming import events as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Add a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
VECTORS = f"""{DOCUMENT_ARTICLES},
tk AS (SELECT id, unnest(list_filter(string_split_regex(lower(strip_accents(coalesce(title, '') || ' ' || coalesce(summary_short, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND NOT (t IN ({STOP})))) AS token FROM dc),
tf AS (SELECT id, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), nn AS (SELECT count(*)::DOUBLE AS n FROM dc),
vw AS (SELECT id, token, tf * (ln(n / df) + 1) AS weight FROM tf JOIN df USING (token), nn)"""


@register(f"WITH {VECTORS} SELECT id, token, round(weight, 6) AS weight FROM vw")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the tokens of titles and summaries."""
    return topics.vectors(document_articles(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@register(f"""WITH {VECTORS}, no AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM vw GROUP BY id)
SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)), 6) AS similarity FROM vw a JOIN vw b ON a.token = b.token AND a.id < b.id JOIN no x ON x.id = a.id JOIN no y ON y.id = b.id
GROUP BY a.id, b.id HAVING sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)) >= 0.3""")
def tfidf_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles with a cosine of 0.3 or more."""
    return topics.similar_pairs(topics.vectors(document_articles(spark, sf_dir))).withColumn("similarity", F.round("similarity", 6))


# articles in turn, newest first; each joins the cluster of its most similar earlier article, equal ones the older cluster
CLUSTERED = f"""{VECTORS.replace("FROM dc)", "FROM tc)", 1).replace("count(*)::DOUBLE AS n FROM dc", "count(*)::DOUBLE AS n FROM tc").replace("tk AS (", "nw AS (SELECT max(published_at) AS now FROM dc), tc AS (SELECT * EXCLUDE (cap) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS cap FROM dc) x, nw WHERE cap <= 20 AND published_at >= now - INTERVAL 1 DAY AND published_at <= now + INTERVAL 300 SECOND), tk AS (", 1)},
no AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM vw GROUP BY id), tn AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS turn FROM tc),
pr AS (SELECT i.turn AS i, j.turn AS j, sum(a.weight * b.weight) / (any_value(x.norm) * any_value(y.norm)) AS sim FROM vw a JOIN vw b USING (token) JOIN tn i ON i.id = a.id JOIN tn j ON j.id = b.id AND j.turn < i.turn JOIN no x ON x.id = a.id JOIN no y ON y.id = b.id GROUP BY 1, 2 HAVING sim >= 0.3),
near AS (SELECT i, list({{'j': j, 'sim': sim}}) AS js FROM pr GROUP BY i), steps AS (SELECT turn, coalesce(js, []) AS js FROM tn LEFT JOIN near ON i = turn),
fold AS (SELECT 0::BIGINT AS turn, []::BIGINT[] AS of UNION ALL SELECT s.turn, list_append(f.of, CASE WHEN len(s.js) = 0 THEN s.turn ELSE list_sort(list_transform(s.js, lambda x: {{'less': -x.sim, 'c': f.of[x.j]}}))[1].c END) FROM fold f JOIN steps s ON s.turn = f.turn + 1),
of AS (SELECT unnest(of) AS c, unnest(range(1, len(of) + 1)) AS turn FROM (SELECT of FROM fold ORDER BY turn DESC LIMIT 1)),
mb AS (SELECT tc.*, NULL::VARCHAR AS hero_image_url, c AS cluster FROM tc JOIN tn USING (id) JOIN of USING (turn))"""
BUILT_OF = """md AS (SELECT *, CASE WHEN hero_image_url IS NULL THEN 2 ELSE 0 END + CASE WHEN source_id IN (SELECT 'src' || k FROM range(0, 20, 4) r(k)) THEN 0 ELSE 1 END AS grade FROM mb),
ld AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY grade, published_at DESC, id) AS k FROM md),
bl AS (SELECT cluster, max(id) FILTER (k = 1) AS lead_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY published_at DESC, id) FILTER (k > 1), '') AS member_ids, count(DISTINCT coalesce(source_id, source_name))::INT AS source_count, count(*) > 1 AS is_aggregated, max(grade) FILTER (k = 1) % 2 AS side, max(published_at) FILTER (k = 1) AS late FROM ld GROUP BY cluster)"""


@register(f"WITH RECURSIVE {CLUSTERED}, {BUILT_OF} SELECT lead_id, member_ids, source_count, is_aggregated, row_number() OVER (ORDER BY source_count DESC, side, late DESC, lead_id)::INT AS pos FROM bl")
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the newest articles, capped by source."""
    articles = document_articles(spark, sf_dir)
    now = articles.agg(F.max("published_at")).first()[0]
    corpus = topics.windowed(ranking.top_by_date(articles, 20), now)
    out = topics.aggregate(corpus, catalogue.sample(spark).where("is_main").select("id"), now)
    return out.withColumn("member_ids", F.array_join("member_ids", ","))


GROUPED = f"""{EVENT_ARTICLES}, nw AS (SELECT max(published_at) AS now FROM ev), rc AS (SELECT ev.* FROM ev, nw WHERE published_at >= now - INTERVAL 1 DAY),
gg AS (SELECT user_id % 15 AS group_pos, event_id AS id FROM events WHERE event_id % 4 = 0), gm AS (SELECT rc.*, 'g' || group_pos AS cluster, count(*) OVER (PARTITION BY group_pos) AS n FROM rc JOIN gg USING (id)),
mb AS (SELECT * EXCLUDE (n) FROM gm WHERE n >= 2 UNION ALL SELECT *, 'a' || id FROM rc WHERE id NOT IN (SELECT id FROM gm WHERE n >= 2))"""
BUILT = """md AS (SELECT *, CASE WHEN hero_image_url IS NULL THEN 2 ELSE 0 END + CASE WHEN source_id IS NOT NULL AND substr(source_id, 4)::INT % 4 = 0 THEN 0 ELSE 1 END AS grade FROM mb),
ld AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY grade, published_at DESC, id) AS k FROM md),
bl AS (SELECT cluster, max(id) FILTER (k = 1) AS lead_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY published_at DESC, id) FILTER (k > 1), '') AS member_ids, count(DISTINCT coalesce(source_id, source_name))::INT AS source_count, count(*) > 1 AS is_aggregated, max(grade) FILTER (k = 1) % 2 AS side, max(published_at) FILTER (k = 1) AS late FROM ld GROUP BY cluster)"""


@register(f"WITH {GROUPED}, {BUILT} SELECT lead_id, member_ids, source_count, is_aggregated, row_number() OVER (ORDER BY source_count DESC, side, late DESC, lead_id)::INT AS pos FROM bl")
def clusters_from_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of given groups of the last day's articles."""
    groups = read(spark, sf_dir, "events").where("event_id % 4 = 0").select((F.col("user_id") % 15).alias("group_pos"), F.col("event_id").alias("id"))
    out = topics.from_groups(groups, event_articles(spark, sf_dir), catalogue.sample(spark).where("is_main").select("id"), as_of(spark, sf_dir))
    return out.withColumn("member_ids", F.array_join("member_ids", ","))


@register(f"""WITH {EVENT_ARTICLES}, mb AS (SELECT *, category || published_at::DATE AS cluster FROM ev), {BUILT}
SELECT lead_id, source_count, is_aggregated, row_number() OVER (ORDER BY source_count DESC, side, late DESC, lead_id)::INT AS pos FROM bl""")
def cluster_lead_and_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads and coverage of clusters by category and day."""
    members = event_articles(spark, sf_dir).withColumn("cluster", F.concat("category", F.to_date("published_at").cast("string")))
    return topics.build(members, catalogue.sample(spark).where("is_main").select("id"), False).select("lead_id", "source_count", "is_aggregated", "pos")


@register("""WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, turn, substr(text, 1, 1200) AS body FROM conversations),
s AS (SELECT conv_id, 0::BIGINT AS k, 10000::BIGINT AS left_over, ''::VARCHAR AS story FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL SELECT s.conv_id, m.k, CASE WHEN left_over > 0 THEN left_over - length('SOURCE: ' || role || chr(10) || 'TITLE: ' || turn || chr(10) || substr(body, 1, left_over)) ELSE left_over END,
    CASE WHEN left_over > 0 THEN story || CASE WHEN s.k > 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || 'SOURCE: ' || role || chr(10) || 'TITLE: ' || turn || chr(10) || substr(body, 1, left_over) ELSE story END
  FROM s JOIN m ON m.conv_id = s.conv_id AND m.k = s.k + 1)
SELECT conv_id AS cluster, arg_max(story, k) AS story FROM s GROUP BY conv_id""")
def story_input_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs for story summaries: conversations as clusters."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cluster"), F.col("turn").alias("place"), F.col("role").alias("source_name"), F.col("turn").cast("string").alias("title"), F.col("text").alias("cleaned_content"), F.lit(None).cast("string").alias("summary_short"))
    return topics.story_input(rows)


@register(f"""WITH {DOCUMENT_ARTICLES} SELECT id, id || chr(9) || substr(regexp_replace(title, '[\\r\\n]+', ' ', 'g'), 1, 140) AS line FROM dc""")
def headline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a provider groups."""
    return document_articles(spark, sf_dir).select("id", text.headline(F.col("id").cast("string"), F.col("title")).alias("line"))


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> tuple[DataFrame, str]:
    """A table as a stream, and a folder for what comes of it. A single file is streamed by a pattern that only its name fits, as
    streams read folders or patterns."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")
    return rows, tables.scratch(spark, "stream")


@register("SELECT event_id, event_type FROM events")
def stream_unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive twice, each kept once within the watermark."""
    rows, folder = event_stream(spark, sf_dir)
    again, _ = event_stream(spark, sf_dir)
    once = stream.unique(rows.unionByName(again), "event_id", "ts")
    stream.run_available(once, lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type")


@register("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1, 2")
def stream_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, kind and day, as a stream over the table, then summed."""
    rows, folder = event_stream(spark, sf_dir)
    first = stream.first_of_day(rows, "ts", ["user_id", "event_type"], "event_id")
    stream.run_available(first, stream.batches(f"{folder}/out"), f"{folder}/state", "update")
    # a day that later batches changed is there once a batch
    days = spark.read.parquet(f"{folder}/out").groupBy("user_id", "event_type", "day").agg(F.min("first").alias("first"))
    return days.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("first.ts").alias("first_ts"))


@register("""SELECT user_id AS reader, max(event_id) AS run, arg_max(ts, event_id) AS saved_at, arg_max(ts, event_id) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) AS expired FROM events GROUP BY user_id""")
def stream_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches of readers as state: a newer run replaces an older one, a superseded run is dropped, and what is twelve hours old ends."""
    rows, folder = event_stream(spark, sf_dir)
    saved = rows.select(F.col("user_id").alias("reader"), F.col("event_id").alias("run"), F.col("ts").alias("saved_at"))
    stream.run_available(cache.kept(saved), stream.batches(f"{folder}/out"), f"{folder}/state", "append", cache.CONF)
    out = spark.read.parquet(f"{folder}/out").groupBy("reader", "run", "saved_at").agg(F.bool_or(F.col("status") == "expired").alias("expired"))
    return out.groupBy("reader").agg(F.max_by(F.struct("run", "saved_at", "expired"), "run").alias("x")).select("reader", "x.run", "x.saved_at", "x.expired")


@register(f"""WITH {DOCUMENT_ARTICLES}, w AS (SELECT *, date_trunc('hour', max(published_at) OVER ()) - INTERVAL 23 HOUR AS since FROM dc),
tk AS (SELECT id, unnest(list_filter(string_split_regex(lower(strip_accents(coalesce(title, '') || ' ' || coalesce(summary_short, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3 AND NOT (t IN ({STOP})))) AS token FROM w WHERE published_at >= since)
SELECT token, count(DISTINCT id) AS df FROM tk GROUP BY token UNION ALL SELECT '' AS token, count(*) AS df FROM w WHERE published_at >= since""")
def stream_pane_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many articles of the last 24 hours each token is, and how many there are (''), added up from panes of an hour that a
    stream keeps."""
    rows, folder = event_stream(spark, sf_dir, "documents")
    stream.run_available(stream.panes(articles_of(rows)), stream.batches(f"{folder}/out"), f"{folder}/state", "update")
    return stream.day_of_panes(spark.read.parquet(f"{folder}/out"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest unique articles, capped by source, as topics with their leads in order of coverage."""
    articles = document_articles(spark, sf_dir).withColumn("article_url", F.concat(F.lit("https://a.example/"), F.md5("cleaned_content"))).withColumns({"region": F.lit("world"), "outlet_name": F.col("source_name")})
    unique = dedup.across_feeds(articles)
    now = articles.agg(F.max("published_at")).first()[0]
    corpus = topics.windowed(ranking.top_by_date(unique, 20), now + timedelta(seconds=1))
    out = topics.aggregate(corpus, catalogue.sample(spark).where("is_main").select("id"), now)
    return out.join(corpus.select(F.col("id").alias("lead_id"), "title", urls.canonical(F.col("article_url")).alias("url")), "lead_id").orderBy("pos")


DAY = f"{EVENT_ARTICLES}, nw AS (SELECT max(published_at) AS now FROM ev), n8 AS (SELECT ev.* FROM ev, nw WHERE published_at >= now - INTERVAL 1 DAY ORDER BY published_at DESC, id LIMIT 800), cp AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS k FROM n8) WHERE k <= 20)"


@register(f"WITH {DAY} SELECT id, source_name FROM cp")
def topic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that topics are made of."""
    return pipelines.topic_corpus(event_articles(spark, sf_dir), as_of(spark, sf_dir), None).select("id", "source_name")


@register(f"""WITH {DAY}, s AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS rnd, row_number() OVER (ORDER BY published_at DESC, id) AS pos2 FROM cp),
f AS (SELECT *, min(pos2) OVER (PARTITION BY coalesce(source_id, source_name)) AS fst FROM s), b AS (SELECT * FROM f ORDER BY rnd, fst LIMIT 100),
p AS (SELECT id, pos2, CASE WHEN contains(title, 'purchase') THEN 'purchase' WHEN contains(title, '7') THEN '7' END AS interest, CASE WHEN contains(title, 'purchase') THEN 40 ELSE 40 * (length(title) - length(replace(title, '7', ''))) END AS relevance, row_number() OVER (ORDER BY rnd, fst) AS o FROM b)
SELECT id, interest, least(100, relevance)::INT AS relevance FROM p WHERE interest IS NOT NULL ORDER BY relevance DESC, o LIMIT 30""")
def for_you_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks for two interests by the local provider."""
    out = pipelines.for_you(event_articles(spark, sf_dir), ["purchase", "7"], as_of(spark, sf_dir), None, enrich.Local())
    return out.select("id", "interest", "relevance")


@register(f"""WITH {GROUPED.replace("FROM ev, nw WHERE published_at >= now - INTERVAL 1 DAY)", "FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS cap FROM (SELECT ev.* FROM ev, nw WHERE published_at >= now - INTERVAL 3 HOUR - INTERVAL 1 DAY ORDER BY published_at DESC, id LIMIT 800)) ev WHERE cap <= 20)").replace("SELECT rc.*,", "SELECT rc.* EXCLUDE (cap),").replace("SELECT *, 'a' || id FROM rc", "SELECT * EXCLUDE (cap), 'a' || id FROM rc")}, {BUILT}
SELECT lead_id, member_ids, source_count, is_aggregated FROM bl""")
def topics_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of groups that were saved three hours ago."""
    now = as_of(spark, sf_dir)
    cache = read(spark, sf_dir, "events").where("event_id % 4 = 0").select((F.col("user_id") % 15).alias("group_pos"), F.col("event_id").alias("id"), times.at(now - timedelta(hours=3)).alias("saved_at"))
    out = pipelines.rehydrated_topics(cache, event_articles(spark, sf_dir), catalogue.sample(spark).where("is_main").select("id"), now, None)
    return out.select("lead_id", F.array_join("member_ids", ",").alias("member_ids"), "source_count", "is_aggregated")


@register(f"""WITH {EVENT_ARTICLES}, nw AS (SELECT max(published_at) AS now FROM ev), cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY published_at DESC, id) AS cap FROM (SELECT ev.* FROM ev, nw WHERE published_at >= now - INTERVAL 3 HOUR - INTERVAL 1 DAY ORDER BY published_at DESC, id LIMIT 800)) x WHERE cap <= 20),
pk AS (SELECT event_id AS id, event_id AS pick_pos, (user_id % 100)::INT AS relevance FROM events WHERE event_id % 5 = 0) SELECT id, relevance, title FROM cp JOIN pk USING (id) ORDER BY relevance DESC, pick_pos LIMIT 30""")
def picks_rehydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks that were saved three hours ago, with their articles."""
    now = as_of(spark, sf_dir)
    saved = times.at(now - timedelta(hours=3)).alias("saved_at")
    cache = read(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("pos"), F.col("event_id").alias("id"), F.lit("x").alias("interest"), (F.col("user_id") % 100).cast("int").alias("relevance"), saved)
    return pipelines.rehydrated_picks(cache, event_articles(spark, sf_dir), now, None).select("id", "relevance", "title")


@register(f"""WITH {EVENT_ARTICLES}, n AS (SELECT * FROM ev ORDER BY published_at DESC, id LIMIT 150),
a AS (SELECT * FROM n WHERE coalesce(source_id, 'src' || right(source_name, 2)::INT) IN (SELECT 'src' || k FROM range(1, 20) r(k) WHERE k % 6 < 2))
SELECT id, (CASE WHEN lower(category) = 'purchase' THEN 3 ELSE 0 END + CASE WHEN lower(language) = 'en' THEN 1 ELSE 0 END)::INT AS score FROM a WHERE lower(source_name) <> 'outlet 01' ORDER BY score DESC, published_at DESC, id LIMIT 50""")
def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown from the store: the newest, those of enabled sources, ranked and cut."""
    allow = catalogue.sample(spark).where("region in ('italy', 'germany') and id <> 'src0'")
    reader = Preferences(preferred_categories=["Purchase"], hidden_sources=["outlet 01"], preferred_language="EN")
    return pipelines.shown(event_articles(spark, sf_dir), reader, allow).select("id", F.col("score").cast("int").alias("score"))


@register(f"""WITH {CATALOGUE}, d AS (SELECT doc_id, md5(text) AS title, outlet_name AS source_name, CASE WHEN regexp_matches(text, '[^\\x00-\\x20]') THEN 'feed_summary' ELSE 'none' END AS content_source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents JOIN cat ON cat.id = source)
SELECT title, source_name, content_source, (CASE WHEN source_name = 'Outlet 03' THEN 4 ELSE 0 END)::INT AS score FROM d WHERE k <= 30 ORDER BY score DESC, doc_id DESC LIMIT 50""")
def home_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh: documents as feed items of their sources, parsed, deduplicated, enriched from pages, ranked."""
    d = read(spark, sf_dir, "documents")
    said = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", " ")  # characters that XML can't hold
    item = F.concat(F.lit("<item><title>"), F.md5("text"), F.lit("</title><link>https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"), F.lit("</link><description><![CDATA["), F.replace(said, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></description><pubDate>"), F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    # a payload holds some two hundred items
    raw = d.groupBy("source", F.floor(F.col("doc_id") / 4000).alias("part")).agg(F.concat_ws("", F.array_sort(F.collect_list(item))).alias("all"))
    raw = raw.select(F.col("source").alias("source_id"), F.concat(F.lit("<rss><channel>"), "all", F.lit("</channel></rss>")).alias("payload"))
    page_table = d.select(F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    new = pipelines.refreshed(raw, catalogue.sample(spark), page_table, Preferences())
    return ranking.rank(new, Preferences(favorite_sources=["outlet 03"]), 50).select("title", "source_name", "content_source", F.col("score").cast("int").alias("score"))


#: As CLUSTERED, over the newest 800 of a day, twenty of a source.
OF_DAY = CLUSTERED.replace("FROM dc) x, nw WHERE cap <= 20", "FROM (SELECT dc.* FROM dc, nw WHERE published_at >= now - INTERVAL 1 DAY ORDER BY published_at DESC, id LIMIT 800) dc) x, nw WHERE cap <= 20")


@register(f"WITH RECURSIVE {OF_DAY}, {BUILT_OF} SELECT lead_id, member_ids, source_count, is_aggregated FROM bl")
def topics_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics where the saved groups are thirteen hours old: made anew."""
    articles = document_articles(spark, sf_dir)
    now = articles.agg(F.max("published_at")).first()[0]
    stale = articles.select((F.col("id") % 15).cast("int").alias("group_pos"), "id", times.at(now - timedelta(hours=13)).alias("saved_at"))
    out = pipelines.topics(stale, articles, catalogue.sample(spark).where("is_main").select("id"), now, None)
    return out.select("lead_id", F.array_join("member_ids", ",").alias("member_ids"), "source_count", "is_aggregated")


@register(rf"""WITH {DAY}, sm AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, id) AS p FROM cp), rr AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, source_name) ORDER BY p) AS k, min(p) OVER (PARTITION BY coalesce(source_id, source_name)) AS f FROM sm),
hd AS (SELECT id, list_sort(list_transform(list_filter(regexp_extract_all(lower(title), '\w{{4,}}'), lambda w: NOT (w IN ({STOP}))), lambda w: {{'n': -length(w), 'w': w}}))[1].w AS word FROM (SELECT * FROM rr ORDER BY k, f LIMIT 100)),
gg AS (SELECT id, word, count(*) OVER (PARTITION BY word) AS n FROM hd WHERE word IS NOT NULL),
mb AS (SELECT cp.*, coalesce('g' || word, 'a' || cp.id) AS cluster FROM cp LEFT JOIN (SELECT * FROM gg WHERE n >= 2) gg ON gg.id = cp.id), {BUILT} SELECT lead_id, member_ids, source_count, is_aggregated FROM bl""")
def topics_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a day's articles by the groups that the local provider makes of a balanced sample."""
    out = pipelines.topics_of_day(event_articles(spark, sf_dir), catalogue.sample(spark).where("is_main").select("id"), as_of(spark, sf_dir), None, enrich.Local())
    return out.select("lead_id", F.array_join("member_ids", ",").alias("member_ids"), "source_count", "is_aggregated")


@register("SELECT event_id % 500 AS id, arg_max(event_type, (ts, event_id)) AS title, max(ts) AS published_at, arg_max(value > 90, (ts, event_id)) AS is_bookmarked FROM events GROUP BY 1")
def stream_store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of articles, events by the remainder of their id, merged batch by batch into a bucketed store."""
    rows, folder = event_stream(spark, sf_dir)
    now = as_of(spark, sf_dir)
    found = rows.select((F.col("event_id") % 500).alias("id"), F.col("event_type").alias("title"), F.col("ts").alias("published_at"), F.lit(None).cast("string").alias("source_id"), (F.col("value") > 90).alias("is_bookmarked"), F.lit(False).alias("is_read"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    stream.run_available(found, stream.merge_into_buckets(f"{folder}/store", now, 8), f"{folder}/state")
    return buckets.load(spark, f"{folder}/store").select("id", "title", "published_at", "is_bookmarked")
