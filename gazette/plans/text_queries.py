"""Queries over texts and pages: expressions, extraction, distilling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import text, urls
from gazette.operators import enrich, pages, ranking
from gazette.plans.bindings import DOCUMENT_ARTICLES, SANITIZED, WORDS, document_articles, read

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


def _hints(x: str, hints: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower({x}), '{h}')" for h in hints)


ENDS = "(suffix(trim({x}), '...') OR suffix(trim({x}), '…') OR suffix(trim({x}), '[…]'))"


@register(f"""WITH w AS (SELECT doc_id, text, {WORDS.format(x="text")} AS words FROM documents)
SELECT doc_id, words::INT AS words, words >= 120 AND NOT ({_hints("text", ("read more", "continue reading"))}) AND NOT {ENDS.format(x="text")} AND NOT (contains(lower(text), 'href') AND contains(lower(text), 'read more')) AS feed_complete,
  words >= 160 AND NOT ({_hints("text", ("read more", "continue reading", "subscribe to continue", "sign in to continue"))}) AND NOT {ENDS.format(x="text")} AS page_complete FROM w""")
def word_count_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, and whether a text would be complete from a feed and from a page."""
    x = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.word_count(x).alias("words"), text.feed_complete(F.lit("feed_content"), x, x).alias("feed_complete"), text.page_complete(x).alias("page_complete"))


@register(f"WITH {DOCUMENT_ARTICLES} SELECT id, summary_short FROM dc")
def summary_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short summaries."""
    return document_articles(spark, sf_dir).select("id", "summary_short")


@register(f"SELECT doc_id, CASE WHEN n >= 40 THEN greatest(1, ceil(n / 220))::INT END AS minutes FROM (SELECT doc_id, {WORDS.format(x='text')} AS n FROM documents)")
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes to read a document."""
    return read(spark, sf_dir, "documents").select("doc_id", text.reading_minutes(text.word_count(F.col("text"))).alias("minutes"))


@register(f"SELECT page_id, {SANITIZED.format(x='html')} AS clean FROM pages")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return read(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("html")).alias("clean"))


PAGE_SIGNS = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#8211;", "-"), ("&#8212;", "-"), ("&#8220;", '"'), ("&#8221;", '"'), ("&amp;", "&")]
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lines(x: str) -> str:
    """A page's lines in SQL."""
    out = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?i)<\\s*br\\s*/?\\s*>', chr(10), 'g'), '(?i)</\\s*(?:p|div|section|article|main|h[1-6]|li|blockquote)\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for entity, sign in PAGE_SIGNS:
        out = "replace({}, '{}', '{}')".format(out, entity, sign.replace("'", "''"))
    return f"array_to_string(list_filter(list_transform(string_split_regex({out}, '\\r\\n|\\r|\\n'), lambda l: trim(regexp_replace(l, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


@register(f"SELECT page_id, {_lines('html')} AS said FROM pages")
def page_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages."""
    return read(spark, sf_dir, "pages").select("page_id", text.page_text(F.col("html")).alias("said"))


@register(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(html, '<a href="/', '<a onclick="x()" href="javascript:/'), '(?i)\son[a-z]+\s*=\s*"[^"]*"', '', 'g'), '(?i)\son[a-z]+\s*=\s*''[^'']*''', '', 'g'),
  '(?i)\s(?:href|src)\s*=\s*"\s*javascript:[^"]*"', '', 'g'), '(?i)\s(?:href|src)\s*=\s*''\s*javascript:[^'']*''', '', 'g'), '(?is)<img\b[^>]*\b(?:width|height)\s*=\s*["'']?1["'']?[^>]*>', '', 'g') AS safe FROM pages""")
def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, given handlers and script addresses, without them again."""
    dirty = F.replace("html", F.lit('<a href="/'), F.lit('<a onclick="x()" href="javascript:/'))
    return read(spark, sf_dir, "pages").select("page_id", text.safe_html(dirty).alias("safe"))


def _bare(x: str) -> str:
    """A page without code, forms and embedded documents, in SQL."""
    for tag in ("script", "style", "noscript", "svg", "canvas", "iframe", "form"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


def _signs(x: str) -> str:
    for entity, sign in PAGE_SIGNS:
        x = "replace({}, '{}', '{}')".format(x, entity, sign.replace("'", "''"))
    return x


_META = "(?:property|name)\\s*=\\s*[''\"](?:og:image|twitter:image|twitter:image:src)[''\"]"


@register(f"""WITH s AS (SELECT page_id, {_bare(f"trim(coalesce(html, ''), {WHITE_SQL})")} AS s FROM pages),
b AS (SELECT *, coalesce(nullif(regexp_extract(s, '(?is)<body\\b[^>]*>(.*?)</body>', 1), ''), s) AS body, list_filter(list_transform(regexp_extract_all(s, '(?is)<article\\b[^>]*>(.*?)</article>', 1) || regexp_extract_all(s, '(?is)<main\\b[^>]*>(.*?)</main>', 1)
  || regexp_extract_all(s, '(?is)<(?:section|div)\\b[^>]*(?:id|class)\\s*=\\s*[''"][^''"]*(?:article|story|post|entry|content|body)[^''"]*[''"][^>]*>(.*?)</(?:section|div)>', 1), lambda x: trim(x, {WHITE_SQL})), lambda x: x <> '') AS found FROM s),
c AS (SELECT page_id, s, body, unnest(found) AS html, unnest(range(len(found))) AS i FROM b), n AS (SELECT *, {WORDS.format(x=f"({_lines('html')})")} AS n FROM c),
o AS (SELECT page_id, arg_max(html, (n, -i)) AS html FROM n GROUP BY page_id), t AS (SELECT b.page_id, s, {_lines('coalesce(o.html, body)')} AS c, {_lines('body')} AS f FROM b LEFT JOIN o USING (page_id)),
w AS (SELECT *, {WORDS.format(x='c')} AS cw, {WORDS.format(x='f')} AS fw, lower(c) AS low FROM t),
u AS (SELECT *, substr(CASE WHEN fw > cw AND fw >= 60 AND (cw < 80 OR (cw < 140 AND fw - cw >= 40) OR (fw >= 2 * cw AND fw - cw >= 100) OR (fw - cw >= 20 AND (low LIKE '%read more%' OR low LIKE '%continue reading%' OR low LIKE '%subscribe to continue%' OR low LIKE '%sign in to continue%' OR low LIKE '%view the full article%'))) THEN f ELSE c END, 1, 250000) AS said FROM w),
k AS (SELECT *, {WORDS.format(x='said')} AS words, lower(said) AS l2 FROM u)
SELECT page_id, said AS cleaned_text, words::INT AS words, words >= 160 AND NOT (l2 LIKE '%read more%' OR l2 LIKE '%continue reading%' OR l2 LIKE '%subscribe to continue%' OR l2 LIKE '%sign in to continue%') AND NOT (said LIKE '%...' OR said LIKE '%…' OR said LIKE '%[…]') AS complete,
  coalesce(nullif({_signs(f"regexp_extract(s, '(?is)<meta\\b[^>]*{_META}[^>]*\\bcontent\\s*=\\s*[''\"]([^''\"]+)[''\"][^>]*>', 1)")}, ''), nullif({_signs(f"regexp_extract(s, '(?is)<meta\\b[^>]*\\bcontent\\s*=\\s*[''\"]([^''\"]+)[''\"][^>]*{_META}[^>]*>', 1)")}, ''),
    nullif({_signs("regexp_extract(s, '(?is)<img\\b[^>]*\\bsrc\\s*=\\s*[''\"]([^''\"]+)[''\"][^>]*>', 1)")}, '')) AS hero FROM k""")
def main_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each page's container, or body."""
    return pages.extracted(read(spark, sf_dir, "pages")).select("page_id", "cleaned_text", "words", "complete", "hero")


MARKS = ("", "-1024x768.JPG?w=1", "_large-800w.webp#x", "@2x.png", "/Hero-thumb_main.jpeg", "/.png")


@register(rf"""WITH u AS (SELECT page_id, url || ([{", ".join(f"'{m}'" for m in MARKS)}])[page_id % 6 + 1] AS url FROM pages),
n AS (SELECT page_id, regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)), '\.[^.]*$', '') AS name FROM u)
SELECT page_id, nullif(regexp_replace(regexp_replace(name, '([-_](?:[0-9]{{2,4}}x[0-9]{{2,4}}|[0-9]{{2,5}}w|large|medium|small|mobile|desktop|tablet|thumb|thumbnail|hero|main))+$', ''), '@[23]x$', ''), '') AS key FROM n""")
def image_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of image addresses that pages' addresses make."""
    url = F.concat("url", F.element_at(F.array(*map(F.lit, MARKS)), (F.col("page_id") % 6 + 1).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", urls.image_key(url).alias("key"))


@register(f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS raw, unnest(range(1, len(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) + 1)) AS i FROM documents),
c AS (SELECT doc_id, {SANITIZED.format(x="raw")} AS v, i FROM t), f AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM c WHERE v <> '' GROUP BY doc_id, lower(v)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT doc_id, coalesce(string_agg(v, '|' ORDER BY i) FILTER (r <= 8), '') AS tags FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def tag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct of a document's words."""
    words = F.split("text", text.WS)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.dedup_ordered(words, 8), "|").alias("tags"))


@register(r"""SELECT page_id, len(regexp_extract_all(html, '[^ \t\n\x0B\f\r]+')) % 200 < 80 AND (regexp_matches(h, '(?i)"isAccessibleForFree"\s*:\s*"?false') OR regexp_matches(h, '(?i)\bsolo\s+per\s+(gli\s+)?abbonati\b') OR regexp_matches(h, '(?i)\briservat[oa]\s+agli\s+abbonati\b') OR regexp_matches(h, '(?i)\babbonati\s+per\s+continuare\b')) AS teaser
FROM (SELECT *, html || (['', '{"isAccessibleForFree" : "False"}', ' Riservato agli abbonati ', ' solo per gli abbonati ', ' abbonatiper continuare '])[page_id % 5 + 1] AS h FROM pages)""")
def paywall_teaser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pages, given marks of a paywall, that are teasers."""
    marked = F.concat("html", F.element_at(F.array(*map(F.lit, ("", '{"isAccessibleForFree" : "False"}', " Riservato agli abbonati ", " solo per gli abbonati ", " abbonatiper continuare "))), (F.col("page_id") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", text.paywalled(marked, F.regexp_count("html", F.lit(r"[^ \t\n\x0B\f\r]+")) % 200).alias("teaser"))


LINKED = "nl AS (SELECT page_id, replace(regexp_replace(html, '<li>(<a [^>]*>[^<]*</a>)</li>', '<p>\\1</p>', 'g'), '<p><b>', '<p>') AS html FROM pages)"


INNER = r"array_to_string(regexp_extract_all(inner_html, '(?is)<a\b[^>]*>(.*?)</a>', 1), ' ')"


@register(rf"""WITH {LINKED}, q AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS inner_html, unnest(range(0, len(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)))) AS pos FROM nl),
s AS (SELECT page_id, pos, {SANITIZED.format(x="inner_html")} AS said, len(regexp_extract_all(inner_html, '(?is)<a\b[^>]*>(.*?)</a>', 1)) AS links, length({SANITIZED.format(x=INNER)}) AS lc FROM q),
o AS (SELECT *, links = 1 AND length(said) > 0 AND lc > 0 AND lc >= length(said) * 0.85 AS single FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - row_number() OVER (PARTITION BY page_id, single ORDER BY pos) AS island FROM o),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id, single, island) AS n FROM i)
SELECT page_id, pos::INT AS pos, said FROM n WHERE NOT (single AND n >= 3)""")
def single_link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages, navigation items among them, without runs of links."""
    html = F.replace(F.regexp_replace("html", "<li>(<a [^>]*>[^<]*</a>)</li>", "<p>$1</p>"), F.lit("<p><b>"), F.lit("<p>"))
    rows = pages.link_paragraphs(read(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return ranking.drop_link_runs(rows).select("page_id", F.col("pos").cast("int").alias("pos"), "said")


@register(f"""WITH d AS (SELECT doc_id, 'Prose of page ' || doc_id || ', that goes on for a while and says some things.' AS said, doc_id % 4 AS kind FROM documents)
SELECT doc_id AS page_id, CASE kind WHEN 0 THEN 'jsonld' WHEN 1 THEN 'readable' WHEN 2 THEN 'fallback' ELSE 'readable' END AS method, CASE kind WHEN 2 THEN 90 WHEN 3 THEN 56 ELSE 140 END::INT AS words,
  CASE kind WHEN 0 THEN rtrim(repeat(said || ' ', 10)) WHEN 1 THEN rtrim(repeat(said || ' ', 10)) WHEN 2 THEN rtrim(repeat('fall ', 90)) ELSE rtrim(repeat(said || ' ', 4)) END AS said, kind = 3 AS paywalled FROM d""")
def distill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four kinds: with a JSON-LD body, with prose among furniture, with too little of it, and of a paywall."""
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    prose = F.concat(F.lit("Prose of page "), n, F.lit(", that goes on for a while and says some things. "))
    several = lambda x, times: F.repeat(x, times)
    menu = "<nav>menu</nav><ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(9)) + "</ul>"
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "articleBody": "'), several(prose, 10), F.lit('"}</script>'))
    body = lambda times: F.concat(F.lit(f"<body>{menu}<div class='share'>share it</div><div>"), several(F.concat(F.lit("<p>"), prose, F.lit("</p>")), times), F.lit(f"<p><a href='/n'>one link</a></p></div>{menu}</body>"))
    html = F.when(k % 4 == 0, F.concat(ld, body(2))).when(k % 4 == 1, body(10)).when(k % 4 == 2, F.lit(f"<body>{menu}<p>Too little.</p></body>")).otherwise(F.concat(body(4), F.lit('{"isAccessibleForFree": false}')))
    fallback = F.when(k % 4 == 2, several(F.lit("fall "), 90)).when(k % 4 == 3, "few words")
    rows = read(spark, sf_dir, "documents").select(k.alias("page_id"), F.lit("https://a.example/").alias("url"), html.alias("html"), fallback.alias("fallback_text"))
    return pages.distilled(rows).select("page_id", "method", "words", F.col("text").alias("said"), "paywalled")


@register(f"""WITH d AS (SELECT doc_id, doc_id % 30 AS old, text, CASE WHEN doc_id % 2 = 0 THEN {_lines("'<p>' || text || '</p>'")} END AS page FROM documents), w AS (SELECT *, {WORDS.format(x="coalesce(page, '')")} AS n FROM d), b AS (SELECT *, n > 0 AND (old = 0 OR n >= old + 15) AS better FROM w)
SELECT doc_id AS id, CASE WHEN better THEN 'article_page' ELSE 'feed_summary' END AS content_source, CASE WHEN better THEN n ELSE old END::INT AS content_word_count, CASE WHEN better THEN page ELSE 'old' END AS cleaned_content FROM b""")
def page_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles after their pages were read, which every second one has."""
    d = read(spark, sf_dir, "documents")
    url, none = F.concat(F.lit("https://a.example/"), F.col("doc_id").cast("string")), F.lit(None).cast("string")
    articles = d.select(
        F.col("doc_id").alias("id"), url.alias("article_url"), F.lit("feed_summary").alias("content_source"), (F.col("doc_id") % 30).cast("int").alias("content_word_count"), F.lit(False).alias("is_content_likely_complete"),
        none.alias("raw_content"), F.lit("old").alias("cleaned_content"), none.alias("hero_image_url"), none.alias("summary_short"),
    )
    page_table = d.where("doc_id % 2 = 0").select(url.alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    return pages.enriched(articles, page_table).select("id", "content_source", "content_word_count", "cleaned_content")


@register(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN trim(html, {WHITE_SQL}) END AS body, CASE WHEN page_id % 3 = 0 THEN 'h' END AS headline, CASE WHEN page_id % 3 = 0 THEN false END AS is_free FROM pages")
def jsonld_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD articles of pages, a third of which are given one."""
    article = F.struct(F.array(F.lit("NewsArticle")).alias("@type"), F.lit("h").alias("headline"), F.lit("False").alias("isAccessibleForFree"), F.col("html").alias("articleBody"))
    # the body's own end tags don't end the script
    said = F.replace(F.to_json(F.struct(F.array(article).alias("@graph"))), F.lit("</"), F.lit("<\\/"))
    body = F.concat(F.lit('<script type="application/ld+json">'), said, F.lit("</script>"))
    given = F.concat("html", F.when(F.col("page_id") % 3 == 0, body).otherwise(""))
    return pages.jsonld_articles(read(spark, sf_dir, "pages").select("page_id", given.alias("html")))


@register("""SELECT doc_id AS case_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '{"n": ' || doc_id || '}' END AS object FROM documents""")
def llm_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects from answers in prose, with a trailing comma, cut off, and without one."""
    n = F.col("doc_id").cast("string")
    said = F.element_at(F.array(F.concat(F.lit('Sure: {"n": '), n, F.lit("} done")), F.concat(F.lit('```json\n{"n": '), n, F.lit(",}\n```")), F.concat(F.lit('a } brace {"n": '), n, F.lit("}")), F.lit("nothing here")), (F.col("doc_id") % 4 + 1).cast("int"))
    found = enrich.repaired(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), said.alias("model_output")))
    return found.withColumn("object", F.when(F.col("object").isNotNull(), F.concat(F.lit('{"n": '), F.get_json_object("object", "$.n"), F.lit("}"))))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@register(rf"""WITH d AS (SELECT doc_id AS id, nullif(trim(text, {WHITE_SQL}), '') AS said FROM documents),
l AS (SELECT id, lower(said) AS low, list_filter(list_transform(string_split(regexp_replace(regexp_replace(said, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x, {WHITE_SQL})), lambda x: x <> '') AS ls FROM d),
b AS (SELECT *, regexp_replace(trim(substr(ls[1], 1, 280), {WHITE_SQL}), '\s+', ' ', 'g') AS first, len(list_distinct(list_transform(CASE WHEN len(ls) > 1 THEN list_transform(ls[2:6], lambda x: substr(x, 1, 140)) ELSE ls[1:1] END, lambda x: lower(regexp_replace(trim(x, {WHITE_SQL}), '\s+', ' ', 'g'))))) AS n FROM l),
w AS (SELECT id, unnest(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]{{4,}}')) AS w FROM l), k AS (SELECT id, w, count(*) AS c FROM w WHERE w NOT IN ({_STOP}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, w) AS pl FROM k),
t AS (SELECT id, string_agg(w, ',' ORDER BY pl) AS tags FROM r WHERE pl <= 8 GROUP BY id),
g AS (SELECT id, c.i, c.name, (length(low) - length(replace(low, c.name, ''))) // length(c.name) AS hits FROM l, (VALUES (1, 'politics'), (2, 'economy'), (3, 'world'), (4, 'technology'), (5, 'science'), (6, 'health'), (7, 'sport'), (8, 'culture'), (9, 'other')) c(i, name) WHERE low IS NOT NULL),
e AS (SELECT id, name AS category, row_number() OVER (PARTITION BY id ORDER BY hits DESC, name = 'other' DESC, i) AS pl FROM g)
SELECT b.id, CASE WHEN first <> '' AND n > 0 THEN first END AS short, CASE WHEN first <> '' AND n > 0 THEN n END::INT AS bullets, category, tags FROM b LEFT JOIN t USING (id) LEFT JOIN (SELECT id, category FROM e WHERE pl = 1) q USING (id)""")
def ai_enrich_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary, category and tags of documents by the local provider."""
    rows = enrich.enriched(document_articles(spark, sf_dir))
    return rows.select("id", "summary.short", F.size("summary.bullets").alias("bullets"), "category", F.array_join("tags", ",").alias("tags"))
