"""Pages to articles: containers and heroes, distilling and blocks, by expressions over texts and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import distill, text, urls
from gazette.operators import elements, linked_data
from gazette.sources import rules as rule_table
from gazette.sources.tables import materialize

# What is cut from pages, where the article may be, where its image may be.
NON_CONTENT = r"(?is)<(script|style|noscript|svg|canvas|iframe|form)[^>]*>.*?</\1>"
ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article>"
MAIN = r"(?is)<main\b[^>]*>(.*?)</main>"
KEYWORD = r"(?is)<(?:section|div)\b[^>]*(?:id|class)\s*=\s*['\"][^'\"]*(?:article|story|post|entry|content|body)[^'\"]*['\"][^>]*>(.*?)</(?:section|div)>"
BODY = r"(?is)<body\b[^>]*>(.*?)</body>"
HERO = (
    r"(?is)<meta\b[^>]*(?:property|name)\s*=\s*['\"](?:og:image|twitter:image|twitter:image:src)['\"][^>]*\bcontent\s*=\s*['\"]([^'\"]+)['\"][^>]*>",
    r"(?is)<meta\b[^>]*\bcontent\s*=\s*['\"]([^'\"]+)['\"][^>]*(?:property|name)\s*=\s*['\"](?:og:image|twitter:image|twitter:image:src)['\"][^>]*>",
    r"(?is)<img\b[^>]*\bsrc\s*=\s*['\"]([^'\"]+)['\"][^>]*>",
)
MOST_BYTES = 2_000_000


#: The signs of windows-1252 where latin-1 has control characters; five places stay as they are.
CONTROLS, SIGNS = ("".join(x) for x in zip(*[(chr(k), bytes([k]).decode("cp1252")) for k in range(0x80, 0xA0) if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)], strict=True))


def decoded(body: Column, charset: Column) -> Column:
    """Bytes of a page as text: a declared utf-8 where it is valid, a declared latin-1 or windows-1252, else utf-8 where it is
    valid, else latin-1; more than MOST_BYTES give null."""
    name, latin, utf8 = F.lower(F.coalesce(charset, F.lit(""))), F.decode(body, "ISO-8859-1"), F.try_validate_utf8(body.cast("string"))
    declared = F.when(F.contains(name, F.lit("utf-8")) & utf8.isNotNull(), utf8).when(name.rlike("iso-8859-1|latin-?1"), latin).when(name.rlike("windows-1252|cp1252"), F.translate(latin, CONTROLS, SIGNS))
    return F.when(F.octet_length(body) <= MOST_BYTES, F.coalesce(declared, utf8, latin))


def landed(pages: DataFrame) -> DataFrame:
    """Landed pages (url, http_status, content_type, body) with html and status: success, insecure_transport,
    http_status, non_html, empty_response or payload_too_large. The first that applies, in this order; html only with success.
    The charset is the content type's."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    status = (
        F.when(~F.startswith(F.lower(F.coalesce("url", F.lit(""))), F.lit("https://")), "insecure_transport").when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "http_status")
        .when((kind != "") & ~kind.rlike("text/html|application/xhtml"), "non_html").when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty_response").when(F.octet_length("body") > MOST_BYTES, "payload_too_large").otherwise("success")
    )
    rows = pages.withColumn("status", status)
    return rows.withColumn("html", F.when(F.col("status") == "success", decoded(F.col("body"), kind))).drop("body")


def without_code(html: Column) -> Column:
    """Without scripts, styles, forms and embedded documents."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), NON_CONTENT, " ")


def extracted(pages: DataFrame) -> DataFrame:
    """pages with raw_html, cleaned_text, hero, words, complete: the container with most words, or the body where that is
    better."""
    rows = pages.withColumn("_s", without_code(text.trimmed(F.col("html"))))
    body = F.nullif(F.regexp_extract("_s", BODY, 1), F.lit(""))
    found = F.concat(*[F.regexp_extract_all("_s", F.lit(p), F.lit(1)) for p in (ARTICLE, MAIN, KEYWORD)])
    rows = rows.withColumn("_body", F.coalesce(body, "_s")).withColumn("_found", F.filter(F.transform(found, text.trimmed), lambda x: x != ""))
    # each candidate's text is made once, and the body's once
    said = F.transform("_found", lambda x: F.struct(x.alias("html"), text.page_text(x).alias("said")))
    rows = rows.withColumn("_said", said).withColumn("_f", text.page_text(F.col("_body")))
    rows = rows.withColumn("_all", F.transform("_said", lambda x: F.struct(text.word_count(x["said"]).alias("n"), x["html"].alias("html"), x["said"].alias("said"))))
    rows = rows.withColumn("_most", F.array_max(F.transform("_all", lambda x: x["n"])))
    rows = rows.withColumn("_best", F.get(F.filter("_all", lambda x: x["n"] == F.col("_most")), 0))
    rows = rows.withColumn("_one", F.coalesce("_best.html", "_body")).withColumn("_c", F.coalesce("_best.said", "_f"))
    rows = rows.withColumn("_use", text.prefer_fallback(text.word_count(F.col("_c")), text.word_count(F.col("_f")), F.col("_c")))
    clean = F.when(F.col("_use"), F.col("_f")).otherwise(F.col("_c"))
    hero = F.coalesce(*[F.nullif(text.decode(F.regexp_extract("_s", p, 1), True), F.lit("")) for p in HERO])
    out = rows.withColumns({"raw_html": text.clip(F.when(F.col("_use"), F.col("_body")).otherwise(F.col("_one"))), "cleaned_text": text.clip(clean), "hero": hero})
    return out.withColumns({"words": text.word_count(F.col("cleaned_text")), "complete": text.page_complete(F.col("cleaned_text"))}).drop("_s", "_body", "_found", "_said", "_all", "_most", "_best", "_one", "_c", "_f", "_use")


def enriched(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles with the text of their pages (url, html) where it is better; others as they are. Only eligible articles meet
    pages."""
    eligible = text.wants_enrichment(F.col("article_url"), F.col("content_source"), F.col("content_word_count"), F.col("is_content_likely_complete"))
    wanted = articles.where(eligible).select(F.col("article_url").alias("url")).distinct()
    got = extracted(pages.join(wanted, "url", "left_semi").select("url", "html")).select(F.col("url").alias("_url"), "raw_html", "cleaned_text", "hero", "words", "complete")
    rows = articles.withColumn("_e", eligible).join(got, F.col("_e") & (F.col("article_url") == F.col("_url")), "left")
    better = F.coalesce(text.replace_content(F.col("words"), F.col("content_word_count"), F.col("content_source"), F.col("is_content_likely_complete")), F.lit(False))
    changed = {
        "raw_content": "raw_html", "cleaned_content": "cleaned_text", "content_word_count": "words", "is_content_likely_complete": "complete",
    }
    new = {k: F.when(better, F.col(v)).otherwise(F.col(k)) for k, v in changed.items()}
    new |= {"content_source": F.when(better, "article_page").otherwise(F.col("content_source")), "hero_image_url": F.when(better, F.coalesce("hero_image_url", urls.resolve(F.col("hero"), F.col("article_url")))).otherwise(F.col("hero_image_url")), "summary_short": F.when(better, text.page_summary(F.col("summary_short"), F.col("cleaned_text"))).otherwise(F.col("summary_short"))}
    return rows.withColumns(new).select(*articles.columns)


def words(said: Column) -> Column:
    return F.coalesce(F.regexp_count(said, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("int")


def cleaned(rows: DataFrame, language: bool = True, hero: bool = True) -> DataFrame:
    """Elements of articles without furniture, link lists, runs of links, short lines, the hero and lines that sites add."""
    rows = elements.without_furniture(rows, distill.CHROME, distill.NAMED)
    rows = elements.without_short(elements.without_links(rows))
    rows = elements.without_hero(rows) if hero else rows
    return elements.without_site_lines(rows, distill.SITE_LINES) if language else rows


def distilled(pages: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """page_id, html, text, words, method (jsonld, readable, fallback, none), paywalled and version of the article in each of pages
    (page_id, which tells them apart, url, html, and, where they have them, language, fallback_text, hero_url). An article in JSON-LD
    of 80 words or more is taken as it is; else the outlet's rule, the best container, the end of the article and the cleaning steps
    apply, in this order, all over one table of elements. A text under 80 words gives way to the fallback text where that has more."""
    known, given = rules or [], set(pages.columns)
    rows = pages.withColumns({c: F.lit(None).cast("string") for c in ("language", "fallback_text", "hero_url") if c not in given})
    rows = rows.withColumn("host", urls.host(F.col("url")))
    rows = rule_table.for_hosts(rows, rule_table.table(pages.sparkSession, known)) if known else rows.withColumn("rule_id", F.lit(None).cast("string"))
    rows = rows.select("page_id", "html", "fallback_text", "language", "hero_url", "rule_id")
    nodes = linked_data.articles(rows).where(words(F.col("body")) >= distill.LEAST_WORDS)
    lines = F.filter(F.transform(F.split("body", "\n"), text.trimmed), lambda x: x != "")
    fast = nodes.select("page_id", F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), elements.escaped(x), F.lit("</p>"))), "\n").alias("html"), F.array_join(lines, "\n").alias("said"), words(F.col("body")).alias("words"), F.lit("jsonld").alias("method"))
    fast = materialize(fast, "jsonld")
    rest = rows.join(fast.select("page_id"), "page_id", "left_anti").withColumn("html", text.safe_html(F.col("html")))
    found = elements.ruled(elements.table(rest, "language", "hero_url", "rule_id"), known)
    found = elements.containers(elements.without(found, elements.is_tag(*distill.CHROME)))
    found = elements.up_to_terminator(found, text.TERMINATORS) if "language" in given else found
    read = elements.rendered(cleaned(found, "language" in given, "hero_url" in given))
    read = read.select("page_id", "html", "said", words(F.col("said")).alias("words"), F.lit("readable").alias("method"))
    # whole texts: never broadcast, however small the tables that they are made of look to the planner
    out = rows.withColumnRenamed("html", "page").join(fast.unionByName(read).hint("merge"), "page_id", "left").withColumn("words", F.coalesce("words", F.lit(0)))
    short, more = F.col("words") < distill.LEAST_WORDS, words(F.col("fallback_text")) > F.col("words")
    marks = text.paywalled(F.coalesce("page", F.lit("")), F.col("words"))
    for r in known:
        for m in r["paywall_markers"]:
            marks = marks | (short & F.coalesce((F.col("rule_id") == r["id"]) & F.col("page").rlike(f"(?i){m}"), F.lit(False)))
    use = short & more
    return out.select(
        "page_id", F.when(~use, F.col("html")).alias("html"), F.when(use, text.trimmed(F.col("fallback_text"))).otherwise(F.coalesce("said", F.lit(""))).alias("text"), F.when(use, words(F.col("fallback_text"))).otherwise(F.col("words")).alias("words"),
        F.when(use, "fallback").otherwise(F.coalesce("method", F.lit("none"))).alias("method"), marks.alias("paywalled"), F.lit(distill.VERSION).alias("version"),
    )


def stale(articles: DataFrame) -> DataFrame:
    """Articles that an older distiller, or none, has seen."""
    return articles.where(F.coalesce("distiller_version", F.lit(0)) < distill.VERSION)


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, pos and typed blocks of pages (page_id, url, html)."""
    return elements.blocks(elements.table(pages, "url"))


def link_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, pos, said, chars, links, link_chars of the paragraphs of pages, by expressions; for ranking.drop_link_runs."""
    inner = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(inner).alias("pos", "inner"))
    linked = F.regexp_extract_all("inner", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    said = text.sanitize(F.col("inner"))
    return rows.select("page_id", "pos", said.alias("said"), F.length(said).alias("chars"), F.size(linked).alias("links"), F.length(text.sanitize(F.array_join(linked, " "))).alias("link_chars"))


def jsonld_articles(pages: DataFrame) -> DataFrame:
    """page_id, body, headline, is_free of pages with a JSON-LD article; others have none of them."""
    return linked_data.articles(pages)
