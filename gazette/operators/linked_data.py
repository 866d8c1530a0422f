"""Articles in pages' JSON-LD, as variants: each round looks at one level of all pages' nodes and explodes it into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions.objects import kind, listed, part, text_of
from gazette.sources.tables import materialize

SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
#: Comment and CDATA marks around a script's text.
WRAP = r"(?s)^\s*(?:<!--|//\s*<!\[CDATA\[|<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/)|(?:-->|//\s*\]\]>|\]\]>|/\*\s*\]\]>\s*\*/)\s*$"


def truth(v: Column) -> Column:
    """Booleans, numbers, their names, and schema.org addresses of them; null for others."""
    name = F.regexp_extract(F.rtrim(F.lower(F.trim(text_of(v))), F.lit("/")), "([^/]*)$", 1)
    said = F.when(name.isin("true", "1", "yes"), True).when(name.isin("false", "0", "no"), False)
    number = F.try_variant_get(v, "$", "double")
    return F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind(v) == "STRING", said).when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number != 0)


def is_article(v: Column) -> Column:
    """Its type, or one of them, ends with Article or is BlogPosting."""
    kinds = part(v, "@type")
    several = F.coalesce(F.transform(listed(kinds), text_of), F.array(text_of(kinds)))
    return F.coalesce(F.exists(several, lambda k: F.coalesce(F.endswith(k, F.lit("Article")) | (k == "BlogPosting"), F.lit(False))), F.lit(False))


def parsed(said: Column) -> Column:
    """A script's text as a variant, null where it can't be read; line breaks in strings, which JSON forbids, are read as spaces."""
    bare = F.regexp_replace(F.regexp_replace(said, WRAP, ""), WRAP, "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_replace(bare, r"[\x00-\x1F]", " ")))


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, path and v: the scripts of pages (page_id, html), which nodes begin with. A path orders nodes of a page: one before
    those in it, elements of a list by place, fields of an object by name."""
    found = pages.where(F.contains("html", F.lit("ld+json"))).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("i", "said"))
    return found.select("page_id", F.array(F.struct(F.col("i"), F.lit("").alias("name"))).alias("path"), parsed(F.col("said")).alias("v")).where("v is not null")


def below(found: DataFrame) -> DataFrame:
    """The next level of nodes: what lists and objects hold, but for an article's text."""
    lists = found.where(kind(F.col("v")) == "ARRAY").select("page_id", "path", F.posexplode(listed(F.col("v"))).alias("i", "w")).withColumn("name", F.lit(""))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    objects = found.where(kind(F.col("v")) == "OBJECT").select("page_id", "path", F.explode(fields).alias("name", "w")).where("name <> 'articleBody'").withColumn("i", F.lit(0))
    both = lists.unionByName(objects)
    return both.where(kind(F.col("w")).isin("ARRAY", "OBJECT")).select("page_id", F.concat("path", F.array(F.struct("i", "name"))).alias("path"), F.col("w").alias("v"))


def articles(pages: DataFrame) -> DataFrame:
    """page_id, body, headline, is_free of every page of pages: of the first node that is an article with a body that isn't blank;
    nulls where there is none. Scripts that can't be read are skipped. There are as many rounds as levels."""
    level, found = nodes(pages), None
    body = F.trim(text_of(part(F.col("v"), "articleBody")), F.lit(" \t\n\x0b\x0c\r"))
    while True:
        level = materialize(level.withColumn("hit", (kind(F.col("v")) == "OBJECT") & is_article(F.col("v")) & F.coalesce(body != "", F.lit(False))), "nodes")
        if level.isEmpty():
            break
        hits = level.where("hit").select("page_id", "path", body.alias("body"), text_of(part(F.col("v"), "headline")).alias("headline"), truth(part(F.col("v"), "isAccessibleForFree")).alias("is_free"))
        found = hits if found is None else found.unionByName(hits)
        level = below(level.where("not hit"))
    if found is None:
        return pages.select("page_id", F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("headline"), F.lit(None).cast("boolean").alias("is_free"))
    # texts in variants look small to the planner, which would send all of them through the driver to every task: a merge join doesn't
    first = found.groupBy("page_id").agg(F.min_by(F.struct("body", "headline", "is_free"), "path").alias("a")).hint("merge")
    return pages.select("page_id").join(first, "page_id", "left").select("page_id", "a.body", "a.headline", "a.is_free")
