"""URL expressions: canonical form, hosts, image keys, source sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
# Size marks at the end of an image's name.
SIZE_MARK = r"([-_](?:[0-9]{2,4}x[0-9]{2,4}|[0-9]{2,5}w|large|medium|small|mobile|desktop|tablet|thumb|thumbnail|hero|main))+$"
PLACEHOLDER = "https://example.invalid/"


def canonical(url: Column) -> Column:
    """Without fragment and tracking parameters, lower-case; other parameters keep their order. Null and text that isn't a URL
    with a scheme give null."""
    bare = F.regexp_replace(url, "#.*$", "")
    base = F.regexp_replace(bare, r"\?.*$", "")
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    name = lambda p: F.lower(F.regexp_replace(p, "=.*$", ""))
    kept = F.filter(F.split(query, "&"), lambda p: ~name(p).isin(*TRACKING))
    rest = F.array_join(kept, "&")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lower(F.when(rest == "", base).otherwise(F.concat(base, F.lit("?"), rest))))


def host(url: Column) -> Column:
    """The host, normalised."""
    return normal_host(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def normal_host(x: Column) -> Column:
    """Trimmed, lower-case, without port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), ":[0-9]*$", ""), r"\.+$", "")


def host_suffixes(x: Column) -> Column:
    """The host and all of its parents, longest first."""
    parts = F.split(x, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def stable_id(source_id: Column, guid: Column, url: Column, title: Column) -> Column:
    """sha256 of source, guid, canonical URL and lower-case title; nulls count as ''."""
    part = lambda x: F.coalesce(x, F.lit(""))
    return F.sha2(F.concat_ws("|", part(source_id), part(guid), part(canonical(url)), F.lower(part(title))), 256)


def image_key(url: Column) -> Column:
    """An image's name without query, folder, extension and size marks; null when nothing is left."""
    path = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    name = F.lower(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1))
    name = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(name, SIZE_MARK, ""), "@[23]x$", ""), F.lit(""))


def srcset(value: Column) -> Column:
    """The URLs of a source set, in order."""
    return F.filter(F.transform(F.split(value, ","), lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1)), lambda u: u != "")


def undotted(url: Column) -> Column:
    """An absolute URL whose path has no . and .. any more."""
    start, path, rest = (F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    names = F.filter(F.split(path, "/"), lambda x, i: i > 0)
    kept = F.aggregate(names, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    end = F.when(F.element_at(names, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(start, F.lit("/"), F.array_join(kept, "/"), end, rest)).otherwise(url)


def resolve(value: Column, base: Column) -> Column:
    """An absolute http(s) URL of an image or link: as it is; //host and www.host with a scheme; a path against base. Null when
    none fits."""
    x = F.trim(value)
    scheme = F.when(base.rlike("(?i)^http://"), "http").otherwise("https")
    origin = F.regexp_extract(base, r"^(?i)(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    folder = F.when(folder.rlike("^(?i)https?://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    joined = F.when(F.startswith(x, F.lit("/")), F.concat(origin, x)).when(F.startswith(x, F.lit("?")), F.concat(F.regexp_replace(base, r"[?#].*$", ""), x)).otherwise(F.concat(folder, F.regexp_replace(x, r"^(\./)+", "")))
    relative = F.when((origin != "") & ~x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (x != ""), undotted(joined))
    return F.when(x.rlike("(?i)^https?://[^/]"), x).when(F.startswith(x, F.lit("//")), F.concat(scheme, F.lit(":"), x)).when(F.startswith(F.lower(x), F.lit("www.")), F.concat(F.lit("https://"), x)).otherwise(relative)


def article_link(link: Column, feed_url: Column) -> Column:
    """An item's link, else the feed's URL, else a placeholder."""
    absolute = F.when(F.trim(link).rlike("(?i)^https?://"), F.trim(link))
    relative = F.when(F.trim(link) != "", resolve(link, feed_url))
    return F.coalesce(absolute, relative, feed_url, F.lit(PLACEHOLDER))


def first_image(html: Column) -> Column:
    """The src of the first img that has one, quoted or not."""
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<img\s(?:[^>]*?\s)?src\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def hero_image(media: Column, content: Column, summary: Column, article_url: Column, source_url: Column) -> Column:
    """The first of media, content image, summary image that resolves against the article or the source."""
    return F.coalesce(*[F.coalesce(resolve(c, article_url), resolve(c, source_url)) for c in (media, first_image(content), first_image(summary))])
