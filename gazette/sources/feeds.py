"""Feed payloads to items, and items to articles.

Payloads land as rows (source_id, fetched_at, payload), by whatever fetched them; parsing runs where Spark dealt them. A
payload that isn't XML gives no items and the status parse_failed.
"""

from __future__ import annotations

import io
import xml.sax
import xml.sax.handler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import text, urls
from gazette.schemas import FEED_ITEMS

#: Element names, lower-case with prefix, that fill a field; the first value that isn't blank stays.
FIELDS = {
    "title": ("title",), "guid": ("guid", "id"), "summary": ("description", "summary"), "content": ("content:encoded", "content", "body", "xhtml:body", "fulltext"),
    "published_at_raw": ("pubdate", "published", "updated", "dc:date"), "author": ("author", "dc:creator", "name"), "language": ("language", "dc:language"),
}
FIELD_OF = {e: f for f, names in FIELDS.items() for e in names}
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".bmp", ".svg")


class _Items(xml.sax.handler.ContentHandler):
    """Collects the items of RSS and the entries of Atom."""

    def __init__(self):
        self.items: list[dict] = []
        self.item: dict | None = None
        self.path: list[str] = []
        self.said: list[str] = []
        self.language: str | None = None

    def startElement(self, name, attrs):  # noqa: N802
        tag = name.lower()
        self.path.append(tag)
        self.said = []
        if tag in ("item", "entry"):
            self.item = {"categories": [], "links": []}
        if self.item is None:
            return
        a = {k.lower(): v for k, v in attrs.items()}
        if tag == "link" and a.get("href"):
            self.item["links"].append((a.get("rel", "alternate").lower(), a["href"].strip()))
        elif tag == "category" and a.get("term"):
            self.item["categories"].append(a["term"].strip())
        elif tag in ("enclosure", "media:content", "media:thumbnail") and a.get("url") and _is_image(tag, a):
            self.item.setdefault("image_url", a["url"].strip())
        elif tag == "itunes:image" and a.get("href"):
            self.item.setdefault("image_url", a["href"].strip())

    def characters(self, content):
        self.said.append(content)

    def endElement(self, name):  # noqa: N802
        tag, value = name.lower(), "".join(self.said).strip()
        self.said = []
        self.path.pop()
        if self.item is None:
            if tag == "language" and value:
                self.language = self.language or value
            return
        if tag in ("item", "entry"):
            self.items.append(self.item)
            self.item = None
        elif tag == "link" and value:
            self.item["links"].append(("text", value))
        elif tag == "category" and value:
            self.item["categories"].append(value)
        elif tag == "url" and value and self.path[-1:] == ["image"]:
            self.item.setdefault("image_url", value)
        elif tag in FIELD_OF and value and not (tag == "name" and self.path[-1:] != ["author"]):
            self.item.setdefault(FIELD_OF[tag], value)


def _is_image(tag: str, a: dict[str, str]) -> bool:
    """A declared type decides, then the medium, then the name's ending; a thumbnail is an image."""
    if tag == "media:thumbnail":
        return True
    if a.get("type"):
        return a["type"].lower().startswith("image/")
    if a.get("medium"):
        return a["medium"].lower() == "image"
    return a["url"].split("?")[0].lower().endswith(IMAGE_ENDINGS)


def _link(links: list[tuple[str, str]]) -> str | None:
    for wanted in ("text", "alternate", "self"):
        for rel, href in links:
            if rel == wanted:
                return href
    return links[0][1] if links else None


def parse(payload: str | bytes) -> list[dict]:
    """Items of a feed in order; raises xml.sax.SAXException when it isn't XML. Items without anything in them are left out."""
    handler = _Items()
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    reader.parse(io.BytesIO(payload.encode() if isinstance(payload, str) else payload))
    out = []
    for item in handler.items:
        row = {f: item.get(f) for f in (*FIELDS, "image_url")}
        row |= {"link": _link(item["links"]), "categories": item["categories"], "language": row["language"] or handler.language}
        if any((row[f] or "").strip() for f in ("title", "link", "summary", "content", "guid", "published_at_raw", "author")):
            out.append(row)
    return out


def items(raw: DataFrame) -> DataFrame:
    """FEED_ITEMS and the status of every payload: success, empty or parse_failed. A payload without items has one row of
    pos null."""
    import pyarrow as pa

    names = ["source_id", "pos", "title", "link", "summary", "content", "published_at_raw", "categories", "language", "guid", "author", "image_url", "status"]

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):  # a payload at a time is read, and gone before the next
                source, payload = (batch.column(c)[k].as_py() for c in range(2))
                try:
                    found = parse(payload or "")
                    status = "success" if found else "empty"
                except xml.sax.SAXException:
                    found, status = [], "parse_failed"
                rows = [{**r, "source_id": source, "pos": k, "status": status} for k, r in enumerate(found)] or [{"source_id": source, "status": status}]
                columns = [[r.get(n) for r in rows] for n in names]
                kinds = {"pos": pa.int32(), "categories": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)

    return raw.select("source_id", "payload").mapInArrow(run, FEED_ITEMS + ", status STRING")


def landed(raw: DataFrame) -> DataFrame:
    """Landed payloads (source_id, url, http_status, body) with payload and fetch_status: success, insecure_url, http_status or
    empty_response, the first that applies; a payload only with success."""
    status = (
        F.when(~F.startswith(F.lower(F.coalesce("url", F.lit(""))), F.lit("https://")), "insecure_url").when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "http_status")
        .when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty_response").otherwise("success")
    )
    rows = raw.withColumn("fetch_status", status)
    return rows.withColumn("payload", F.when(F.col("fetch_status") == "success", F.col("body").cast("string"))).drop("body")


def articles(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Articles of items (pos not null) of catalogue sources, before deduplication. Items without any title are left out."""
    s = catalogue.select(F.col("id").alias("s_id"), F.col("outlet_name").alias("s_name"), F.col("feed_url").alias("s_url"), F.col("language").alias("s_language"), F.col("tags").alias("s_tags"), "region")
    rows = found.where("pos is not null").join(s, F.col("source_id") == F.col("s_id"))
    title = text.feed_title(F.col("title"), F.col("summary"), F.col("content"), F.col("link"), F.col("s_name"))
    raw, source = text.content_choice(F.col("content"), F.col("summary"))
    link = urls.article_link(F.col("link"), F.col("s_url"))
    rows = rows.withColumns({"_title": title, "_raw": raw, "_from": source, "_link": link, "_clean": text.sanitize(raw)})
    tags = text.dedup_ordered(F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.coalesce("s_tags", F.array().cast("array<string>"))), 8)
    return rows.where("_title is not null").select(
        urls.stable_id(F.col("source_id"), F.col("guid"), F.col("_link"), F.col("_title")).alias("id"), text.optional(F.col("guid")).alias("external_id"), F.col("_title").alias("title"), F.col("s_name").alias("source_name"), "source_id",
        F.coalesce("s_url", F.concat(F.lit(urls.PLACEHOLDER), F.col("source_id"))).alias("source_url"), F.col("_link").alias("article_url"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.feed_date(F.col("published_at_raw")).cast("timestamp_ntz")).alias("published_at"), text.optional(F.col("author")).alias("author_name"),
        urls.hero_image(text.optional(F.col("image_url")), F.col("content"), F.col("summary"), F.col("_link"), F.col("s_url")).alias("hero_image_url"), F.col("_raw").alias("raw_content"), F.col("_clean").alias("cleaned_content"), F.col("_from").alias("content_source"),
        text.word_count(F.col("_clean")).alias("content_word_count"), text.feed_complete(F.col("_from"), F.col("_raw"), F.col("_clean")).alias("is_content_likely_complete"), text.feed_summary(F.col("summary"), F.col("_clean")).alias("summary_short"),
        F.element_at(F.when(F.size(tags) > 0, tags), 1).alias("category"), tags.alias("tags"), F.coalesce("language", "s_language").alias("language"), "pos", "region", F.col("s_name").alias("outlet_name"),
    )
