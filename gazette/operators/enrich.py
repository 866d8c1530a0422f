"""Model functions over articles behind one interface of five; the local provider answers without any network.

A provider's answers are text, as a model's are: they are parsed tolerantly and checked against the input, so any provider
can be put in. Providers run on Arrow batches, answers are read by expressions; what doesn't parse gives null.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import objects, text

CATEGORIES = ("politics", "economy", "world", "technology", "science", "health", "sport", "culture", "other")
LANGUAGES = {"it": "Italian", "en": "English", "de": "German", "fr": "French", "es": "Spanish"}


def language_name(preference: Column, system: Column) -> Column:
    """The language that a summary is asked for: the reader's, or the system's; English where neither is known."""
    chosen = F.lower(F.coalesce(preference, F.lit("system")))
    code = F.lower(F.split(F.when(chosen == "system", system).otherwise(chosen), "[-_]")[0])
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in LANGUAGES.items()], F.lit("English"))


def valid_endpoint(url: Column, local: Column) -> Column:
    """Endpoints take https; a local one takes http too."""
    said = F.trim(url)
    return F.coalesce(said.rlike(r"(?i)^https?://[^/\s]+(?:/\S*)?$") & (local | said.rlike("(?i)^https")), F.lit(False))


class Provider:
    """Five functions from text to a model's answer; one that isn't provided raises."""

    def summarise(self, content: str) -> str:
        raise NotImplementedError("summarise")

    def categorise(self, content: str) -> str:
        raise NotImplementedError("categorise")

    def tags(self, content: str) -> str:
        raise NotImplementedError("tags")

    def group(self, headlines: list[str]) -> str:
        raise NotImplementedError("group")

    def pick(self, interests: list[str], headlines: list[str]) -> str:
        raise NotImplementedError("pick")


class Timeout(Exception):
    """What a provider raises when it can't be reached in time."""


class Retrying(Provider):
    """Another provider, asked once more after a pause when it can't be reached in time; other errors pass."""

    def __init__(self, provider: Provider, pause: float = 2.0):
        self.provider, self.pause = provider, pause

    def _ask(self, name: str, *values) -> str:
        import time

        try:
            return getattr(self.provider, name)(*values)
        except (Timeout, TimeoutError, ConnectionError):
            time.sleep(self.pause)
            return getattr(self.provider, name)(*values)

    def summarise(self, content: str) -> str:
        return self._ask("summarise", content)

    def categorise(self, content: str) -> str:
        return self._ask("categorise", content)

    def tags(self, content: str) -> str:
        return self._ask("tags", content)

    def group(self, headlines: list[str]) -> str:
        return self._ask("group", headlines)

    def pick(self, interests: list[str], headlines: list[str]) -> str:
        return self._ask("pick", interests, headlines)


class Local(Provider):
    """Deterministic answers from word counts."""

    def _words(self, content: str) -> list[str]:
        return [w for w in re.findall(r"\w{4,}", content.lower()) if w not in text.STOP_WORDS]

    def summarise(self, content: str) -> str:
        lines = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", content) if s.strip()]
        return "Here it is: " + json.dumps({"shortSummary": lines[0][:280] if lines else "", "bullets": [s[:140] for s in lines[1:6]] or lines[:1]}, ensure_ascii=False)

    def categorise(self, content: str) -> str:
        low = content.lower()
        counts = {c: low.count(c) for c in CATEGORIES}
        best = max(CATEGORIES, key=lambda c: (counts[c], c == "other"))
        return json.dumps({"category": best})

    def tags(self, content: str) -> str:
        top = sorted(Counter(self._words(content)).items(), key=lambda x: (-x[1], x[0]))[:8]
        return json.dumps({"tags": [w for w, _ in top]}, ensure_ascii=False)

    def group(self, headlines: list[str]) -> str:
        by_word: dict[str, list[str]] = {}
        for h in headlines:
            name, _, title = h.partition("\t")
            for w in sorted(self._words(title), key=lambda w: (-len(w), w))[:1]:
                by_word.setdefault(w, []).append(name)
        return json.dumps({"groups": [ids for _, ids in sorted(by_word.items()) if len(ids) > 1]})

    def pick(self, interests: list[str], headlines: list[str]) -> str:
        found = []
        for h in headlines:
            name, _, title = h.partition("\t")
            for i in interests:
                hits = title.lower().count(i.lower())
                if hits:
                    found.append({"id": name, "interest": i, "relevance": 40 * hits})
                    break
        return json.dumps({"picks": found})


def texts(v: Column, most: int) -> Column:
    """An array's distinct texts that aren't blank, without regard to case, in order; null where there is none."""
    clean = F.transform(objects.listed(v), lambda x: text.collapse(F.coalesce(objects.text_of(x), F.lit(""))))
    found = text.dedup_ordered(clean, most)
    return F.when(F.size(found) > 0, found)


def answered(answer: Column) -> Column:
    """The object of an answer as a variant."""
    return F.try_parse_json(objects.object_in(answer))


def summary(v: Column) -> Column:
    """short and up to five bullets, both needed."""
    short, bullets = text.collapse(objects.text_of(objects.part(v, "shortSummary"))), texts(objects.part(v, "bullets"), 5)
    return F.when((short != "") & bullets.isNotNull(), F.struct(short.alias("short"), bullets.alias("bullets")))


def category(v: Column) -> Column:
    """The category's name."""
    return F.nullif(text.collapse(objects.text_of(objects.part(v, "category"))), F.lit(""))


def tags(v: Column) -> Column:
    """Up to eight."""
    return texts(objects.part(v, "tags"), 8)


def groups(v: Column) -> Column:
    """Arrays of two ids or more."""
    one = lambda g: F.filter(F.transform(objects.listed(g), lambda i: text.trimmed(objects.text_of(i))), lambda i: F.coalesce(i != "", F.lit(False)))
    return F.coalesce(F.filter(F.transform(objects.listed(objects.part(v, "groups")), one), lambda g: F.coalesce(F.size(g) >= 2, F.lit(False))), F.array().cast("array<array<string>>"))


def picks(v: Column) -> Column:
    """id, interest, relevance from 1 to 100; entries without an id or interest go."""

    def one(p):
        r = F.when(objects.kind(objects.part(p, "relevance")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(objects.part(p, "relevance"), "$", "double"))
        return F.struct(text.trimmed(objects.text_of(objects.part(p, "id"))).alias("id"), text.collapse(objects.text_of(objects.part(p, "interest"))).alias("interest"), F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(F.when(r.isNotNull(), F.floor(F.least(r, F.lit(1000.0)))), F.lit(1)))).cast("int").alias("relevance"))

    found = F.transform(objects.listed(objects.part(v, "picks")), one)
    return F.coalesce(F.filter(found, lambda p: F.coalesce((p["id"] != "") & (p["interest"] != ""), F.lit(False))), F.array().cast("array<struct<id:string,interest:string,relevance:int>>"))


def read_answer(spark: SparkSession, answer: str, reader) -> list:
    """One answer, to one question about a bounded list, as reader's rows."""
    return spark.createDataFrame([(answer,)], "answer string").select(answered(F.col("answer")).alias("v")).select(reader(F.col("v")).alias("found")).first()["found"]


def enriched(articles: DataFrame, provider: Provider | None = None) -> DataFrame:
    """id, summary, category, tags of articles (id, cleaned_content, raw_content). Only the provider's own answers come from Python."""
    import pyarrow as pa

    p, names = provider or Local(), ["id", "summary", "category", "tags"]

    def run(batches):
        for batch in batches:
            said = batch.column(1).to_pylist()
            made = [(p.summarise(x), p.categorise(x), p.tags(x)) if x else (None, None, None) for x in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[k] for m in made], pa.string()) for k in range(3)]], names)

    kind = articles.schema["id"].dataType.simpleString()
    asked = articles.select("id", text.summarisation_input(F.col("cleaned_content"), F.col("raw_content")).alias("said"))
    answers = asked.mapInArrow(run, f"id {kind}, summary string, category string, tags string")
    read = answers.select("id", *[answered(F.col(c)).alias(c) for c in names[1:]])  # each answer is read once
    return read.select("id", summary(F.col("summary")).alias("summary"), category(F.col("category")).alias("category"), tags(F.col("tags")).alias("tags"))


def repaired(outputs: DataFrame) -> DataFrame:
    """case_id and the JSON object in each model_output, null where there is none."""
    return outputs.select("case_id", objects.object_in(F.col("model_output")).alias("object"))
