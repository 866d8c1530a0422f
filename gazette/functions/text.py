"""Text expressions over columns: sanitising, word counts, summaries, completeness, tokens. All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded in feed text, and in pages besides.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]
PAGE_ENTITIES = [("&#8211;", "-"), ("&#8212;", "-"), ("&#8220;", '"'), ("&#8221;", '"')]
WHITE = " \t\n\x0B\f\r"
WS = r"[ \t\n\x0B\f\r]+"
# Phrases that say a text goes on elsewhere.
FEED_HINTS = ("read more", "continue reading")
PAGE_HINTS = (*FEED_HINTS, "subscribe to continue", "sign in to continue")
FALLBACK_HINTS = (*PAGE_HINTS, "view the full article")
# Event handlers, script addresses and images of one pixel, which are stripped from markup.
UNSAFE = (
    r"(?i)\son[a-z]+\s*=\s*\"[^\"]*\"",
    r"(?i)\son[a-z]+\s*=\s*'[^']*'",
    r"(?i)\s(?:href|src)\s*=\s*\"\s*javascript:[^\"]*\"",
    r"(?i)\s(?:href|src)\s*=\s*'\s*javascript:[^']*'",
    r"(?is)<img\b[^>]*\b(?:width|height)\s*=\s*[\"']?1[\"']?[^>]*>",
)
#: Words that carry no topic, of the languages that sources have most.
STOP_WORDS = tuple(sorted(set("""
about after all also and any are been but can could did does for from had has have her him his how into its just may more most not now off one only other our out over said she should some
such than that the their them then there these they this those through too two under until very was were what when where which while who why will with would you your
aber als auch auf aus bei das dass dem den der des die doch ein eine einem einen einer hat ich ihr ist mit nach nicht nur oder sich sie sind und uber vom von vor war wie wird zum zur
con como del las los mas para pero por que sin sobre sus una uno unos aux avec ces cette dans des elle est ils les leur mais nous par pas plus pour qui ses son sont sur une vous
che chi con dal dalla dei del della delle gli hai hanno nel nella non per piu sono sul sulla tra una uno
""".split())))  # fmt: skip


def _marked() -> tuple[str, str]:
    """Letters of any script that Unicode decomposes into a letter and marks, and those letters."""
    marked, plain = "", ""
    for c in map(chr, range(0xC0, 0xFFFE)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and not unicodedata.combining(parts[0]) and all(unicodedata.category(x)[0] == "M" for x in parts[1:]):
            marked, plain = marked + c, plain + parts[0]
    return marked, plain


MARKED, PLAIN = _marked()


def trimmed(x: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(x, F.lit(WHITE))


def collapse(x: Column) -> Column:
    """White space to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(x, WS, " "))


def decode(x: Column, page: bool = False) -> Column:
    """Decode the entities; the ampersand last, so that nothing is decoded twice."""
    for entity, sign in [*ENTITIES, *(PAGE_ENTITIES if page else []), ("&amp;", "&")]:
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def sanitize(x: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed; null gives ''."""
    return collapse(decode(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " ")))


def safe_html(x: Column) -> Column:
    """Markup without what UNSAFE names."""
    for pattern in UNSAFE:
        x = F.regexp_replace(x, pattern, "")
    return x


def optional(x: Column) -> Column:
    """Sanitised, null when nothing is left."""
    return F.nullif(sanitize(x), F.lit(""))


def fold(x: Column) -> Column:
    """Lower case without marks on letters, of any script, composed or not."""
    return F.lower(F.regexp_replace(F.translate(x, MARKED, PLAIN), r"\p{M}+", ""))


def word_count(x: Column) -> Column:
    """Runs of anything but white space; null counts 0."""
    return F.size(F.array_remove(F.split(F.coalesce(x, F.lit("")), WS), ""))


def prefix(x: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(x, 1, n)


def feed_title(title: Column, summary: Column, content: Column, link: Column, outlet: Column) -> Column:
    """Title, else 120 characters of summary or content, else the outlet's name where there is a link, else null (no row)."""
    linked = F.when(F.coalesce(link, F.lit("")) != "", outlet)
    return F.coalesce(optional(title), F.nullif(prefix(sanitize(summary), 120), F.lit("")), F.nullif(prefix(sanitize(content), 120), F.lit("")), F.nullif(linked, F.lit("")))


def feed_summary(summary: Column, cleaned: Column) -> Column:
    """280 characters of the summary, else the content, cut and marked when it is longer."""
    explicit = F.nullif(prefix(sanitize(summary), 280), F.lit(""))
    snippet = F.trim(prefix(cleaned, 280))
    cut = F.when(F.length(cleaned) <= 280, cleaned).otherwise(F.when(snippet != "", F.concat(snippet, F.lit("…"))))
    return F.coalesce(explicit, F.when(cleaned != "", cut))


def page_summary(existing: Column, cleaned: Column) -> Column:
    """Keep a summary of 40 characters or more; else the page's text, cut at 280."""
    text = trimmed(cleaned)
    cut = F.when(F.length(text) <= 280, text).otherwise(F.concat(trimmed(prefix(text, 280)), F.lit("...")))
    return F.when(F.length(trimmed(existing)) >= 40, existing).when(text == "", existing).otherwise(cut)


def _hinted(lowered: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(lowered, F.lit(h))
    return out


def trailing_off(x: Column) -> Column:
    """Ends in an ellipsis."""
    t = trimmed(x)
    return F.endswith(t, F.lit("...")) | F.endswith(t, F.lit("…")) | F.endswith(t, F.lit("[…]"))


def feed_complete(source: Column, raw: Column, cleaned: Column) -> Column:
    """A feed's own content of 120 words or more that neither breaks off nor points elsewhere."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    elsewhere = F.contains(low, F.lit("href")) & F.contains(low, F.lit("read more"))
    return (source == "feed_content") & (word_count(cleaned) >= 120) & ~_hinted(F.lower(cleaned), FEED_HINTS) & ~trailing_off(cleaned) & ~elsewhere


def page_complete(cleaned: Column) -> Column:
    """A page's text of 160 words or more without a hint that it goes on."""
    return (word_count(cleaned) >= 160) & ~_hinted(F.lower(cleaned), PAGE_HINTS) & ~trailing_off(cleaned)


def prefer_fallback(candidate_words: Column, fallback_words: Column, candidate: Column) -> Column:
    """Whether a page's whole body beats the container found: by five thresholds on words, or by hints of a cut."""
    c, f = candidate_words, fallback_words
    longer = (c < 80) | ((c < 140) & (f >= c + 40)) | ((f >= c * 2) & (f >= c + 100)) | (_hinted(F.lower(candidate), FALLBACK_HINTS) & (f >= c + 20))
    return (f > c) & (f >= 60) & longer


def replace_content(new_words: Column, old_words: Column, source: Column, complete: Column) -> Column:
    """Whether a page's text replaces what an article has."""
    rule = F.when(source == "feed_summary", new_words >= old_words + 15).when(complete, new_words >= old_words + 80).when(old_words < 120, new_words >= old_words + 20).otherwise((new_words >= old_words + 35) | (new_words >= 180))
    return F.when(new_words <= 0, False).when(old_words == 0, True).otherwise(rule)


def improved(new_words: Column, old_words: Column, new_source: Column, old_source: Column) -> Column:
    """Whether an enriched article is worth storing: it has more words, or its content comes from elsewhere."""
    return (new_words > old_words) | ~new_source.eqNullSafe(old_source)


def wants_enrichment(url: Column, source: Column, words: Column, complete: Column) -> Column:
    """An https article that isn't long enough yet for where its content comes from."""
    enough = ((source == "article_page") & (words >= 180)) | (complete & (words >= 220)) | ((source == "feed_content") & (words >= 350))
    return F.startswith(F.lower(url), F.lit("https://")) & ~enough


def wants_detail_enrichment(words: Column, complete: Column) -> Column:
    """Opening an article enriches it unless it is complete and has 220 words."""
    return ~(complete & (words >= 220))


def reading_minutes(words: Column) -> Column:
    """Minutes at 220 words a minute, one at least; null under 40 words."""
    return F.when(words >= 40, F.greatest(F.lit(1), F.ceil(words / 220).cast("int")))


def content_choice(content: Column, summary: Column) -> tuple[Column, Column]:
    """Raw content, and where it comes from."""
    has = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), WS, " ")) != ""
    return F.when(has(content), content).when(has(summary), summary), F.when(has(content), "feed_content").when(has(summary), "feed_summary").otherwise("none")


# Markup that ends a line of a page.
LINE_BREAK, BLOCK_END = r"(?i)<\s*br\s*/?\s*>", r"(?i)</\s*(p|div|section|article|main|h[1-6]|li|blockquote)\s*>"


def page_text(html: Column) -> Column:
    """Lines of a page: breaks and block ends part lines, other tags are spaces, blank lines go."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), LINE_BREAK, "\n")
    x = F.regexp_replace(x, BLOCK_END, "\n")
    x = decode(F.regexp_replace(x, "<[^>]+>", " "), True)
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.array_join(F.array_remove(F.transform(F.split(x, "\n"), collapse), ""), "\n")


def paragraphs_html(text: Column) -> Column:
    """Lines of plain text as escaped paragraphs."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), "")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "\n")


# The line, by language, that ends an article; what follows is the site's.
TERMINATORS = {"it": ("© riproduzione riservata", "©riproduzione riservata", "riproduzione riservata ©", "riproduzione riservata &copy;", "riproduzione riservata&copy;")}


def cut_at_terminator(text: Column, language: Column) -> Column:
    """The text before the earliest terminator of its language, without regard to case."""
    low = F.lower(text)
    primary = primary_language(language)
    out = text
    for code, phrases in TERMINATORS.items():
        places = [F.nullif(F.instr(low, F.lit(p)), F.lit(0)) for p in phrases]
        first = F.array_min(F.array(*places))
        out = F.when((primary == code) & first.isNotNull(), F.rtrim(F.substring(text, F.lit(1), first - 1), F.lit(WHITE))).otherwise(out)
    return out


def primary_language(language: Column) -> Column:
    """The primary subtag, lower-case."""
    return F.nullif(F.regexp_extract(F.lower(trimmed(language)), "^([a-z]+)", 1), F.lit(""))


def tokens(title: Column, summary: Column) -> Column:
    """Folded runs of letters and digits, of 3 or more, that aren't stop words; with repeats."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def headline(article_id: Column, title: Column) -> Column:
    """id, a tab, the title on one line, 140 characters of it."""
    return F.concat_ws("\t", article_id, prefix(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\r\n]+", " "), 140))


def summarisation_input(cleaned: Column, raw: Column) -> Column:
    """Trimmed cleaned content, else raw content, else null."""
    return F.coalesce(F.nullif(trimmed(cleaned), F.lit("")), F.nullif(trimmed(raw), F.lit("")))


def cached_summary(short: Column, bullets: Column, least: int | None = None) -> Column:
    """The stored summary where it isn't blank, or, if `least` is given, where it has so many characters."""
    return F.when(trimmed(short) != "" if least is None else F.length(short) >= least, F.struct(short.alias("short"), bullets.alias("bullets")))


def dedup_ordered(values: Column, most: int | None = None, ignore_case: bool = True) -> Column:
    """Sanitised distinct values in order of first appearance; blanks go; at most so many."""
    key = (lambda v: F.lower(v)) if ignore_case else (lambda v: v)
    start = F.array().cast("array<string>")

    def step(acc, raw):
        # once the list is full, nothing is looked at any more
        v = sanitize(raw)
        more = F.when((v == "") | F.exists(acc, lambda a: key(a) == key(v)), acc).otherwise(F.concat(acc, F.array(v)))
        return F.when(F.size(acc) < most, more).otherwise(acc) if most else more

    return F.aggregate(values, start, step)


# Marks of a paywall.
PAYWALL_MARKS = (r'(?i)"isAccessibleForFree"\s*:\s*"?false', r"(?i)\bsolo\s+per\s+(gli\s+)?abbonati\b", r"(?i)\briservat[oa]\s+agli\s+abbonati\b", r"(?i)\babbonati\s+per\s+continuare\b")


def paywalled(html: Column, words: Column, marks: tuple[str, ...] = ()) -> Column:
    """Under 80 words, and a mark of a paywall on the page."""
    found = F.lit(False)
    for m in (*PAYWALL_MARKS, *marks):
        found = found | html.rlike(m)
    return (words < 80) & found


def clip(text: Column, most: int = 250_000) -> Column:
    """At most so many characters."""
    return F.substring(text, 1, most)


def report_escape(x: Column) -> Column:
    """A string on one line of a report."""
    for sign, kept in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(sign), F.lit(kept))
    return x


def feed_date(raw: Column) -> Column:
    """ISO-8601 or RFC-822, with or without seconds and weekday (which is ignored); null when neither fits."""
    x = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    for name, offset in (("GMT|UTC|UT|Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CET", "+0100"), ("CEST", "+0200"), ("PST", "-0800"), ("PDT", "-0700")):
        x = F.regexp_replace(x, rf"(?i)\b(?:{name})$", offset)
    iso = F.when(raw.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}T"), F.try_to_timestamp(F.trim(raw)))
    forms = [F.try_to_timestamp(x, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    return F.coalesce(iso, *[F.when(x.rlike(r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4} "), f) for f in forms])
