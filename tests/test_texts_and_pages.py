"""Text and URL expressions, feeds, distilling, model answers, streams."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gazette.functions import objects, text, urls
from gazette.operators import elements, enrich, linked_data, pages
from gazette.sources import catalogue, feeds
from gazette.streaming import events as stream


def one(spark, expression, *values, kinds=None):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(values), strict=True))
    return spark.createDataFrame([values], schema).select(expression(*[F.col(n) for n in names]).alias("x")).first().x


def test_urls(spark):
    c = lambda u: one(spark, urls.canonical, u)
    assert c("HTTPS://A.example/P?utm_source=x&B=2&FBCLID=3#f") == "https://a.example/p?b=2" and c("https://a.example/?gclid=1") == "https://a.example/" and c("https://a.example/x?utm_sourced=1") == "https://a.example/x?utm_sourced=1" and c(None) is None and c("no url") is None
    assert one(spark, urls.host, "https://u:p@WWW.A.example.:8080/x") == "www.a.example" and one(spark, urls.normal_host, " A.b:80 ") == "a.b"
    key = lambda u: one(spark, urls.image_key, u)
    assert key("https://c.example/a/Hero-1024x768.JPG?x=1") == "hero" and key("/a/photo_large-800w.webp") == "photo" and key("x@2x.png") == "x" and key("  ") is None and key("https://c.example/a/b.tar.gz") == "b.tar"
    assert one(spark, urls.srcset, "a.jpg 1x, b.jpg 2x ,, c") == ["a.jpg", "b.jpg", "c"]
    r = lambda v, b: one(spark, urls.resolve, v, b)
    assert r("//c.example/i.png", "http://a.example/x") == "http://c.example/i.png" and r("www.c.example/i", "https://a.example") == "https://www.c.example/i" and r("/i.png", "https://a.example/x/y?z") == "https://a.example/i.png" and r("i.png", "https://a.example/x/y") == "https://a.example/x/i.png" and r("data:image/png", "https://a.example/") is None and r("i.png", "https://a.example") == "https://a.example/i.png"
    assert one(spark, urls.article_link, None, None, ) == urls.PLACEHOLDER and one(spark, urls.article_link, "/n/1", "https://a.example/f.xml") == "https://a.example/n/1"
    assert one(spark, urls.first_image, "<p><img class=x src=/a.png alt=b>") == "/a.png"


def test_texts(spark):
    assert one(spark, text.sanitize, " <b>a</b>&amp;lt;&nbsp;b\n\tc&#39;") == "a &lt; b c'" and one(spark, text.sanitize, None) == ""
    assert one(spark, text.word_count, " a  b\nc\t") == 3 and one(spark, text.word_count, None) == 0 and one(spark, text.word_count, "") == 0
    assert one(spark, text.feed_title, " <i></i>", "<p>" + "s" * 200, None, None, "O") == "s" * 120 and one(spark, text.feed_title, None, None, None, "l", "O") == "O" and one(spark, text.feed_title, None, None, None, None, "O") is None
    assert one(spark, text.feed_summary, None, "x" * 300) == "x" * 280 + "…" and one(spark, text.feed_summary, "s", "x") == "s" and one(spark, text.feed_summary, None, "") is None
    assert one(spark, text.page_summary, "short", "y" * 300) == "y" * 280 + "..." and one(spark, text.page_summary, "z" * 40, "y") == "z" * 40
    long = "word " * 200
    assert one(spark, text.feed_complete, "feed_content", long, long) and not one(spark, text.feed_complete, "feed_summary", long, long) and not one(spark, text.feed_complete, "feed_content", long, long + "…") and not one(spark, text.feed_complete, "feed_content", long, long + "Read More") and not one(spark, text.page_complete, long + "sign in to continue")
    assert one(spark, text.page_text, "<h1>A</h1><p>b<br/>c &#8211; d</p>\r\n <i>e</i>") == "A\nb\nc - d\ne"
    assert one(spark, text.paragraphs_html, "a <b>\n\n c") == "<p>a &lt;b&gt;</p>\n<p>c</p>"
    assert one(spark, text.cut_at_terminator, "Body. RIPRODUZIONE riservata © more", "it-IT") == "Body." and one(spark, text.cut_at_terminator, "Body. © riproduzione riservata", "xx") == "Body. © riproduzione riservata" and one(spark, text.cut_at_terminator, "x", None) == "x"
    assert one(spark, text.tokens, "The Città of  AI, città-2024!", None) == ["citta", "citta", "2024"]
    assert one(spark, text.headline, "i", "a\nb" + "c" * 200) == "i\ta b" + "c" * 137
    assert one(spark, lambda x: text.dedup_ordered(x, 2), ["A", " a ", "", "b", "C"], kinds=["array<string>"]) == ["A", "b"]
    assert one(spark, lambda h, w: text.paywalled(h, w), '{"isAccessibleForFree":"False"}', 79, kinds=["string", "int"]) and not one(spark, lambda h, w: text.paywalled(h, w), '{"isAccessibleForFree":"False"}', 80, kinds=["string", "int"])
    minutes = lambda n: one(spark, text.reading_minutes, n, kinds=["int"])
    assert (minutes(39), minutes(40), minutes(221)) == (None, 1, 2)
    date = lambda x: (lambda t: t and t.replace(tzinfo=None).isoformat())(one(spark, text.feed_date, x))
    assert date("Tue, 01 Apr 2026 10:20:30 +0200") == "2026-04-01T08:20:30" and date("1 Apr 2026 10:20 GMT") == "2026-04-01T10:20:00" and date("2026-04-01T10:20:30.5Z") == "2026-04-01T10:20:30.500000" and date("soon") is None and date(None) is None
    rule = lambda *v: one(spark, text.replace_content, *v, kinds=["int", "int", "string", "boolean"])
    assert not rule(0, 0, "none", False) and rule(1, 0, "none", False) and rule(115, 100, "feed_summary", True) and not rule(179, 100, "feed_content", True) and rule(120, 100, "feed_content", False) and rule(180, 200, "feed_content", False) and not rule(150, 149, "feed_content", False)
    assert one(spark, text.prefer_fallback, 79, 80, "x", kinds=["int", "int", "string"]) and not one(spark, text.prefer_fallback, 139, 178, "x", kinds=["int", "int", "string"]) and one(spark, text.prefer_fallback, 200, 220, "read more", kinds=["int", "int", "string"])
    assert one(spark, text.cached_summary, " ", ["b"], kinds=["string", "array<string>"]) is None


RSS = """<?xml version="1.0"?><rss xmlns:content="c" xmlns:dc="d" xmlns:media="m"><channel><language>it</language>
<item><title>One &amp; only</title><link>/n/1?utm_source=x</link><guid>g1</guid><pubDate>Tue, 01 Apr 2026 08:00:00 GMT</pubDate><description>Short</description><content:encoded><![CDATA[<p>%s</p><img src=i.png>]]></content:encoded><category>A</category><category>a</category><dc:creator>Me</dc:creator></item>
<item><title>Old</title><link>https://a.example/n/1</link><pubDate>Mon, 31 Mar 2026 08:00:00 GMT</pubDate><enclosure url="https://a.example/x.jpg" type="audio/mpeg"/></item>
<item><description>Only a summary</description><media:content url="//img.example/p" medium="image"/></item><item> <title> </title></item></channel></rss>""" % ("body " * 130)  # fmt: skip
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="https://a.example/self"/><link rel="alternate" href="https://a.example/alt"/><id>x</id><updated>2026-04-01T10:00:00Z</updated><author><name>Ann</name></author><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    raw = spark.createDataFrame([("src0", RSS), ("src1", ATOM), ("src2", "not xml"), ("src3", "<rss/>"), ("src4", None)], "source_id string, payload string")
    found = feeds.items(raw).collect()
    assert sorted((r.source_id, r.pos, r.status) for r in found if r.pos is None) == [("src2", None, "parse_failed"), ("src3", None, "empty"), ("src4", None, "parse_failed")]
    by = {(r.source_id, r.pos): r for r in found}
    assert by["src0", 0].categories == ["A", "a"] and by["src0", 0].language == "it" and by["src0", 0].author == "Me" and by["src0", 1].image_url is None and by["src0", 2].image_url == "//img.example/p" and ("src0", 3) not in by
    assert by["src1", 0].link == "https://a.example/alt" and by["src1", 0].author == "Ann"
    rows = {(r.source_id, r.pos): r for r in feeds.articles(feeds.items(raw), catalogue.sample(spark)).collect()}
    a = rows["src0", 0]
    assert a.title == "One & only" and a.article_url == "https://feeds.example/n/1?utm_source=x" and a.content_source == "feed_content" and a.is_content_likely_complete and a.tags == ["A"] and a.category == "A" and a.hero_image_url == "https://feeds.example/n/i.png" and a.published_at == datetime(2026, 4, 1, 8)
    assert rows["src0", 2].title == "Only a summary" and rows["src0", 2].content_source == "feed_summary" and rows["src0", 2].hero_image_url == "https://img.example/p" and rows["src0", 2].published_at is None and len(a.id) == 64


LONG = "<p>" + "A sentence, with some words in it that say something. " * 6 + "</p>"


def distilled(spark, rows, rules=None):
    """What pages.distilled gives for (page_id, html, fallback_text, language, hero_url), as rows by page_id."""
    given = spark.createDataFrame([(i, "https://x.example/n", *rest) for i, *rest in rows], "page_id long, url string, html string, fallback_text string, language string, hero_url string")
    return {r.page_id: r for r in pages.distilled(given, rules).collect()}


def test_distill(spark):
    page = f"<html><body><nav>menu</nav><div class='share-bar'>share me</div><article class='story-body'><h1>T</h1>{LONG * 3}<p>short</p><p><a href=1>one one one</a></p><p><a href=1>two two two</a></p><p><a href=1>three three</a></p><figure><img src='https://c.example/hero-800w.jpg'></figure><p>Leggi anche: altro.</p><p>© Riproduzione riservata</p><p>After words, all gone.</p></article><footer>f</footer></body></html>"
    ld = '<script type="application/ld+json"><!-- {"@type":"NewsArticle","articleBody":"%s"} --></script>' % ("w " * 90)
    got = distilled(spark, [(1, page, None, "it", "https://x.example/hero.png"), (2, '<p>solo per gli abbonati</p><script>{"isAccessibleForFree": false}</script>', "fall back " * 60, None, None), (3, None, None, None, None), (4, ld, None, "it", None), (5, "", " ", "xx", "")])
    out = got[1]
    assert out.method == "readable" and out.words > 150 and not any(x in out.text for x in ("menu", "share me", "short", "one one", "Leggi anche", "After words")) and "<img" not in out.html
    assert got[2].paywalled and got[2].method == "fallback" and got[2].words == 120 and (got[3].method, got[3].text, got[3].words, got[3].html) == ("none", "", 0, None) and got[4].method == "jsonld" and got[4].html.startswith("<p>w w") and got[5].method == "none"
    again = distilled(spark, [(1, out.html, None, "it", None)])[1]
    assert again.text == out.text
    rule = {"id": "r", "hosts": ["x.example"], "body_selectors": [".none", "#x .b.c"], "strip_selectors": ["p.ad"], "strip_text_patterns": ["^drop this"], "paywall_markers": ["members only"]}
    ruled = distilled(spark, [(1, f"<div id=x><div class='b c'>{LONG}<p class=ad>ad</p><p>Drop this line, whatever its length may be.</p></div></div>{LONG}<p>out</p>", None, None, None), (2, "<p>Members only</p>", None, None, None)], [rule])
    assert ruled[1].text == " ".join(LONG[3:-4].split()) and ruled[2].paywalled
    assert spark.range(1).select(text.safe_html(F.lit("<a href=\"javascript:x\" onclick='y'>t</a><img width=1 src=p>"))).first()[0] == "<a>t</a>"


def test_blocks(spark):
    html = "Lead <b>in</b><h2>H</h2><p>p <img src=a.png alt=x></p><ul><li>a<li>b</ul><blockquote>q</blockquote><pre>c\n d</pre><ol></ol>"
    got = pages.blocks(spark.createDataFrame([(1, "https://a.example/z/", html), (2, "", None)], "page_id long, url string, html string")).orderBy("pos").collect()
    assert [(b["kind"], b["text"] or b["items"] or b["url"]) for b in got] == [("paragraph", "Lead in"), ("heading", "H"), ("paragraph", "p"), ("image", "https://a.example/z/a.png"), ("list", ["a", "b"]), ("quote", "q"), ("code", "c\n d")]


def test_jsonld(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    cases = [ld('[{"@type":"Thing"},{"@graph":[{"@type":["X","BlogPosting"],"articleBody":" b ","isAccessibleForFree":"http://schema.org/False"}]}]'), ld("{bad") + ld('{"@type":"ReportageNewsArticle","articleBody":"ok","headline":"h"}'), ld('{"@type":"Article","articleBody":" "}'), None, ld('{"@type":"Article","articleBody":"outer","a":{"@type":"Article","articleBody":"inner"}}') + ld('{"@type":"Article","articleBody":"second"}'), ld('{"b":[{"@type":"Article","articleBody":"one\ntwo"}],"c":{"@type":"Article","articleBody":"later"}}'), ld("5"), ld('{"@type":7,"articleBody":"x"}')]
    got = {r.page_id: (r.body, r.headline, r.is_free) for r in pages.jsonld_articles(spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")).collect()}
    none = (None, None, None)
    assert got == {0: ("b", None, False), 1: ("ok", "h", None), 2: none, 3: none, 4: ("outer", None, None), 5: ("one two", None, None), 6: none, 7: none}
    values = ["true", "1", '"True"', '"https://schema.org/False"', '"maybe"', "null", "0.0", "{}"]
    free = spark.createDataFrame([(v,) for v in values], "v string").select(linked_data.truth(F.parse_json("v")).alias("x")).collect()
    assert [r.x for r in free] == [True, True, True, False, None, None, False, None]


def answers(spark, reader, *said):
    """What a reader finds in each answer."""
    return [enrich.read_answer(spark, x, reader) for x in said]


def test_answers(spark):
    said = ['x } {"a": [1, 2,],} y', '{"groups": [["a","b"], ["c', '```json\n{"a": "}"}\n```', "none", None, 'a "quote {" } {"b": "\\"}", "c": {"d": 1}}', '[{"a": 1}]', "{" * 50 + '{"deep": 1']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "case_id int, model_output string")
    assert [r.object for r in enrich.repaired(got).orderBy("case_id").collect()] == ['{"a":[1,2]}', '{"groups":[["a","b"]]}', '{"a":"}"}', None, None, '{"b":"\\"}","c":{"d":1}}', '{"a":1}', '{"deep":1}']
    as_tuples = lambda found: [tuple(x) for x in found]
    picked = answers(spark, enrich.picks, '{"picks": [{"id": "a", "interest": "x", "relevance": 250}, {"id": "", "interest": "x"}, {"id": "b", "interest": "y", "relevance": -3}, 4]}', '{"picks": [{"id": "b", "interest": "x"}, {"id": "c", "interest": "x", "relevance": 41.7}, {"id": "d", "interest": "x", "relevance": "9"}]}', "no", '{"picks": 3}')
    assert [as_tuples(p) for p in picked] == [[("a", "x", 100), ("b", "y", 1)], [("b", "x", 1), ("c", "x", 41), ("d", "x", 1)], [], []]
    assert answers(spark, enrich.groups, '{"groups": [["a", " "], ["a", "b"], 3]}', '{"groups": {}}') == [[["a", "b"]], []] and answers(spark, enrich.summary, '{"shortSummary": "s", "bullets": []}') == [None] and answers(spark, enrich.tags, '{"tags": ["A", "a", 5, "b"]}') == [["A", "b"]]
    rows = spark.createDataFrame([("1", "First line here. Second economy line.", None), ("2", None, " "), ("3", "", "raw text words")], "id string, cleaned_content string, raw_content string")
    got = {r.id: r for r in enrich.enriched(rows).collect()}
    assert got["1"].category == "economy" and got["1"].summary.short == "First line here." and got["2"].summary is None and "words" in got["3"].tags
    with pytest.raises(NotImplementedError):
        enrich.Provider().tags("x")


def test_one_retry(spark):
    class Slow(enrich.Local):
        def __init__(self, failures, error):
            self.left, self.error, self.calls = failures, error, 0

        def tags(self, content):
            self.calls, self.left = self.calls + 1, self.left - 1
            if self.left >= 0:
                raise self.error("no answer")
            return super().tags(content)

    once, twice, other = Slow(1, enrich.Timeout), Slow(2, TimeoutError), Slow(1, ValueError)
    assert answers(spark, enrich.tags, enrich.Retrying(once, 0).tags("words words")) == [["words"]] and once.calls == 2
    for p, error, calls in ((twice, TimeoutError, 2), (other, ValueError, 1)):
        with pytest.raises(error):
            enrich.Retrying(p, 0).tags("x")
        assert p.calls == calls
    with pytest.raises(NotImplementedError):
        enrich.Retrying(enrich.Provider(), 0).group([])


def test_decoded(spark):
    rows = spark.createDataFrame([(b"\x93hi\x94 \x80", "text/html; charset=windows-1252"), (b"\x93hi\x94", "iso-8859-1"), (b"\xe9", None), ("é€".encode(), "UTF-8"), (b"\xe9", "utf-8"), (b"x" * 2_000_001, None), (None, None)], "body binary, charset string")
    assert [r.x for r in rows.select(pages.decoded(F.col("body"), F.col("charset")).alias("x")).collect()] == ["“hi” €", "\x93hi\x94", "é", "é€", "é", None, None]


def test_the_container_is_the_prose(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section {k} of the site</a></li>" for k in range(15)) + "</ul>"
    prose = "<p>A sentence, with some words in it that say something more than nothing.</p>"
    found = [f"<body>{menu}<div id=a>{prose * 6}</div>{menu}</body>", f"<body>{menu}<section><div id=a>{prose * 3}<div>{prose * 3}</div></div>{menu}</section></body>", f"<body><div id=a><div>{prose * 2}</div><div>{prose * 4}</div></div>{menu}</body>"]
    rows = elements.containers(elements.table(spark.createDataFrame(list(enumerate([*found, menu, "", "<p>short</p>", None])), "page_id long, html string")))
    got = {r.page_id: r.x for r in rows.groupBy("page_id").agg(F.min_by(F.col("attributes")["id"], "pos").alias("x")).collect()}
    assert got == {0: "a", 1: "a", 2: "a"}


ODD_PAGES = [
    None, "", "plain text", "<p>one<p>two <b>three<div>four</div>five", "<ul><li>a<ul><li>b</ul><li>c</ul>", "<table><tr><td>1<td>2<tr><th>3</table>", "</div></p>x<br/>y<br>z", "<script>var a = '</p>';</script>a<!-- c -->b<style>p{}</style>",
    "<div " + " ".join(f"a{k}='{k}'" for k in range(50)) + ">x</div>", "<b>" * 3000 + "deep" + "</i>" * 3000 + "<li>" * 500, "a&amp;b &lt;c&gt; &copy;", "<P CLASS='A b'>Up</P>", "<img src=x><img src=x/>", "< p>not a tag</ p>", "x" * 100_000 + "<p>" + "y " * 50_000,
]


def test_elements_of_any_page(spark):
    """Rows of a page are numbered through, elements nest, and what is cut out is what lies in the interval."""
    rows = elements.table(spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").repartition(3)).orderBy("page_id", "pos").collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert set(by) == set(range(len(ODD_PAGES))) - {0, 1}
    for found in by.values():
        assert [r.pos for r in found] == list(range(len(found)))
        stack = []
        for r in found:
            if r.event == "close":
                assert stack.pop() == (r.el, r.pos) and found[r.el].tag == r.tag and found[r.el].attributes == r.attributes
            else:
                assert r.depth == len(stack) and r.el == r.pos
                if r.event == "open" and r.last > r.pos:
                    stack.append((r.pos, r.last))
        assert not stack
    text_of = {r.page_id: r.said for r in elements.texts(elements.table(spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string"))).collect()}
    assert text_of[2] == "plain text" and text_of[3] == "one two three four five" and text_of[4] == "a b c" and text_of[5] == "1 2 3" and text_of[6] == "x y z" and text_of[7] == "ab" and text_of[10] == "a&b <c> ©"
    # outermost elements go whole; nested ones of the same kind count once
    nested = elements.table(spark.createDataFrame([(1, "<div class=x>a<div class=x>b</div>c</div>d<div>e</div>")], "page_id long, html string"))
    assert elements.texts(elements.without(nested, F.col("attributes")["class"] == "x")).first().said == "d e"
    assert [r.tag for r in elements.selected(nested, ".x .x, div > p", "hit").where("hit and event = 'open'").collect()] == ["div"]


def test_pages(spark):
    body = "word " * 200
    p = spark.createDataFrame([(1, "https://a.example/1", f"<body><article>{body}</article><p>x</p><meta property='og:image' content='/h.png'></body>"), (2, "https://a.example/2", "<script>x</script>"), (3, "https://a.example/3", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extracted(p).collect()}
    assert got[1].words == 200 and got[1].complete and got[1].hero == "/h.png" and got[2].words == 0 and got[3].words == 0
    a = spark.createDataFrame([(1, "https://a.example/1", "feed_summary", 10, False, None, None, None, None), (2, "http://a.example/1", "feed_summary", 10, False, None, None, None, None)], "id long, article_url string, content_source string, content_word_count int, is_content_likely_complete boolean, raw_content string, cleaned_content string, hero_image_url string, summary_short string")
    rows = {r.id: r for r in pages.enriched(a, p.select("url", "html")).collect()}
    assert rows[1].content_source == "article_page" and rows[1].content_word_count == 200 and rows[1].hero_image_url == "https://a.example/h.png" and rows[2].content_source == "feed_summary"
    assert pages.distilled(p, [{"id": "r", "hosts": ["a.example"], "body_selectors": ["article"], "strip_selectors": [], "strip_text_patterns": [], "paywall_markers": []}]).count() == 3 and pages.blocks(p).count() >= 1 and pages.jsonld_articles(p).count() == 3
    raw = spark.createDataFrame([(bytearray("é".encode("latin-1")), None), (bytearray("é".encode()), "utf-8"), (bytearray("é".encode("latin-1")), "ISO-8859-1")], "b binary, c string")
    assert [r.x for r in raw.select(pages.decoded(F.col("b"), F.col("c")).alias("x")).collect()] == ["é", "é", "é"]


def test_stream(spark, tmp_path):
    schema = "id string, title string, is_bookmarked boolean, is_read boolean, published_at timestamp, updated_at timestamp_ntz"
    rows = [("a", "1"), ("b", "1"), ("a", "2")]
    for k, (i, t) in enumerate(rows):
        spark.createDataFrame([(i, t, False, False, datetime(2026, 4, 1, k), None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream.run_available(stream.unique(stream.read(spark, str(tmp_path / "in"), schema)), lambda b, _: seen.extend(r.id for r in b.collect()), str(tmp_path / "c1"))
    assert sorted(seen) == ["a", "b"]
    store_path, now = str(tmp_path / "store"), datetime(2026, 4, 2)
    stream.run_available(stream.read(spark, str(tmp_path / "in"), schema, 1), stream.merge_into(store_path, now), str(tmp_path / "c2"))
    from gazette.operators import store

    assert sorted(r.id for r in store.load(spark, store_path).collect()) == ["a", "b"]
    counted = []
    stream.run_available(stream.counts(stream.read(spark, str(tmp_path / "in"), schema), "published_at", "id", "1 day", None), lambda b, _: counted.extend((r.id, r.n) for r in b.collect()), str(tmp_path / "c3"), "complete")
    assert sorted(counted) == [("a", 2), ("b", 1)]


def test_runs_and_settings(spark):
    rows = elements.runs(elements.table(spark.createDataFrame([(1, "a <b>b <i>c</i></b> <a href=u>l</a>")], "page_id long, html string"))).orderBy("pos").collect()
    assert [(r.text, r.kinds, r.url) for r in rows] == [("a ", [], None), ("b ", ["strong"], None), ("c", ["strong", "em"], None), ("l", ["link"], "u")]
    asked = spark.createDataFrame([("it", "en"), (None, "de-DE"), ("system", "xx"), ("FR_ca", None), (None, None)], "p string, s string")
    assert [r.x for r in asked.select(enrich.language_name(F.col("p"), F.col("s")).alias("x")).collect()] == ["Italian", "German", "English", "French", "English"]
    ends = spark.createDataFrame([("https://a.example/v1", False), ("http://a.example", False), ("http://localhost:1", True), ("ftp://a", True), ("https://a b", True), (None, True)], "u string, l boolean")
    assert [r.x for r in ends.select(enrich.valid_endpoint(F.col("u"), F.col("l")).alias("x")).collect()] == [True, False, True, False, False, False]


def streamed(spark, folder, schema, batches):
    """A stream of a folder, one file a batch, by the files' times."""
    for rows in batches:
        time.sleep(1.1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return stream.read(spark, str(folder), schema, 1)


def test_caches_end_and_are_superseded(spark, tmp_path):
    from gazette.streaming import cache

    at = lambda hour: datetime(2026, 4, 1) + timedelta(hours=hour)
    schema = "reader long, run long, saved_at timestamp_ntz"
    rows = streamed(spark, tmp_path / "in", schema, [[(1, 5, at(0)), (2, 1, at(1)), (2, 2, at(1))], [(1, 4, at(2)), (2, 3, at(6))], [(3, 1, at(14))], [(1, 9, at(15))], [(4, 7, at(26.5))]])
    seen = []
    stream.run_available(cache.kept(rows), lambda b, _: seen.extend((r.reader, r.run, r.saved_at, r.status) for r in b.collect()), str(tmp_path / "state"), "append", cache.CONF)
    assert sorted(x for x in seen if x[3] != "superseded") == sorted([(1, 5, at(0), "saved"), (2, 2, at(1), "saved"), (2, 3, at(6), "saved"), (3, 1, at(14), "saved"), (1, 9, at(15), "saved"), (4, 7, at(26.5), "saved"), (2, 3, at(6), "expired"), (3, 1, at(14), "expired")])
    assert {x[:2] for x in seen if x[3] == "superseded"} >= {(1, 4), (2, 1)}


def test_panes_add_up_to_a_day(spark, tmp_path):
    schema = "title string, summary_short string, published_at timestamp_ntz"
    at = lambda hour: datetime(2026, 4, 1) + timedelta(hours=hour)
    rows = streamed(spark, tmp_path / "in", schema, [[("bridge opens", None, at(0.5)), ("bridge bridge", "river", at(1.2))], [("river again", None, at(1.9)), ("bridge", None, at(2))], [("late river", None, at(24.5))]])
    stream.run_available(stream.panes(rows), stream.batches(str(tmp_path / "out")), str(tmp_path / "state"), "update")
    got = {r.token: r.df for r in stream.day_of_panes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"": 4, "bridge": 2, "river": 3, "again": 1, "late": 1}
    assert {r.token: r.df for r in stream.day_of_panes(spark.read.parquet(str(tmp_path / "out")), 1).collect()} == {"": 1, "late": 1, "river": 1}


def test_references_end_in_a_semicolon(spark):
    """As the SQL of the queries over pages reads them: what no semicolon ends, or no name is, stays as it is, in texts, addresses and code."""
    html = "<p>a&amp;&amp;&amp</p><a href='/x?b=1&copy=2&amp;c=&lt'>&ampd; &foo; &lt;&#65;&#x42;&copy;</a><script>if(a&&b)&amp;</script>﷐"
    rows = elements.table(spark.createDataFrame([(1, html)], "page_id long, html string"))
    found = rows.collect()
    assert elements.texts(rows).first().said == "a&&&amp &ampd; &foo; <AB©﷐"
    assert next(r.attributes["href"] for r in found if r.tag == "a") == "/x?b=1&copy=2&c=&lt" and next(r.said for r in found if r.tag == "#code") == "if(a&&b)&amp;"


def test_cached_summaries_by_length(spark):
    stored = lambda x: one(spark, lambda s, b: text.cached_summary(s, b, 3), x, ["b"], kinds=["string", "array<string>"])
    assert [stored(x) and stored(x).short for x in ("A.", "A.b", "\n ", None)] == [None, "A.b", None, None]


def test_element_tasks_grow_in_number(spark, monkeypatch):
    """Whatever the number of shuffle partitions, a task has some TASK_ROWS rows of elements."""
    monkeypatch.setattr(elements, "TASK_ROWS", 64)
    rows = elements.table(spark.range(100).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>x</p>"), 20).alias("html")))
    assert rows.rdd.getNumPartitions() == 2 * 100 * 40 // 64


def test_plain_answers_are_read_as_they_stand(spark):
    """The way without a fold gives what the other gives: each answer again with a quoted sign before it, which takes the other."""
    said = ['Here it is: {"a": [1, {"b": "}"}]}', '{"b": 1, "a": "\\"{"} and {"c": 2}', 'x } {"a": {"b": 1,},} y', '\\{"a": 1}', '{"a": 1', '{"a": 1}}', '{"a": "{"} }']
    rows = spark.createDataFrame([(k, s, f'"q" {s}') for k, s in enumerate(said)], "k int, one string, other string")
    got = rows.select("k", objects.object_in(F.col("one")).alias("one"), objects.object_in(F.col("other")).alias("other")).orderBy("k").collect()
    assert all(r.one == r.other for r in got) and [r.one for r in got][:2] == ['{"a":[1,{"b":"}"}]}', '{"a":"\\"{","b":1}']


def test_pages_are_dealt_out_before_they_are_read(spark):
    """A file that is scanned in one task is read in several."""
    rows = elements.table(spark.range(0, 40, 1, 1).selectExpr("id AS page_id", "concat('<p>', id, '</p>') AS html"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.rindex("RepartitionByExpression") and plan.count("RepartitionByExpression") == 2
    assert rows.where("event = 'text'").selectExpr("count(*) n", "count_if(said = cast(page_id as string)) same").first() == (40, 40)


def test_newest_run_of_a_reader_asks_the_state_once():
    """Statuses of a batch, and that no call of the state's server is made whose answer is known."""
    import pandas as pd

    from gazette.streaming import cache

    class State:
        value, calls, timers = None, [], set()

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    s, newest = State(), cache.Newest(1)
    newest.init(s)
    batch = lambda *rows: iter([pd.DataFrame([r], columns=["run", "saved_us"]) for r in rows])
    told = lambda *rows: [tuple(r) for out in newest.handleInputRows((7,), batch(*rows), None) for r in out.itertuples(index=False)]
    assert told((2, 5000), (1, 9000), (2, 5000), (2, 4000)) == [(7, 1, 9000, "superseded"), (7, 2, 4000, "superseded"), (7, 2, 5000, "saved")]
    assert told((2, 5000), (1, 1000)) == [(7, 1, 1000, "superseded"), (7, 2, 5000, "saved")]
    assert told((1, 8000)) == [(7, 1, 8000, "superseded")] and s.timers == {3_600_005}
    assert told((3, 7000)) == [(7, 3, 7000, "saved")] and s.timers == {3_600_007} and s.calls == ["get"] * 4


def test_texts_are_never_broadcast(spark):
    """Tables that texts are read from, or made of, may look small to the planner: their texts still don't go through the driver."""
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "articleBody": "'), F.repeat(F.lit("some words "), 50), F.lit('"}</script>'))
    html = F.when(F.col("id") % 2 == 0, ld).otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("other words "), 60), F.lit("</p>")))
    rows = spark.range(20).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), html.alias("html"))
    for out in (linked_data.articles(rows), pages.distilled(rows)):
        joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
        assert out.count() == 20
    assert {(r.method, r.words) for r in pages.distilled(rows).collect()} == {("jsonld", 100), ("readable", 120)}
