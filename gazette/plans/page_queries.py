"""Queries over elements of pages. Those over `pages` have SQL that reads the markup by itself: a recursive query holds the stack of
open elements, token by token, and all rules are said again over it. The others are cases made from `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import distill, text
from gazette.operators import elements, pages
from gazette.plans.bindings import read
from gazette.plans.scalar_queries import pick, turns

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


VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr'"
BLOCK = "'address', 'article', 'aside', 'blockquote', 'body', 'dd', 'div', 'dl', 'dt', 'fieldset', 'figcaption', 'figure', 'footer', 'form', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'header', 'hr', 'html', 'li', 'main', 'nav', 'ol', 'p', 'pre', 'section', 'table', 'tbody', 'td', 'tfoot', 'th', 'thead', 'tr', 'ul'"
ONE_LINE = r"trim(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
WORDS_IN = r"len(regexp_extract_all({x}, '[^ \t\n\x0B\f\r]+'))"
#: tok: tokens of pages; st: the stack of open elements (tag, and the number k of the token that opened it) after each; leaf: texts with
#: the elements around, `piece` beginning with a space where a block's edge or a line break came before; el: elements, those around and
#: themselves, and the token `until` which they last.
MARKUP = rf"""WITH RECURSIVE raw AS (SELECT page_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<![^>]*>|</?[a-z][^>]*>|[^<]+|<') AS ts FROM pages)),
tok AS MATERIALIZED (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, CASE WHEN t[1:1] <> '<' THEN 'text' WHEN t[1:2] = '<!' THEN 'note' WHEN t[1:2] = '</' THEN 'end' WHEN regexp_matches(t, '(?i)^<(script|style)') THEN 'code' ELSE 'start' END AS kind FROM raw),
st AS (SELECT page_id, 0::BIGINT AS k, []::STRUCT(tag VARCHAR, id BIGINT)[] AS s FROM pages
  UNION ALL SELECT st.page_id, tok.k, CASE kind
    WHEN 'end' THEN CASE WHEN list_contains(list_transform(s, lambda x: x.tag), tok.tag) THEN s[1:len(s) - list_position(list_reverse(list_transform(s, lambda x: x.tag)), tok.tag)] ELSE s END
    WHEN 'start' THEN list_concat(s[1:coalesce(list_min(list_filter(range(1, len(s) + 1), lambda i: (tok.tag IN ({BLOCK}) AND s[i].tag = 'p' OR tok.tag = 'li' AND s[i].tag = 'li')
        AND len(list_filter(s[i + 1:], lambda x: x.tag IN ('ul', 'ol', 'table', 'dl', 'select') OR tok.tag <> 'li' AND x.tag IN ('div', 'section', 'article', 'blockquote'))) = 0)), len(s) + 1) - 1],
      CASE WHEN tok.tag IN ({VOID}) THEN [] ELSE [{{'tag': tok.tag, 'id': tok.k}}] END)
    ELSE s END FROM st JOIN tok ON tok.page_id = st.page_id AND tok.k = st.k + 1),
placed AS MATERIALIZED (SELECT st.page_id, st.k, t, tag, kind, list_transform(s, lambda x: x.id) AS chain, list_transform(s, lambda x: x.tag) AS tags,
  sum(CASE WHEN kind IN ('start', 'end') AND tag IN ({BLOCK}, 'br') THEN 1 ELSE 0 END) OVER (PARTITION BY st.page_id ORDER BY st.k) AS edges FROM st JOIN tok USING (page_id, k)),
leaf AS MATERIALIZED (SELECT page_id, k, chain, tags, edges, CASE WHEN edges > lag(edges, 1, -1) OVER (PARTITION BY page_id ORDER BY k) THEN ' ' ELSE '' END || said AS piece, said,
  coalesce(list_last(list_filter(list_zip(chain, tags), lambda x: x[2] IN ({BLOCK})))[1], -1) AS home
  FROM (SELECT *, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS said FROM placed WHERE kind = 'text')),
span AS (SELECT page_id, id, max(k) AS until FROM (SELECT page_id, k, unnest(chain) AS id FROM placed) GROUP BY ALL),
el AS MATERIALIZED (SELECT placed.page_id, k AS id, tag, t, CASE WHEN tag IN ({VOID}) THEN list_append(tags, tag) ELSE tags END AS tags, CASE WHEN tag IN ({VOID}) THEN list_append(chain, k) ELSE chain END AS chain, coalesce(until, k) AS until FROM placed LEFT JOIN span ON span.page_id = placed.page_id AND span.id = placed.k WHERE kind = 'start'),"""


def kept(name: str, condition: str, chosen: str, leaves: str = "leaf", els: str = "el") -> str:
    """SQL: leaves and elements under a name, without (or, for `within`, only) what lies in elements that `chosen` selects (page_id, id)."""
    sign = "" if condition == "within" else "NOT "
    return f"""{name}_gone AS (SELECT page_id, list(id) AS ids FROM ({chosen}) GROUP BY page_id),
{name}_leaf AS MATERIALIZED (SELECT x.* FROM {leaves} x LEFT JOIN {name}_gone USING (page_id) WHERE {sign}coalesce(list_has_any(chain, ids), false)),
{name}_el AS MATERIALIZED (SELECT x.* FROM {els} x LEFT JOIN {name}_gone USING (page_id) WHERE {sign}coalesce(list_has_any(chain, ids), false)),"""


def measured(name: str, leaves: str = "leaf", els: str = "el") -> str:
    """SQL: under a name, the text of each element, its links, and the characters of their texts."""
    return f"""{name}_said AS MATERIALIZED (SELECT page_id, id, {ONE_LINE.format(x="string_agg(piece, '' ORDER BY k)")} AS said FROM (SELECT page_id, k, piece, unnest(chain) AS id FROM {leaves}) GROUP BY page_id, id),
{name}_links AS (SELECT page_id, up AS id, count(*) AS links, sum(length(coalesce(said, ''))) AS linked FROM (SELECT page_id, id, unnest(list_filter(chain, lambda x: x <> id)) AS up FROM {els} WHERE tag = 'a') LEFT JOIN {name}_said USING (page_id, id) GROUP BY page_id, up),
{name} AS MATERIALIZED (SELECT e.page_id, e.id, e.tag, coalesce(said, '') AS said, coalesce(links, 0) AS links, coalesce(linked, 0) AS linked FROM {els} e LEFT JOIN {name}_said USING (page_id, id) LEFT JOIN {name}_links USING (page_id, id)),"""


CHROME_SQL = "SELECT page_id, id FROM {els} WHERE tag IN ('nav', 'footer', 'button', 'noscript', 'form', 'title', 'meta', 'link', 'style', 'script', 'template')"
NAMED_SQL = r"""SELECT page_id, id FROM {els} WHERE tag <> 'body' AND regexp_matches(lower(regexp_extract(t, 'class="([^"]*)"', 1) || ' ' || regexp_extract(t, ' id="([^"]*)"', 1)), '(?:^|[\s_-])(?:ad|advert|share|related|newsletter|footer|cookie)s?(?:$|[\s_-])')"""
LISTS_SQL = "SELECT page_id, id FROM {m} WHERE tag IN ('div', 'section', 'aside', 'nav', 'ul', 'ol') AND links >= 3 AND length(said) > 0 AND length(said) - linked < 400 AND linked > 0.5 * length(said)"
RUNS_SQL = """SELECT page_id, id FROM (SELECT *, count(*) FILTER (single) OVER (PARTITION BY page_id, run) AS many FROM (SELECT *, sum(CASE WHEN single THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY id) AS run
  FROM (SELECT *, links = 1 AND linked > 0 AND linked >= 0.85 * length(said) AS single FROM {m} WHERE tag = 'p'))) WHERE single AND many >= 3"""
SHORT_SQL = "SELECT page_id, id FROM {m} WHERE tag IN ('p', 'li') AND said <> '' AND length(said) < 25 AND NOT regexp_matches(said, '[.?!:]')"
#: Worth of blocks (their words, less those in links, twice those beyond half, and eight), added up over what lies in a block.
BEST_SQL = f"""blocks_{{n}} AS (SELECT page_id, home AS id, sum({WORDS_IN.format(x="said")}) AS n, sum(CASE WHEN list_contains(tags, 'a') THEN {WORDS_IN.format(x="said")} ELSE 0 END) AS l FROM {{leaves}} GROUP BY page_id, home),
worth_{{n}} AS (SELECT page_id, up AS id, sum(n - 2 * greatest(0, l - 0.5 * n) - l - 8) AS worth FROM (SELECT b.page_id, n, l, unnest(e.chain) AS up FROM blocks_{{n}} b JOIN {{els}} e USING (page_id, id) WHERE n > 0) GROUP BY ALL),
best_{{n}} AS (SELECT page_id, max_by(id, (coalesce(worth, 0), id)) AS id, max(coalesce(worth, 0)) AS worth FROM {{els}} LEFT JOIN worth_{{n}} USING (page_id, id) WHERE tag IN ({BLOCK}) GROUP BY page_id),"""
CONTAINER_SQL = "SELECT page_id, id FROM best_{n} JOIN {m} USING (page_id, id) WHERE worth > 0 AND length(said) >= 200"
SAID_SQL = "SELECT page_id, coalesce(said, '') AS said FROM pages LEFT JOIN (SELECT page_id, {line} AS said FROM {leaves} GROUP BY page_id) USING (page_id)"


def said_of(leaves: str) -> str:
    return SAID_SQL.format(line=ONE_LINE.format(x="string_agg(piece, '' ORDER BY k)"), leaves=leaves)


def told(spark: SparkSession, sf_dir: str, step) -> DataFrame:
    """page_id and the text that a step leaves of each page."""
    p = read(spark, sf_dir, "pages")
    found = elements.texts(step(elements.table(p)))
    return p.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("said", F.lit("")).alias("said"))


@register(MARKUP + said_of("leaf"))
def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages, words apart by one space."""
    return told(spark, sf_dir, lambda rows: rows)


@register(MARKUP + kept("c", "without", CHROME_SQL.format(els="el") + " UNION " + NAMED_SQL.format(els="el")) + said_of("c_leaf"))
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages without elements that are never content or whose class or id names furniture."""
    return told(spark, sf_dir, lambda rows: elements.without_furniture(rows, distill.CHROME, distill.NAMED))


@register(MARKUP + measured("m") + kept("c", "without", LISTS_SQL.format(m="m")) + said_of("c_leaf"))
def page_link_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages without containers that are mostly links."""
    return told(spark, sf_dir, elements.without_link_lists)


@register(MARKUP + measured("m") + kept("c", "without", SHORT_SQL.format(m="m")) + said_of("c_leaf"))
def page_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages without short paragraphs and items that have no punctuation."""
    return told(spark, sf_dir, elements.without_short)


@register(MARKUP + measured("m") + BEST_SQL.format(n="b", leaves="leaf", els="el") + kept("c", "within", CONTAINER_SQL.format(n="b", m="m")) + said_of("c_leaf"))
def page_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the containers that read most like articles."""
    return told(spark, sf_dir, elements.containers)


PATHS = {"nav li a": "/nav/(.*/)?li/(.*/)?a$", "article p": "/article/(.*/)?p$", "article p, h1": "/article/(.*/)?p$|/h1$", "body ul li": "/body/(.*/)?ul/(.*/)?li$", "p b": "/p/(.*/)?b$", "nav p": "/nav/(.*/)?p$"}


@register(MARKUP + "x AS (SELECT page_id, t, '/' || array_to_string(tags, '/') AS path FROM el) SELECT p.page_id, "
          + ", ".join(f"count(*) FILTER (regexp_matches(path, '{r}'))::INT AS n{k}" for k, r in enumerate(PATHS.values()))
          + """, count(*) FILTER (regexp_extract(t, 'class="([^"]*)"', 1) = 'ad')::INT AS n_ad, count(*) FILTER (t LIKE '<a href="/t%')::INT AS n_t FROM pages p LEFT JOIN x USING (page_id) GROUP BY p.page_id""")  # fmt: skip
def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each page selectors find."""
    p = read(spark, sf_dir, "pages")
    rows, names = elements.table(p), [f"n{k}" for k in range(len(PATHS))] + ["n_ad", "n_t"]
    for name, selector in zip(names, [*PATHS, "div.ad", "a[href^='/t']"], strict=True):
        rows = elements.selected(rows, selector, name)
    counts = rows.groupBy("page_id").agg(*[F.count_if((F.col("event") == "open") & F.col(n)).cast("int").alias(n) for n in names])
    return p.select("page_id").join(counts, "page_id", "left").select("page_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


#: Chain of the steps that apply to pages as they are: chrome, container, furniture, link lists, runs of links, short lines.
DISTILLED_SQL = (
    MARKUP + kept("c", "without", CHROME_SQL.format(els="el")) + measured("cm", "c_leaf", "c_el") + BEST_SQL.format(n="b", leaves="c_leaf", els="c_el") + kept("i", "within", CONTAINER_SQL.format(n="b", m="cm"), "c_leaf", "c_el")
    + kept("n", "without", NAMED_SQL.format(els="i_el"), "i_leaf", "i_el") + measured("nm", "n_leaf", "n_el") + kept("l", "without", LISTS_SQL.format(m="nm"), "n_leaf", "n_el")
    + measured("lm", "l_leaf", "l_el") + kept("r", "without", RUNS_SQL.format(m="lm"), "l_leaf", "l_el") + measured("rm", "r_leaf", "r_el") + kept("s", "without", SHORT_SQL.format(m="rm"), "r_leaf", "r_el")
)  # fmt: skip


@register(DISTILLED_SQL + rf"""part AS (SELECT page_id, k AS place, 0 AS deep, replace(replace(replace(said, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS part FROM s_leaf
  UNION ALL SELECT page_id, id, 0, '<' || tag || '>' FROM s_el UNION ALL SELECT page_id, until + 1, -len(chain), '</' || tag || '>' FROM s_el WHERE tag NOT IN ({VOID})),
h AS (SELECT page_id, string_agg(part, '' ORDER BY place, deep) AS html FROM part GROUP BY page_id),
w AS (SELECT t.page_id, t.said AS text, {WORDS_IN.format(x="t.said")} AS words, h.html, p.html AS page FROM ({said_of("s_leaf")}) t LEFT JOIN h USING (page_id) JOIN pages p USING (page_id))
SELECT page_id, html, text, words::INT AS words, CASE WHEN html IS NULL THEN 'none' ELSE 'readable' END AS method, words < 80 AND regexp_matches(page, '(?i)"isAccessibleForFree"\s*:\s*"?false|\bsolo\s+per\s+(gli\s+)?abbonati\b|\briservat[oa]\s+agli\s+abbonati\b|\babbonati\s+per\s+continuare\b') AS paywalled, 1::INT AS version FROM w""")
def distill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distilled articles of pages."""
    return pages.distilled(read(spark, sf_dir, "pages"))


WHOLE = "'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'ul', 'ol', 'blockquote', 'pre'"


@register(MARKUP + rf"""o AS (SELECT *, list_filter(list_zip(chain, tags, range(1, len(chain) + 1)), lambda x: x[2] IN ({WHOLE}))[1] AS outer_el FROM leaf),
g AS (SELECT page_id, k, piece, said, outer_el[2] AS tag, CASE WHEN outer_el IS NULL THEN 'run' || edges ELSE 'el' || outer_el[1] END AS key, CASE WHEN tags[outer_el[3] + 1] = 'li' THEN chain[outer_el[3] + 1] END AS item FROM o),
i AS (SELECT page_id, key, item, min(k) AS k, {ONE_LINE.format(x="string_agg(piece, '' ORDER BY k)")} AS said FROM g WHERE tag IN ('ul', 'ol') AND item IS NOT NULL GROUP BY ALL),
l AS (SELECT page_id, key, list(said ORDER BY k) FILTER (said <> '') AS items FROM i GROUP BY ALL),
b AS (SELECT page_id, key, any_value(tag) AS tag, min(k) AS place, {ONE_LINE.format(x="string_agg(piece, '' ORDER BY k)")} AS said, regexp_replace(string_agg(said, '' ORDER BY k), '^\n+|\n+$', '', 'g') AS raw FROM g GROUP BY page_id, key)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS pos, CASE WHEN tag IS NULL THEN 'paragraph' WHEN tag IN ('ul', 'ol') THEN 'list' WHEN tag = 'blockquote' THEN 'quote' WHEN tag = 'pre' THEN 'code' ELSE 'heading' END AS kind,
  CASE WHEN tag LIKE 'h_' THEN tag[2:2]::INT END AS level, CASE WHEN tag = 'pre' THEN raw WHEN tag IS NULL OR tag NOT IN ('ul', 'ol') THEN said END AS text, array_to_string(items, '|') AS items, NULL::VARCHAR AS url, NULL::VARCHAR AS alt, CASE WHEN tag IN ('ul', 'ol') THEN tag = 'ol' END AS ordered
FROM b LEFT JOIN l USING (page_id, key) WHERE CASE WHEN tag IN ('ul', 'ol') THEN len(items) > 0 ELSE said <> '' END""")
def block_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of pages."""
    return pages.blocks(read(spark, sf_dir, "pages")).withColumn("items", F.array_join("items", "|"))


@register(MARKUP + r"""u AS (SELECT page_id, k, regexp_replace(said, '[ 	

]+', ' ', 'g') AS said, CASE WHEN list_contains(tags, 'b') THEN 'strong' ELSE '' END || CASE WHEN list_contains(tags, 'a') THEN 'link' ELSE '' END AS kinds, CASE WHEN list_contains(tags, 'a') THEN chain[list_position(tags, 'a')] END AS a FROM leaf),
r AS (SELECT u.page_id, u.k, said, kinds, regexp_extract(t, 'href="([^"]*)"', 1) AS href, a FROM u LEFT JOIN tok ON tok.page_id = u.page_id AND tok.k = u.a),
n AS (SELECT *, sum(CASE WHEN kinds IS DISTINCT FROM pk OR href IS DISTINCT FROM ph THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS run FROM (SELECT *, lag(kinds, 1, 'none') OVER w AS pk, lag(href) OVER w AS ph FROM r WINDOW w AS (PARTITION BY page_id ORDER BY k))),
j AS (SELECT page_id, run, string_agg(said, '' ORDER BY k) AS text, any_value(kinds) AS kinds, any_value(href) AS url FROM n GROUP BY page_id, run)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY run) - 1)::INT AS pos, text, kinds, url FROM j WHERE trim(text) <> ''""")
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline runs of pages: text, kinds and address."""
    return elements.runs(elements.table(read(spark, sf_dir, "pages"))).withColumn("kinds", F.array_join("kinds", ""))


def left(rows: DataFrame, step, *keep: str) -> DataFrame:
    """doc_id and the text that a step leaves of each row's html."""
    found = elements.texts(step(elements.table(rows.select(F.col("doc_id").alias("page_id"), "html", *keep), *keep)))
    return rows.select("doc_id").join(found, F.col("doc_id") == F.col("page_id"), "left").select("doc_id", F.coalesce("said", F.lit("")).alias("said"))


def lines(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """doc_id and markup made of parts."""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("html"))


def number() -> Column:
    return F.col("doc_id").cast("string")


def sentence() -> Column:
    return F.concat(F.lit("Sentence "), number(), F.lit(", which has words enough to stay where it is."))


IT_SAYS = "'Sentence ' || doc_id || ', which has words enough to stay where it is.'"


@register(f"SELECT doc_id, {IT_SAYS} || ' Second.' AS said FROM documents")
def chrome_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation, forms, code and the like go."""
    return left(lines(spark, sf_dir, "<title>t</title><nav>menu ", number(), "</nav><div><p>", sentence(), "<script>x</script><style>y</style></p><button>b</button><form><p>f</p></form></div><noscript>n</noscript><p>Second.</p><template>q</template><footer>f</footer>"), lambda rows: elements.without(rows, elements.is_tag(*distill.CHROME)))


NAMES = [("share", True), ("related-posts", True), ("shared", False), ("my_newsletter box", True), ("[cookie-x] text", False), ("article-body", False), ("site-footer", True), ("badge", False), ("top ads", True), ("ad", True), ("COOKIE", True), ("popupular", False)]


@register(f"SELECT doc_id, CASE WHEN {turns('doc_id', [b for _, b in NAMES])} THEN '' ELSE 'furniture ' END || {IT_SAYS} AS said FROM documents")
def furniture_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements whose class or id names furniture go."""
    name = pick("doc_id", [n for n, _ in NAMES])
    return left(lines(spark, sf_dir, F.when(F.col("doc_id") % 2 == 0, '<div class="').otherwise('<div id="'), name, '">furniture</div><p>', sentence(), "</p>"), lambda rows: elements.without_furniture(rows, distill.CHROME, distill.NAMED))


@register(f"""SELECT doc_id, CASE WHEN doc_id % 5 >= 3 AND doc_id % 500 < 400 AND 10 * (doc_id % 5) > 0.5 * (10 * (doc_id % 5) + doc_id % 500 + CASE WHEN doc_id % 500 > 0 THEN doc_id % 5 ELSE doc_id % 5 - 1 END) THEN '' ELSE repeat('abcdefghij ', doc_id % 5) || CASE WHEN doc_id % 500 > 0 THEN repeat('x', doc_id % 500) || ' ' ELSE '' END END || {IT_SAYS} AS said FROM documents""")
def link_lists_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers that are mostly links go; n links of ten letters and m other letters each."""
    links, rest = F.repeat(F.lit("<a>abcdefghij</a> "), (F.col("doc_id") % 5).cast("int")), F.repeat(F.lit("x"), (F.col("doc_id") % 500).cast("int"))
    return left(lines(spark, sf_dir, "<div>", links, rest, "</div><p>", sentence(), "</p>"), elements.without_link_lists)


@register(f"SELECT doc_id, CASE WHEN doc_id % 6 >= 3 THEN '' ELSE repeat('linked words ', doc_id % 6) END || {IT_SAYS} || ' linked words' AS said FROM documents")
def link_runs_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three paragraphs or more that are a link each go."""
    link = "<p><a href='/x'>linked words</a></p>"
    return left(lines(spark, sf_dir, F.repeat(F.lit(link), (F.col("doc_id") % 6).cast("int")), "<p>", sentence(), "</p>", link), elements.without_link_runs)


@register(f"SELECT doc_id, CASE WHEN doc_id % 40 >= 25 THEN repeat('y', doc_id % 40) || ' ' ELSE '' END || 'Short one. ' || {IT_SAYS} AS said FROM documents")
def short_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short paragraphs without punctuation go."""
    return left(lines(spark, sf_dir, "<p>", F.repeat(F.lit("y"), (F.col("doc_id") % 40).cast("int")), "</p><ul><li>Short one.</li></ul><p>", sentence(), "</p>"), elements.without_short)


SITE_LINES = [("it-IT", "Leggi anche: ", True), ("it", "Si legge anche ", False), ("en", "Read more ", True), ("xx", "Read more ", False), (None, "Read more ", False), ("DE_de", "Anzeige ", True)]
HOLDERS = [("p", None), ("h2", 80), ("header", 80), ("a", 80), ("li", None), ("div", 80)]


@register(f"""WITH d AS (SELECT doc_id, {turns('doc_id', [w for _, w, _ in SITE_LINES])} || repeat('z', doc_id % 700) AS t, {turns('doc_id', [g for *_, g in SITE_LINES])} AS goes, {turns('doc_id // 6', [m for _, m in HOLDERS])} AS most FROM documents)
SELECT doc_id, CASE WHEN goes AND (most IS NULL OR length(trim(t)) <= most) THEN '' ELSE trim(t) || ' ' END || {IT_SAYS} AS said FROM d""")
def site_lines_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that sites add go: paragraphs of any length, other elements when they are short."""
    d = read(spark, sf_dir, "documents").withColumn("k", F.floor(F.col("doc_id") / 6))
    tag, words = pick("k", [t for t, _ in HOLDERS]), F.concat(pick("doc_id", [w for _, w, _ in SITE_LINES]), F.repeat(F.lit("z"), (F.col("doc_id") % 700).cast("int")))
    html = F.concat(F.lit("<"), tag, F.lit(">"), words, F.lit("</"), tag, F.lit("><p>"), sentence(), F.lit("</p>"))
    return left(d.select("doc_id", html.alias("html"), pick("doc_id", [la for la, *_ in SITE_LINES]).alias("language")), lambda rows: elements.without_site_lines(rows, distill.SITE_LINES), "language")


SHOWN = [("https://i.example/a/Photo-800x600.jpg", True), ("/b/photo_large.webp?x=1", True), ("photograph.jpg", False), ("", False), ("/p/photo@2x.png", True), ("x.png", False)]


@register(f"SELECT doc_id, {turns('doc_id', [0 if g else 1 for _, g in SHOWN])}::INT AS said FROM documents")
def hero_again_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many figures are left when the hero's own goes."""

    html = lines(spark, sf_dir, '<figure><picture><img src="', pick("doc_id", [s for s, _ in SHOWN]), '"></picture></figure><p>x</p>')
    rows = elements.without_hero(elements.table(html.select(F.col("doc_id").alias("page_id"), "html", F.lit("https://cdn.example/photo-1024w.png#top").alias("hero_url")), "hero_url"))
    return rows.groupBy(F.col("page_id").alias("doc_id")).agg(F.count_if(elements.opens(elements.is_tag("figure"))).cast("int").alias("said"))


@register("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'main text' ELSE 'story text kept' END || ' ' || doc_id AS said FROM documents")
def outlet_rule_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first container that an outlet's rule finds, without what the rule strips."""
    rule = {"id": "x", "hosts": ["x.example"], "body_selectors": [".none", ".story", "main"], "strip_selectors": [".ad", "p#gone"], "strip_text_patterns": ["^strip me"], "paywall_markers": []}
    story = F.when(F.col("doc_id") % 3 == 0, "<section>").otherwise('<section class="story"><p>story text</p><p id="gone">x</p><p>kept</p>')
    html = ("<main>main text ", number(), "</main>", story, '<span class="ad">ad</span><p>Strip me now</p>', F.when(F.col("doc_id") % 3 == 0, "").otherwise(number()), "</section>")
    return left(lines(spark, sf_dir, *html).withColumn("rule_id", F.lit("x")), lambda rows: elements.ruled(rows, [rule]), "rule_id")


MARKS = [("it", "<p>© Riproduzione <b>riservata</b></p>", False), ("it-IT", "<p>testo. © RIPRODUZIONE RISERVATA qui</p>", True), ("en", "<p>© riproduzione riservata</p>", False), ("it", "<figure><figcaption>© riproduzione riservata</figcaption></figure>", False), ("IT", "<img alt='© riproduzione riservata'>", False), ("it", "<div><p>riproduzione riservata &copy;</p></div>", True), (None, "x", False)]
LEFT = ["© Riproduzione riservata After.", "testo.", "© riproduzione riservata After.", "© riproduzione riservata After.", "After.", "", "x After."]


@register(f"SELECT doc_id, trim({IT_SAYS} || ' ' || {turns('doc_id', LEFT)}) AS said FROM documents")
def terminator_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup up to the phrase that ends articles, where it is said in the text."""
    d = read(spark, sf_dir, "documents")
    html = F.concat(F.lit("<article><p>"), sentence(), F.lit("</p>"), pick("doc_id", [m for _, m, _ in MARKS]), F.lit("</article><p>After.</p>"))
    return left(d.select("doc_id", html.alias("html"), pick("doc_id", [la for la, *_ in MARKS]).alias("language")), lambda rows: elements.up_to_terminator(rows, text.TERMINATORS), "language")


@register("SELECT doc_id, repeat('Prose number ' || doc_id || ', that goes on for a while and says things. ', 3) || repeat('More prose of the same sort, in another paragraph. ', 2 + doc_id % 5) AS said FROM documents")
def container_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's container among navigation, teasers and a sidebar."""
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(12)) + "</ul>"
    side = "<div><h3>Others</h3>" + "".join(f"<p><a href='/{k}'>A teaser for another story {k}</a></p>" for k in range(6)) + "</div>"
    first = F.repeat(F.concat(F.lit("<p>Prose number "), number(), F.lit(", that goes on for a while and says things.</p>")), 3)
    more = F.repeat(F.lit("<p>More prose of the same sort, in another paragraph.</p>"), (F.col("doc_id") % 5 + 2).cast("int"))
    found = left(lines(spark, sf_dir, f"<body><div>{menu}</div><div><div><div>", first, more, f"</div></div>{side}</div><div>{menu}</div></body>"), elements.containers)
    return found.select("doc_id", F.concat("said", F.lit(" ")).alias("said"))


@register("""SELECT doc_id, unnest([0, 1, 2, 3, 4, 5])::INT AS pos, unnest(['heading', 'paragraph', 'list', 'quote', 'image', 'code']) AS kind, unnest(['Head ' || doc_id, 'Some bold text ' || doc_id, NULL, 'Quote', NULL, 'a  b' || chr(10) || 'c']) AS said,
  unnest([NULL, NULL, 'one|two ' || doc_id, NULL, NULL, NULL]) AS items, unnest([NULL, NULL, NULL, NULL, 'https://a.example/i/' || doc_id || '.png', NULL]) AS url, unnest([doc_id % 6 + 1, NULL, NULL, NULL, NULL, NULL])::INT AS level, unnest([NULL, NULL, doc_id % 2 = 0, NULL, NULL, NULL]) AS ordered FROM documents""")
def typed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of markup with one of each kind."""
    k = F.col("doc_id")
    level, kind = (k % 6 + 1).cast("string"), F.when(k % 2 == 0, "ol").otherwise("ul")
    html = ("<h", level, ">Head ", number(), "</h", level, "><p>Some <b>bold</b>\n text ", number(), "</p><", kind, "><li>one</li><li> </li><li>two ", number(), "</li></", kind, "><blockquote><p>Quote</p></blockquote><figure><img src='/i/", number(), ".png' alt=''></figure><pre>a  b\nc</pre><script>no</script>")
    rows = pages.blocks(lines(spark, sf_dir, *html).select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/n/1").alias("url"), "html"))
    return rows.select(F.col("page_id").alias("doc_id"), "pos", "kind", F.col("text").alias("said"), F.array_join("items", "|").alias("items"), "url", "level", "ordered")


@register("SELECT doc_id, 'plain :|strong ' || doc_id || ':strong|both:link+strong/u' || doc_id || '| end:' AS said FROM documents")
def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a line: text, kinds and address."""
    html = lines(spark, sf_dir, "plain <strong>strong ", number(), "</strong><a href='/u", number(), "'><b>both</b></a> end")
    rows = elements.runs(elements.table(html.select(F.col("doc_id").alias("page_id"), "html")))
    run = F.concat("text", F.lit(":"), F.array_join("kinds", "+"), F.coalesce("url", F.lit("")))
    return rows.groupBy(F.col("page_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", run.alias("run")))), lambda x: x["run"]), "|").alias("said"))


SELECTORS = [("p", 3), ("div p", 2), (".a.b", 1), ("#x", 1), ("[data-k]", 2), ("[data-k=v1]", 1), ("[href^=http], em", 2), ("div .none", 0), ("*[data-k$='2']", 1)]


@register(f"SELECT doc_id, {turns('doc_id', [n for _, n in SELECTORS])}::INT AS said FROM documents")
def selector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements a selector finds."""
    html = "<p class='a'>1</p><div id='x'><p class='a b' data-k='v1'>2<a href='http://q'>l</a></p><section><p data-k='v2'><em>3</em></p></section></div>"
    rows = elements.table(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(html).alias("html")))
    for k, (selector, _) in enumerate(SELECTORS):
        rows = elements.selected(rows, selector, f"found{k}")
    counts = [F.count_if((F.col("event") == "open") & F.col(f"found{k}")).cast("int") for k in range(len(SELECTORS))]
    return rows.groupBy(F.col("page_id").alias("doc_id")).agg(F.array(*counts).alias("n")).select("doc_id", F.get("n", F.col("doc_id") % len(SELECTORS)).alias("said"))


TRUTHS = [('"False"', False), ("true", True), ('"https://schema.org/True"', True), ("1", True), ('"no"', False), ("null", None), ('"maybe"', None), ("0", False)]


@register(f"SELECT doc_id AS page_id, {turns('doc_id', [v for _, v in TRUTHS])} AS is_free FROM documents")
def jsonld_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans as articles' JSON-LD writes them."""
    html = lines(spark, sf_dir, '<script type="application/ld+json">/*<![CDATA[*/{"@graph": [{"@type": "Person"}, {"@type": ["Thing", "NewsArticle"], "articleBody": " b ", "isAccessibleForFree": ', pick("doc_id", [t for t, _ in TRUTHS]), "}]}/*]]>*/</script>")
    return pages.jsonld_articles(html.select(F.col("doc_id").alias("page_id"), "html")).where("body = 'b'").select("page_id", "is_free")
