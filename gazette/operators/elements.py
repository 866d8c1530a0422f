"""Pages as tables of elements, and what distilling does with them: expressions, sums and windows over rows, none of them by page in
Python.

table() turns pages into rows in document order: an open and a close row for each element, a row for each text. `pos` numbers them,
`el` is the place where the row's element begins, `last` the one where it ends, so an element's content is an interval:

* what lies in an element is summed by running sums, read off where it opens and where it closes;
* an element is inside some other one of a kind if more of these were opened than closed before it;
* elements go, with all that is in them, by a running maximum of the last places of those that go.

All windows are by page, so the rows are dealt out once; each is linear in a page's rows, however deep its elements are nested. A page
is at most one html text, so the rows of a page, and no others, are together.

A word belongs to the element in which it begins. White space is that of ASCII; pages without html have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gazette.functions import markup, text, urls

ROW = "event string, pos int, el int, last int, home int, depth int, tag string, attributes map<string,string>, said string, sep int, letters int, parts int, begun int, linked boolean"
#: Rows of an Arrow batch, about as many of a task, and how many tasks' rows are read in one.
ROWS, TASK_ROWS, READ_TASKS = 16384, 1 << 16, 16
SPACE = r"[ \t\n\x0B\f\r]+"


def table(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, the columns to keep (of strings) and ROW of every element and text of pages (page_id, html)."""
    import pyarrow as pa

    fields = (("event", pa.string()), ("pos", pa.int32()), ("el", pa.int32()), ("last", pa.int32()), ("home", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("said", pa.string()), ("sep", pa.int32()), ("letters", pa.int32()), ("parts", pa.int32()), ("begun", pa.int32()), ("linked", pa.bool_()))
    names = ["page_id", *keep, *[n for n, _ in fields]]

    def made(batch, at, rows):
        for a in range(0, len(rows), ROWS):
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows[a : a + ROWS], strict=True), fields, strict=True)]
            mine = pa.array(at[a : a + ROWS], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(mine), *[batch.column(2 + i).take(mine) for i in range(len(keep))], *columns], names)

    def run(batches):
        # a batch holds the rows of many pages: one of each page would cost more than reading it
        for batch in batches:
            at, held = [], []
            for k in range(len(batch)):
                found = markup.rows(batch.column(1)[k].as_py())
                at.extend([k] * len(found))
                held.extend(found)
                if len(held) >= ROWS:
                    yield from made(batch, at, held)
                    at, held = [], []
            yield from made(batch, at, held)

    # tasks grow in number with the markup, not in size: each step's windows sort a task's rows anew. Pages are dealt out before they
    # are read, too, as reading costs most and a file may be scanned in one task
    signs = pages.agg(F.sum(F.octet_length("html") - F.octet_length(F.replace(F.col("html"), F.lit("<"))))).first()[0] or 0
    least, many = pages.sparkSession.sparkContext.defaultParallelism, -(-2 * signs // TASK_ROWS)
    kind = pages.schema["page_id"].dataType.simpleString()
    dealt = pages.select("page_id", "html", *keep).repartition(max(least, -(-many // READ_TASKS)), "page_id")
    rows = dealt.mapInArrow(run, f"page_id {kind}, " + "".join(f"{c} string, " for c in keep) + ROW)
    return rows.repartition(max(least, many), "page_id")


def in_page() -> WindowSpec:
    """A page's rows in order."""
    return Window.partitionBy("page_id").orderBy("pos")


def upto() -> WindowSpec:
    return in_page().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return in_page().rowsBetween(Window.unboundedPreceding, -1)


def of_page() -> WindowSpec:
    return Window.partitionBy("page_id")


def of_element() -> WindowSpec:
    return Window.partitionBy("page_id", "el")


def opens(condition: Column) -> Column:
    """Rows where an element that the condition holds for begins."""
    return (F.col("event") == markup.OPEN) & F.coalesce(condition, F.lit(False))


def is_tag(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def covered(rows: DataFrame, chosen: Column, name: str) -> DataFrame:
    """rows with a column that says whether a row lies in, or is, an element for which chosen holds."""
    return rows.withColumn(name, F.coalesce(F.max(F.when(opens(chosen), F.col("last"))).over(upto()) >= F.col("pos"), F.lit(False)))


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """rows but for the elements for which gone holds, and what is in them."""
    return covered(rows, gone, "_in").where(~F.col("_in")).drop("_in")


def inside(condition: Column) -> Column:
    """Whether a row lies in an element for which the condition, on tag and attributes, holds. A close row lies in its own."""
    moved = F.when((F.col("event") == markup.OPEN) & condition & (F.col("last") > F.col("pos")), 1).when((F.col("event") == markup.CLOSE) & condition, -1).otherwise(0)
    return F.coalesce(F.sum(moved).over(before()), F.lit(0)) > 0


def marked(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """rows with a column that holds the condition's value where an element opens, for all rows of that element."""
    return rows.withColumn(name, F.coalesce(F.max(F.when(F.col("event") == markup.OPEN, condition)).over(of_element()), F.lit(False)))


def totals(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with a column for each value: its sum over what an element holds, on the rows of that element."""
    running = {f"_sum_{k}": F.sum(F.coalesce(v, F.lit(0))).over(upto()) for k, v in values.items()}
    at = lambda k, event: F.max(F.when(F.col("event") == event, F.col(f"_sum_{k}"))).over(of_element())
    out = rows.withColumns(running).withColumns({k: F.coalesce(at(k, markup.CLOSE) - at(k, markup.OPEN), F.lit(0)) for k in values})
    return out.drop(*running)


def length(letters: str, begun: str) -> Column:
    """Characters of a text with one space between words."""
    return F.greatest(F.col(letters) + F.col(begun) - 1, F.lit(0))


def without_furniture(rows: DataFrame, chrome: tuple[str, ...], named: str) -> DataFrame:
    """Elements that are never content go, and those whose own class or id has a name of furniture; bracketed variants of class
    names don't count."""
    names = F.regexp_replace(F.lower(F.concat_ws(" ", F.col("attributes")["class"], F.col("attributes")["id"])), r"\[[^\]]*\]", " ")
    return without(rows, is_tag(*chrome) | ((F.col("tag") != "body") & names.rlike(named)))


def with_links(rows: DataFrame) -> DataFrame:
    """rows with the sums of an element's links, and of letters and words in it and in its links."""
    return totals(rows, n_links=opens(is_tag("a")).cast("int"), n_letters=F.col("letters"), n_words=F.col("begun"), l_letters=F.when(F.col("linked"), F.col("letters")), l_words=F.when(F.col("linked"), F.col("begun")))


LINKS = ("n_links", "n_letters", "n_words", "l_letters", "l_words")


def link_lists(ceiling: float = 0.5, least: int = 3, other: int = 400) -> Column:
    """Containers with three links or more, under 400 other characters, and mostly link text."""
    every, linked = length("n_letters", "n_words"), F.greatest(F.col("l_letters") + F.col("l_words") - F.col("n_links"), F.lit(0))
    return is_tag("div", "section", "aside", "nav", "ul", "ol") & (F.col("n_links") >= least) & (every > 0) & (every - linked < other) & (linked > every * ceiling)


def without_link_lists(rows: DataFrame) -> DataFrame:
    """Containers that are mostly links go."""
    return without(with_links(rows), link_lists()).drop(*LINKS)


def without_runs(rows: DataFrame, share: float = 0.85, least: int = 3) -> DataFrame:
    """with_links() rows without runs of three paragraphs or more that are one link each."""
    paragraph = opens(is_tag("p"))
    single = paragraph & (F.col("n_links") == 1) & (F.col("l_letters") > 0) & (length("l_letters", "l_words") >= length("n_letters", "n_words") * share)
    rows = rows.withColumn("_single", single).withColumn("_run", F.sum((paragraph & ~F.col("_single")).cast("int")).over(upto()))
    rows = rows.withColumn("_many", F.sum(F.col("_single").cast("int")).over(Window.partitionBy("page_id", "_run")))
    return without(rows, F.col("_single") & (F.col("_many") >= least)).drop("_single", "_run", "_many")


def without_link_runs(rows: DataFrame) -> DataFrame:
    """Runs of three paragraphs or more that are one link each go."""
    return without_runs(with_links(rows)).drop(*LINKS)


def without_links(rows: DataFrame) -> DataFrame:
    """Both, on one set of sums: no container stands in a paragraph, so paragraphs' sums outlast the lists."""
    return without_runs(without(with_links(rows), link_lists())).drop(*LINKS)


def without_short(rows: DataFrame, least: int = 25) -> DataFrame:
    """Paragraphs and items of few characters without a mark of punctuation go; empty ones stay."""
    rows = totals(rows, n_letters=F.col("letters"), n_words=F.col("begun"), n_marks=F.when(F.col("tag") == "#text", F.regexp_count("said", F.lit("[.?!:]"))))
    short = is_tag("p", "li") & (F.col("n_letters") > 0) & (length("n_letters", "n_words") < least) & (F.col("n_marks") == 0)
    return without(rows, short).drop("n_letters", "n_words", "n_marks")


def pieces() -> Column:
    """A text with a space before it if it doesn't go on with a word; for rows of texts in order."""
    return F.when(F.lag("sep").over(in_page()) == F.col("sep"), F.col("said")).otherwise(F.concat(F.lit(" "), F.col("said")))


def collapsed(said: Column) -> Column:
    return F.trim(F.regexp_replace(said, SPACE, " "))


def in_order(piece: str) -> Column:
    """A group's pieces one after another, by pos."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(piece).alias("piece")))), lambda x: x["piece"]), "")


def texts(rows: DataFrame) -> DataFrame:
    """page_id and said: the text of each page that has any, words apart by one space."""
    leaves = rows.where("tag = '#text'").withColumn("_piece", pieces())
    return leaves.groupBy("page_id").agg(collapsed(in_order("_piece")).alias("said"))


def containers(rows: DataFrame, most_links: float = 0.5, block_cost: int = 8, least: int = 200) -> DataFrame:
    """The rows of each page's container that reads most like an article: of all blocks the one whose blocks are worth most together.
    A block is the text that an element holds outside of other blocks; it is worth its words, less those in links, less twice those
    in links beyond the share most_links, less block_cost. So prose adds and navigation takes away, and the best element is the
    largest one that takes in no more furniture than its prose is worth; of equal ones the last to begin. Pages whose best one is
    worth nothing, or has under `least` characters, have no rows."""
    block = opens(is_tag(*sorted(markup.BLOCK)))
    of = Window.partitionBy("page_id", F.when(F.col("event") == markup.TEXT, F.col("home")).when(block, F.col("el")))
    rows = rows.withColumns({"_n": F.sum("parts").over(of), "_links": F.sum(F.when(F.col("linked"), F.col("parts")).otherwise(0)).over(of)})
    value = F.when(block & (F.col("_n") > 0), F.col("_n") - 2 * F.greatest(F.lit(0), F.col("_links") - most_links * F.col("_n")) - F.col("_links") - block_cost)
    rows = totals(rows.withColumn("_value", F.coalesce(value, F.lit(0.0))), _below=F.col("_value"))
    rows = rows.withColumn("_best", F.max(F.when(block, F.struct((F.col("_below") + F.col("_value")).alias("worth"), "pos"))).over(of_page()))
    found = covered(rows, (F.col("pos") == F.col("_best.pos")) & (F.col("_best.worth") > 0), "_in").where("_in")
    chars = F.sum(F.col("letters") + F.col("begun")).over(of_page()) - 1
    return found.withColumn("_chars", chars).where(F.col("_chars") >= least).drop("_n", "_links", "_value", "_below", "_best", "_in", "_chars")


# ---- selectors


def is_step(tag: str | None, parts: list[tuple]) -> Column:
    """tag, .class, #id, [attribute], [attribute=value] and its *= ^= $= ~= forms, together, as a condition on a row."""
    out = F.col("tag") == tag if tag else ~F.startswith("tag", F.lit("#"))
    for name, ident, attribute, op, value in parts:
        have = F.col("attributes")[attribute.lower()] if attribute else F.col("attributes")["id" if ident else "class"]
        if name:
            one = F.array_contains(F.split(have, SPACE), name)
        elif ident:
            one = have == ident
        else:
            one = {"": have.isNotNull(), "=": have == value, "*=": F.contains(have, F.lit(value)), "^=": F.startswith(have, F.lit(value)), "$=": F.endswith(have, F.lit(value)), "~=": F.array_contains(F.split(have, SPACE), value)}.get(op, F.lit(False))
        out = out & one
    return F.coalesce(out, F.lit(False))


def selected(rows: DataFrame, selector: str, name: str) -> DataFrame:
    """rows with a column that says, on the rows of an element, whether the selector (alternatives by commas, descendants by spaces)
    finds it. Each step but the last is a running count of what is open."""
    found = F.lit(False)
    for k, alternative in enumerate(markup.steps(selector)):
        condition = is_step(*alternative[0])
        for j, step in enumerate(alternative[1:]):
            column = f"_{name}_{k}_{j}"
            rows = marked(rows.withColumn(column, is_step(*step) & inside(condition)), F.col(column), column)
            condition = F.col(column)
        found = found | condition
    return rows.withColumn(name, found).drop(*[c for c in rows.columns if c.startswith(f"_{name}_")])


def ruled(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """rows, by their rule_id, narrowed to the outermost elements of the first body selector that finds any on the page, then without
    what the strip selectors find and the texts that the patterns find: paragraphs and items by their own text, div, span and aside
    of up to 80 characters by all of theirs."""
    for r in rules:
        mine = F.coalesce(F.col("rule_id") == r["id"], F.lit(False))
        bodies = [f"_body{k}" for k in range(len(r["body_selectors"]))]
        for name, selector in zip(bodies, r["body_selectors"], strict=True):
            rows = selected(rows, selector, name)
        if bodies:
            first = F.coalesce(*[F.when(F.max(F.when(F.col("event") == markup.OPEN, F.col(b))).over(of_page()), F.lit(k)) for k, b in enumerate(bodies)])
            rows = rows.withColumn("_first", first)
            chosen = F.coalesce(*[F.when(F.col("_first") == k, F.col(b)) for k, b in enumerate(bodies)], F.lit(False))
            rows = covered(rows, chosen, "_in").where(~mine | F.col("_first").isNull() | F.col("_in")).drop(*bodies, "_first", "_in")
        for selector in r["strip_selectors"]:
            rows = without(selected(rows, selector, "_strip"), mine & F.col("_strip")).drop("_strip")
        if r["strip_text_patterns"]:
            pattern = "(?i)" + "|".join(f"(?:{p})" for p in r["strip_text_patterns"])
            rows = beginnings(rows, 80)
            own = Window.partitionBy("page_id", F.when(F.col("tag") == "#text", F.col("home")).when(F.col("event") == markup.OPEN, F.col("el")))
            rows = rows.withColumn("_own", collapsed(in_order_over("_piece", own, F.col("tag") == "#text")))
            told = F.when(is_tag("p", "li"), F.col("_own")).when(is_tag("div", "span", "aside") & (F.col("chars") <= 80), F.col("begins"))
            rows = without(rows, mine & told.rlike(pattern)).drop("_own", "begins", "chars", "_piece")
    return rows


def in_order_over(piece: str, window, which: Column) -> Column:
    """in_order() over a window, of some rows."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("pos", F.col(piece).alias("piece")))).over(window)), lambda x: x["piece"]), "")


# ---- what sites add


def beginnings(rows: DataFrame, most: int) -> DataFrame:
    """rows with _piece (a text with a space before it if it begins a word), chars (of an element's text) and begins: its first
    `most` characters. Texts that aren't blank have a character each, so as many texts hold them."""
    rows = totals(rows, n_letters=F.col("letters"), n_words=F.col("begun"))
    some = F.col("letters") > 0
    leaves = Window.partitionBy("page_id", some).orderBy("pos")
    rows = rows.withColumn("_piece", F.when(some & (F.lag("sep").over(leaves) == F.col("sep")), F.col("said")).otherwise(F.concat(F.lit(" "), F.col("said"))))
    short = F.regexp_replace("_piece", SPACE, " ").substr(1, most + 2)
    ahead = F.when(some, F.ltrim(F.regexp_replace(F.array_join(F.collect_list(short).over(leaves.rowsBetween(0, most)), ""), SPACE, " ")))
    rows = rows.withColumn("_ahead", ahead).withColumn("chars", length("n_letters", "n_words"))
    nearest = F.last("_ahead", True).over(Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    begins = F.when((F.col("event") == markup.OPEN) & (F.col("chars") > 0), F.substring(nearest, F.lit(1), F.least(F.col("chars"), F.lit(most)).cast("int")))
    return rows.withColumn("begins", begins).drop("n_letters", "n_words", "_ahead")


def without_site_lines(rows: DataFrame, patterns: dict[str, str], most: int = 80) -> DataFrame:
    """Elements whose text begins with a line that sites add go, by the column language: paragraphs and items of any length, others
    up to `most` characters; other languages change nothing."""
    rows = beginnings(rows, most)
    own = F.split(F.lower(F.trim("language")), "[-_]")[0]
    told = F.coalesce(*[F.when(own == la, F.col("begins").rlike(p)) for la, p in patterns.items()])
    holder = is_tag("p", "li") | (is_tag("div", "section", "span", "h1", "h2", "h3", "h4", "h5", "h6", "header", "aside", "a") & (F.col("chars") <= most))
    return without(rows, holder & told).drop("begins", "chars", "_piece")


def without_hero(rows: DataFrame) -> DataFrame:
    """Images that are the hero (column hero_url) again, by key, go with the figure or picture around them."""
    sources = F.concat(F.array(F.col("attributes")["src"]), F.coalesce(urls.srcset(F.col("attributes")["srcset"]), F.array().cast("array<string>")))
    same = is_tag("img", "picture", "source") & F.exists(sources, lambda u: urls.image_key(u) == urls.image_key(F.col("hero_url")))
    rows = rows.withColumn("_hero", F.coalesce(opens(same), F.lit(False)))
    rows = totals(rows, _heroes=F.col("_hero").cast("int"))
    return without(rows, F.col("_hero") | (is_tag("figure", "picture") & (F.col("_heroes") > 0))).drop("_hero", "_heroes")


def up_to_terminator(rows: DataFrame, phrases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows before the first phrase that ends articles of the language, wherever it stands in a text; captions, attributes and code
    don't count."""
    own = F.split(F.lower(F.trim("language")), "[-_]")[0]
    low = F.lower("said")
    found = lambda said: F.least(*[F.nullif(F.instr(low, p), F.lit(0)) for p in said], F.lit(None)) if len(said) > 1 else F.nullif(F.instr(low, said[0]), F.lit(0))
    at = F.coalesce(*[F.when(own == la, found(said)) for la, said in phrases.items()])
    rows = rows.withColumn("_caption", inside(is_tag("figure", "figcaption"))).withColumn("_at", F.when((F.col("tag") == "#text") & ~F.col("_caption"), at))
    rows = rows.withColumn("_cut", F.min(F.when(F.col("_at").isNotNull(), F.col("pos"))).over(of_page()))
    kept = rows.where(F.col("_cut").isNull() | (F.col("pos") <= F.col("_cut")) | ((F.col("event") == markup.CLOSE) & (F.col("el") < F.col("_cut"))))
    cut = F.when(F.col("pos") == F.col("_cut"), F.substring(F.col("said"), F.lit(1), F.col("_at") - 1)).otherwise(F.col("said"))
    return kept.withColumn("said", cut).drop("_at", "_cut", "_caption")


# ---- from rows back to texts


def escaped(x: Column, quotes: bool = False) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def rendered(rows: DataFrame) -> DataFrame:
    """page_id, html and said (the text) of each page's rows."""
    attributes = F.array_join(F.transform(F.map_entries("attributes"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escaped(a["value"], True), F.lit('"'))), "")
    opened = F.concat(F.lit("<"), F.col("tag"), attributes, F.lit(">"))
    part = F.when(F.col("event") == markup.OPEN, opened).when(F.col("event") == markup.CLOSE, F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise(F.when(F.col("tag") == "#code", F.col("said")).otherwise(escaped(F.col("said"))))
    leaves = Window.partitionBy("page_id", F.col("tag") == "#text").orderBy("pos")
    piece = F.when(F.col("tag") == "#text", F.when(F.lag("sep").over(leaves) == F.col("sep"), F.col("said")).otherwise(F.concat(F.lit(" "), F.col("said"))))
    rows = rows.withColumns({"_part": part, "_piece": piece})
    join = lambda c: F.array_join(F.transform(F.col("_all"), lambda x: x[c]), "")
    out = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_part").alias("part"), F.coalesce("_piece", F.lit("")).alias("piece")))).alias("_all"))
    return out.select("page_id", join("part").alias("html"), collapsed(join("piece")).alias("said"))


def blocks(rows: DataFrame) -> DataFrame:
    """page_id, pos (from 0), kind, level, text, items, url, alt, ordered of the blocks of rows (with url, the page's): headings, lists,
    quotes and code are the outermost such elements; between them, and between edges of other blocks, texts make paragraphs; an
    image outside of the former is a block."""
    whole = is_tag("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre")
    rows = rows.where(~is_tag("#code"))
    earlier = F.max(F.when(opens(whole), F.col("last"))).over(before())
    rows = rows.withColumn("_outer", opens(whole) & F.coalesce(earlier < F.col("pos"), F.lit(True)))
    outer = F.last(F.when(F.col("_outer"), F.struct("el", "last", "tag", "depth")), True).over(upto())
    rows = rows.withColumn("_o", outer).withColumn("_o", F.when(F.col("_o.last") >= F.col("pos"), F.col("_o")))
    # an image's, or any block's, edge and a line break end a paragraph
    edge = ((F.col("event") != markup.TEXT) & is_tag(*sorted(markup.BLOCK))) | opens(is_tag("br", "img", "picture"))
    rows = rows.withColumn("_run", F.sum(edge.cast("int")).over(upto()))
    child = F.last(F.when(F.col("_o").isNotNull() & (F.col("event") == markup.OPEN) & (F.col("depth") == F.col("_o.depth") + 1), F.struct("el", "last", "tag")), True).over(upto())
    rows = rows.withColumn("_child", child).withColumn("_item", F.when((F.col("_child.tag") == "li") & (F.col("_child.last") >= F.col("pos")) & (F.col("_child.el") > F.col("_o.el")), F.col("_child.el")))
    leaves = Window.partitionBy("page_id", F.col("tag") == "#text").orderBy("pos")
    rows = rows.withColumn("_piece", F.when(F.lag("sep").over(leaves) == F.col("sep"), F.col("said")).otherwise(F.concat(F.lit(" "), F.col("said"))))
    source = F.coalesce(F.nullif(F.col("attributes")["src"], F.lit("")), F.get(urls.srcset(F.col("attributes")["srcset"]), 0))
    image = opens(is_tag("img")) & F.col("_o").isNull() & source.isNotNull()
    rows = rows.withColumn("_image", image)
    used = rows.where((F.col("tag") == "#text") | F.col("_image"))
    key = F.when(F.col("_o").isNotNull(), F.struct(F.lit(0).alias("k"), F.col("_o.el").cast("long").alias("n"))).when(F.col("_image"), F.struct(F.lit(1).alias("k"), F.col("pos").cast("long").alias("n"))).otherwise(F.struct(F.lit(2).alias("k"), F.col("_run").alias("n")))
    used = used.withColumns({"_key": key, "_src": F.when(F.col("_image"), urls.resolve(source, F.col("url"))), "_alt": F.when(F.col("_image"), F.nullif(F.col("attributes")["alt"], F.lit("")))})
    part = F.struct("pos", F.when(F.col("tag") == "#text", F.col("_piece")).alias("piece"), F.col("said").alias("raw"), F.col("_item").alias("item"))
    found = used.groupBy("page_id", "_key").agg(F.min("pos").alias("at"), F.first("_o.tag").alias("tag"), F.first("_src").alias("url"), F.first("_alt").alias("alt"), F.array_sort(F.collect_list(part)).alias("parts"))
    said = collapsed(F.array_join(F.transform("parts", lambda x: x["piece"]), ""))
    raw = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["raw"]), ""), r"^\n+|\n+$", "")
    ids = F.array_distinct(F.filter(F.transform("parts", lambda x: x["item"]), lambda i: i.isNotNull()))
    items = F.filter(F.transform(ids, lambda i: collapsed(F.array_join(F.transform(F.filter("parts", lambda x: x["item"] == i), lambda x: x["piece"]), ""))), lambda x: x != "")
    listed = F.col("tag").isin("ul", "ol")
    kind = F.when(F.col("tag").isNull(), F.when(F.col("_key.k") == 1, "image").otherwise("paragraph")).when(listed, "list").when(F.col("tag") == "blockquote", "quote").when(F.col("tag") == "pre", "code").otherwise("heading")
    found = found.select("page_id", "at", kind.alias("kind"), F.when(kind == "heading", F.substring("tag", 2, 1).cast("int")).alias("level"), F.when(kind == "code", raw).when(~kind.isin("list", "image"), said).alias("text"), F.when(listed, items).alias("items"), "url", "alt", F.when(listed, F.col("tag") == "ol").alias("ordered"))
    full = found.where((F.col("kind") == "image") & F.col("url").isNotNull() | (F.col("kind") == "list") & (F.size("items") > 0) | ~F.col("kind").isin("image", "list") & (F.trim(F.regexp_replace("text", SPACE, " ")) != ""))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return full.select("page_id", pos.cast("int").alias("pos"), "kind", "level", "text", "items", "url", "alt", "ordered")


def runs(rows: DataFrame) -> DataFrame:
    """page_id, pos (from 0), text, kinds (link, strong, em, code; outermost first) and url of the inline runs of rows: neighbouring
    texts of the same kinds and address are one; white space is collapsed, blank runs are left out."""
    names = {"link": ("a",), "strong": ("strong", "b"), "em": ("em", "i"), "code": ("code",)}
    rows = rows.where(~is_tag("#code"))
    for kind, tags in names.items():
        moved = F.when((F.col("event") == markup.OPEN) & is_tag(*tags), 1).when((F.col("event") == markup.CLOSE) & is_tag(*tags), -1).otherwise(0)
        rows = rows.withColumn(f"_{kind}", F.sum(moved).over(upto()))
        rows = rows.withColumn(f"_{kind}_at", F.when(F.col(f"_{kind}") > 0, F.last(F.when(opens(is_tag(*tags)) & (F.col(f"_{kind}") == 1), F.col("pos")), True).over(upto())))
    around = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"_{k}_at").alias("at"), F.lit(k).alias("kind")) for k in names]), lambda x: x["at"].isNotNull()))
    href = F.when(F.col("_link") > 0, F.last(F.when(opens(is_tag("a")), F.struct(F.col("attributes")["href"].alias("href"))), True).over(upto())["href"])
    rows = rows.withColumns({"kinds": F.transform(around, lambda x: x["kind"]), "url": href}).where("tag = '#text'")
    new = (F.lag("kinds").over(in_page()) == F.col("kinds")) & F.lag("url").over(in_page()).eqNullSafe(F.col("url"))
    rows = rows.withColumn("_new", (~F.coalesce(new, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(upto())).withColumn("_said", F.regexp_replace("said", SPACE, " "))
    out = rows.groupBy("page_id", "_run").agg(in_order("_said").alias("text"), F.first("kinds").alias("kinds"), F.first("url").alias("url")).where(F.trim("text") != "")
    return out.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("_run")) - 1).cast("int").alias("pos"), "text", "kinds", "url")
