"""HTML extraction by layout-aware rendering: a tree with implied tags, visibility rules, and text as it would be laid out.

All visible text is emitted: blocks on lines of their own (paragraphs, headings, lists, tables and quotes apart by a blank
line), list items marked and indented, table cells in columns of equal width, preformatted text as it is. Nothing is judged
to be boilerplate. Pages are rows; Spark deals them out, and a page is parsed in one pass over its tokens.

Hidden are elements that are never shown, that have the attribute `hidden`, or whose display or visibility says so, in their own
style or in the page's style sheets (rules for all media or screens, by tag, class and id; of several that fit, the most specific and
last counts; rules with combinators, pseudo-classes or attributes hide nothing). What only assistive tools skip is shown. Buttons and
fields show their values. Cells that span rows keep their place in the rows below.

Defined results: a null page is an empty text; an item that begins with a list shows that list's marks only; markup that never ends is
text; unknown tags are inline; white space that folds is that of style sheets, so no-break spaces stay; elements may be nested to any
depth (each list item and quote indents its lines, so a page's text grows with depth times lines); annotations of formulas are not
shown; repeated rows each get a row.
"""

from __future__ import annotations

import html
import re
from bisect import bisect, bisect_left
from collections import defaultdict
from collections.abc import Generator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_MARKUP = re.compile(r"[!?]|/?[A-Za-z]")
_NAME_END = re.compile(r"[\s/>]")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
UNSEEN = frozenset("head script style title template noscript iframe object embed svg canvas audio video meta link datalist noembed noframes area".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address li dt dd tr td th thead tbody tfoot caption figcaption details summary legend center dir menu optgroup option".split())
LISTS = frozenset({"ul", "ol", "menu", "dir"})
#: A start tag (key) ends open elements of the first set, unless one of the second set is met before.
_TABLE = frozenset({"table"})
_CELLS, _ROWS, _PARTS = frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"})
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "option": (frozenset({"option"}), frozenset({"select", "optgroup"})), "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (_CELLS, _TABLE | _ROWS), "th": (_CELLS, _TABLE | _ROWS), "tr": (_CELLS | _ROWS, _TABLE), "thead": (_CELLS | _ROWS | _PARTS, _TABLE), "tbody": (_CELLS | _ROWS | _PARTS, _TABLE), "tfoot": (_CELLS | _ROWS | _PARTS, _TABLE), "body": (frozenset({"head"}), frozenset()),
}
_CLOSES_P = (BLOCK | {"hr"}) - frozenset("html body td th tr thead tbody tfoot caption option optgroup".split())
_P, _P_STOP = frozenset({"p"}), frozenset("table td th button li dd dt body".split())
#: An end tag passes over cells and tables only if it is one of these.
_CELL, _THROUGH = frozenset({"td", "th", "table"}), frozenset("table tr tbody thead tfoot body html".split())
#: Parts of a formula that are not shown.
_NOTES = frozenset({"annotation", "annotation-xml"})
#: Bounds of the layout, see above.
PADDED, SPARE, NESTED, INDENT, COLUMNS = 4, 2000, 8, 400, 1000
_ZEROS, _LONG = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


#: White space that folds.
WHITE, _FOLDED = " \t\n\r\f", re.compile(r"[ \t\n\r\f]+")
#: Fields that show their value.
SHOWN = frozenset("submit reset button text search email url tel number date time".split())
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    """An element: tag, attributes, parts (strings and elements)."""

    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.parts = tag, attributes, []

    def seen(self) -> bool:
        a = self.attributes
        if self.tag in UNSEEN or "hidden" in a or (self.tag == "dialog" and "open" not in a):
            return False
        return not ("style" in a and HIDDEN.search(a["style"]))


def unescaped(said: str) -> str:
    """Character references resolved; numbers of any length."""
    if "&" not in said:
        return said
    return html.unescape(_LONG.sub("\ufffd", _ZEROS.sub("&#", said)) if "&#" in said else said)


def span(said: str, most: int = 1000) -> int:
    """The value of a colspan or rowspan, 1 to `most`."""
    digits = re.match(r"[ \t\n\f\r]*\+?0*([0-9]*)", said)[1]
    return max(1, min(int(digits[:6] or 0), most))


def sheet(source: str) -> list[tuple[str, str]]:
    """Selectors and declarations of a style sheet's rules that hold on screens: what stands in other at-rules is passed over."""
    out, at, n, deep = [], 0, len(source), 0
    source = re.sub(r"/\*.*?(?:\*/|\Z)", " ", source, flags=re.S)
    while (begin := source.find("{", at)) >= 0:
        close = source.find("}", at)
        if 0 <= close < begin:  # the end of a media rule
            at, deep = close + 1, max(0, deep - 1)
            continue
        head = source[at:begin].rpartition(";")[2].strip()
        if head.startswith("@"):
            if re.fullmatch(r"@media\s+(?:(?:only\s+)?screen|all)", head, re.I):
                at, deep = begin + 1, deep + 1
                continue
            at, open_braces = begin + 1, 1
            for m in re.compile(r"[{}]").finditer(source, at):
                open_braces += 1 if m[0] == "{" else -1
                at = m.end()
                if not open_braces:
                    break
            else:
                break
            continue
        end = source.find("}", begin)
        out.append((head, source[begin + 1 : end if end >= 0 else n]))
        if end < 0:
            break
        at = end + 1
    return out


class Rules:
    """Which elements the page's style sheets hide."""

    def __init__(self, sheets: list[str]):
        self.by: dict[tuple[str, str], list] = defaultdict(list)  # by the class, id or tag that a selector names last
        for order, (head, body) in enumerate(r for s in sheets for r in sheet(s)):
            said = {k.lower(): v.lower() for k, v in _DECLARED.findall(body)}
            for selector in head.split(",") if said else []:
                m = _COMPOUND.match(selector.strip())
                if m and m[0]:
                    tag, names = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                    key = ("name", names[-1]) if names else ("tag", tag)
                    self.by[key].append(((sum(x[0] == "#" for x in names), len(names), tag != "*", order), tag, frozenset(names), said))

    def hide(self, node: Node) -> bool:
        a = node.attributes
        names = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
        found = [r for key in (("tag", "*"), ("tag", node.tag), *(("name", x) for x in names)) for r in self.by.get(key, ()) if r[1] in ("*", node.tag) and r[2] <= names]
        said: dict[str, str] = {}
        for *_, one in sorted(found, key=lambda r: r[0]):
            said |= one
        said |= {k.lower(): v.lower() for k, v in _DECLARED.findall(a.get("style", ""))}
        return said.get("display") == "none" or said.get("visibility") in ("hidden", "collapse")


class TagEnds:
    """Where tags end, for pages in which some never do: found for the whole page at once, so that such tags, however many
    there are, are not each searched to the end of the page."""

    def __init__(self, source: str):
        self.source, self.stop = source, -1
        self.places, self.ends = [], []
        coming, after = {'"': -1, "'": -1}, -1  # the end met after the nearest quote of each kind, and after the nearest mark
        for m in reversed(list(re.finditer("[>\"']", source))):
            c = m[0]
            end = m.start() if c == ">" else coming[c]
            if c != ">":
                coming[c] = after
            after = end
            self.places.append(m.start())
            self.ends.append(end)
        self.places.reverse()
        self.ends.reverse()
        self.last = source.rfind(">")

    def ended(self, at: int) -> bool:
        """Whether the markup that begins at `at` has an end."""
        begin = at + 1 + (self.source[at + 1 : at + 2] == "/")
        first = self.source[begin : begin + 1]
        if not (first.isascii() and first.isalpha()):
            return self.source.startswith("<!--", at) or self.last > at
        if self.stop < begin:  # the name ends here
            m = _NAME_END.search(self.source, begin)
            self.stop = m.start() if m else len(self.source)
        k = bisect_left(self.places, self.stop)
        return k < len(self.ends) and self.ends[k] >= 0


def attributes(source: str) -> dict[str, str]:
    """Names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        value = next((v for v in values if v), "")
        out.setdefault(name.lower(), unescaped(value))
    return out


def tree(source: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(source)
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements by tag, rising
    ends, sheets = None, []

    def cut(to: int) -> None:
        while len(stack) > to:
            places[stack.pop().tag].pop()

    def last(tags: frozenset) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: frozenset, stop: frozenset) -> None:
        """Close open elements down to the outermost of tags that no element of stop covers."""
        held = last(stop)
        found = [p[k] for t in tags if (p := places.get(t)) and (k := bisect(p, held)) < len(p)]
        if found:
            cut(min(found))

    while at < n:
        if ends and source[at] == "<" and not ends.ended(at):
            stack[-1].parts.append("<")
            at += 1
            continue
        m = TOKEN.match(source, at)
        at, tag = m.end(), m[2]
        if tag is None:
            said = m[0]
            if said == "<" and ends is None and _MARKUP.match(source, at):
                ends = TagEnds(source)
            if said[0] != "<" or said == "<":
                stack[-1].parts.append(unescaped(said))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br", {}))
            if (mine := places.get(tag)) and (tag in _THROUGH or mine[-1] >= last(_CELL)):
                cut(mine[-1])
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in _CLOSES_P:
            close(_P, _P_STOP)
        node = Node(tag, attributes(m[3]) if m[3] and ("=" in m[3] or "hidden" in m[3] or "open" in m[3]) else {})
        if tag in _NOTES and places.get("math"):
            node.attributes["hidden"] = ""
        stack[-1].parts.append(node)
        if tag in RAW:
            end = RAW[tag].search(source, at)
            stop = end.start() if end else n
            if tag in ("textarea", "xmp"):
                node.parts.append(unescaped(source[at:stop]))
            elif tag == "style":
                sheets.append(source[at:stop])
            at = source.find(">", stop) + 1 or n
        elif tag not in VOID and not m[3].endswith("/"):
            places[tag].append(len(stack))
            stack.append(node)
    rules = Rules(sheets)
    todo = [root] if rules.by else []
    while todo:
        node = todo.pop()
        if rules.hide(node):
            node.attributes["hidden"] = ""
        else:
            todo += [p for p in node.parts if isinstance(p, Node)]
    return root


class Page:
    """Lines laid out so far."""

    def __init__(self, tables: int = 0):
        self.tables = tables  # that the page is a cell of
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False
        self.first, self.rest = "", ""  # what the next line, and those after it, begin with

    def text(self, said: str, pre: bool) -> None:
        if pre:
            for k, line in enumerate(said.split("\n")):
                if k:
                    self.line(True)
                if line:
                    self.put(line.expandtabs(4))
            return
        words = _FOLDED.sub(" ", said).strip(" ")
        if not words:
            self.space = self.space or bool(said and self.now)
            return
        if said[0] in WHITE or self.space:
            self.space = bool(self.now)
        self.put((" " if self.space and self.now else "") + words)
        self.space = said[-1] in WHITE

    def put(self, said: str) -> None:
        if not self.now and self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.now.append(said)

    def line(self, always: bool = False) -> None:
        """End the line if there is one."""
        if self.now or always:
            self.lines.append((self.first + "".join(self.now)).rstrip(WHITE))
            self.first, self.now = self.rest, []
        self.space = False

    def out(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def finished(job: Generator):
    """What a job returns. A job yields the jobs that it waits for; they wait on a list, so depth is no matter of recursion."""
    waiting, said = [job], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(said))
            said = None
        except StopIteration as end:
            waiting.pop()
            said = end.value
    return said


def lay(node: Node, page: Page, pre: bool = False) -> Generator:
    """A job that lays out the parts of a visible element."""
    items = int(node.attributes["start"]) if node.tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", node.attributes.get("start", "")) else 1
    for part in node.parts:
        if isinstance(part, str):
            page.text(part, pre)
        elif part.tag == "br":
            page.line(True)
        elif part.tag == "input":
            if part.seen() and part.attributes.get("type", "text").lower() in SHOWN:
                page.text(part.attributes.get("value", ""), False)
        elif part.seen():
            tag = part.tag
            if tag == "table" and page.tables < NESTED:
                page.line()
                page.gap = True
                for line in (yield table(part, page.tables + 1)):
                    page.put(line)
                    page.line()
                page.gap = True
                continue
            if tag not in BLOCK:
                yield lay(part, page, pre)
                continue
            page.line()
            apart = tag in APART and not (tag in LISTS and node.tag == "li")  # a list in an item stays with it
            page.gap = page.gap or apart
            held, printed = (page.first, page.rest), len(page.lines)
            if tag == "li":
                mark = f"{items}. " if node.tag == "ol" else "- "
                items += 1
                page.first, page.rest = page.rest + mark, (page.rest + " " * len(mark))[:INDENT]
            elif tag in ("blockquote", "dd"):
                more = "> " if tag == "blockquote" else "  "
                page.first, page.rest = (page.first + more)[:INDENT], (page.rest + more)[:INDENT]
            yield lay(part, page, pre or tag == "pre")
            page.line()
            page.first, page.rest = held[1] if len(page.lines) > printed else held[0], held[1]
            page.gap = page.gap or apart


def table(node: Node, depth: int) -> Generator:
    """A job for the lines of a table: its caption, and rows with cells in columns of equal width. A cell's own lines stay apart."""
    rows, todo = [], [node]
    below: dict[int, int] = {}  # columns that a cell above still takes up, and in how many rows

    def free(cells: list) -> None:
        """Blank cells where cells above reach down."""
        while below.get(len(cells), 0) > 0 and len(cells) < COLUMNS:
            below[len(cells)] -= 1
            cells.append([""])

    while todo:
        at = todo.pop()
        if at.tag == "tr":
            cells = []
            for c in at.parts:
                if isinstance(c, Node) and c.tag in ("td", "th") and c.seen():
                    free(cells)
                    inner = Page(depth)
                    yield lay(c, inner)
                    wide, down = min(span(c.attributes.get("colspan", "1")), max(1, COLUMNS - len(cells))), span(c.attributes.get("rowspan", "1"), 65534)
                    if down > 1:
                        below |= {k: max(below.get(k, 0), down - 1) for k in range(len(cells), min(len(cells) + wide, COLUMNS))}
                    cells += [inner.out().split("\n")] + [[""]] * (wide - 1)
                elif isinstance(c, Node) and c.seen() or isinstance(c, str) and c.strip():
                    inner = Page(depth)  # what stands between cells
                    holder = Node("td", {})
                    holder.parts.append(c)
                    yield lay(holder, inner)
                    cells += [inner.out().split("\n")] if inner.lines else []
            begun = len(cells)
            below = {k: v - (k >= begun) for k, v in below.items() if v - (k >= begun) > 0}  # cells that reach past this row's end
            while len(cells) > 1 and cells[-1] == [""]:
                cells.pop()
            rows.append(cells)
        elif at.tag == "caption" or at.tag not in ("table", "thead", "tbody", "tfoot"):
            inner = Page(depth)
            yield lay(at, inner)
            rows.append([inner.out().split("\n")] if inner.lines or inner.now else [])
        else:
            for c in reversed(at.parts):
                if isinstance(c, str):
                    if c.strip():
                        holder = Node("caption", {})
                        holder.parts.append(c)
                        todo.append(holder)
                elif c.seen() and c.tag not in ("colgroup", "col"):
                    todo.append(c)
    return [line for line in (aligned(rows) or apart(rows)) if line]


def aligned(rows: list[list[list[str]]]) -> list[str] | None:
    """Cells in columns; None where padding would swell the text."""
    widths: list[int] = []
    for cells in rows:
        if len(cells) > 1:
            for k, cell in enumerate(cells):
                widths[k : k + 1] = [max([len(x) for x in cell] + widths[k : k + 1])]
    upto = [0]
    for w in widths:
        upto.append(upto[-1] + w + 2)
    padded = sum(max(map(len, cells)) * upto[len(cells)] for cells in rows if len(cells) > 1)
    if padded > SPARE and padded > SPARE + PADDED * sum(len(x) - x.count(" ") for cells in rows if len(cells) > 1 for cell in cells for x in cell):
        return None
    lines = []
    for cells in rows:
        for k in range(max((len(c) for c in cells), default=0)):
            line = [c[k] if k < len(c) else "" for c in cells]
            lines.append("  ".join(x.ljust(widths[j]) if len(line) > 1 else x for j, x in enumerate(line)).rstrip())
    return lines


def apart(rows: list[list[list[str]]]) -> list[str]:
    """Cells without columns: short ones two spaces apart, others on lines of their own."""
    lines = []
    for cells in rows:
        if all(len(c) == 1 for c in cells):
            lines.append("  ".join(c[0] for c in cells if c[0]))
        else:
            lines += [x.rstrip() for c in cells for x in c]
    return lines


def rendered(source: str | None) -> str:
    """The visible text of a page as laid out."""
    page = Page()
    finished(lay(tree((source or "").replace("\r\n", "\n").replace("\r", "\n")), page))
    return page.out()


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every page."""
    import pyarrow as pa


    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rendered(x) for x in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return only(pages, "page_id", "html").mapInArrow(run, f"page_id {kind}, text string")


def op7_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, with its size."""
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
