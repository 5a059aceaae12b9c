"""Visible text of HTML pages: a tree builder with implied tags, then a layout-aware renderer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+/$")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[{};]|[^{};\"']++|[\"']", re.DOTALL)
_AT = re.compile(r"@([\w-]+)\s*(.*)", re.DOTALL)
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$", re.IGNORECASE)

# Element names of the HTML standard, by their part in building and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style title template iframe noembed noframes object audio video canvas datalist".split())
#: Elements of drawings and formulas that are not shown where they stand; they and a drawing's texts are named after both.
_FOREIGN = {"svg": frozenset("defs desc metadata symbol marker clippath mask pattern".split()), "math": frozenset(("annotation", "annotation-xml"))}
NEVER_SHOWN |= {f"{x} {tag}" for x, tags in _FOREIGN.items() for tag in tags}
_OF_FOREIGN = frozenset(("text",)).union(*_FOREIGN.values())
#: Media queries that hold on a screen, whatever its size.
ON_SCREEN = frozenset(("", "all", "screen", "only all", "only screen", "not print", "not speech"))
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure fieldset form address menu dir".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main li dt dd tr td th caption thead tbody tfoot figcaption details summary legend center dialog option hgroup search optgroup".split()) | {"svg text"}
CLOSES_P = BLOCK - frozenset("html body td th tr caption thead tbody tfoot option optgroup legend".split())
CELLS = frozenset(("td", "th"))
#: Start tag -> the open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th")))),
    **dict.fromkeys(("td", "th"), (CELLS, frozenset(("table", "tr")))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption")), frozenset(("table",)))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
_IN_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: The most columns and rows that a cell may span, as the HTML standard has them.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Layout has bounds, so that the text stays in proportion to the page; no text is lost by them.  Lists are indented up to
#: so many levels; a column is padded to so many characters at most, and a row up to so many in all (beyond, cells stand
#: two spaces apart); cells that begin beyond MOST_COLUMNS keep no column in the rows below.
MOST_LEVELS, WIDEST, LINE = 16, 120, 400


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs else {}


def build(html: str) -> Node:
    """The element tree; text children are strings, character references resolved.

    places has the depths at which each tag is open, so that an open element is found without a walk down the stack.
    """
    root = Node("html")
    stack, names, places = [root], ["html"], {"html": [0]}

    def close(k: int):
        for name in names[k:]:
            places[name].pop()
        del stack[k:], names[k:]

    def last(tags) -> int:
        return max((p[-1] for t in tags if (p := places.get(t))), default=0)

    def find(wanted, barrier) -> int:
        k = last(wanted)
        return k if k and k >= last(barrier) else 0

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        m = _TOKEN.match(html, lt) if lt >= 0 else None
        while lt >= 0 and not m:  # a lone "<" is text
            lt = html.find("<", lt + 1)
            m = _TOKEN.match(html, lt) if lt >= 0 else None
        end = lt if lt >= 0 else n
        if end > at:
            text = html[at:end]
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not find(("p",), CELLS):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                k = find((tag,), frozenset(("table",)) if tag in _IN_TABLE and tag != "table" else frozenset() if tag == "table" else CELLS)
                if k:
                    close(k)
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attrs = m[3] if m[2] else m[5]
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag in CLOSES_P and (k := find(("p",), CELLS)):
            close(k)
        if tag in IMPLIED:
            ended, barrier = IMPLIED[tag]
            while k := find(ended, barrier):
                close(k)
        elif tag in BLOCK and places.get("head"):
            close(places["head"][0])
        name = tag
        if tag in _OF_FOREIGN:
            name = next((f"{x} {tag}" for x in ("svg", "math") if places.get(x) and (tag in _FOREIGN[x] or x == "svg" and tag == "text")), tag)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if attrs and attrs[-1] == "/" and (tag in _FOREIGN or places.get("svg") or places.get("math")) and not _UNQUOTED_END.search(attrs):
            continue  # drawings and formulas know <path/>
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            body = html[at : stop.start() if stop else n]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = stop.end() if stop else n
        elif tag not in VOID:  # HTML ignores the slash of <div/>
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            names.append(tag)
    return root


def _span(value: str, most: int, none: int) -> int:
    """A whole number of ASCII digits from 1 to most; else, none."""
    digits = re.match(r"\s*\+?0*(\d{1,9})(\d*)", value, re.ASCII)
    return min(int(digits[1]), most) if digits and not digits[2] and int(digits[1]) else most if digits and digits[2] else none


def _on_screen(query: str) -> bool:
    return any(" ".join(q.lower().split()) in ON_SCREEN for q in query.split(","))


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the style rules that hold on every screen; other conditions, and rules inside rules, are passed over."""
    stack: list[tuple[bool, str | None, list]] = [(True, None, [])]
    text = ""
    for token in [*_CSS.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.DOTALL)), None]:
        if token == "{":
            prelude, text = text.strip(), ""
            holds = stack[-1][0] and stack[-1][1] is None
            if at := _AT.match(prelude):
                stack.append((holds and (at[1].lower() == "layer" or at[1].lower() == "media" and _on_screen(at[2])), None, []))
            else:
                stack.append((holds, prelude, []))
        elif token == ";":
            stack[-1][2].append(text)
            text = ""
        elif token == "}" or token is None:  # the end of a sheet ends all that is open
            for _ in range(1 if token else len(stack)):
                if len(stack) > 1:
                    holds, selectors, body = stack.pop()
                    if holds and selectors is not None:
                        yield selectors, ";".join([*body, text])
                    text = ""
        else:
            text += token


def _hiding_rules(root: Node) -> tuple[set, set]:
    """Simple selectors (tag, .class, #id, tag.class) with display: none, and with visibility: hidden."""
    none, hidden, todo = set(), set(), [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            if c.tag == "style":
                if not _on_screen(c.attributes().get("media", "")):
                    continue
                for selectors, body in _rules("".join(x for x in c.children if isinstance(x, str))):
                    body = body.lower().replace(" ", "")
                    to = none if "display:none" in body else hidden if "visibility:hidden" in body else None
                    if to is not None:
                        to.update(m.groups() for s in selectors.split(",") if (m := _SIMPLE.match(s.strip())) and s.strip())
            else:
                todo.append(c)
    return none, hidden


class _Page:
    def __init__(self, root: Node):
        self.root = root
        self.none, self.hidden = _hiding_rules(root)
        self.tables: dict[int, list[str]] = {}  # lines of the tables that have been laid out

    def text(self) -> list[str]:
        """Lines of the page. Tables are laid out innermost first, so nesting of any depth needs no recursion."""
        for table, visible in reversed(self._laid_tables()):
            self.tables[id(table)] = self.table(table, visible)
        return self.render(self.root)

    def _laid_tables(self) -> list[tuple[Node, bool]]:
        """Tables that are laid out, outer ones first, and whether their own text is visible."""
        found, todo = [], [(self.root, True)]
        while todo:
            node, visible = todo.pop()
            for c in node.children:
                if not isinstance(c, str):
                    laid, vis = self.shown(c, visible)
                    if laid:
                        todo.append((c, vis))
                        if c.tag == "table":
                            found.append((c, vis))
        return found

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """(is laid out, its own text is visible)."""
        if node.tag in NEVER_SHOWN:
            return False, False
        if not node.attrs and not self.none and not self.hidden:
            return node.tag != "dialog", visible
        a = node.attributes()
        style = a.get("style", "").lower().replace(" ", "")
        if "hidden" in a or "display:none" in style or node.tag == "dialog" and "open" not in a:
            return False, False
        names = {(t, k, v) for t in (None, node.tag.rpartition(" ")[2]) for k, v in [(None, None), ("#", a.get("id")), *((".", c) for c in a.get("class", "").split())]}
        if names & self.none and "display:" not in style:
            return False, False
        if "visibility:visible" in style:
            visible = True
        elif "visibility:hidden" in style or "visibility:collapse" in style or names & self.hidden:
            visible = False
        return True, visible

    def render(self, node: Node, visible: bool = True) -> list[str]:
        """Lines of text; an empty line is a gap between blocks."""
        lines: list[str] = []
        buffer: list[str] = []
        state = {"gap": False, "marker": ""}
        lists: list[list] = []  # [kind, number]

        def flush(gap: bool = False):
            text = "".join(buffer)
            buffer.clear()
            for part in text.split("\0"):  # \0 is a line break inside a block
                part = part.strip(" ")
                if part:
                    indent = "  " * min(MOST_LEVELS, max(0, len(lists) - 1))
                    if state["gap"] and lines and lines[-1]:
                        lines.append("")
                    state["gap"] = False
                    hang = "  " if lists and not state["marker"] else ""
                    lines.append(indent + (state["marker"] or hang) + part)
                    state["marker"] = ""
            state["gap"] = state["gap"] or gap

        todo: list[tuple] = [(c, visible, False) for c in reversed(node.children)]
        while todo:
            item, vis, pre = todo.pop()
            if callable(item):
                item()
                continue
            if isinstance(item, str):
                if vis:
                    item = item.replace("\0", "").replace("\xa0", " ")
                    if pre:
                        flush()
                        for line in item.strip("\n").split("\n"):
                            if state["gap"] and lines and lines[-1]:
                                lines.append("")
                            state["gap"] = False
                            lines.append("  " * min(MOST_LEVELS, max(0, len(lists) - 1)) + line.rstrip())
                    else:
                        item = _SPACES.sub(" ", item)
                        if not buffer or buffer[-1].endswith((" ", "\0")):
                            item = item.lstrip(" ")
                        if item:
                            buffer.append(item)
                continue
            laid, vis = self.shown(item, vis)
            if not laid:
                continue
            tag = item.tag
            if tag == "br":
                buffer.append("\0")
                continue
            if tag == "table":
                flush(True)
                for line in self.tables.pop(id(item)):
                    if state["gap"] and lines and lines[-1]:
                        lines.append("")
                    state["gap"] = False
                    lines.append("  " * min(MOST_LEVELS, max(0, len(lists) - 1)) + line)
                state["gap"] = True
                continue
            children = item.children
            if tag == "details" and "open" not in item.attributes():
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag in BLOCK:
                spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists)
                flush(spaced)
                leave = lambda s=spaced: flush(s)
                if tag in ("ul", "ol", "menu", "dir"):
                    start = item.attributes().get("start", "1") if tag == "ol" else "1"
                    lists.append([tag, int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0])

                    def leave(s=spaced):
                        flush()
                        lists.pop()
                        state["marker"] = ""
                        state["gap"] = state["gap"] or s
                elif tag == "li" and lists:
                    lists[-1][1] += 1
                    state["marker"] = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- "
                todo.append((leave, vis, pre))
            elif tag in ("img", "input", "hr"):
                continue
            todo.extend((c, vis, pre or tag in ("pre", "textarea")) for c in reversed(children))
        flush()
        return lines

    def table(self, node: Node, visible: bool) -> list[str]:
        """Rows with cells padded to their column's width (WIDEST and LINE at most), two spaces between columns. A cell stands in the first free
        column of its row and keeps its columns in the rows that it spans."""
        grid: list[dict[int, str]] = []
        before: list[str] = []
        taken: list[tuple[int, int, int]] = []  # columns that cells above span: first, end, row at which they are free
        spans: list[tuple[int, int, int]] = []  # the same of cells in this row
        full: list[list[int]] = []  # taken columns as stretches without gaps
        at = passed = n = ends = 0  # ends: the first row at which one of taken is free
        todo: list[tuple] = [(c, visible) for c in reversed(node.children)]
        row: dict[int, str] | None = None

        def start_row():
            nonlocal row, at, taken, passed, n, ends
            n += 1
            if spans or (taken and n >= ends):
                taken = sorted(s for s in taken + spans if s[2] > n)
                ends = min((s[2] for s in taken), default=0)
                spans.clear()
                full.clear()
                for first, end, _ in taken:
                    if full and first <= full[-1][1]:
                        full[-1][1] = max(full[-1][1], end)
                    else:
                        full.append([first, end])
            row, at, passed = {}, 0, 0
            grid.append(row)

        while todo:
            item, vis = todo.pop()
            if item is None:  # a group of rows begins or ends: no cell spans beyond that
                row, taken = None, []
                spans.clear()
                full.clear()
                continue
            if isinstance(item, str):
                if item.strip() and vis:
                    before.append(_SPACES.sub(" ", item).strip())
                continue
            laid, vis = self.shown(item, vis)
            if not laid:
                continue
            if item.tag in CELLS:
                if row is None:
                    start_row()
                text = " ".join(x.strip() for x in self.render(item, vis) if x)
                a = item.attributes()
                while passed < len(full) and full[passed][0] <= at:
                    at = max(at, full[passed][1])
                    passed += 1
                row[at] = text
                down = _span(a.get("rowspan", "1"), MOST_ROWS, MOST_ROWS if a.get("rowspan", "").strip() == "0" else 1)
                end = at + _span(a.get("colspan", "1"), MOST_COLUMNS, 1)
                if down > 1 and at < MOST_COLUMNS:
                    spans.append((at, end, n + down))
                at = end
            elif item.tag == "tr":
                start_row()
                todo.extend((c, vis) for c in reversed(item.children))
            elif item.tag in ("thead", "tbody", "tfoot", "colgroup"):
                todo.append((None, vis))
                todo.extend((c, vis) for c in reversed(item.children))
                todo.append((None, vis))
            else:  # a caption, or what stands in a table outside cells
                before += [x for x in self.render(_wrapped(item), vis) if x]
        widths: dict[int, int] = {}
        for r in grid:
            for c, x in r.items():
                widths[c] = max(widths.get(c, 0), len(x))
        starts, x = {}, 0
        for c, w in sorted(widths.items()):
            if w:
                starts[c] = min(x, LINE)
                x += min(w, WIDEST) + 2
        lines = []
        for r in grid:
            parts, length = [], 0
            for c, text in r.items():  # from left to right
                if text:
                    gap = max(2 if parts else 0, starts[c] - length)
                    parts += [" " * gap, text]
                    length += gap + len(text)
            if parts:
                lines.append("".join(parts))
        return before + lines


def _wrapped(node: Node) -> Node:
    out = Node("div")
    out.children.append(node)
    return out


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page(build(html))
    return "\n".join(page.text()).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and the visible text of each page, with its number of code points.

    Every page is a row by itself; a null or empty page has the empty text; markup that is
    cut off or misnested is repaired as a browser would, never dropped, however long or deeply nested a page is;
    rows map one to one whatever their ids, repeated ones too; other columns are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(h) for h in part.column(1).to_pylist()], pa.string())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
