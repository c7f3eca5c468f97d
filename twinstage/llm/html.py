"""HTML extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that supplies implied tags (body, end tags of
paragraphs, list items, options and table parts, a tbody or tr that is missing) and
void elements; unmatched end tags are dropped. A renderer walks the tree and emits all
visible text: blocks on lines of their own, paragraphs, headings, lists and tables set
off by an empty line, list items with a bullet or number and indented by depth, table
cells padded to the width of their column (wide characters take two places; a cell that
spans rows or columns keeps those below and behind it in their columns; lines of over
``WIDEST`` places are not padded for), preformatted text as it is, other white space
collapsed.

Invisible are: elements that are never shown (script, style, template, head, …), the
attribute ``hidden``, ``display:none`` and ``visibility:hidden`` in a style attribute or
in a style element's rules (tags, classes and ids, joined by descent or >; !important,
specificity and order decide; rules with other selectors do not count), closed
details except their summary, closed dialogs, hidden inputs. Rules inside at-rules count
where these hold on a screen of ``SCREEN`` pixels (@media with types, widths, heights and
a few preferences; @supports unless negated; @layer); others are left out.

Inside svg and math a start tag may close itself, and a start tag of HTML content closes
them, as in browsers. Of an svg the text elements and foreign objects are visible, of
math all but annotations and phantoms.

Pages stay in the task that scans them: no shuffle. One page is one string in memory.
Tags are found in time linear in the page, broken ones too; style rules are looked up by
the id, class or tag they need.
Elements nested deeper than ``DEPTH`` become children of the last level, as browsers do;
their text is kept.

Edge cases: a null or empty page gives an empty text; text without any tag is its own
rendering; unclosed comments and raw elements run to the end of the page; rows that
repeat are rendered each; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

DEPTH = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title iframe noembed noframes object canvas audio video "
                  "datalist link meta base area param source track col colgroup".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre "
                  "search section summary table ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table pre blockquote figure hr article section fieldset xmp".split())
# Inside svg and math: start tags that close these, and elements whose content is HTML again.
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu "
                    "meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HTML_AGAIN = {"svg": {"foreignobject", "desc", "title"}, "math": {"annotation-xml", "mi", "mo", "mn", "ms", "mtext"}}
_UNSHOWN = frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
# A start tag of these closes an open p.
_CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend"} | {"table"}
# start tag: (open elements that it closes, elements that stop the search)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_GAP = re.compile(r"[\s/>]")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CSS = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[{};]|[^{};\"']+", re.S)
WIDEST = 200    # columns; longer lines of a cell do not set the width of their column
COLUMNS = 1000  # of a table, in which cells may cover rows below
SCREEN = {"width": 1280, "height": 800}  # pixels, for media queries
_LENGTH = r"\s*(\d*\.?\d+)(px|em|rem)?\s*\)"
_BOUND = re.compile(r"\(\s*(min|max)-(?:device-)?(width|height)\s*:" + _LENGTH)
_RANGE = re.compile(r"\(\s*(width|height)\s*(<=|>=|<|>)" + _LENGTH)
_PREFERENCE = {"orientation:landscape": True, "orientation:portrait": False, "prefers-color-scheme:light": True,
               "prefers-color-scheme:dark": False, "prefers-reduced-motion:no-preference": True,
               "prefers-reduced-motion:reduce": False, "hover:hover": True, "hover:none": False, "pointer:fine": True,
               "pointer:coarse": False, "pointer:none": False, "scripting:none": False}
_COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_LOOSE = re.compile(r"[\t\n\r\f]|  ")
_SPACE = re.compile(r"[ \t\n\r\f]+")


@lru_cache(64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "number", "look")  # number: of an item of an ol; look: by the style sheet

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.number, self.look = tag, attrs, [], None, None


class Tags:
    """The tags of a page one after the other, in time linear in the page.

    A start tag ends at the first > outside of quotes; without one the < is text. Whatever a search
    has shown (no > behind here, no end of a tag that is outside of quotes here, next mark, end of a
    name) is kept, so broken tags do not make later ones look again at the same places.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.dead: set[int] = set()   # quotes that open outside of quotes and lead to no >
        self.mark = (0, -1)           # from, next mark at or after it
        self.name = (0, -1)           # from, end of a name that starts there or later

    def _ahead(self, known: tuple[int, int], pattern: re.Pattern, at: int) -> tuple[int, int]:
        if known[0] <= at <= known[1]:
            return known
        m = pattern.search(self.page, at)
        return at, m.start() if m else len(self.page)

    def _close(self, at: int) -> int:
        """Place of the > that ends a start tag whose name ends at ``at``, or -1."""
        page, seen = self.page, []
        self.mark = self._ahead(self.mark, _MARK, at)
        k = self.mark[1]
        while k < len(page) and k not in self.dead:
            if page[k] == ">":
                return k
            seen.append(k)
            other = page.find(page[k], k + 1)
            m = _MARK.search(page, other + 1) if other >= 0 else None
            k = m.start() if m else len(page)
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, name of a start tag, its attributes, name of an end tag) of the next tag or comment."""
        page = self.page
        while (k := page.find("<", at)) >= 0:
            at = k + 1
            c = page[at:at + 1]
            if c.isascii() and c.isalpha():
                self.name = self._ahead(self.name, _GAP, at)
                stop = self._close(self.name[1]) if at <= self.last else -1
                if stop >= 0:
                    return k, stop + 1, page[at:self.name[1]].lower(), page[self.name[1]:stop], ""
            elif page.startswith("!--", at):
                stop = page.find("-->", at + 3)
                return k, stop + 3 if stop >= 0 else len(page), "", "", ""
            elif c and c in "!?/" and at < self.last:
                m = _NAME.match(page, at + 1) if c == "/" else None
                return k, page.index(">", at + 1) + 1, "", "", m[0].lower() if m else ""
        return None


def _owned(raw: str) -> bool:
    """Is the end of a start tag part of a last attribute without quotes? Then it owns the slash there."""
    k = next((i for i in range(len(raw) - 1, -1, -1) if raw[i] in "\"'>" or raw[i].isspace()), -1)
    tail = raw[k + 1:]
    return "=" in tail[:-1] or bool(tail and k >= 0 and raw[k].isspace() and raw[:k].rstrip()[-1:] == "=")


class Sheet:
    """Style rules by the id, class or tag that an element must have for them.

    Selectors are compounds of a tag, ids and classes, joined by descent or ``>``; rules with others do
    not count. !important, then ids, classes and tags, then order decide between rules, as on a screen.
    """

    def __init__(self):
        self.rules: dict[tuple, tuple] = {}  # (selector, property, important) -> (specificity, order, value)
        self.order = 0

    def add(self, selector: str, found: dict[str, tuple[str, bool]]) -> None:
        chain, link = [], " "
        for part in selector.replace(">", " > ").split():
            if part == ">":
                if link == ">" or not chain:
                    return
                link = ">"
                continue
            m = _COMPOUND.fullmatch(part)
            if not m:
                return
            marks = re.findall(r"[.#][\w-]+", m[2])
            chain.append((link, (m[1] or "*").lower(), frozenset(x[1:] for x in marks if x[0] == "#"),
                          frozenset(x[1:] for x in marks if x[0] == ".")))
            link = " "
        if not chain or link == ">":
            return
        weight = (sum(len(c[2]) for c in chain), sum(len(c[3]) for c in chain), sum(c[1] != "*" for c in chain))
        for name, (value, important) in found.items():
            self.order += 1
            self.rules[tuple(chain), name, important] = (weight, self.order, value)

    def dress(self, root: Node) -> None:
        """Give every element its look: {property: value} by the rules and its own style."""
        by: dict[str, list] = {}
        for (chain, name, important), (weight, order, value) in self.rules.items():
            _, tag, ids, classes = chain[-1]
            key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
            by.setdefault(key, []).append((chain, name, ((important, False, weight, order), value)))
        todo: list[tuple[Node, tuple | None]] = [(root, None)]
        while todo:
            n, up = todo.pop()
            for c in n.children:
                if isinstance(c, Node):
                    me = (c.tag, c.attrs.get("id"), frozenset(c.attrs.get("class", "").split()), up)
                    c.look = self._look(by, c, me)
                    todo.append((c, me))

    @staticmethod
    def _look(by: dict[str, list], n: Node, me: tuple) -> dict[str, str]:
        best = {k: ((important, True), v) for k, (v, important) in _visibility(n.attrs.get("style", "")).items()}
        for key in ("*", n.tag, f"#{me[1]}", *("." + x for x in me[2])):
            for chain, name, entry in by.get(key, ()):
                if (name not in best or best[name][0] < entry[0]) and _fits(chain[-1], me) and _under(chain, me[3]):
                    best[name] = entry
        return {k: v for k, (_, v) in best.items()}


def _fits(compound: tuple, element: tuple) -> bool:
    """Has the element (tag, id, classes, element above) what the compound asks for?"""
    _, tag, ids, classes = compound
    return tag in ("*", element[0]) and (not ids or ids == {element[1]}) and classes <= element[2]


def _under(chain: tuple, up: tuple | None) -> bool:
    """Do the elements above fit the compounds before the last? From the top down, each looked at once."""
    if len(chain) == 1:
        return True
    path = []
    while up is not None:
        path.append(up)
        up = up[3]
    here = ever = [False] * (len(chain) - 1)  # does a match of the first k + 1 compounds end at this element, at any so far?
    for element in reversed(path):
        here = [(k == 0 or (here if c[0] == ">" else ever)[k - 1]) and _fits(c, element) for k, c in enumerate(chain[:-1])]
        ever = [a or b for a, b in zip(ever, here)]
    return (here if chain[-1][0] == ">" else ever)[-1]


class Builder:
    """Tree of a page: elements and strings under one root."""

    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.newest = self.root
        self.inside = False  # has the page had an svg or math?
        self.sheet = Sheet()

    def _add(self, item) -> None:
        self.open[-1].children.append(item)

    def _start_of(self, tag: str) -> None:
        if tag in _CLOSES_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    del self.open[k:]
                    break
                if self.open[k].tag in ("td", "th", "table", "button", "object"):
                    break
        if tag in _IMPLIED:
            closes, stops = _IMPLIED[tag]
            cut = None
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in stops:
                    break
                if self.open[k].tag in closes:
                    cut = k
            if cut:
                del self.open[cut:]
        need = {"tr": ("tbody", ("tbody", "thead", "tfoot"), "table"), "td": ("tr", ("tr",), "table"),
                "th": ("tr", ("tr",), "table")}.get(tag)
        if need and any(n.tag == need[2] for n in self.open) and self.open[-1].tag not in need[1]:
            if tag == "tr" or self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if tag != "tr" and self.open[-1].tag == "table":
                    self._push("tbody", {})
                self._push(need[0], {})

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = self.newest = Node(tag, attrs)
        self._add(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def _unpush(self) -> None:
        if self.open[-1] is self.newest:
            self.open.pop()

    def foreign(self) -> bool:
        """Is the innermost open element svg or math content?"""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in _HTML_AGAIN:
                return all(n.tag not in _HTML_AGAIN[self.open[k].tag] for n in self.open[k + 1:])
        return False

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> bool:
        """Open an element; is it one of svg or math that closes itself?"""
        if self.inside and self.foreign():
            if tag not in _BREAKS:
                self._push(tag, attrs)
                if closed:
                    self._unpush()
                return closed
            while self.foreign():
                self.open.pop()
        if tag in _HTML_AGAIN:
            self.inside = True
        self._start(tag, attrs)
        if closed and tag in _HTML_AGAIN:
            self._unpush()
            return True
        return False

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag not in ("html", "head", "body") and tag not in NEVER and self.open[-1].tag == "head":
            self.open.pop()  # content ends an unclosed head
        self._start_of(tag)
        self._push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and all(n.tag != "p" for n in self.open):
            self._add(Node("p", {}))
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return  # an end tag does not leave a table cell

    def text(self, s: str) -> None:
        if s:
            if self.open[-1].tag == "head" and s.strip():
                self.open.pop()
            self._add(s)

    def feed(self, page: str) -> Node:
        at, tags = 0, Tags(page)
        while at < len(page):
            m = tags.next(at)
            if not m:
                self.text(unescape(page[at:]))
                break
            begin, stop, tag, raw, ended = m
            self.text(unescape(page[at:begin]))
            at = stop
            if tag:
                attrs: dict[str, str] = {}
                if raw and raw != "/":
                    for a in _ATTR.finditer(raw):
                        attrs.setdefault(a[1].lower(), unescape(next((v for v in a.groups()[1:] if v is not None), "")))
                closed = raw[-1:] == "/" and not _owned(raw)
                if not self.start(tag, attrs, closed) and tag in RAW:
                    stop = _ends(tag).search(page, at, max(tags.last + 1, at))
                    body = page[at:stop.start()] if stop else page[at:]
                    at = stop.end() if stop else len(page)
                    if tag == "style":
                        if _media(attrs.get("media", "")):
                            self._styles(body)
                    elif tag in ("textarea", "title"):
                        self._add(unescape(body))
                    elif tag == "xmp":
                        self._add(body)
                    if self.open[-1].tag == tag:
                        self.open.pop()
            elif ended:
                self.end(ended)
        return self.root

    def _styles(self, css: str) -> None:
        for selectors, body in _rules(re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)):
            found = _visibility(body)
            for sel in selectors.split(",") if found else ():
                self.sheet.add(sel, found)


def _rules(css: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the style rules that hold on a screen, nested blocks taken apart."""
    out: list[tuple[str, str]] = []
    open_: list[tuple[bool, bool, tuple[str, list[str]] | None]] = []  # (holds, is a rule itself, rule that declarations go to)
    text: list[str] = []

    def close() -> None:
        holds, itself, rule = open_.pop()
        if holds and itself:
            out.append((rule[0], ";".join(rule[1])))

    def declare() -> None:
        if open_ and open_[-1][0] and open_[-1][2]:
            open_[-1][2][1].append("".join(text))
        text.clear()

    for m in _CSS.finditer(css):
        t = m[0]
        if t == "{":
            prelude = "".join(text).strip()
            text.clear()
            holds, _, rule = open_[-1] if open_ else (True, False, None)
            if prelude.startswith("@"):
                open_.append((holds and _holds(prelude), False, rule))
            else:  # a rule inside a rule is about descendants, so not a simple one
                open_.append((holds and rule is None, True, (prelude, [])))
        elif t == "}":
            declare()
            if open_:
                close()
        elif t == ";":
            declare()
        else:
            text.append(t)
    declare()
    while open_:
        close()
    return out


def _holds(prelude: str) -> bool:
    """Does an at-rule with a block hold on a screen?"""
    m = re.match(r"@([\w-]+)\s*(.*)", prelude, re.S)
    name, rest = (m[1].lower(), m[2]) if m else ("", "")
    return name == "layer" or (name == "media" and _media(rest)) or (name == "supports" and not re.match(r"not\b", rest, re.I))


def _media(queries: str) -> bool:
    return not queries.strip() or any(_query(q.strip()) for q in queries.lower().split(","))


def _query(q: str) -> bool:
    """One media query on a screen; what is not known does not hold, negated or not."""
    m = re.match(r"(not|only)\b\s*", q)
    parts = [_feature(p.strip()) for p in re.split(r"\band\b", q[m.end():] if m else q)]
    holds = False if False in parts else None if None in parts else True
    return holds is False if m and m[1] == "not" else holds is True


def _feature(p: str) -> bool | None:
    if re.fullmatch(r"[a-z-]+", p):
        return p in ("all", "screen")
    m = _BOUND.fullmatch(p)
    if m:
        size = float(m[3]) * (16 if m[4] in ("em", "rem") else 1)
        return SCREEN[m[2]] >= size if m[1] == "min" else SCREEN[m[2]] <= size
    m = _RANGE.fullmatch(p)
    if m:
        have, size = SCREEN[m[1]], float(m[3]) * (16 if m[4] in ("em", "rem") else 1)
        return {"<": have < size, "<=": have <= size, ">": have > size, ">=": have >= size}[m[2]]
    return _PREFERENCE.get(re.sub(r"[\s()]", "", p))


def _visibility(style: str) -> dict[str, tuple[str, bool]]:
    """{property: (value, is it important?)} of the two properties that hide text."""
    out: dict[str, tuple[str, bool]] = {}
    for part in style.lower().split(";") if style else ():
        k, _, v = part.partition(":")
        k = k.strip()
        if k in ("display", "visibility"):
            important = "!important" in v.replace(" ", "")
            if important or not out.get(k, ("", False))[1]:
                out[k] = (v.partition("!")[0].strip(), important)
    return out


def _look(n: Node) -> dict[str, str]:
    if n.look is not None:
        return n.look
    return {k: v for k, (v, _) in _visibility(n.attrs["style"]).items()} if "style" in n.attrs else {}


def _cells(s: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(n: Node, name: str, most: int) -> int:
    v = n.attrs.get(name, "1")
    return min(int(v), most) if re.fullmatch(r"[0-9]{1,5}", v) else 1


class Renderer:
    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = 0          # line ends asked for before the next text
        self.indent = ""
        self.marker = ""
        self.space = False

    # -- output -----------------------------------------------------------
    def flush(self, gap: int = 1) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
            self.gap = 0
        self.line, self.space = "", False
        if self.lines:
            self.gap = max(self.gap, gap)

    def write(self, s: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line = self.indent + self.marker
            self.indent, self.marker = self.indent + " " * len(self.marker), ""
        self.line += s

    def words(self, s: str) -> None:
        if _LOOSE.search(s):
            s = _SPACE.sub(" ", s)
        body = s.strip(" ")
        if s[:1] == " ":
            self.space = True
        if body:
            self.write(" " + body if self.space and self.line else body)
            self.space = s[-1] == " "

    def exact(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                if self.line.strip():
                    self.lines.append(self.line.rstrip())
                elif self.lines:
                    self.lines.append("")
                self.line, self.gap = "", 0
            if part:
                self.write(part)

    # -- walk ---------------------------------------------------------------
    def walk(self, n: Node, seen: bool = True, pre: bool = False) -> None:
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    self.exact(c) if pre else self.words(c)
            else:
                self.element(c, n, seen, pre)

    def element(self, n: Node, parent: Node, seen: bool, pre: bool) -> None:
        tag = n.tag
        if tag in NEVER or "hidden" in n.attrs or (tag == "dialog" and "open" not in n.attrs):
            return
        style = _look(n)
        if style.get("display") == "none":
            return
        if "visibility" in style:
            seen = style["visibility"] not in ("hidden", "collapse")
        if tag == "svg":
            self.svg(n, seen)
            return
        if tag == "mphantom" or (parent.tag == "semantics" and tag in ("annotation", "annotation-xml")) \
                or (parent.tag in ("text", "tspan", "textpath") and tag in _UNSHOWN):
            return
        if tag in ("mtr", "mtd"):
            self.space = True
        if tag == "br":
            if seen and self.line:
                self.flush(1)
            elif seen:
                self.gap = max(self.gap, 2 if self.gap else 1)
            return
        if tag == "input":
            if seen and n.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search") and n.attrs.get("value"):
                self.words(n.attrs["value"])
            return
        if parent.tag == "details" and "open" not in parent.attrs and tag != "summary":
            return
        if tag == "table":
            self.table(n, seen)
            return
        if tag in ("td", "th", "tr", "caption"):  # outside of a table
            self.flush(1)
            self.walk(n, seen, pre)
            self.flush(1)
            return
        if tag not in BLOCK:
            self.walk(n, seen, pre or tag == "textarea")
            return
        inside_list = parent.tag in ("li", "dd") and tag in ("ul", "ol", "dl", "menu", "dir")
        gap = 1 if inside_list or tag not in SPACED else 2
        self.flush(gap)
        before = self.indent
        if tag in ("li", "dd"):
            if tag == "li":
                self.marker = self._marker(n, parent)
            else:
                self.indent += "  "
            self.walk(n, seen, pre)
            if self.marker:
                self.marker = ""
        elif tag == "blockquote":
            self.indent += "  "
            self.walk(n, seen, pre)
        elif tag == "details" and "open" not in n.attrs:
            for c in n.children:
                if isinstance(c, Node):
                    self.element(c, n, seen, pre)
        else:
            self.walk(n, seen, pre or tag in ("pre", "xmp"))
        self.flush(gap)
        self.indent = before

    @staticmethod
    def _marker(n: Node, parent: Node) -> str:
        if parent.tag != "ol":
            return "- "
        if n.number is None:  # all items of the list at once
            start = parent.attrs.get("start", "1")
            at = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            for k, c in enumerate(c for c in parent.children if isinstance(c, Node) and c.tag == "li"):
                c.number = at + k
        return f"{n.number}. "

    def svg(self, n: Node, seen: bool) -> None:
        """Text elements and foreign objects, each set off by a space."""
        for c in n.children:
            if isinstance(c, str) or c.tag in _UNSHOWN or c.tag in NEVER:
                continue
            style = {k: c.attrs[k].strip().lower() for k in ("display", "visibility") if k in c.attrs}
            style |= _look(c)
            if style.get("display") == "none":
                continue
            see = style["visibility"] not in ("hidden", "collapse") if "visibility" in style else seen
            if c.tag in ("text", "foreignobject"):
                self.space = True
                self.walk(c, see)
                self.space = True
            else:
                self.svg(c, see)

    # -- tables -------------------------------------------------------------
    def table(self, n: Node, seen: bool) -> None:
        rows: list[list[tuple[int, list[str], int]]] = []  # (column, lines, columns spanned)
        captions: list[list[str]] = []

        def cell(c: Node, visible: bool) -> list[str]:
            sub = Renderer()
            sub.walk(c, visible)
            sub.flush()
            return [x for x in sub.lines if x] or [""]

        def part(node: Node, visible: bool) -> None:
            loose = Node("div", {})
            taken: dict[int, int] = {}  # column: rows of this part that a cell above still covers
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        loose.children.append(c)
                    continue
                if c.tag in NEVER or "hidden" in c.attrs:
                    continue
                style = _look(c)
                if style.get("display") == "none":
                    continue
                see = style["visibility"] not in ("hidden", "collapse") if "visibility" in style else visible
                if c.tag == "caption":
                    captions.append(cell(c, see))
                elif c.tag in ("tbody", "thead", "tfoot"):
                    part(c, see)
                elif c.tag == "tr":
                    row, at, fresh = [], 0, {}
                    for d in c.children:
                        if isinstance(d, str):
                            if d.strip():
                                loose.children.append(d)
                            continue
                        look = _look(d)
                        if d.tag in NEVER or "hidden" in d.attrs or look.get("display") == "none":
                            continue
                        ok = look["visibility"] not in ("hidden", "collapse") if "visibility" in look else see
                        while at in taken:
                            at += 1
                        span, down = max(_span(d, "colspan", 100), 1), _span(d, "rowspan", 65534) or 65534  # 0: all rows of the part
                        row.append((at, cell(d if d.tag in ("td", "th") else _wrap(d), ok), span))
                        if down > 1:
                            fresh |= {k: down for k in range(at, min(at + span, COLUMNS))}
                        at += span
                    taken = {k: v - 1 for k, v in (taken | fresh).items() if v > 1}
                    rows.append(row)
                else:
                    loose.children.append(c)
            if loose.children:  # misplaced content stands before the table
                captions.append(cell(loose, visible))

        part(n, seen)
        width: dict[int, int] = {}
        for row in rows:
            for at, lines, span in row:
                if span == 1:
                    width[at] = max(width.get(at, 0), *(w for w in map(_cells, lines) if w <= WIDEST), 0)
        self.flush(2)
        for lines in captions:
            for x in filter(None, lines):
                self.write(x)
                self.flush(1)
        for row in rows:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                out, done = "", 0
                for at, lines, span in row:
                    out += " " * sum(width.get(i, 0) + 2 for i in range(done, at))
                    wide = sum(width.get(i, 0) for i in range(at, at + span)) + 2 * (span - 1)
                    line = lines[k] if k < len(lines) else ""
                    out += line + " " * (max(wide - _cells(line), 0) + 2)
                    done = at + span
                if out.strip():
                    self.write(out.rstrip())
                    self.flush(1)
        self.flush(2)


def _wrap(n: Node) -> Node:
    out = Node("td", {})
    out.children.append(n)
    return out


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    b = Builder()
    r = Renderer()
    root = b.feed(page)
    if b.sheet.rules:
        b.sheet.dress(root)
    r.walk(root)
    r.flush()
    while r.lines and not r.lines[-1]:
        r.lines.pop()
    return "\n".join(r.lines)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, text, n_lines, n_chars."""
    X.ready(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    fields = T.StructType([src.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [render(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(out, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in out], pa.int64()),
                     pa.array([len(x) for x in out], pa.int64())], names=["id", "text", "n_lines", "n_chars"])

    return src.mapInArrow(run, fields).withColumnRenamed("id", id_col)
