"""The element tree that a browser builds from a page's source, for use inside tasks: implied and omitted tags,
tables, open formatting that goes on in the next block, raw text. One page is small; Spark spreads the pages."""

from __future__ import annotations

import re
from html import unescape

# Element kinds of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open paragraph.
BLOCKS = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul".split())
#: End tags of these close everything that is open inside them.
ENDING = BLOCKS - {"hr", "table"} | {"button"}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ROWS, CELLS = frozenset("tbody thead tfoot".split()), frozenset("td th".split())
TABLE_PARTS = ROWS | CELLS | frozenset("caption colgroup col tr".split())
IN_TABLE = ROWS | frozenset("table tr".split())
SPECIAL = BLOCKS | IN_TABLE | CELLS | VOID | SCOPE | RAW | frozenset("body head button colgroup select textarea title".split())
#: Open elements at most; a deeper one takes the place of the last.
DEEPEST = 512
MARKED = CELLS | frozenset("caption applet marquee object template".split())

_ATTRIBUTES = r"""(?:[^\s>=/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?|[\s=/]++)*+"""
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s>=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | {"title", "textarea"}}


class Element:
    """A tag with its attributes as written; kids are elements and texts in order."""

    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: str = "", up: Element | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def attributes(self) -> dict[str, str]:
        """Names in lower case; of a name given twice the first counts."""
        out = {}
        for m in _ATTRIBUTE.finditer(self.attrs):
            out.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
        return out


class _Builder:
    def __init__(self):
        self.top = Element("html")
        self.open, self.head, self.body = [self.top], None, None
        self.formatting: list[tuple[Element, bool]] = []  # an element, and whether it only marks a border

    # where things go

    def put(self, kid, into: Element | None = None) -> None:
        """kid at the end of the current element, or before the table if that can't hold it."""
        into = into or self.open[-1]
        if into.tag in IN_TABLE and not (isinstance(kid, Element) and kid.tag in TABLE_PARTS | RAW | {"template"}):
            table = next(e for e in reversed(self.open) if e.tag == "table")
            into, at = table.up, table.up.kids.index(table)
            into.kids.insert(at, kid)
        else:
            at = len(into.kids)
            into.kids.append(kid)
        if isinstance(kid, Element):
            kid.up = into
        elif at and isinstance(into.kids[at - 1], str):
            into.kids[at - 1 : at + 1] = [into.kids[at - 1] + kid]

    def push(self, tag: str, attrs: str = "") -> Element:
        e = Element(tag, attrs)
        if len(self.open) >= DEEPEST:
            last = self.open.pop()
            self.formatting = [x for x in self.formatting if x[0] is not last]
        self.put(e)
        if tag not in VOID:
            self.open.append(e)
        if tag in MARKED:
            self.formatting.append((e, True))
        return e

    def find(self, tags, border=SCOPE) -> int:
        """Place in the stack of the nearest open element among tags, 0 if a border comes first."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in border:
                break
        return 0

    def close(self, tags, border=SCOPE) -> bool:
        k = self.find(tags, border)
        if k:
            del self.open[k:]
        return bool(k)

    def in_body(self) -> None:
        if not self.body:
            if not self.head:
                self.head = Element("head", up=self.top)
                self.top.kids.append(self.head)
            self.body = Element("body", up=self.top)
            self.top.kids.append(self.body)
            self.open = [self.top, self.body]

    def resume(self) -> None:
        """Opens formatting again that was open when its block ended."""
        if not self.formatting or self.formatting[-1][0] in self.open:
            return
        there = set(map(id, self.open))
        while self.formatting and self.formatting[-1][1] and id(self.formatting[-1][0]) not in there:
            self.formatting.pop()
        k = len(self.formatting)
        while k and not self.formatting[k - 1][1] and id(self.formatting[k - 1][0]) not in there:
            k -= 1
        for i in range(k, len(self.formatting)):
            old = self.formatting[i][0]
            self.formatting[i] = (self.push(old.tag, old.attrs), False)

    # what comes

    def text(self, data: str) -> None:
        blank = not data.strip("\t\n\f\r ")
        if not self.body:
            if blank or (self.open[-1] is self.head and not data):
                return
            self.in_body()
        if not blank:
            self.resume()
        if blank and self.open[-1].tag in IN_TABLE:
            self.open[-1].kids.append(data)
        else:
            self.put(data)

    def start(self, tag: str, attrs: str) -> None:
        if tag == "html":
            self.top.attrs = self.top.attrs or attrs
            return
        if not self.body:
            if tag == "head":
                if not self.head:
                    self.head = self.push("head", attrs)
                return
            if tag in IN_HEAD:
                if not self.head:
                    self.head = self.push("head")
                self.open = [self.top, self.head] if self.open[-1] is self.top else self.open
                self.push(tag, attrs)
                return
            self.in_body()
        if tag == "body":
            self.body.attrs = self.body.attrs or attrs
            return
        if tag == "head":
            return
        if tag in TABLE_PARTS:
            self.part(tag, attrs)
            return
        if tag == "table" and self.open[-1].tag in IN_TABLE:
            self.close({"table"}, ())
        if tag in BLOCKS:
            self.close({"p"}, SCOPE | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag in ("li", "dd", "dt"):
            self.close({"li"} if tag == "li" else {"dd", "dt"}, SPECIAL - {"address", "div", "p", "li", "dd", "dt"} | ({"dd", "dt"} if tag == "li" else {"li"}))
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option" or (tag == "optgroup" and self.find({"option"}, {"select"})):
                self.close({"option"}, {"select"})
            if tag == "optgroup":
                self.close({"optgroup"}, {"select"})
        elif tag == "button":
            self.close({"button"})
        elif tag == "select" and self.close({"select"}):
            return
        elif tag == "a" and any(e.tag == "a" and not mark for e, mark in self.since_border()):
            self.end_formatting("a")
        if tag not in BLOCKS and tag not in RAW:
            self.resume()
        e = self.push(tag, attrs)
        if tag in FORMATTING:
            same = [x for x in self.since_border() if x[0].tag == tag and x[0].attrs == attrs]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append((e, False))
        elif attrs.endswith("/") and tag not in VOID and any(x.tag in ("svg", "math") for x in self.open):
            self.open.pop()

    def since_border(self):
        k = max((i + 1 for i, (_, mark) in enumerate(self.formatting) if mark), default=0)
        return self.formatting[k:]

    def part(self, tag: str, attrs: str) -> None:
        """A row, cell, caption or column, with the row and body around it that may be left out."""
        k = self.find({"table"}, {"template", "html"})
        if not k:
            return
        stays = {"table"} | (ROWS | {"tr"} if tag in CELLS else ROWS if tag == "tr" else {"colgroup"} if tag == "col" else set())
        while self.open[-1].tag not in stays:
            self.open.pop()
        if tag in CELLS and self.open[-1].tag == "table":
            self.push("tbody")
        if tag in CELLS and self.open[-1].tag in ROWS:
            self.push("tr")
        if tag == "tr" and self.open[-1].tag == "table":
            self.push("tbody")
        if tag == "col" and self.open[-1].tag == "table":
            self.push("colgroup")
        self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head" and not self.body:
                self.open = [self.top]
            return
        if not self.body:
            if tag in IN_HEAD and self.open[-1].tag == tag:
                self.open.pop()
                return
            if tag not in ("br", "p"):
                return
            self.in_body()
        if tag == "br":
            self.start("br", "")
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag == "p":
            if not self.find({"p"}, SCOPE | {"button"}):
                self.start("p", "")
            self.close({"p"}, SCOPE | {"button"})
        elif tag in HEADINGS:
            self.close(HEADINGS)
        elif tag in ("li",):
            self.close({"li"}, SCOPE | {"ol", "ul"})
        elif tag in TABLE_PARTS or tag == "table":
            self.close({tag}, {"html", "table", "template"})
        elif tag in ENDING or tag in MARKED:
            self.close({tag})
        else:
            self.close({tag}, SPECIAL - {tag})

    def end_formatting(self, tag: str) -> None:
        """An end tag of formatting that may not match: what was opened inside a block stays in it, and the block
        gets formatting of its own (the syntax calls this the adoption agency)."""
        for _ in range(8):
            entry = next((x for x in reversed(self.since_border()) if x[0].tag == tag), None)
            if not entry:
                self.close({tag}, SPECIAL)
                return
            e = entry[0]
            if e not in self.open:
                self.formatting.remove(entry)
                return
            at = self.open.index(e)
            if any(x.tag in SCOPE for x in self.open[at + 1 :]):
                return
            far = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in SPECIAL), None)
            if far is None:
                del self.open[at:]
                self.formatting.remove(entry)
                return
            block, above, mark = self.open[far], self.open[at - 1], self.formatting.index(entry)
            last, k = block, far
            for step in range(1, far - at):
                k -= 1
                node = self.open[k]
                held = next((x for x in self.formatting if x[0] is node), None)
                if step > 3 and held:
                    self.formatting.remove(held)
                    held = None
                if not held:
                    del self.open[k]
                    continue
                new = Element(node.tag, node.attrs)
                self.open[k] = new
                i = self.formatting.index(held)
                self.formatting[i] = (new, False)
                if last is block:
                    mark = i + 1
                self.move(last, new)
                last = new
            self.move(last, above)
            new = Element(e.tag, e.attrs, block)
            new.kids, block.kids = block.kids, [new]
            for x in new.kids:
                if isinstance(x, Element):
                    x.up = new
            before = self.formatting.index(entry)
            del self.formatting[before]
            self.formatting.insert(min(mark - (before < mark), len(self.formatting)), (new, False))
            self.open.remove(e)
            self.open.insert(self.open.index(block) + 1, new)

    def move(self, e: Element, into: Element) -> None:
        if e.up:
            e.up.kids = [x for x in e.up.kids if x is not e]
        self.put(e, into)


def parse(source: str) -> Element:
    """The html element of a page; head and body are there as in a browser, even for an empty text.

    Comments go; a tag that the text's end cuts off goes with its attributes; what is never closed ends with
    what holds it. Character references are decoded in texts, not in raw ones (scripts, styles).
    """
    b, at, n = _Builder(), 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            b.text(unescape(source[at:]))
            break
        if m.start() > at:
            b.text(unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None or source[at - 1] != ">":
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        b.start(tag, m[3])
        if tag in _ENDS and b.open[-1].tag == tag:
            end = _ENDS[tag].search(source, at)
            stop = end.start() if end else n
            if stop > at:
                inside = source[at:stop]
                b.open[-1].kids.append(inside if tag in RAW else unescape(inside))
            at = stop
    b.in_body()
    return b.top
