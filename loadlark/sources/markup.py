"""HTML as a tree: one pass over the tags with a stack of what is open.

Pages of plain tags alone are cut at them by one pattern, and each spelling of a tag
is read once; a page with anything else (comments, scripts, titles, a ``<`` in a text,
an unusual attribute) goes through the standard library's parser. Both give the same tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TABLE = ("table", "td", "th")
#: A start tag ends these open elements, as far as the nearest one of the second list.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",))),
    **dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside nav header footer form pre blockquote main hr".split(), (("p",), (*_TABLE, "div", "button"))),
}
_NO_TEXT = ("script", "style", "template")


_PIECES = re.compile("(<[^<>]*>)")
_END_TAG = re.compile("</([A-Za-z][A-Za-z0-9]*)[ \n\t]*>")
_ATTRIBUTE = """[ \n\t]+([A-Za-z][A-Za-z0-9_-]*)(?:=(?:'([^'<>&]*)'|"([^"<>&]*)"|([A-Za-z0-9_.#%-]+)))?"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_START_TAG = re.compile(f"<([A-Za-z][A-Za-z0-9]*)((?:{re.sub('[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \n\t]*(/?)>")
#: What is inside of these isn't made of tags.
_RAW = frozenset("script style title textarea plaintext iframe noembed noframes noscript xmp".split())
_NO_CLASS: frozenset[str] = frozenset()


class Element:
    """``order`` counts the elements of a page; those inside of this one are the next ones, up to ``last``."""

    __slots__ = ("tag", "attrs", "classes", "children", "order", "last", "page")

    def __init__(self, tag: str, attrs: dict[str, str], classes: frozenset[str], order: int, page: list[Element]):
        self.tag, self.attrs, self.classes, self.children, self.order, self.last, self.page = tag, attrs, classes, [], order, order, page

    def has(self, *classes: str) -> bool:
        return self.classes.issuperset(classes)

    def inside(self) -> list[Element]:
        """All elements inside, in the order of the page."""
        return self.page[self.order : self.last]

    def all(self, tag: str, *classes: str, **attrs: str) -> Iterator[Element]:
        for x in self.page[self.order : self.last]:
            if x.tag == tag and (not classes or x.classes.issuperset(classes)) and (not attrs or all(x.attrs.get(k) == v for k, v in attrs.items())):
                yield x

    def first(self, tag: str, *classes: str, **attrs: str) -> Element | None:
        return next(self.all(tag, *classes, **attrs), None)

    def own(self, inside: str, *tags: str) -> Iterator[Element]:
        """Elements called ``tags`` that no ``inside`` stands between: the rows of a table without those of a table in it."""
        stack = self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, Element):
                if x.tag in tags:
                    yield x
                elif x.tag != inside:
                    stack += x.children[::-1]

    def text(self) -> str:
        """The pieces of text inside, each stripped, without anything between them."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        parts, stack = [], self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x.strip())
            elif x.tag not in _NO_TEXT:
                stack += x.children[::-1]
        return "".join(parts)


def _classes(attrs: dict[str, str]) -> frozenset[str]:
    return frozenset(attrs["class"].split()) if attrs.get("class") else _NO_CLASS


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page: list[Element] = []
        self.root = Element("", {}, _NO_CLASS, 0, self.page)
        self.open = [self.root]

    def _shut(self, at: int) -> None:
        """What is open from a place on ends here."""
        for e in self.open[at:]:
            e.last = len(self.page)
        del self.open[at:]

    def _end(self, tags: tuple[str, ...], as_far_as: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._shut(i)
                return
            if self.open[i].tag in as_far_as:
                return

    def start(self, tag: str, attrs: dict[str, str], classes: frozenset[str]) -> None:
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        e = Element(tag, attrs, classes, len(self.page) + 1, self.page)
        self.page.append(e)
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        self.start(tag, held, _classes(held))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._end((tag,), _stops(tag))

    def handle_data(self, data):
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)

    def done(self) -> Element:
        self._shut(1)
        self.root.last = len(self.page)
        return self.root


def _stops(tag: str) -> tuple[str, ...]:
    """An end tag of something else doesn't close a table's cell around it."""
    return () if tag in (*_TABLE, "tr", "tbody", "thead", "tfoot", "body", "html") else ("td", "th")


#: What is known of a tag as it is spelled: kind, name, attributes, classes, what it ends and as far as where. Bounded.
_known: dict[str, tuple | None] = {}
_MOST = 4096
_START, _END, _BOTH = 0, 1, 2


def _spelled(tag: str) -> tuple | None:
    if m := _END_TAG.fullmatch(tag):
        name = m[1].lower()
        return _END, name, None, None, (name,), _stops(name)
    m = _START_TAG.fullmatch(tag)
    if not m or m[1].lower() in _RAW:
        return None
    name, attrs = m[1].lower(), {}
    for key, a, b, bare in _ATTRIBUTES.findall(m[2]):
        if bare and m[3]:
            return None
        attrs[key.lower()] = a or b or bare
    kind = _BOTH if m[3] or name in _VOID else _START  # one that holds nothing
    return kind, name, attrs, _classes(attrs), *_ENDS.get(name, ((), ()))


def _plain(page: str) -> Element | None:
    """The tree of a page that consists of plain tags, or None."""
    pieces = _PIECES.split(page)
    if page.count("<") != len(pieces) // 2:
        return None
    known = _known
    try:
        entries = [known[tag] for tag in pieces[1::2]]
    except KeyError:
        entries = []
        for tag in pieces[1::2]:
            entry = known[tag] if tag in known else _spelled(tag)
            if len(known) < _MOST:
                known[tag] = entry
            entries.append(entry)
    if None in entries:
        return None
    elements: list[Element] = []
    root = Element("", {}, _NO_CLASS, 0, elements)
    stack, tags, inner, n = [root], [""], root.children, 0  # what is open, and how it is called
    for text, (kind, name, attrs, classes, ends, stops) in zip(pieces[::2], entries, strict=False):
        if text:
            if "&" in text:
                text = unescape(text)
            if inner and inner[-1].__class__ is str:
                inner[-1] += text
            else:
                inner.append(text)
        if ends:
            if tags[-1] in ends:
                stack.pop().last = n
                tags.pop()
                inner = stack[-1].children
            elif tags[-1] not in stops:
                for i in range(len(tags) - 2, 0, -1):
                    if tags[i] in ends:
                        for e in stack[i:]:
                            e.last = n
                        del stack[i:], tags[i:]
                        inner = stack[-1].children
                        break
                    if tags[i] in stops:
                        break
        if kind != _END:
            n += 1
            e = Element(name, attrs, classes, n, elements)
            elements.append(e)
            inner.append(e)
            if kind == _START:
                stack.append(e)
                tags.append(name)
                inner = e.children
    if text := pieces[-1]:
        text = unescape(text)
        if inner and inner[-1].__class__ is str:
            inner[-1] += text
        else:
            inner.append(text)
    for e in stack:
        e.last = n
    return root


def parse(page: str | None) -> Element:
    """The tree of a page; what isn't closed ends with what is around it, what was never opened is passed over."""
    root = _plain(page or "")
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.done()
