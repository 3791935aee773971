"""Element extraction from one HTML page, and the Arrow UDF that applies it to a column.

The page is read once by a linear scanner. Nesting is kept as a stack: an end tag closes
the nearest open element of its name with everything above it, an unmatched one is ignored,
and the end of the page closes the rest. As in the HTML standard, a link ends where the next
one starts, and a heading where the next heading starts, so every text is kept once for each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

from pagerisk.functions.scanner import MarkupScanner, RejectedMarkup

# Elements without content, per the HTML standard (with its obsolete ones). Fixed values.
VOID_ELEMENTS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose text is not page text. Fixed values.
HIDDEN_TEXT = frozenset(["script", "style", "template", "rt", "rp"])
HEADING_LEVELS = ("h1", "h2", "h3", "h4", "h5")
NO_TITLE = "No Title"

_STRINGS = "array<string>"
FIELD_TYPES = {
    "title": "string",
    "headings": "array<struct<level:int,pos:int,text:string>>",
    "links": "array<struct<text:string,href:string>>",
    "meta": "map<string,string>",
    "text": "string",
    "embedded_scripts": _STRINGS,
    "external_scripts": _STRINGS,
    "images": "array<struct<src:string,alt:string>>",
}
_ARROW_STRINGS = pa.list_(pa.string())
_ARROW_TYPES = {
    "title": pa.string(),
    "headings": pa.list_(
        pa.struct([("level", pa.int32()), ("pos", pa.int32()), ("text", pa.string())])
    ),
    "links": pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())])),
    "meta": pa.map_(pa.string(), pa.string()),
    "text": pa.string(),
    "embedded_scripts": _ARROW_STRINGS,
    "external_scripts": _ARROW_STRINGS,
    "images": pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())])),
}


class PageElements(MarkupScanner):
    """Collects the elements of one page while reading it."""

    def __init__(self, html: str):
        self.titles: list[list[str]] = []
        self.heads: list[tuple[int, list[str]]] = []
        self.anchors: list[tuple[list[str], str]] = []
        self.meta: dict[str, str] = {}
        self.scripts: list[tuple[list[str], str | None]] = []
        self.images: list[dict[str, str]] = []
        self.visible: list[str] = []
        self._open: list[str] = []
        self._open_count: dict[str, int] = {}
        self._collecting: list[tuple[int, str, list[str]]] = []
        self._hiding: list[tuple[int, str]] = []
        self._node: list[str] = []
        self.scan(html)
        self._end_node()

    def handle_data(self, data):
        self._node.append(data)

    def handle_comment(self, data):
        self._end_node()

    def handle_section(self, name, data):
        self._end_node()
        if name == "cdata":
            self._node.append(data[6:])
            self._end_node()

    def handle_starttag(self, tag, attrs):
        self._end_node()
        values = {name: value or "" for name, value in attrs}
        text: list[str] | None = None
        if tag == "title":
            text = [] if not self.titles else None  # only the first counts
            self.titles.append([] if text is None else text)
        elif tag in HEADING_LEVELS:
            text = []
            self._stop(HEADING_LEVELS)
            self.heads.append((int(tag[1]), text))
        elif tag == "a":
            text = []
            self._stop(("a",))
            self.anchors.append((text, values.get("href", "#")))
        elif tag == "script":
            text = []
            self.scripts.append((text, values.get("src")))
        elif tag == "img":
            self.images.append({"src": values.get("src", ""), "alt": values.get("alt", "")})
        elif tag == "meta" and values.get("name"):
            self.meta[values["name"].lower()] = values.get("content", "")
        if tag in VOID_ELEMENTS:
            return
        depth = len(self._open)
        self._open.append(tag)
        self._open_count[tag] = self._open_count.get(tag, 0) + 1
        if text is not None:
            self._collecting.append((depth, tag, text))
        if tag in HIDDEN_TEXT:
            self._hiding.append((depth, tag))

    def _stop(self, tags):
        """Texts that are collected for elements of these names are at their end."""
        self._collecting = [mark for mark in self._collecting if mark[1] not in tags]

    def handle_endtag(self, tag):
        self._end_node()
        if not self._open_count.get(tag):
            return
        closed = None
        while closed != tag:
            closed = self._open.pop()
            self._open_count[closed] -= 1
        for marks in (self._collecting, self._hiding):
            while marks and marks[-1][0] >= len(self._open):
                marks.pop()

    def _end_node(self):
        if not self._node:
            return
        node = "".join(self._node)
        self._node = []
        hidden_by = self._hiding[-1][1] if self._hiding else None
        if hidden_by is None:
            self.visible.append(node)
        for _, tag, text in self._collecting:
            if hidden_by == ("script" if tag == "script" else None):
                text.append(node)

    def field(self, name: str):
        return getattr(self, f"_get_{name}")()

    def _get_title(self):
        return _stripped(self.titles[0]) if self.titles else NO_TITLE

    def _get_headings(self):
        ordered = sorted(enumerate(self.heads), key=lambda item: (item[1][0], item[0]))
        return [
            {"level": level, "pos": pos, "text": _stripped(text)} for pos, (level, text) in ordered
        ]

    def _get_links(self):
        return [{"text": _stripped(text), "href": href} for text, href in self.anchors]

    def _get_meta(self):
        return list(self.meta.items())

    def _get_text(self):
        return " ".join(" ".join(self.visible).split())

    def _get_embedded_scripts(self):
        return [_stripped(text) for text, _ in self.scripts if "".join(text)]

    def _get_external_scripts(self):
        return [src for _, src in self.scripts if src is not None]

    def _get_images(self):
        return self.images


def _stripped(nodes: list[str]) -> str:
    """Text nodes, each stripped, joined without a separator."""
    return "".join(node.strip() for node in nodes)


def page_elements(html: Column, fields=tuple(FIELD_TYPES)) -> Column:
    """Struct of the chosen fields; a NULL or unreadable page gives a NULL struct.

    Only the named fields are built and sent back to the JVM.
    """
    fields = tuple(fields)
    unknown = set(fields) - set(FIELD_TYPES)
    if not fields or unknown:
        raise ValueError(f"unknown or no fields: {sorted(unknown)}")
    arrow_type = pa.struct([(name, _ARROW_TYPES[name]) for name in fields])

    @F.arrow_udf("struct<" + ",".join(f"{n}:{FIELD_TYPES[n]}" for n in fields) + ">")
    def extract(pages: pa.Array) -> pa.Array:
        rows = []
        for page in pages:
            if not page.is_valid:
                rows.append(None)
                continue
            try:
                elements = PageElements(page.as_py())
            except RejectedMarkup:
                rows.append(None)
            else:
                rows.append({name: elements.field(name) for name in fields})
        return pa.array(rows, type=arrow_type)

    return extract(html)
