"""A forward scanner of HTML: tags, text and comments in order, in time linear in the page.

Every character is read a fixed number of times, whatever is left unclosed: where the end
of a construct is not found once, it is not looked for again.
"""

from __future__ import annotations

import re
from html import unescape

# Elements whose content is text up to their end tag, per the HTML standard. Fixed values.
RAW_TEXT = frozenset(["script", "style"])

_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/=>]*)(\s*=+\s*)?")
_UNQUOTED = re.compile(r"[^>\s]*")
_BLANK = re.compile(r"[\s/]*")
_SECTION = re.compile(r"<!\[([a-zA-Z][-_.a-zA-Z0-9]*)")
_COMMENT_END = re.compile(r"--!?>")
_SECTION_END = {False: re.compile(r"\]\s*>"), True: re.compile(r"\]\s*\]\s*>")}
# Names of marked sections, by whether two brackets end them. Fixed values.
_SECTIONS = {
    "temp": True, "cdata": True, "ignore": True, "include": True, "rcdata": True, "if": False,
    "else": False, "endif": False,
}


class RejectedMarkup(ValueError):
    """The scanner cannot read the page."""


class MarkupScanner:
    """Calls its handlers for what a page holds, in order; ``scan`` reads one page.

    Character references in text and attribute values are decoded. A ``<`` that opens
    nothing, and one whose construct does not end, is text, and reading goes on behind it; if
    it is a tag that does not end, all the rest of the page is text. A quoted value without
    its second quote ends at white space or ``>``. Script and style hold text up to their end
    tag, and nothing if there is none.
    """

    #: Marked sections that are read as such; all others end at the next ``>``.
    sections: dict[str, bool] = _SECTIONS

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A start tag; attributes without a value have None."""

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        """An end tag."""

    def handle_data(self, data: str) -> None:
        """A piece of text; more of the same text may follow."""

    def handle_comment(self, data: str) -> None:
        """A comment, declaration or processing instruction."""

    def handle_section(self, name: str, data: str) -> None:
        """A marked section, by its lower-case name; data has the name too."""

    def unknown_section(self, data: str) -> None:
        """A marked section of no known name, up to the next ``>``."""
        raise RejectedMarkup(f"unknown marked section {data[:40]!r}")

    def handle_unfinished(self, data: str) -> None:
        """A start tag that does not end, with the rest of the page."""
        self.handle_data(unescape(data))

    def scan(self, page: str) -> None:
        self._page = page
        self._missing: set[object] = set()
        at, size = 0, len(page)
        while at < size:
            opens = page.find("<", at)
            if opens < 0:
                self.handle_data(unescape(page[at:]))
                return
            if opens > at:
                self.handle_data(unescape(page[at:opens]))
            at = self._markup(opens)
            if at < 0:
                self.handle_data("<")
                at = opens + 1

    def _find(self, what: str | re.Pattern, start: int) -> tuple[int, int]:
        """Where ``what`` comes next and ends; not looked for again once it is missing."""
        if what in self._missing:
            return -1, -1
        if isinstance(what, str):
            found = self._page.find(what, start)
            span = (found, found + len(what))
        else:
            match = what.search(self._page, start)
            span = match.span() if match else (-1, -1)
        if span[0] < 0:
            self._missing.add(what)
        return span

    def _markup(self, at: int) -> int:
        """Read what a ``<`` opens; the place behind it, or -1 if that is nothing."""
        page = self._page
        second = page[at + 1 : at + 2]
        if second == "/":
            return self._end_tag(at)
        if second == "!":
            return self._declaration(at)
        if second == "?":
            end, after = self._find(">", at + 2)
            if end >= 0:
                self.handle_comment(page[at + 2 : end])
            return after
        name = _TAG_NAME.match(page, at + 1)
        return self._start_tag(name) if name else -1

    def _end_tag(self, at: int) -> int:
        end, after = self._find(">", at + 2)
        if end < 0:
            return -1
        name = _TAG_NAME.match(self._page, _BLANK.match(self._page, at + 2).end(), end)
        if name:
            self.handle_endtag(name[0].lower())
        elif end > at + 2:
            self.handle_comment(self._page[at + 2 : end])
        return after

    def _declaration(self, at: int) -> int:
        page = self._page
        if page.startswith("<!--", at):
            for empty in ("<!-->", "<!--->"):
                if page.startswith(empty, at):
                    self.handle_comment("")
                    return at + len(empty)
            end, after = self._find(_COMMENT_END, at + 4)
            if end >= 0:
                self.handle_comment(page[at + 4 : end])
            return after
        section = _SECTION.match(page, at)
        if page.startswith("<![", at):
            name = section[1].lower() if section else ""
            if name in self.sections:
                end, after = self._find(_SECTION_END[self.sections[name]], at + 3)
                if end >= 0:
                    self.handle_section(name, page[at + 3 : end])
                return after
        end, after = self._find(">", at + 2)
        if end >= 0:
            found = page[at + 2 : end]
            (self.unknown_section if found[:1] == "[" else self.handle_comment)(found)
        return after

    def _start_tag(self, name: re.Match) -> int:
        page, at = self._page, name.end()
        attrs: list[tuple[str, str | None]] = []
        while attribute := _ATTRIBUTE.match(page, at):
            at = attribute.end()
            value = None
            if attribute[2]:
                quote = page[at : at + 1]
                end = self._find(quote, at + 1)[0] if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    plain = _UNQUOTED.match(page, at)
                    value, at = plain[0], plain.end()
                value = unescape(value)
            attrs.append((attribute[1].lower(), value))
        end = _BLANK.match(page, at).end()
        if page[end : end + 1] != ">":
            self.handle_unfinished(page[name.start() - 1 :])
            return len(page)
        tag = name[0].lower()
        if page[end - 1] == "/" and end > at:
            self.handle_startendtag(tag, attrs)
            return end + 1
        self.handle_starttag(tag, attrs)
        return self._raw_text(tag, end + 1) if tag in RAW_TEXT else end + 1

    def _raw_text(self, tag: str, at: int) -> int:
        close = re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE).search(self._page, at)
        if not close:
            return len(self._page)
        if close.start() > at:
            self.handle_data(self._page[at : close.start()])
        self.handle_endtag(tag)
        return close.end()
