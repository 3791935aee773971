"""Main text of HTML pages by two passes of block rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from pagerisk.functions.scanner import MarkupScanner

# Frequent function words of four languages. Fixed values.
STOP_WORDS = frozenset(
    [
        *["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with"],
        *["as", "be", "by", "at", "this", "are", "or", "from", "not", "have", "an", "which"],
        *["de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "pour"],
        *["qui", "dans", "par", "pas", "au", "sur", "ne", "se", "ce", "il", "elle", "avec"],
        *["der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für"],
        *["ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "aus", "sie", "bei"],
        *["el", "los", "las", "y", "del", "una", "con", "para", "por", "su", "al", "lo", "no"],
    ]
)
# Elements that start and end a block. Fixed values.
BLOCKS = frozenset(
    [
        *["address", "article", "aside", "blockquote", "body", "caption", "center", "dd"],
        *["details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer"],
        *["form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html"],
        *["legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary"],
        *["table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"],
    ]
)
# Elements whose content is never main text. Fixed values.
DROPPED = frozenset(
    [
        *["aside", "audio", "button", "canvas", "dialog", "footer", "form", "head", "iframe"],
        *["math", "menu", "nav", "noscript", "object", "script", "select", "style", "svg"],
        *["template", "textarea", "title", "video"],
    ]
)
# Parts of class, id and role values that mark furniture of a page. Fixed values.
FURNITURE = frozenset(
    [
        *["ad", "ads", "adsense", "advert", "advertisement", "alert", "banner", "breadcrumb"],
        *["breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo"],
        *["cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav"],
        *["navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination"],
        *["popup", "promo", "recommended", "related", "reply", "respond", "search", "share"],
        *["sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe"],
        *["toolbar", "widget"],
    ]
)
_PAGE_HEADER = frozenset(["header", "masthead"])
# Those of them that say where a thing stands; the others say what its text is. Fixed values.
LAYOUT = _PAGE_HEADER | frozenset(
    [
        *["alert", "banner", "footer", "menu", "modal", "nav", "navbar", "navigation", "notice"],
        *["overlay", "pager", "pagination", "popup", "search", "share", "sharing", "sidebar"],
        *["social", "toolbar", "widget"],
    ]
)
# First and last parts of names that tell of a state, as in has-sidebar. Fixed values.
_STATE_FIRST = frozenset(["has", "have", "no", "not", "with", "without"])
_STATE_LAST = frozenset(["closed", "disabled", "enabled", "open", "opened"])
_ARTICLE = frozenset(["article", "main"])
_VOID = frozenset(
    [
        *["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param"],
        *["source", "track", "wbr"],
    ]
)
# Elements whose ids are targets of links and made from their words.
_ANCHORS = frozenset(["a", "h1", "h2", "h3", "h4", "h5", "h6"])
# Elements whose start ends an open one of their kind: which, and what it may not be outside of.
_CELL_BOUNDS = frozenset(["table", "tbody", "tfoot", "thead", "tr"])
_IMPLIED = {
    **{name: (frozenset(["td", "th"]), _CELL_BOUNDS) for name in ("td", "th")},
    "tr": (frozenset(["tr"]), _CELL_BOUNDS - {"tr"}),
    "li": (frozenset(["li"]), (BLOCKS | DROPPED) - {"address", "div", "li", "p"}),
    **{
        name: (frozenset(["dd", "dt"]), (BLOCKS | DROPPED) - {"address", "dd", "div", "dt", "p"})
        for name in ("dd", "dt")
    },
    "p": (frozenset(["p"]), (BLOCKS | DROPPED) - {"p"}),
    "a": (frozenset(["a"]), BLOCKS),
}
# What text is called when names are joined, as in commentlist or user-responses.
_JOINED = re.compile(
    r"(comment|advert|promo|sponsor|respon[sd]|repl(?:y|ie))"
    r"(?:s|es|e|list|section|area|thread|form|box|wrap|wrapper|container|block|unit)*"
)
_JOINED_AS = {"comment": "comments", "advert": "advert", "promo": "promo", "sponsor": "sponsor"}
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")
# Letters of scripts that put no spaces between words; two make about a word.
_SPACELESS = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\U00020000-\U0003ffff]"
)

SHORT_WORDS = 12
STOP_DENSITY = 0.3
LOW_STOP_DENSITY = 0.15
LINK_DENSITY = 0.4
# With more of its letters in links, a block is nothing but links; so many make a menu.
LINK_ONLY = 0.9
MENU_BLOCKS = 3
# What has a furniture name must outweigh all other text so many times to be no furniture.
OUTWEIGHS = 10
# Good text outside the articles must outweigh theirs so many times for them to be teasers.
OUTWEIGHS_ARTICLES = 2
# Ids with more parts are made from the words of a title.
MOST_ID_PARTS = 3

GOOD, BAD, UNSURE = 1, 0, None


class Container:
    """An element with a furniture name, and the letters of the blocks in it."""

    __slots__ = (
        "hits", "parent", "inside", "lifted", "inner", "article",
        "letters", "prose", "articles", "own", "own_articles",
    )

    def __init__(
        self, hits: frozenset[str], parent: Container | None, inside: int, article: bool = False
    ):
        self.hits = hits
        self.article = article  # an outermost article, which is none of the page's then
        self.parent = parent
        self.inside = inside
        self.lifted = False
        self.inner: list[Container] = []
        self.letters = self.prose = self.articles = self.own = self.own_articles = 0


class Block:
    """Text between two block boundaries, and where it stands."""

    __slots__ = (
        "parts", "linked", "dropped", "container", "inside", "heading",
        "text", "words", "short", "letters", "links",
    )

    def __init__(self, dropped: bool, container: Container | None, inside: int, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.dropped = dropped
        self.container = container
        self.inside = inside
        self.heading = heading

    def read(self) -> str:
        """The text; if it is not dropped, words, letters and their share in links are set."""
        parts = "".join(self.parts).split()
        self.text = " ".join(parts)
        if not self.dropped:
            self.words = _WORD.findall(self.text.lower())
            self.short = len(self.words) < SHORT_WORDS and (
                self.text.isascii() or len(_SPACELESS.findall(self.text)) < 2 * SHORT_WORDS
            )
            self.letters = sum(map(len, parts))
            self.links = self.linked / self.letters if self.letters else 0.0
        return self.text


class BlockReader(MarkupScanner):
    """Cuts a page into blocks while reading it once."""

    sections = {}  # as in the HTML standard, they are comments

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.containers: list[Container] = []
        self.homes: list[Container | None] = [None]  # where the article of that number starts
        # element, whether it is dropped, what it is if it has a furniture name
        self._open: list[tuple[str, bool, Container | None]] = []
        self._count: dict[str, int] = {}  # open elements by name
        self._dropped = 0
        self._container: Container | None = None
        self._articles = 0
        self._anchors = 0
        self._heading = False
        self._block: Block | None = None
        self._side: Block | None = None
        self.scan(html)
        self._end()

    def unknown_section(self, data):
        """A comment."""

    def handle_unfinished(self, data):
        """Markup."""

    def handle_data(self, data):
        dropped = self._dropped > 0
        block = self._block
        if block is not None and block.dropped != dropped:
            if dropped:  # a script or the like inside a block of text
                return
            self._end()
        elif block is not None and block.container is not self._container:
            if self._container is None or self._container.parent is not block.container:
                self._end()
            elif self._side is None or self._side.container is not self._container:
                self._side = self._begin(dropped)
                self.blocks.append(self._side)
        if self._block is None:
            self._block = self._begin(dropped)
        block = self._block if self._block.container is self._container else self._side
        block.parts.append(data)
        if self._anchors:
            block.linked += len("".join(data.split()))

    def _begin(self, dropped):
        inside = len(self.homes) - 1 if self._articles else 0
        return Block(dropped, self._container, inside, self._heading)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        if tag in BLOCKS:
            self._end()
            self._heading = tag[0] == "h" and tag[1:].isdigit()
        if tag == "a":
            self._anchors = 1
        if tag in BLOCKS:
            self._leave(*_IMPLIED["p"])
        if tag in _IMPLIED:
            self._leave(*_IMPLIED[tag])
        if tag in _VOID:
            return
        if tag in _ARTICLE and self._count.get("nav"):
            self.handle_endtag("nav")
        if tag in BLOCKS or tag in DROPPED or tag == "span":
            self._enter(tag, attrs)
        elif self._count.get(tag) or attrs and self._furniture(tag, attrs):
            self._enter(tag, attrs)

    def _leave(self, tags, bounds):
        """Close the innermost open element of ``tags`` that is not outside of ``bounds``."""
        if not any(self._count.get(tag) for tag in tags):
            return
        for name, _, _ in reversed(self._open):
            if name in tags:
                self._pop(name)
                return
            if name in bounds:
                return

    def _enter(self, tag, attrs):
        dropped = tag in DROPPED or tag == "header" and not self._articles
        dropped = dropped or any(key == "hidden" for key, _ in attrs)
        named = None
        if tag in _ARTICLE and not self._articles:
            # Its place says nothing, but it may be a reader's comment or an advert.
            if not dropped and (hits := self._furniture(tag, attrs) - LAYOUT):
                named = Container(hits, self._container, 0, article=True)
                self.containers.append(named)
                self._container = named
            else:
                self.homes.append(self._container)
        elif not dropped and (hits := self._furniture(tag, attrs)):
            inside = len(self.homes) - 1 if self._articles else 0
            named = Container(hits, self._container, inside)
            self.containers.append(named)
            self._container = named
        self._open.append((tag, dropped, named))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._dropped += dropped
        self._articles += tag in _ARTICLE and not (named and named.article)

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end()
            self._heading = False
        if tag == "a":
            self._anchors = 0
        if tag in _IMPLIED:
            self._leave(frozenset([tag]), _IMPLIED[tag][1] - {tag})
        elif self._count.get(tag):
            self._pop(tag)

    def _pop(self, tag):
        closed = None
        while closed != tag:
            closed, dropped, named = self._open.pop()
            self._count[closed] -= 1
            self._dropped -= dropped
            if named is not None:
                self._container = named.parent
            self._articles -= closed in _ARTICLE and not (named and named.article)

    def _furniture(self, tag, attrs) -> frozenset[str]:
        """The parts of the element's names that mark furniture."""
        if tag in ("html", "body"):
            return frozenset()
        found = set()
        for key, value in attrs:
            if key not in ("class", "id", "role") or not value:
                continue
            for name in value.split():
                parts = [part.lower() for part in _NAME_PARTS.findall(name)]
                if len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST):
                    continue
                if key != "id" or len(parts) <= MOST_ID_PARTS and tag not in _ANCHORS:
                    found.update(parts)
                    joined = filter(None, map(_JOINED.fullmatch, parts))
                    found.update(_JOINED_AS.get(match[1], "reply") for match in joined)
        if tag not in BLOCKS and tag != "span":  # words of a sentence: places say nothing of them
            return frozenset(found & FURNITURE - LAYOUT)
        return frozenset(found & FURNITURE if self._articles else found & (FURNITURE | _PAGE_HEADER))

    def _end(self):
        if self._block is not None:
            self.blocks.append(self._block)
            self._block = self._side = None


def lift(reader: BlockReader, blocks: list[Block]) -> None:
    """Overrule the names of containers that hold the page's text; drop what the others hold.

    A name is a vote. From the outside in, containers of one name are no furniture where
    they hold the only articles of the page, or most of its text while hardly any prose
    stands elsewhere: none where the name says what the text is.
    """
    if not reader.containers:
        return
    total = exposed = exposed_articles = 0
    for block in blocks:
        if block.dropped:
            continue
        letters = block.letters
        prose = letters if not block.short and block.links <= LINK_DENSITY else 0
        total += letters
        own = letters if block.inside else prose
        if block.container is None:
            exposed += own
            exposed_articles += letters if block.inside else 0
        else:
            block.container.letters += letters
            block.container.prose += prose
            block.container.own += own
            block.container.own_articles += letters if block.inside else 0
        if block.inside and reader.homes[block.inside] is not None:
            reader.homes[block.inside].articles += letters
    for container in reversed(reader.containers):
        parent = container.parent
        if parent is not None:
            parent.letters += container.letters
            parent.prose += container.prose
            parent.articles += container.articles
    level = []
    for container in reader.containers:
        (level if container.parent is None else container.parent.inner).append(container)
    while level:
        groups: dict[frozenset[str], list[Container]] = {}
        for container in level:
            groups.setdefault(container.hits, []).append(container)
        level, claimed = [], False
        for hits, group in groups.items():
            articles = sum(c.articles for c in group)
            prose = sum(c.prose for c in group)
            # A name of a text is not overruled by articles: readers' comments may be such.
            only = bool(articles) and not exposed_articles and not claimed and hits <= LAYOUT
            most = 2 * sum(c.letters for c in group) > total and prose > OUTWEIGHS * exposed
            most = most and (hits <= LAYOUT or not exposed)
            if only or most and (articles or not exposed_articles or all(c.inside for c in group)):
                claimed = claimed or only
                for container in group:
                    container.lifted = True
                    level.extend(container.inner)
                    exposed += container.own
                    exposed_articles += container.own_articles
    for block in blocks:
        block.dropped |= block.container is not None and not block.container.lifted


def stop_density(block: Block) -> float:
    return sum(word in STOP_WORDS for word in block.words) / max(len(block.words), 1)


def classify(block: Block):
    """First pass: good, bad, or unsure for blocks that say too little."""
    if block.dropped or block.links > LINK_DENSITY:
        return BAD
    if block.short or block.heading:
        return UNSURE
    return GOOD if stop_density(block) >= STOP_DENSITY else UNSURE


def classify_in_article(block: Block, label):
    """The label of a block in the page's article: what is not made of links is good there."""
    if block.dropped or label == GOOD or block.links <= LINK_DENSITY:
        return BAD if block.dropped else GOOD
    if block.short:
        return GOOD if block.heading or block.links <= LINK_ONLY else UNSURE
    return GOOD if stop_density(block) >= LOW_STOP_DENSITY else UNSURE


def strike_menus(blocks: list[Block], labels: list) -> None:
    """Makes runs of link-only blocks bad where an article starts, ends or is interrupted.

    A run between two good blocks is a list of the article's own.
    """
    at = 0
    for linked, run in groupby(
        zip(blocks, labels, strict=True),
        lambda pair: pair[1] is UNSURE and pair[0].links > LINK_ONLY,
    ):
        end = at + len(list(run))
        if linked and end - at >= MENU_BLOCKS:
            if at == 0 or end == len(labels) or BAD in (labels[at - 1], labels[end]):
                labels[at:end] = [BAD] * (end - at)
        at = end


def settle(labels: list, headings: list[bool]) -> list[bool]:
    """Second pass: what is unsure takes the label of the nearest decided block.

    Where both sides are equally near and differ, a heading goes with what follows it and
    other blocks are bad. With nothing decided on either side they are bad.
    """
    count = len(labels)
    before: list = [None] * count
    after: list = [None] * count
    seen = None
    for n in range(count):
        seen = (n, labels[n]) if labels[n] is not UNSURE else seen
        before[n] = seen
    seen = None
    for n in reversed(range(count)):
        seen = (n, labels[n]) if labels[n] is not UNSURE else seen
        after[n] = seen
    out = []
    for n in range(count):
        back, on = before[n], after[n]
        if back is None or on is None:
            near = back or on
            out.append(near is not None and near[1] == GOOD)
        elif n - back[0] == on[0] - n and back[1] != on[1]:
            out.append(headings[n] and on[1] == GOOD)
        else:
            out.append((back if n - back[0] <= on[0] - n else on)[1] == GOOD)
    return out


def label(blocks: list[Block]) -> tuple[list, bool]:
    """First pass over a page: the rules for every block, and what its articles add to them.

    Also returns whether the articles count.
    """
    labels = [classify(block) for block in blocks]
    # Where next to nothing reaches the bar, the language is none of those of the stop words.
    plain = [
        n
        for n, block in enumerate(blocks)
        if labels[n] is UNSURE and not block.short and not block.heading
    ]
    good = sum(block.letters for n, block in enumerate(blocks) if labels[n] == GOOD)
    if sum(blocks[n].letters for n in plain) > OUTWEIGHS * good:
        for n in plain:
            labels[n] = GOOD
    inside = sum(block.letters for block in blocks if block.inside and not block.dropped)
    outside = sum(
        block.letters for n, block in enumerate(blocks) if labels[n] == GOOD and not block.inside
    )
    if outside > OUTWEIGHS_ARTICLES * inside:
        return labels, False
    labels = [
        classify_in_article(block, label) if block.inside else label
        for block, label in zip(blocks, labels, strict=True)
    ]
    if GOOD not in labels:  # a page of short blocks: what is not linked is its text
        labels = [
            GOOD if label is UNSURE and block.links <= LINK_DENSITY else label
            for block, label in zip(blocks, labels, strict=True)
        ]
    return labels, True


def main_text(html: str | None) -> str:
    """The main text of one page, its blocks joined by an empty line."""
    if not html:
        return ""
    reader = BlockReader(html)
    blocks = [block for block in reader.blocks if block.read()]
    lift(reader, blocks)
    labels, articles = label(blocks)
    kept: list[bool] = []
    for inside, part in groupby(blocks, lambda block: block.inside):
        some = list(part)
        marks = labels[len(kept) : len(kept) + len(some)]
        if inside and articles:
            strike_menus(some, marks)
        kept += settle(marks, [block.heading for block in some])
    return "\n\n".join(block.text for block, keep in zip(blocks, kept, strict=True) if keep)


def extract(
    pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all but the HTML, if not given), text and n_chars of every page.

    A page is cut at block elements. First pass: what stands in menus, page headers, footers,
    sidebars, forms, scripts, or in elements named as adverts, notices or comments is bad,
    unless the named elements hold the only articles or nearly all text of the page. For all
    else link density, length and the density of stop words decide, and blocks that are
    short or have few stop words stay unsure; on pages with next to no stop words, long
    blocks with few links are good. Inside an article only blocks made of links are unsure, and bad in a run at its
    bounds, unless good text outside outweighs all articles of the page, which then are
    teasers. Second pass: what is unsure
    inherits from the nearest decided block, on its own side of an article's bounds.

    A NULL, empty or wholly bad page gives an empty text; pages are read one by one, whole,
    so repeated rows give equal results; input columns text and n_chars are replaced; an
    empty table gives an empty one.
    """
    names = [c for c in pages.columns if c != html_col] if keep is None else keep
    names = [c for c in names if c not in ("text", "n_chars")]
    source = pages.select(
        *[pages[f"`{c}`"] for c in names], pages[f"`{html_col}`"].alias("_llm_html")
    )
    schema = T.StructType(
        [
            *source.schema.fields[:-1],
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts = [main_text(value.as_py()) for value in batch.column(last)]
            kept = [batch.column(i) for i in range(last)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
