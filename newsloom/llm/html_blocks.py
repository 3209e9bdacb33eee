"""Pages as blocks of text, with what a classifier of boilerplate asks about each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Tags that begin and end a block of text.  A line break inside a block is white space.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags whose content is no text of the page; it ends at the end tag, whatever it holds.
RAW_TAGS = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg".split())
#: Tags that an open one of the same group ends.
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open item does not end beyond these.
SCOPES = frozenset("ul ol menu dl table select body html article section div".split())

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of a class, id or role that name what is never the article, wherever it is.
NEVER_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "contentinfo comment comments commentlist reply replies respond disqus share sharing social "
    "related recommended newsletter subscribe subscription signup login pagination pager copyright".split()
)
#: Words that name a part beside the article, or a frame that may also hold it.
FRAMES = frozenset(
    "notice notices alert alerts sidebar aside complementary masthead header topbar popup modal "
    "dialog overlay widget toolbar search form".split()
)
#: A name that begins so tells what an element has or lacks, not what it is.
TELLING = frozenset("has have no not with without hide hides hidden show shows is js".split())
#: Names of a heading's frame, which are no boilerplate inside an article.
HEADS = frozenset(("header", "masthead"))
BOILERPLATE_TAGS = frozenset("nav footer menu search button select optgroup option fieldset legend label".split())
FRAME_TAGS = frozenset("aside form dialog".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Block:
    text: str
    link_chars: int  # characters inside links
    depth: int
    gap: int  # steps in the tree from the block before
    parent: int  # the element the block is in
    tag: str
    boilerplate: int  # open elements that tell of boilerplate
    article: int  # open article elements
    frame: int = 0  # the innermost open element that does unless it holds the article


@dataclass
class _Open:
    tag: str
    number: int
    boilerplate: int
    article: int
    frame: int = 0


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, 0, 0)])
    elements: int = 0
    runs: list[str] = field(default_factory=list)
    link_chars: int = 0
    links: int = 0
    lowest: int = 0  # least depth since the last block
    last_depth: int = 0
    around: dict[int, int] = field(default_factory=dict)  # of each frame the one around it, or 0
    holders: set[int] = field(default_factory=set)  # frames with an article inside
    prose: dict[int, int] = field(default_factory=dict)  # characters of paragraphs in each frame

    def text(self, run: str) -> None:
        run = html.unescape(run)
        self.runs.append(run)
        if self.links:
            self.link_chars += len(run)

    def flush(self) -> None:
        text = " ".join("".join(self.runs).split())
        if text:
            inner, depth = self._block_element()
            gap = self.last_depth + depth - 2 * min(self.lowest, depth)
            parent = self.stack[max(depth - 1, 0)].number
            top = self.stack[depth]
            self.blocks.append(
                Block(text, self.link_chars, depth, gap, parent, inner, top.boilerplate, top.article, top.frame)
            )
            if inner == "p" and not top.boilerplate:
                self.prose[top.frame] = self.prose.get(top.frame, 0) + len(text)
            self.lowest = self.last_depth = depth
        self.runs, self.link_chars = [], 0

    def frames_beside(self) -> dict[int, int]:
        """For each frame, how many of it and those around it are beside the article: a frame
        around the article is the page itself, and so is, on a page that marks no article,
        one around most of the paragraphs."""
        prose, holders = dict(self.prose), set(self.holders)
        for frame in reversed(self.around):  # inner ones first
            outer = self.around[frame]
            prose[outer] = prose.get(outer, 0) + prose.get(frame, 0)
            if frame in holders:
                holders.add(outer)
        beside = {0: 0}
        for frame, outer in self.around.items():
            is_page = frame in holders or (not holders and 2 * prose.get(frame, 0) > prose.get(0, 0))
            beside[frame] = beside[outer] + (not is_page)
        return beside

    def _block_element(self) -> tuple[str, int]:
        """Innermost open block element and its depth."""
        depth = len(self.stack) - 1
        while depth and self.stack[depth].tag not in BLOCK_TAGS:
            depth -= 1
        return self.stack[depth].tag, depth

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if self.stack[-1].tag == "p" or any(x.tag == "p" for x in self.stack[-4:]):
                self._end({"p"}, SCOPES)
            if tag in ITEMS:
                self._end(ITEMS[tag], SCOPES - {tag})
        if tag in VOID_TAGS:
            if tag == "br":
                self.runs.append(" ")
            return
        top = self.stack[-1]
        names = set()
        for match in _ATTRIBUTE.finditer(attributes):
            for name in (match[2] or match[3] or match[4] or "").split():
                words = [word.lower() for word in _NAME.findall(name)]
                if words and words[0] not in TELLING:
                    names.update(words)
        if top.article:
            names -= HEADS
        marked = tag in BOILERPLATE_TAGS or bool(names & NEVER_ARTICLE) or bool(_HIDDEN.search(attributes))
        frame = tag in FRAME_TAGS or bool(names & FRAMES) or (tag == "header" and not top.article)
        if tag in ("body", "html"):
            marked = frame = False
        self.elements += 1
        inner = self.elements if frame else top.frame
        if frame:
            self.around[inner] = top.frame
        if tag in ARTICLE_TAGS and not top.boilerplate:
            self.holders.add(inner)
        article = top.article + (tag in ARTICLE_TAGS)
        self.stack.append(_Open(tag, self.elements, top.boilerplate + marked, article, inner))
        self.links += tag == "a"

    def _end(self, tags: set[str] | frozenset[str], scopes: frozenset[str]) -> None:
        """Closes the nearest open element of ``tags``, unless a scope is nearer."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                self._cut(depth)
                return
            if tag in scopes:
                return

    def _cut(self, depth: int) -> None:
        self.links -= sum(x.tag == "a" for x in self.stack[depth:])
        del self.stack[depth:]
        self.lowest = min(self.lowest, depth - 1)

    def close(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self._cut(depth)
                return
            # An inline end tag does not end the block around it.
            if tag not in BLOCK_TAGS and self.stack[depth].tag in BLOCK_TAGS:
                return


def read_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    reader, at = _Reader(), 0
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            reader.text(page[at:])
            break
        if match.start() > at:
            reader.text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            reader.close(tag)
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            reader.open(tag, match[3] or "")
    reader.flush()
    beside = reader.frames_beside()
    for block in reader.blocks:
        block.boilerplate += beside[block.frame]
    return reader.blocks
