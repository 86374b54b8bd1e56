"""Main text of web pages by tag-path ratios (operator 5).

A page's text nodes are grouped by their root-to-leaf path of block tags. A path's ratios are its text and its
punctuation per node; both are smoothed along the page, multiplied, and nodes above a share of the spread are taken as
content. The article is the nearest article or main element around them, else the smallest element that holds all of them
and the heading before; its blocks are returned in page order but for those under elements that a page uses for other
things (menus, forms, adverts, comments of readers).
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import exp
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, text_chunks

#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in "script style noscript template iframe textarea title xmp noembed noframes".split()}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")

#: Tags that don't break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr picture math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes: an element of its own kind that is still open in the same container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure".split()}
#: Elements that hold no article text, by tag, by ARIA role, and by words of class.
NOT_TEXT = frozenset("head nav footer aside form button select option input label svg canvas object embed dialog menu audio video map datalist fieldset legend".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOT_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adv sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " sidebar sidenav menu menus nav navbar navigation navi breadcrumb breadcrumbs footer topbar masthead comment comments commentlist respond replies reply disqus share sharing social related recommended"
    " widget widgets login signup signin search searchbox toolbar pagination pager copyright legal disclaimer paywall alert toc buy shop cart checkout cta".split()
)
#: Words that say nothing about what an element is for; a class of such words and those above is one for other things.
GENERIC = frozenset(
    "list area box section wrapper wrap container block item items content contents inner outer body bar link links post posts form thread slot unit top bottom left right main holder panel group title heading"
    " header row col column text small large desktop mobile button buttons icon icons primary secondary global site page entry js lazy sticky fixed".split()
)
#: Elements of running text: their class alone never decides, only together with the ratio of their path.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd pre blockquote figcaption caption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset({"html", "body", "article", "main"})


#: What names a container of readers' comments.
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())


def _named(value: str, words_of=NOT_WORDS) -> bool:
    """Whether a class or id says that its element is for other things than article text: all its words are such words or say nothing."""
    for token in value.split():
        words = [w.lower() for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if any(w in words_of for w in words) and all(w in words_of or w in GENERIC or len(w) == 1 or w.isdigit() for w in words):
            return True
    return False


#: What an element's tag and attributes say: nothing, that it is for other things if its path fails, that it is.
NOTHING, DOUBT, OTHER = range(3)


def _other(tag: str, attrs: str, inside: bool) -> int:
    """Whether the element is for something else than article text. inside: below an article or main element, where ids name headings and sections, so that they count only for containers of readers' comments."""
    if tag in NOT_TEXT or tag == "header" and not inside:
        return OTHER
    if not attrs or tag in _SCOPE:
        return NOTHING
    out = NOTHING
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        low = value.lower()
        if name == "hidden" or name == "aria-hidden" and low == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            return OTHER
        if name == "role" and low in NOT_ROLES:
            return OTHER
        if name == "class" or name == "id" and tag not in RUNNING:
            if _named(value, COMMENTS if inside and name == "id" else NOT_WORDS):
                out = DOUBT if tag in RUNNING else OTHER
            elif not inside and tag not in RUNNING and low == "header":
                out = OTHER
        if out == OTHER:
            return out
    return out


def _tokens(page: str) -> Iterator[tuple[str, str, str, str | None]]:
    """The page's tags (slash, name, attributes, None) and texts ("", "", "", text), in one pass.

    A quote without an end doesn't count as one: tags up to it end at their first `>`. So at most two searches for the end of
    a quote are in vain. A tag without an end is no text, as in browsers.
    """
    at, size, broken = 0, len(page), 0
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "", "", "", page[at:end]
            at = end
            continue
        name = _NAME.match(page, at)
        if name is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), at):
                at = page.find(">", at) + 1 or size
            else:
                yield "", "", "", "<"
                at += 1
            continue
        begin = name.end()
        end = begin if begin < broken else _INSIDE.match(page, begin).end()
        if begin >= broken and page[end : end + 1] != ">":
            broken = end + 1
        if begin < broken:
            end = page.find(">", begin)
        if end < 0:
            return
        slash, tag, at = name.group(1), name.group(2).lower(), end + 1
        if tag in RAW and not slash:
            close = RAW[tag].search(page, at)
            at = (page.find(">", close.end() - 1) + 1 or size) if close else size
        else:
            yield slash, tag, page[begin:end], None


class Block(NamedTuple):
    """node: the element that it stands in; path: a number of the tags down to there; links: characters in links; able: whether it may be article text; doubt: only if its path passes."""

    node: int
    path: int
    text: str
    links: int
    able: bool
    doubt: bool

    @property
    def linked(self) -> bool:
        """Whether half or more of the block is links."""
        return self.links * 2 >= max(1, len(self.text))


class Page:
    """A page's blocks and elements, in order. Elements are numbered as they open, 0 is the page, so those inside one are a range."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.tag, self.parent, self.last = [""], [0], [0]
        self.declared = [0]  # the innermost article or main element around, itself included; 0: none
        paths: dict[tuple[int, str], int] = {}
        stack, path, others, opened = [0], [0], [NOTHING], Counter()
        held: list[str] = []
        links, link, shut = 0, 0, None

        def flush():
            nonlocal held, links
            if held:
                text = _SPACE.sub(" ", "".join(held)).strip()
                if text:
                    self.blocks.append(Block(stack[-1], path[-1], text, links, others[-1] < OTHER, others[-1] == DOUBT))
                held, links = [], 0

        def pop():
            path.pop()
            others.pop()
            node = stack.pop()
            self.last[node] = len(self.tag) - 1
            opened[self.tag[node]] -= 1

        def near(tag):
            return any(self.tag[node] == tag for node in stack[-3:])

        for slash, tag, attrs, text in _tokens(page):
            if text is not None:
                if "&" in text:
                    text = html.unescape(text)
                held.append(text)
                if link:
                    links += len(text.strip())
                continue
            if tag in INLINE:
                if tag == "br":
                    held.append(" ")
                elif tag == "a":
                    link = 0 if slash else 1
                # An inline element that is no article text (a badge, a hidden span) is passed over up to its end.
                elif shut is None and not slash and attrs and _other(tag, attrs, True) == OTHER:
                    shut = tag, len(held)
                elif shut and slash and shut[0] == tag:
                    del held[shut[1] :]
                    shut = None
                continue
            flush()
            shut = None
            if slash:
                if opened[tag]:
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                link = 0
                continue
            if tag in VOID or attrs.endswith("/") and tag not in CLOSES:
                continue
            for t in CLOSES.get(tag, ()):
                top = self.tag[stack[-1]]
                if not (t == "li" and top in ("ul", "ol")) and not (t in ("td", "th", "tr") and top == "table"):
                    while near(t):
                        pop()
            inside = opened["article"] or opened["main"] or tag in ("article", "main")
            others.append(max(others[-1], _other(tag, attrs, inside)))
            node = len(self.tag)
            self.declared.append(node if tag in ("article", "main") else self.declared[stack[-1]])
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.last.append(node)
            opened[tag] += 1
            path.append(paths.setdefault((path[-1], tag), len(paths) + 1))
            stack.append(node)
        flush()
        while len(stack) > 1:
            pop()
        self.last[0] = len(self.tag) - 1

    def heading(self, block: Block, *kinds: str) -> bool:
        return self.tag[block.node] in (kinds or HEADINGS)

    def within(self, block: Block, node: int) -> bool:
        return node <= block.node <= self.last[node]

    def shared(self, found: list[Block]) -> int:
        """The innermost element around all blocks."""
        node, most = min(b.node for b in found), max(b.node for b in found)
        while self.last[node] < most:
            node = self.parent[node]
        return node

    def branches(self, node: int) -> list[int]:
        """For the elements from this one to its last, in order: the child of it that they are in (the first: itself)."""
        out = [node]
        for n in range(node + 1, self.last[node] + 1):
            out.append(n if self.parent[n] == node else out[self.parent[n] - node])
        return out


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    """Gaussian mean over neighbours."""
    kernel = [exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + radius], values[i + d]) for d in range(-radius, radius + 1) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _from_title(page: Page, found: list[Block], own: list[int]) -> int:
    """Where the article begins: at the h1 before these blocks, or a heading just before, if they hold none of their own."""
    if any(page.heading(found[i], "h1") for i in own):
        return own[0]
    title = next((i for i in range(own[0] - 1, -1, -1) if page.heading(found[i], "h1")), -1)
    if title < 0 and own[0] and not page.heading(found[own[0]]) and page.heading(found[own[0] - 1]):
        title = own[0] - 1
    return own[0] if title < 0 else title


def content(source: str, level: float = 0.5, whole: float = 0.9) -> list[str]:
    """The article's blocks. level: threshold in standard deviations; whole: share of content text from which on a page's article and main elements are taken at their word."""
    page = Page(source)
    found = [b for b in page.blocks if b.able]
    # Blocks of links don't decide where the article is, but for one that has no others.
    able = [b for b in found if not b.linked] or [b for b in found if page.declared[b.node]]
    if not able:
        return []
    chars, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in able:
        chars[b.path] += len(b.text)
        marks[b.path] += len(_PUNCT.findall(b.text))
        nodes[b.path] += 1
    length = _smooth([chars[b.path] / nodes[b.path] for b in able])
    points = _smooth([(1 + marks[b.path]) / nodes[b.path] for b in able])
    fused = [a * b for a, b in zip(length, points)]
    mean = sum(fused) / len(fused)
    spread = (sum((f - mean) ** 2 for f in fused) / len(fused)) ** 0.5
    least = min(level * spread, max(fused))
    taken = [b for b, f in zip(able, fused) if f >= least] or able
    passed = {b.path for b in taken}
    found = [b for b in found if not b.doubt or b.path in passed and not b.linked]
    marked = [b for b in taken if page.declared[b.node]]
    if marked and sum(len(b.text) for b in marked) >= whole * sum(len(b.text) for b in taken):
        taken = marked
    around = page.shared(taken)
    article = page.declared[around]
    if article:
        return [b.text for b in found if page.within(b, article)]
    # No article or main element is around all. A lone block is no article: its neighbours in the same element belong to it.
    if around and any(b.node == around for b in taken):
        around = page.parent[around]
    own = [i for i, b in enumerate(found) if page.within(b, around)]
    begin, end = _from_title(page, found, own), own[-1] + 1
    # What is taken may be the page itself, or lie beside the article: lists of nothing but links are its menus there.
    page_wide = page.tag[around] in ("", "html", "body")
    branch = page.branches(around) if page_wide else []
    texts = {branch[b.node - around] for b in able if page.within(b, around)} if page_wide else set()
    menu = lambda i, b: b.linked and not page.heading(b) and (i < own[0] or page_wide and branch[b.node - around] not in texts)
    return [b.text for i, b in enumerate(found[begin:end], begin) if not menu(i, b)]


def main_text(page: str) -> str:
    return "\n\n".join(content(page))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars. One pass, no exchange. Null or empty html, and pages without text: an empty text.

    Repeated rows each give a row; other columns are ignored. Very long or deeply nested pages take time and memory in
    proportion to their length.
    """

    def rows(batches):
        for chunk in text_chunks(batches, "t"):
            texts = [main_text(p) for p in filled(chunk.column("t")).to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("i").cast(pa.int64()), chunk.column("u").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("t")).mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
