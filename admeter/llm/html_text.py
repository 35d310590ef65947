"""Main text of web pages, from flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  Each block has shallow features: its word count and link density and those
of its neighbours, whether it ends a sentence, what share of the page's words its container holds, and, as evidence among the
rest, what elements and names around it say.  A small decision tree, grown on the invented pages of
``labelled_pages``, tells main text from the rest.

A page is read once from front to back; no tag or character is looked at more often than a fixed number of times, so hostile
pages take time in proportion to their length.

Fixed meaning of edge cases: a null or empty page has an empty text; open elements and comments end with the page;
a ``<`` that starts no tag is text; repeated rows give equal rows; the columns ``text`` and ``n_chars`` replace
input columns of these names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, without

# possessive, so that a tag that does not end is not tried again from each of its characters
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:\s++(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+|/)?+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([\w-]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
#: References to characters by numbers of any length.
ZEROS, TOO_LARGE = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?")
#: Elements of HTML by what they do to a text.
SKIPPED = frozenset("script style noscript template textarea select option svg math iframe object canvas audio video button head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
#: What a head holds; anything else opens the body, as its end tag may be left out.
IN_HEAD = frozenset("head title meta link base style script noscript template".split())
#: Elements in which a closing slash counts.
FOREIGN = frozenset("svg math".split())
UNQUOTED_END = re.compile(r"=\s*+[^\s\"'>]*/$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be left out before another of their kind.
REPEATED = frozenset("p li dt dd tr td th option".split())
#: Elements that hold text rather than parts of a page.
TEXTUAL = HEADINGS | frozenset("p li dt dd tr pre ul ol dl tbody thead tfoot table caption figcaption hr br title".split())
OTHER_PARTS = frozenset("nav header footer aside form menu dialog".split())
MAIN_PARTS = frozenset("article main".split())
#: Words in classes, ids and roles that name parts beside the main text: surely, for readers' comments, or perhaps; and the main text.
STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs toc pager pagination sidebar aside widget footer masthead topbar toolbar related recommended newsletter signup complementary contentinfo "
    "byline".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus discussion".split())
WEAK_NAMES = frozenset(
    "promotion notice alert side header top bottom share sharing social subscribe subscription login signin search tags meta copyright legal disclaimer hidden skip form".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())
#: From such a word on, a class or id says what stands beside or in an element (``has-sidebar``), or, at its end, how it is set (``share-enabled``).
MODIFIERS, STATES = frozenset("has no with without".split()), frozenset("enabled disabled".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What sites say about themselves and to their readers.
CUES = re.compile(
    r"©|\b(?:copyright|all rights reserved|cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|register|privacy policy|terms of (?:use|service)|advertisement|sponsored|share this|read more"
    r"|most read|comments?|reply|posted by|says:|powered by|follow us|contact us|imprint|order (?:now|today))(?!\w)", re.I)
FEATURES = ("words", "links", "sentence", "cues", "heading", "list_item", "words_before", "links_before", "words_after", "links_after", "words_near", "links_near",
            "place", "box_share", "in_core", "other_part", "strong_name", "weak_name", "main_part", "article_head")
OTHER, STRONG, COMMENT, WEAK, MAIN, FORM, ARTICLE_HEAD, HIDDEN = (1 << i for i in range(8))
#: Share of a page's words from which a part is too large for what a form or a name says, and that the core of a page holds.
TOO_LARGE_PART, CORE = 0.6, 0.5


class Block:
    """A run of text between two borders of block elements."""

    __slots__ = ("parts", "linked", "box", "heading", "item", "words", "links", "text")

    def __init__(self, box: int, heading: bool, item: bool):
        self.parts: list[str] = []
        self.linked, self.box, self.heading, self.item = 0, box, heading, item

    def close(self) -> bool:
        self.text = decoded("".join(self.parts)) if self.parts else ""
        self.words = self.text.count(" ") + bool(self.text)
        self.links = min(1.0, self.linked / max(1, len(self.text)))
        return bool(self.text)


def decoded(text: str) -> str:
    """Character references decoded, white space as one space."""
    if "&#" in text:
        text = TOO_LARGE.sub("�", ZEROS.sub(r"&#\1", text))
    return " ".join(references.unescape(text).split())


def own_words(value: str) -> list[list[str]]:
    """The words of each class, id or role that name the element itself."""
    found = []
    for name in value.split():
        words = [w.lower() for w in NAME.findall(name)]
        end = next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))
        if words and words[-1] not in STATES:
            found.append(words[:end])
    return found


def said(tag: str, attrs: str) -> int:
    """What an element's class, id or role say about it.  A class that names the main text stands against others that don't, and
    a page has one ``main`` element, which is what it says."""
    flags = 0
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            for words in own_words(value):
                names = set(words)
                flags |= STRONG * bool(names & STRONG_NAMES) | COMMENT * bool(names & COMMENT_NAMES) | WEAK * bool(names & WEAK_NAMES)
                if names & MAIN_NAMES and not names & (STRONG_NAMES | COMMENT_NAMES | WEAK_NAMES):
                    flags |= MAIN
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            flags |= HIDDEN
    if tag == "main" or tag == "article" and not flags & COMMENT or flags & MAIN and not flags & (COMMENT | STRONG):
        flags &= ~(STRONG | WEAK)
    return flags


class Page:
    """The flat blocks of a page, in its order, and the boxes (containers and named elements) that they stand in."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.flags = [0], [0]  # of each box; the first one is the page
        self.read(page)

    def read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # element, the box around it
        inline: list[Counter] = [Counter()]  # open inline elements within each open block element
        depth = Counter()
        box, breaks, at, end = 0, 0, 0, len(page)
        block = Block(0, False, False)

        def border() -> None:
            nonlocal block
            if block.parts and block.close():
                self.blocks.append(block)
                block = Block(box, depth["heading"] > 0, depth["li"] > 0)
            else:
                block.parts, block.linked, block.box, block.heading, block.item = [], 0, box, depth["heading"] > 0, depth["li"] > 0

        def opened(tag: str, step: int) -> None:
            for kind, is_one in (("skip", tag in SKIPPED), ("foreign", tag in FOREIGN), ("link", tag == "a"), ("heading", tag in HEADINGS), ("li", tag == "li")):
                if is_one:
                    depth[kind] += step

        def close_to(index: int) -> None:
            nonlocal box
            while len(stack) > index:
                tag, box = stack.pop()
                opened(tag, -1)
                if tag in INLINE:
                    inline[-1][tag] -= 1
                else:
                    inline.pop()

        def end_head() -> None:
            if stack and stack[-1][0] == "head":
                close_to(len(stack) - 1)

        def say(text: str) -> None:
            nonlocal breaks
            filled = not text.isspace() and text != ""
            if filled:
                end_head()
            if text and not depth["skip"]:
                if filled:
                    breaks = 0
                    if depth["link"]:
                        block.linked += len(" ".join(text.split()))
                block.parts.append(text)

        def close_inline(tag: str) -> None:
            if inline[-1][tag]:  # it is open, and no block element stands between
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close_to(i)

        open_blocks: Counter = Counter()
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                say(page[at:])
                break
            say(page[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:  # comments, declarations, broken tags
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in INLINE:
                    close_inline(tag)
                    continue
                border()
                if open_blocks[tag]:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    for name, _ in stack[i:]:
                        open_blocks[name] -= name not in INLINE
                    close_to(i)
                    block.box, block.heading, block.item = box, depth["heading"] > 0, depth["li"] > 0
                continue
            if tag not in IN_HEAD:
                if stack and stack[-1][0] == "head":
                    open_blocks["head"] -= 1
                end_head()
            if tag == "br":
                breaks += 1
                if breaks > 1:
                    border()
                else:
                    say(" ")
                continue
            if tag in VOID:
                if tag not in INLINE:
                    border()
                continue
            attrs = m["attrs"]
            if (tag in FOREIGN or depth["foreign"]) and attrs.endswith("/") and not UNQUOTED_END.search(attrs):
                continue
            if tag in INLINE:
                if tag == "a" and depth["link"]:
                    close_inline("a")
                stack.append((tag, box))
                inline[-1][tag] += 1
                opened(tag, 1)
                continue
            border()
            i = len(stack) - sum(inline[-1].values()) - 1  # the innermost open block element
            name = stack[i][0] if i >= 0 else ""
            above = stack[i - 1][0] if i >= 1 else ""
            if name == "p" or name == tag and tag in REPEATED:
                open_blocks[name] -= 1
                close_to(i)
            elif tag in ("td", "th") and name in ("td", "th") or tag in ("dt", "dd") and name in ("dt", "dd") or tag == "tr" and name in ("td", "th") and above == "tr":
                i -= tag == "tr"
                for name, _ in stack[i:]:
                    open_blocks[name] -= name not in INLINE
                close_to(i)
            flags = said(tag, attrs) if attrs else 0
            if tag in ("html", "body"):
                flags = 0
            if tag == "header" and self.flags[box] & MAIN and not self.flags[box] & (OTHER | STRONG | COMMENT):
                flags |= ARTICLE_HEAD
            elif tag in OTHER_PARTS:
                flags |= FORM if tag == "form" else OTHER
            if tag in MAIN_PARTS and not flags & (STRONG | COMMENT):
                flags |= MAIN
            stack.append((tag, box))
            inline.append(Counter())
            open_blocks[tag] += 1
            opened(tag, 1)
            if flags or tag not in TEXTUAL:
                self.parent.append(box)
                # what is said of a part holds for its parts, and main text inside another part is none
                around = self.flags[box]
                self.flags.append(flags | around)
                box = len(self.flags) - 1
            block.box, block.heading, block.item = box, depth["heading"] > 0, depth["li"] > 0
            if tag in RAW:
                close = re.compile(rf"</{tag}", re.I).search(page, at)
                at = close.start() if close else end
        border()


def summed(held: np.ndarray, parent: list[int]) -> np.ndarray:
    """What boxes hold, with the boxes in them; a box comes after the one around it."""
    out = held.copy()
    for i in range(len(parent) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def features(page: Page) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    found, n = page.blocks, len(page.blocks)
    words, links = np.array([b.words for b in found], float), np.array([b.links for b in found], float)
    box = np.array([b.box for b in found])
    flags, parent = np.array(page.flags), page.parent
    held = np.zeros(len(flags))
    np.add.at(held, box, words * (1 - links))
    whole = summed(held, parent)
    # a form, or a name, that holds most of a page says little about it, unless another part is the main text
    any_main = bool(((flags[box] & MAIN > 0) & (flags[box] & (OTHER | STRONG | COMMENT) == 0)).any()) if n else False
    named = {bit: np.zeros(len(flags), bool) for bit in (STRONG, WEAK, FORM)}
    for i in range(1, len(flags)):
        for bit, known in named.items():
            new = bool(flags[i] & bit) and not flags[parent[i]] & bit
            known[i] = known[parent[i]] or new and (whole[i] < TOO_LARGE_PART * whole[0] or bit == STRONG and any_main)
    aside = (flags & (OTHER | HIDDEN) > 0) | named[FORM]
    beside = named[STRONG] | (flags & COMMENT > 0)
    # of the words that stand in no such part: the share of each box, and the smallest box that holds most of them
    own = summed(np.where(aside | beside, 0.0, held), parent)
    share = np.where(aside | beside, 0.0, own / max(own[0], 1e-9))
    core, inside = 0, np.zeros(len(flags), bool)
    for i in range(1, len(flags)):
        if share[i] >= CORE and parent[i] == core:
            core = i
    inside[core] = True
    for i in range(core + 1, len(flags)):
        inside[i] = inside[parent[i]] and not (aside[i] or beside[i])
    near = lambda x, by: np.concatenate([np.zeros(max(by, 0)), x[max(-by, 0):n - max(by, 0)], np.zeros(max(-by, 0))])[:n] if n > abs(by) else np.zeros(n)
    around = sum(near(words, i) for i in (-2, -1, 1, 2))
    linked = sum(near(words * links, i) for i in (-2, -1, 1, 2))
    has = lambda bit: (flags[box] & bit) > 0
    return np.column_stack([
        words, links, [b.text[-1:] in ".?!:…\"'”" for b in found], [len(CUES.findall(b.text)) for b in found], [b.heading for b in found], [b.item for b in found],
        near(words, 1), near(links, 1), near(words, -1), near(links, -1), around, linked / np.maximum(around, 1), np.arange(n) / max(n - 1, 1),
        share[box], inside[box], aside[box], beside[box], named[WEAK][box], has(MAIN), has(ARTICLE_HEAD)]).astype(float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4) -> tuple:
    """A decision tree by Gini impurity: (answer,) or (feature, limit, at most limit, above it).  Ties go to the first feature."""
    share, n = y.mean(), len(y)
    best = (n * share * (1 - share) - 1e-9, None, None)
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            value, ones = x[order, f], np.cumsum(y[order])
            left = np.arange(1, n)
            a, b = ones[:-1] / left, (ones[-1] - ones[:-1]) / (n - left)
            worth = left * a * (1 - a) + (n - left) * b * (1 - b)
            worth[(value[1:] == value[:-1]) | (left < least) | (n - left < least)] = np.inf
            if n > 1 and worth.min() < best[0] - 1e-9:
                i = int(worth.argmin())
                best = (worth[i], f, (value[i] + value[i + 1]) / 2)
    if best[1] is None:
        return (bool(share >= 0.5),)
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, decide(low, x), decide(high, x))


def labelled(page: str, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a marked page's blocks, and whether each is main text."""
    marked, plain = Page(page), Page(page.replace(mark, ""))
    if len(marked.blocks) != len(plain.blocks):
        raise ValueError("a mark stands for a block of its own")
    return features(plain), np.array([mark in b.text for b in marked.blocks], float)


@cache
def trained() -> tuple:
    """The tree grown on all blocks of the labelled pages."""
    from .labelled_pages import MARK, pages

    rows, answers = zip(*[labelled(p, MARK) for p in pages()])
    return grow(np.concatenate(rows), np.concatenate(answers))


def main_text(page: str | None, tree: tuple) -> str:
    found = Page(page) if page else None
    if not found or not found.blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(found.blocks, decide(tree, features(found))) if keep)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with ``text``, the main text of each page, and ``n_chars``, its code points."""
    small_batches(df.sparkSession)
    tree = trained()

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(p, tree) for p in pages.to_pylist()), pa.string())

    pages = df.withColumn("_html", F.col(html).cast("string"))
    return without(without(pages, "text"), "n_chars").withColumn("text", texts("_html")).drop("_html").withColumn("n_chars", F.length("text").cast("bigint"))
