"""A small labelled table for the block classifier: invented pages whose main text is marked where it stands.

Each page is put together from parts that vary what the features see: layouts with elements of HTML5, with names, with neither,
with tables, a form around all, or no container; short and long paragraphs and side texts, links inside articles, comments as
long as the article, misleading names.  A block is main text if it holds ``MARK``, which is taken out before features are
computed, so equal texts in different places have labels of their own.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: Stands in the blocks that are main text.
MARK = "⁠"
#: Pages of the table, and the seed from which they are put together.
PAGES, SEED = 300, 5

WORDS = (
    "the river rose by noon and farmers moved their herds to hills while council opened a school as shelter for those whose houses stood near bank "
    "nobody in village could remember spring wet old records agree that it went on raining all night market price wheat barley fell little most years at "
    "this time bees winter hive moved slowly with care two sons cook salt smoke ferry leaves tide snow white ponds early frost mill path bridge five miles "
    "long walk letters came late because storm had closed road north wool dyes red green blue things that grow under stones of an island people say").split()
NAMES = "Ann Bob Carla Deniz Emil Fay Goran Hana Ivo June".split()
#: What sites say about themselves, said in a text.
QUOTED = ("All rights reserved.", "The comments were kind.", "Sign in, said the door.", "Nobody would subscribe to a newsletter that winter.", "Copyright law is old.", "Posted by the mill at noon.")
SITES = ("Daily Field", "The Northern Star", "Hill Times", "Valley Post", "Mill Notes")

Make = random.Random


def sentence(rng: Make, least: int, most: int) -> str:
    words = rng.choices(WORDS, k=rng.randint(least, most))
    return (" ".join(words)).capitalize() + rng.choice(".....?!")


def prose(rng: Make, size: str | None = None) -> str:
    size = size or rng.choice(("tiny", "short", "middle", "middle", "long", "long"))
    n = {"tiny": 1, "short": 1, "middle": 2, "long": rng.randint(3, 8)}[size]
    least, most = {"tiny": (1, 3), "short": (4, 9), "middle": (8, 18), "long": (9, 20)}[size]
    return " ".join(sentence(rng, least, most) for _ in range(n))


def label(rng: Make) -> str:
    return " ".join(rng.choices(WORDS, k=rng.randint(1, 4))).capitalize()


def link(rng: Make, text: str | None = None) -> str:
    return f'<a href="/{rng.randint(1, 999)}">{text or label(rng)}</a>'


# main text


def article(rng: Make) -> list[str]:
    """Blocks of an article, each marked."""
    parts = [f"<h1>{MARK}{label(rng)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice((1, 2, 3, 4, 6, 9))):
        kind = rng.random()
        if kind < 0.62:
            parts.append(f"<p>{MARK}{prose(rng)}</p>")
        elif kind < 0.70:
            parts.append(f"<p>{MARK}{prose(rng, 'short')} {link(rng)} {prose(rng, rng.choice(('short', 'middle')))}</p>")
        elif kind < 0.76:
            parts.append(f"<h2>{MARK}{label(rng)}</h2><p>{MARK}{prose(rng)}</p>")
        elif kind < 0.84:
            parts.append("<ul>" + "".join(f"<li>{MARK}{prose(rng, rng.choice(('tiny', 'short', 'middle')))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.88:
            parts.append(f"<blockquote>{MARK}{prose(rng, 'middle')}</blockquote>")
        elif kind < 0.92:
            parts.append(f"<table><tr><td>{MARK}{label(rng)}</td><td>{MARK}{rng.randint(2, 99)}</td></tr><tr><td>{MARK}{label(rng)}</td><td>{MARK}{rng.randint(2, 99)}</td></tr></table>")
        elif kind < 0.965:
            parts.append(f"<p>{MARK}{rng.choice(QUOTED)}</p>")
        elif kind < 0.985:
            parts.append("<ul>" + "".join(f"<li>{link(rng, MARK + sentence(rng, 3, 6))}</li>" for _ in range(2)) + "</ul>")
        else:
            parts.append(f"<p>{MARK}{prose(rng, 'tiny')}</p><p>{MARK}{prose(rng, 'tiny')}</p>")
    if not any("<p>" in p for p in parts):
        parts.append(f"<p>{MARK}{prose(rng, 'long')}</p>")
    return parts


# other parts


def menu(rng: Make) -> str:
    links = [link(rng) for _ in range(rng.randint(3, 8))]
    return rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), " ".join(links), "<ul>" + "".join(f"<li>{label(rng)}</li>" for _ in links) + "</ul>"))


def title(rng: Make) -> str:
    return rng.choice((f"<h1>{link(rng, rng.choice(SITES))}</h1>", f"{link(rng, rng.choice(SITES))}<p>{sentence(rng, 4, 10)}</p>", f"<p>{rng.choice(SITES)}</p>", f"<h2>{rng.choice(SITES)}</h2>"))


def advert(rng: Make) -> str:
    return rng.choice((f"<p>{prose(rng, 'middle')}</p>", "Buy", prose(rng, "short"), f"<p>{prose(rng, 'short')} {link(rng, 'Order today')}</p>", f"Advertisement <p>{prose(rng, 'middle')}</p>", prose(rng, "middle")))


def notice(rng: Make) -> str:
    return rng.choice((
        f"<p>We use cookies to make this site work. {sentence(rng, 5, 12)}</p>", f"Sign in to read all of it. {link(rng, 'Sign in')}", f"<p>Please log in or register to go on.</p>",
        f"<p>By using this site you accept our terms of use and our privacy policy.</p>", f"<p>You have read 3 of 5 free pages. Subscribe now.</p>", f"{sentence(rng, 6, 14)}"))


def teasers(rng: Make) -> str:
    head = f"<h3>{rng.choice(('Most read', 'More', 'Related', label(rng)))}</h3>"
    return head + rng.choice((
        "<ul>" + "".join(f"<li>{link(rng, sentence(rng, 3, 8))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", f"<p>{prose(rng, 'middle')}</p><p>{prose(rng, 'short')}</p>",
        "".join(f"<div>{link(rng)}<p>{prose(rng, 'short')} {link(rng, 'Read more')}</p></div>" for _ in range(3))))


def comments(rng: Make) -> str:
    def one() -> str:
        who = rng.choice(NAMES)
        head = rng.choice((f"<p>{who}, {rng.randint(1, 28)} May {rng.randint(2001, 2024)}</p>", f"<b>{who}</b> says:", f"<p>Posted by {who}</p>", ""))
        return f"<div>{head}<p>{prose(rng, rng.choice(('short', 'middle', 'long')))}</p>{rng.choice(('', link(rng, 'Reply'), '<p>Reply</p>'))}</div>"

    return rng.choice((f"<h3>{rng.randint(1, 9)} comments</h3>", "<h3>Comments</h3>", "")) + "".join(one() for _ in range(rng.randint(1, 4)))


def end(rng: Make) -> str:
    year = rng.randint(1999, 2024)
    return rng.choice((
        f"<p>Copyright {year} {rng.choice(SITES)}. All rights reserved.</p>", f"&copy; {year} {rng.choice(SITES)} &middot; {sentence(rng, 3, 9)}", f"<p>{link(rng, 'Imprint')} {link(rng, 'Contact')}</p>",
        f"<p>Imprint</p>", f"<h5>Help</h5><p>{prose(rng, 'short')}</p><p>{prose(rng, 'middle')}</p>", f"{prose(rng, 'middle')} All rights reserved.", f"<p>{prose(rng, 'tiny')}</p>"))


def letter(rng: Make) -> str:
    return rng.choice((f"<p>Get our newsletter each day. {sentence(rng, 4, 9)}</p><label>Your mail address</label><input name=m>", f"<label>Subscribe</label><p>{prose(rng, 'middle')}</p><button>Go</button>"))


def share(rng: Make) -> str:
    return rng.choice(("Share this with your friends", f"{link(rng, 'Share')} {link(rng, 'Print')}", "Follow us"))


OTHERS: dict[str, tuple[Callable[[Make], str], tuple[str, ...], tuple[str, ...]]] = {
    "menu": (menu, ("nav",), ("menu", "top-menu", "navbar", "breadcrumbs")), "title": (title, ("header",), ("masthead", "site-header", "topbar")),
    "advert": (advert, ("div class='ad'",), ("ad", "advert", "ad-slot", "sponsored", "promo")), "notice": (notice, ("dialog", "div role='alert'"), ("cookie-notice", "banner", "popup", "signin-overlay")),
    "teasers": (teasers, ("aside",), ("sidebar", "related-posts", "widget", "recommended")), "comments": (comments, ("section class='comments'", "section id='comments'"), ("comments", "comments-area", "replies", "disqus")),
    "end": (end, ("footer",), ("footer", "footer-links", "site-footer")), "letter": (letter, ("form",), ("newsletter", "signup")), "share": (share, ("div class='share'",), ("social-share", "share-buttons", "sharing")),
}
CONTENT = {
    "elements": ("article", "main", "article class='post has-sidebar'", "article class='post story-meta tags'", "main class='with-toc'"),
    "names": ("div id='content'", "div class='post'", "div class='story-body'", "div class='entry-content'", "div id='social-science-article'", "section class='article-text'"),
    "neutral": ("div", "div class='c2'", "div id='x7'", "section", "td", "div class='row'", "div class='notice-board-story'"),
}


def wrapped(opening: str, inside: str) -> str:
    if opening == "td":
        return f"<table><tr><td>{inside}</td></tr></table>"
    return f"<{opening}>{inside}</{opening.split()[0]}>"


def page(rng: Make, style: str | None = None) -> str:
    """A marked page: built of elements that say what they are, of names, of neither, or without containers."""
    style = style or rng.choice(("elements", "elements", "names", "names", "neutral", "neutral", "flat"))

    def other(kind: str) -> str:
        make, elements, names = OTHERS[kind]
        inside = make(rng)
        if style in ("neutral", "flat"):
            return wrapped(rng.choice((f"div class='c{rng.randint(3, 9)}'", "div", f"div id='b{rng.randint(1, 9)}'")), inside)
        if style == "elements" and rng.random() < 0.8:
            return wrapped(rng.choice(elements), inside)
        return wrapped(f"div {rng.choice(('class', 'id'))}='{rng.choice(names)}'", inside)

    body = article(rng)
    if style != "flat" and rng.random() < 0.15:
        body = [f"<div class='para'>{b}</div>" for b in body]
    inner = list(body)
    for kind in ("advert", "teasers", "share"):
        if style in ("elements", "names") and len(body) > 3 and rng.random() < 0.25:
            inner.insert(rng.randint(2, len(inner)), other(kind))
    text = "".join(inner)
    if style == "elements" and rng.random() < 0.3 and body[0].startswith("<h1>"):
        text = f"<header>{body[0]}<p>By {rng.choice(NAMES)}, {rng.randint(1, 28)} May</p></header>" + "".join(inner[1:])
    if style == "elements" and rng.random() < 0.2:
        text += f"<footer><p>Filed under {label(rng)}</p></footer>"
    if style != "flat":
        text = wrapped(rng.choice(CONTENT[style]), text)
    some = lambda kind, chance: other(kind) if rng.random() < chance else ""
    plain = style == "flat"  # without a container only short parts beside the text can be told from it
    before = some("notice", 0.3) + some("title", 0.5) + other("menu") + some("advert", 0.0 if plain else 0.35) + some("teasers", 0.0 if plain else 0.2)
    after = (some("share", 0.3) + some("teasers", 0.0 if plain else 0.35) + some("comments", 0.0 if plain else 0.45) + some("letter", 0.25) + some("advert", 0.0 if plain else 0.2) + some("menu", 0.2) + some("end", 0.85))
    whole = before + text + after
    if style in ("neutral", "names") and rng.random() < 0.2:
        whole = f"<form id='form1'><div class='{rng.choice(('content', 'page', 'outer'))}'>{whole}</div></form>"
    head = f"<head><title>{label(rng)}</title><style>p{{}}</style></head>" if rng.random() < 0.7 else ""
    return f"<html>{head}<body>{whole}</body></html>"


def pages(count: int = PAGES, seed: int = SEED, style: str | None = None) -> list[str]:
    """Marked pages, of all styles or one."""
    rng = random.Random(seed)
    return [page(rng, style) for _ in range(count)]
