"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks.  Each block has its word count and
link density, those of its neighbours, what its words tell (a sentence's end,
words of notices), and what its place tells (inside an article, inside a part
or class that names boilerplate, and how much of the page lies outside such).
A name is evidence only: where nearly all of a page stands under it, the text
decides.  A tree trained on a small labelled table of pages keeps or drops
each block.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataplane.llm.tree import Tree, grow, share

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.DOTALL)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.IGNORECASE) for name in RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
PARTS = {"nav", "footer", "aside", "form", "head", "header", "menu", "button", "select", "dialog", "fieldset", "label"}
#: Words of class, id and role names that name boilerplate, words that may stand beside them, and those that say nothing inside an article.
CUES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent notice notices popup modal newsletter subscribe subscription signup "
    "login sidebar side widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead copyright comment comments commentlist reply replies respond disqus discussion "
    "social share sharing related recommended recommendations tags pagination pager hidden skip skiplink complementary contentinfo search dialog alertdialog".split()
)
BESIDE = set("a and area bar block body bottom box button buttons card col column container content desktop entry form global group icon icons inner item items left line link links list listing main message mobile more module outer overlay page panel policy post posts primary right row section site slot sub thread title to top unit wrap wrapper".split()) 
TITLES = {"header", "masthead", "side", "tags", "banner", "search", "notice"}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of notices in the languages of the tables; their share of a block's words is a feature.
NOTICE = re.compile(
    r"\b(?:cookies?|consent|subscribe|newsletter|copyright|rights reserved|sign (?:up|in)|log ?in|advert(?:isement)?s?|sponsored|privacy policy|terms of (?:use|service)"
    r"|abonnieren|anmelden|rechte vorbehalten|datenschutz|anzeige|abonnez|inscrivez|droits réservés|publicité|suscríbe(?:te|se)|derechos reservados|publicidad)\b|©",
    re.I,
)
SENTENCE_END = re.compile(r"[.!?…:。][\"'”’»)\]]*\Z")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "ends", "notice", "in_article", "in_part", "rest", "heading", "item", "outside")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    in_part: bool
    cue: int  # number of the innermost element around it whose names or style tell boilerplate, or 0
    heading: bool
    item: bool
    label: bool
    outside: bool = False
    rest: float = 0.0  # under a cue: the share of the page's words outside links that stands outside that element; 1 where an article has text of its own


def _told(attributes: str, article: bool) -> tuple[bool, bool]:
    """Whether attributes name or hide boilerplate, and whether they carry the label of the training table.

    A class, id or role counts if one of its names consists of cue words and
    words that may stand beside them, as ``site-footer`` or ``cookieNotice2``;
    ``side-story`` and ``overflow-hidden`` do not.
    """
    cue = label = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for token in value.split():
                label |= token == "keep"
                words = [w for w in re.split(r"[-_:\d]+", HUMP.sub("-", token).lower()) if w]
                known = [w for w in words if w in CUES and not (article and w in TITLES)]
                cue |= bool(known) and all(w in CUES or w in BESIDE for w in words)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            cue = True
    return cue, label


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; blocks without text are left out."""
    out: list[Block] = []
    opened: dict[str, int] = {}  # how often each name is on the stack, so a stray closing tag costs no search
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, in article, in part, innermost cue, label
    state = (False, False, 0, False)
    part: list[str] = []
    linked: list[str] = []
    above = [0]  # the cue around each cue
    in_link, at = 0, 0

    def flush() -> None:
        nonlocal part, linked
        text = " ".join(unescape("".join(part)).split())
        if text:
            names = {s[0] for s in stack[-3:]}
            out.append(Block(text, text.count(" ") + 1, len(unescape("".join(linked)).split()), *state[:3], bool(names & {"h1", "h2", "h3", "h4", "h5", "h6"}), bool(names & {"li", "td", "th", "dd", "dt"}), state[3]))
        part, linked = [], []

    def close(name: str) -> None:
        nonlocal state
        while True:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                break
        state = stack[-1][1:] if stack else (False, False, 0, False)

    while m := MARKUP.search(page, at):
        text = page[at : m.start()]
        if text:
            part.append(text)
            if in_link:
                linked.append(text)
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):  # what it holds is no markup up to its own closing tag
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            part.append(" ")
            continue
        if name == "br":
            part.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            linked.append(" ")
        if name in INLINE and not (not closing and ("hidden" in attributes or "none" in attributes)):
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if opened.get(name):
                close(name)
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(name)
        article = state[0] or name in ARTICLE
        inside = state[1] or (name in PARTS and not (name == "header" and article))
        cue, label = _told(attributes, article) if attributes else (False, False)
        if cue:
            above.append(state[2])
        state = (article, inside, len(above) - 1 if cue else state[2], state[3] or label)
        stack.append((name, *state))
        opened[name] = opened.get(name, 0) + 1
    part.append(page[at:])
    flush()
    if any(b.in_article and not (b.in_part or b.cue) for b in out):  # what names tell holds
        for b in out:
            b.outside, b.rest = not b.in_article, float(b.cue > 0)
        return out
    under = [0] * len(above)
    for b in out:
        under[b.cue] += b.words - b.linked
    for k in range(len(above) - 1, 0, -1):  # cues are numbered from outer to inner ones
        under[above[k]] += under[k]
    for b in out:
        if b.cue:
            b.rest = 1.0 - under[b.cue] / max(1, under[0])
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """FEATURES of each block; beyond the ends there are 0 words and link density 0."""
    words = np.array([0, *[b.words for b in found], 0], dtype=float)
    links = np.array([0, *[min(1.0, b.linked / b.words) for b in found], 0], dtype=float)
    told = [(SENTENCE_END.search(b.text) is not None, len(NOTICE.findall(b.text)) / b.words) for b in found]
    place = [(b.in_article, b.in_part, b.rest, b.heading, b.item, b.outside) for b in found]
    own = np.array([t + p for t, p in zip(told, place, strict=True)], dtype=float).reshape(-1, 8)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own])


def labelled_pages(seed: int = 7, n: int = 640) -> list[str]:
    """A small labelled table of pages, drawn from templates; blocks of the main text carry class "keep".

    Half of the pages have an article element; in it every block is main text,
    however short, late or full of links, but for parts and names that tell
    otherwise.  The others are flat: main text in blocks of all lengths, with
    sentences that hold links, captions and words of notices, between link
    lists, short lines that stand at links, and notices without a name.  Some
    pages of both kinds stand as a whole under a name of boilerplate, and some
    have no main text.
    """
    rng = random.Random(seed)
    words = lambda a, b: " ".join(["word"] * rng.randint(a, b))
    link = lambda: f"<a href='/x'>{words(1, 3)}{rng.choice(('', '', '', '.'))}</a>"
    end = lambda: "." if rng.random() < 0.85 else ""

    def notice() -> str:
        return rng.choice(
            (
                lambda: f"We use cookies {words(2, 14)}. <a href='/c'>Accept</a>",
                lambda: f"Cookies {words(3, 10)}.",
                lambda: f"Subscribe {words(1, 6)}" + rng.choice((".", "", "!")),
                lambda: f"{words(1, 4)} newsletter {words(0, 6)}" + rng.choice((".", "")),
                lambda: f"Copyright 2020 {words(1, 4)}. All rights reserved.",
                lambda: f"© {words(2, 5)}",
                lambda: f"Log in {words(0, 3)} or sign up {words(0, 4)}" + end(),
                lambda: f"Advertisement {words(0, 3)}",
                lambda: f"Sponsored: {words(2, 9)}" + end(),
                lambda: f"{words(1, 4)} <a href='/p'>privacy policy</a> {words(0, 2)} <a href='/t'>terms of use</a>.",
            )
        )()

    def paragraph(most: int, linked: float) -> str:
        parts = [words(1, most)] + [f"<a href='/y'>{words(1, 8)}</a> {words(0, 3)}" for _ in range(3) if rng.random() < linked]
        if most >= 40 and rng.random() < 0.2:
            topics = ("cookies", "newsletter", "copyright", "advertisement", "consent")
            parts += [f"{words(20, 40)} {rng.choice(topics)} {words(2, 9)}" + (f" {rng.choice(topics)} {words(2, 9)}" if rng.random() < 0.5 else "")]
        rng.shuffle(parts)
        return " ".join(parts).rstrip() + end()

    def main(linked: float, closing: int) -> str:
        out = [f"<h1 class=keep>{words(1, 10)}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 7, 8, 9))):
            most = rng.choice((4, 15, 40, 90, 160))
            kind = rng.random()
            if linked >= 0.5 and kind < 0.15:
                out.append(f"<p class=keep>{link()}</p><ul><li class=keep>{link()}</li></ul>")
            elif linked < 0.5 and kind < 0.12:
                out.append(f"<p class=keep>{words(1, 3)} <a href='/y'>{words(2, 6)}</a>{rng.choice(('.', f' {words(1, 2)}.'))}</p>")
            elif kind < 0.2:
                out.append(f"<figure><img src=a><figcaption class=keep>{words(2, 20)}{end()}</figcaption></figure>")
            elif linked >= 0.5 and kind < 0.25:
                out.append(f"<p class=keep>{notice()}</p>")
            elif kind < 0.7:
                out.append(f"<p class=keep>{paragraph(most, linked)}</p>")
            elif kind < 0.8:
                out.append(f"<h2 class=keep>{words(1, 8)}</h2><p class=keep>{words(8, 60)}{end()}</p>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li class=keep>{words(3, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            else:
                out.append(f"<blockquote class=keep>{words(5, 50)}{end()}</blockquote>")
        if linked < 0.5:
            out += [f"<p>{notice()}</p>" for _ in range(2) if rng.random() < 0.3]
            rng.shuffle(out)
        if rng.random() < 0.3:
            out.append(f"<p class=keep>{words(1, 2)} <a href='/y'>{words(3, 9)}</a>.</p>")
        return "".join(out) + f"<p class=keep>{words(1, rng.choice((closing, closing, 40, 120)))}{end()}</p>"

    def links() -> str:
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8))) + "</ul>"
        return f"<div>{' | '.join(link() for _ in range(rng.randint(2, 6)))}</div>"

    def named() -> str:
        inner = rng.choice((links, lambda: f"<p>{words(1, 12)}</p>", lambda: f"<p>{words(20, 90)}{end()}</p>", lambda: f"<p>{notice()}</p>"))()
        tag = rng.choice(("nav", "aside", "footer", "form", "div class=ad", "div class='cookie-notice'", "div id=sidebar", "section class='comment-list'", "div class=related", "div hidden"))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def bare() -> str:
        return rng.choice(("<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>")).format(notice())

    def beside_links() -> str:
        return links() + (f"<div>{words(1, 6)}{end()}</div>" if rng.random() < 0.6 else "") + links()

    pages = []
    for k in range(n):
        full = rng.choice((0.9, 0.8, 0.7, 0.2))
        around = [rng.choice((named, named, links, beside_links, bare))() if rng.random() < full else "" for _ in range(4)]
        if k % 2:
            wrap = rng.choice(("<article>{}</article>", "<main><div>{}</div></main>", "<main><article><header class=entry-header>{}</header></article></main>", "<article class='side-story'>{}</article>"))
            inside = main(0.5, 8).split("</p>")
            inside.insert(rng.randrange(len(inside)), named() if rng.random() < 0.6 else "<p>")
            loose = rng.choice(("", f"<p>{words(1, 60)}{end()}</p>", f"<p>{words(1, 4)}{end()}</p>", f"<div class=ad>{words(1, 6)}{end()}</div>"))
            text = wrap.format("</p>".join(inside))
        else:
            loose, text = "", main(0.2, 8)
        if rng.random() < 0.2:
            around = [a if a.startswith(("<nav", "<footer", "<ul")) else "" for a in around]
            text = (named() if rng.random() < 0.3 else "") + text + (named() if rng.random() < 0.5 else "")
            loose, text = "", f"<div class='{rng.choice(('widget-content', 'sidebar-right', 'ad-free', 'promo', 'banner', 'comments', 'share-box'))}'>{text}</div>"
        elif rng.random() < 0.08:
            loose, text = "", ""
        elif rng.random() < 0.08:
            loose, text, around = "", f"<p class=keep>{words(1, 30)}{end()}</p>", ["", *around[1:2], "", ""]
        body = around[0] + loose + text + around[1] + loose + around[2] + around[3]
        pages.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
    return pages


def train(ablated: tuple[str, ...] = ()) -> Tree:
    """The tree over the labelled table; features in ``ablated`` are set to 0."""
    found = [blocks(p) for p in labelled_pages()]
    x = np.concatenate([vectors(b) for b in found])
    x[:, [FEATURES.index(f) for f in ablated]] = 0
    return grow(x, np.array([b.label for page in found for b in page], dtype=int), depth=12, least=3)


def main_text(page: str, tree: Tree) -> str:
    """The kept blocks of a page, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, row in zip(found, vectors(found).tolist(), strict=True) if share(tree, row) >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    A null or empty html, and a page of which no block is kept, has text ''.
    Broken markup is read as far as it goes; other columns are ignored.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
