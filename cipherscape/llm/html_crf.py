"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, with
the tags, class and id words of their ancestors.  Binary features of a block (its
ancestors, its length, links, punctuation and a few cue words) and the labels of
neighbours score a label sequence, content or boilerplate; Viterbi finds the best.

The weights come from labelled pages: ``labelled_pages`` writes pages from many
layouts with known labels (a bounded number, a parameter), and ``train`` maximises
their conditional likelihood by AdaGrad with forward-backward sums.

Text rules: character references are decoded, white space inside a block becomes
one space, blocks are trimmed and joined by one space in page order.  Scripts,
styles, comments, the head, form fields and the like never are blocks.

A page is read in one pass: an attribute's quote that is never closed ends its tag at the next '<' or '>', and
an end tag without a start, an element without an end or a comment without one costs no second reading.

Edge cases: null or empty html and pages without text give an empty text; unclosed
and stray tags are taken as browsers mostly do; a very long page is one sequence,
read whole; repeated rows give equal results; an empty table gives an empty
result; further columns stay.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTENT, OTHER = 1, 0

# HTML element kinds.
SKIPPED = frozenset("script style noscript template iframe object svg math head select textarea button option canvas audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
#: What an implied end never crosses.
SCOPES = frozenset("ul ol table div section article main aside header footer nav form body blockquote dl figure".split())

#: Tags that features name.
TOLD = frozenset("article main li td nav aside footer form header".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^>\"']*")
_HEADING = re.compile("h[1-6]|pre")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int
    tags: frozenset[str]
    names: frozenset[str]
    own: str


class _Scanner:
    """Finds tags in one pass forward.  What is looked for in vain is not looked for again, so no part of a page is read over and over."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # what doesn't come any more
        self.plain = False  # a tag ran to the end of the page: quotes mean nothing from there on

    def find(self, what: str, at: int) -> int:
        found = self.page.find(what, at) if what not in self.gone else -1
        if found < 0:
            self.gone.add(what)
        return found

    def end_of(self, at: int) -> int:
        """Where the attributes that start at ``at`` end: at '>' outside of quotes; in a tag that never ends so, at the next '<' or '>'."""
        pos = at
        while not self.plain:
            pos = _PLAIN.match(self.page, pos).end()
            if pos >= len(self.page):
                break
            if self.page[pos] == ">":
                return pos
            pos = self.find(self.page[pos], pos + 1) + 1
            if not pos:
                break
        self.plain = True
        ends = [e for e in (self.find(">", at), self.find("<", at)) if e >= 0]
        return min(ends, default=len(self.page))

    def close_of(self, tag: str, at: int) -> int | None:
        """The end of the next end tag of ``tag``, None where none comes."""
        if f"</{tag}" in self.gone:
            return None
        found = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        if found is None:
            self.gone.add(f"</{tag}")
            return None
        return self.find(">", found.end()) + 1 or len(self.page)


class _Open:
    """The open elements.  Counts by tag answer at once whether an end tag has anything to end, so a stray one costs nothing."""

    def __init__(self, known_tags: frozenset[str] | None, known_names: frozenset[str] | None):
        self.known_tags, self.known_names = known_tags, known_names
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.own: list[str] = ["body"]
        self.count: Counter[str] = Counter()
        self.frames: list[Counter[str]] = [Counter()]  # since the last element that an implied end doesn't cross
        self.named: Counter[str] = Counter()
        self.tags: frozenset[str] | None = frozenset()
        self.names: frozenset[str] | None = frozenset()

    def push(self, tag: str, names: frozenset[str]) -> None:
        if self.known_names is not None:
            names &= self.known_names
        self.stack.append((tag, names))
        self.count[tag] += 1
        if tag not in INLINE:
            self.own.append(tag)
        if tag in SCOPES:
            self.frames.append(Counter())
        else:
            self.frames[-1][tag] += 1
        if self.count[tag] == 1:
            self.tags = None
        for w in names:
            self.named[w] += 1
            if self.named[w] == 1:
                self.names = None

    def pop(self) -> str:
        tag, names = self.stack.pop()
        self.count[tag] -= 1
        if tag not in INLINE:
            self.own.pop()
        if tag in SCOPES:
            self.frames.pop()
        else:
            self.frames[-1][tag] -= 1
        if not self.count[tag]:
            del self.count[tag]
            self.tags = None
        for w in names:
            self.named[w] -= 1
            if not self.named[w]:
                del self.named[w]
                self.names = None
        return tag

    def end(self, tag: str) -> None:
        if self.count[tag]:
            while self.pop() != tag:
                pass
        else:
            del self.count[tag]

    def imply(self, ends: set[str], all_of_them: bool) -> None:
        """End the nearest element of ``ends``, or all of them, up to a scope."""
        while any(self.frames[-1][t] for t in ends):
            while self.pop() not in ends:
                pass
            if not all_of_them:
                return

    def around(self) -> tuple[frozenset[str], frozenset[str]]:
        """Tags and names of all open elements; made anew only when one came or went."""
        if self.tags is None:
            self.tags = frozenset(self.count if self.known_tags is None else self.count.keys() & self.known_tags)
        if self.names is None:
            self.names = frozenset(self.named)
        return self.tags, self.names


def blocks(page: str, known_tags: frozenset[str] | None = None, known_names: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order; of the tags and names around them those that are ``known``, or all."""
    out: list[Block] = []
    held: list[str] = []
    scan, around = _Scanner(page), _Open(known_tags, known_names)
    linked = 0

    def cut() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(text, min(linked, len(text)), *around.around(), around.own[-1]))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        held.append(raw)
        if "a" in around.count:
            linked += len(raw.strip())

    at, n = 0, len(page)
    while at < n:
        start = scan.find("<", at)
        if start < 0:
            add(page[at:])
            break
        found = _TAG.match(page, start)
        if found is None:
            if page.startswith("<!--", start):
                end = scan.find("-->", start + 4) + 3
                end = end if end > 2 else n
            elif page.startswith(("<!", "<?"), start):
                end = scan.find(">", start) + 1
            else:
                end = 0
            if start > at:
                add(page[at:start])
            if not end:  # a sign like any other
                add("<")
                end = start + 1
            at = end
            continue
        if start > at:
            add(page[at:start])
        tag, stop = found[2].lower(), scan.end_of(found.end())
        attributes = page[found.end() : stop]
        at = stop + 1 if page[stop : stop + 1] == ">" else stop
        if found[1]:  # an end tag
            if tag in SKIPPED:
                continue
            if tag not in INLINE:
                cut()
            around.end(tag)
            continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                end = scan.close_of(tag, at)
                if end is not None:
                    at = end
                elif tag == "head":
                    body = None if "<body" in scan.gone else re.compile(r"<body\b", re.I).search(page, at)
                    if body is None:
                        scan.gone.add("<body")
                    at = body.start() if body else at
                elif tag in ("script", "style", "textarea"):
                    at = n
            if tag not in INLINE:
                cut()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                cut()
            continue
        if tag not in INLINE:
            cut()
            implied = CLOSES.get(tag) or ({"p"} if tag in SCOPES or _HEADING.fullmatch(tag) else None)
            if implied:
                around.imply(implied, tag == "tr")
        names = frozenset()
        if "=" in attributes:
            names = frozenset(w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        if not attributes.endswith("/"):
            around.push(tag, names)
    cut()
    return out


CUES = (
    "cookie cookies subscribe newsletter copyright rights reserved advert advertisement sponsored login sign share comments reply "
    "menu search privacy terms contact related read follow email consent accept promo"
).split()  # fixed values

_CUES = frozenset(CUES)


def _grade(n: float, steps: tuple[float, ...]) -> int:
    return sum(n >= s for s in steps)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features that hold for each block."""
    out, told = [], {}
    for k, b in enumerate(page):
        words = b.text.split()
        size, link = _grade(len(words), (2, 4, 8, 15, 30, 60)), _grade(b.linked / max(1, len(b.text)), (0.05, 0.3, 0.6, 0.95))
        lower = {w.strip(".,:;!?()").lower() for w in words}
        f = ["1", f"own:{b.own}", f"size:{size}", f"link:{link}", f"size:{size},link:{link}", f"end:{b.text[-1] in '.!?:;'}", f"own:{b.own},size:{size}"]
        around = (b.tags, b.names, link)
        if around not in told:
            tags = b.tags - INLINE - {"html", "body"}
            told[around] = [f"in:{t}" for t in tags] + [f"name:{w}" for w in b.names] + [f"in:{t},link:{link}" for t in tags & {"article", "main", "li", "td"}]
            told[around].append(f"wrapped:{'article' in tags or 'main' in tags},{bool(tags & {'nav', 'aside', 'footer', 'form', 'header'})}")
        f += told[around]
        f += [f"cue:{c}" for c in CUES if c in lower] if not lower.isdisjoint(_CUES) else []
        f += ["copy"] * ("©" in b.text) + ["first"] * (k == 0) + ["last"] * (k == len(page) - 1)
        f.append(f"stops:{_grade(sum(map(b.text.count, '.,')), (1, 3, 8))}")
        out.append(f)
    return out


@dataclass
class Model:
    """Weights: (feature, label), and (label before, label)."""

    index: dict[str, int] = field(default_factory=dict)
    state: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, named: list[list[str]]) -> np.ndarray:
        get, met = self.index.get, {}  # blocks of a page are often alike
        for f in map(tuple, named):
            if f not in met:
                met[f] = self.state[[i for i in map(get, f) if i is not None]].sum(0)
        return np.array([met[tuple(f)] for f in named]) if named else np.zeros((0, 2))

    def viterbi(self, score: np.ndarray) -> list[int]:
        if not len(score):
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        rows = score.tolist()
        x, y = rows[0]
        back = []
        for a, b in rows[1:]:
            back.append((1 if y + p10 > x + p00 else 0, 1 if y + p11 > x + p01 else 0))
            x, y = max(x + p00, y + p10) + a, max(x + p01, y + p11) + b
        label = [1 if y > x else 0]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], passes: int = 8, rate: float = 0.3, l2: float = 1e-3, seed: int = 3) -> Model:
    """Conditional likelihood by AdaGrad steps, a page at a time."""
    index: dict[str, int] = {}
    for named, _ in pages:
        for f in named:
            for name in f:
                index.setdefault(name, len(index))
    coded = [([np.array([index[x] for x in f]) for f in named], np.array(labels)) for named, labels in pages if named]
    state, pair = np.zeros((len(index), 2)), np.zeros((2, 2))
    state_sq, pair_sq = np.full_like(state, 1e-6), np.full_like(pair, 1e-6)
    order = random.Random(seed)
    for _ in range(passes):
        order.shuffle(coded)
        for rows, labels in coded:
            n = len(rows)
            score = np.array([state[r].sum(0) for r in rows])
            fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0] = score[0]
            for k in range(1, n):
                fore[k] = np.logaddexp(fore[k - 1, 0] + pair[0], fore[k - 1, 1] + pair[1]) + score[k]
            for k in range(n - 2, -1, -1):
                nxt = score[k + 1] + aft[k + 1]
                aft[k] = np.logaddexp(pair[:, 0] + nxt[0], pair[:, 1] + nxt[1])
            total = np.logaddexp(*fore[-1])
            share = np.exp(fore + aft - total)
            share[np.arange(n), labels] -= 1
            flat, each = np.concatenate(rows), np.repeat(share, [len(r) for r in rows], axis=0)
            grad = np.zeros_like(state)
            np.add.at(grad, flat, each)
            touched = np.unique(flat)
            g = grad[touched] + l2 * state[touched]
            state_sq[touched] += g * g
            state[touched] -= rate * g / np.sqrt(state_sq[touched])
            if n > 1:
                joint = np.exp(fore[:-1, :, None] + pair + (score + aft)[1:, None, :] - total).sum(0)
                np.subtract.at(joint, (labels[:-1], labels[1:]), 1)
                joint += l2 * pair
                pair_sq += joint * joint
                pair -= rate * joint / np.sqrt(pair_sq)
    return Model(index, state, pair)


# -- labelled pages -----------------------------------------------------------------


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, texts of the content blocks in order): pages from random layouts with known content, every fourth without telling names."""
    return [(_plain_page if k % 4 == 3 else _page)(random.Random(seed * 1_000_003 + k)) for k in range(count)]


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu qua tre ston ing er al".split()
    n = r.randint(low, high)
    out = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n)]
    for k in range(r.randint(4, 9), n, r.randint(6, 14)):
        out[k - 1] += r.choice([".", ".", ",", ";"])
    return " ".join(out).capitalize()


def _sentence(r: random.Random, low: int = 3, high: int = 90) -> str:
    return _words(r, low, max(low, int(high * r.random() ** 1.5))) + r.choice([".", ".", ".", "!", "?", ""])


class _Writer:
    def __init__(self, r: random.Random):
        self.r, self.parts, self.content = r, [], []

    def text(self, text: str, content: bool) -> None:
        self.parts.append(html.escape(text, quote=False))
        if content:
            self.content.append(text)

    def element(self, tag: str, text: str, content: bool, attributes: str = "") -> None:
        self.parts.append(f"<{tag}{attributes}>")
        if content and len(text.split()) > 6 and self.r.random() < 0.25:  # inline markup inside
            words = text.split()
            k = self.r.randrange(1, len(words) - 2)
            i = self.r.choice(["b", "em", "a href='/x'", "span", "i"])
            self.parts.append(f"{html.escape(' '.join(words[:k]), quote=False)} <{i}>{html.escape(words[k], quote=False)}</{i.split()[0]}> {html.escape(' '.join(words[k + 1 :]), quote=False)}")
            self.content.append(text)
        else:
            self.text(text, content)
        if tag != "p" or self.r.random() < 0.85:
            self.parts.append(f"</{tag}>")

    def links(self, n: int, wrap: str, attributes: str = "") -> None:
        self.parts.append(f"<{wrap}{attributes}><ul>" if self.r.random() < 0.7 else f"<{wrap}{attributes}>")
        listed = self.parts[-1].endswith("<ul>")
        for _ in range(n):
            label = _words(self.r, 1, 4).rstrip(".,;") if self.r.random() < 0.8 else _sentence(self.r, 3, 12)
            self.parts.append(f"<li><a href='/{n}'>{label}</a></li>" if listed else f"<a href='/{n}'>{label}</a> ")
        self.parts.append(("</ul>" if listed else "") + f"</{wrap}>")


def _named(r: random.Random, *names: str) -> str:
    return f" {r.choice(['class', 'class', 'id'])}=\"{r.choice(names)}\""


def _page(r: random.Random) -> tuple[str, list[str]]:
    w = _Writer(r)
    w.parts.append(r.choice(["<!DOCTYPE html>", ""]) + f"<html><head><meta charset='utf-8'><title>{_words(r, 2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
    bare = r.random() < 0.15  # nothing but the article
    if not bare and r.random() < 0.35:
        _notice(w)
    wrapped = not bare and r.random() < 0.4
    if wrapped:
        w.parts.append("<header" + (_named(r, "site-header", "masthead", "top") if r.random() < 0.5 else "") + ">")
        w.element(r.choice(["h1", "div", "p", "span"]), _words(r, 1, 4), False)
    if not bare and r.random() < 0.85:
        w.links(r.randint(2, 9), *r.choice([("nav", ""), ("nav", ""), ("div", _named(r, "menu", "navbar", "nav main-menu", "navigation", "topnav")), ("div", ' role="navigation"')]))
    if wrapped:
        w.parts.append("</header>")
    for _ in range(0 if bare else r.choice([0, 1, 1, 2])):
        r.choice([_advert, _advert, _crumbs, _side, _form, _notice])(w)
    opening, closing = r.choice([
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
        (f"<div{_named(r, 'content', 'post-body', 'entry-content', 'article-body', 'story', 'main-content', 'post')}>", "</div>"),
        ("<div><div>", "</div></div>"), ("<section>", "</section>"), ('<div role="main">', "</div>"),
    ])
    w.parts.append(opening)
    if r.random() < 0.8:
        title = _sentence(r, 1, 14)
        if r.random() < 0.15:
            w.parts.append("<header>")
            w.element("h1", title, True)
            w.parts.append("</header>")
        else:
            w.element(r.choice(["h1", "h1", "h2"]), title, True)
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        kind = r.random()
        if kind < 0.7:
            text = _sentence(r, 1, 120)
            if r.random() < 0.12:  # a line break is a boundary of blocks
                more = _sentence(r, 1, 40)
                w.parts.append("<p>" + r.choice(["", "<b>"]))
                w.text(text, True)
                w.parts.append("<br>")
                w.text(more, True)
                w.parts.append(r.choice(["</p>", ""]))
            else:
                w.element(r.choice(["p", "p", "p", "p", "div", "blockquote", "pre"]), text, True)
        elif kind < 0.8:
            w.element(r.choice(["h2", "h3"]), _words(r, 1, 7), True)
        elif kind < 0.9:
            kind = r.choice(["ul", "ol"])
            w.parts.append(f"<{kind}>")
            for _ in range(r.randint(2, 6)):
                w.element("li", _sentence(r, 1, 25), True)
            w.parts.append(f"</{kind}>")
        elif kind < 0.94:
            w.parts.append("<table>")
            for _ in range(r.randint(1, 3)):
                w.parts.append("<tr>")
                for _ in range(r.randint(2, 3)):
                    w.element("td", _words(r, 1, 4), True)
                w.parts.append("</tr>")
            w.parts.append("</table>")
        else:
            r.choice([_advert, _form, _share, _side, _notice])(w)
    if r.random() < 0.2:
        _share(w)
    early = r.random() < 0.25
    if early and r.random() < 0.7:
        _comments(w)
    w.parts.append(closing)
    for _ in range(0 if bare else r.choice([0, 1, 1, 2])):
        r.choice([_side, _related, _advert, _form, _comments, _comments, _share, _notice])(w)
    if not bare and r.random() < 0.85:
        _foot(w)
    w.parts.append(r.choice(["</body></html>", "</body></html>", ""]))
    return "".join(w.parts), w.content


def _plain_page(r: random.Random) -> tuple[str, list[str]]:
    """A page whose parts have no telling class or id: nested divs, tables, rows of links, lists of comments."""
    w = _Writer(r)
    w.parts.append(f"<html><head><title>{_words(r, 2, 8)}</title></head><body>")
    table = r.random() < 0.3
    if r.random() < 0.6:
        _link_row(w)
    if r.random() < 0.3:
        tag = r.choice(["div", "h2", "h4"])
        w.parts.append(f"<{tag}><a href='/'>{_words(r, 1, 4)}</a></{tag}>")
    if r.random() < 0.2:
        w.element("p", r.choice(["We use cookies ", "Please accept cookies "]) + _sentence(r, 2, 15), False)
    if table:
        w.parts.append("<table><tr><td>")
        for _ in range(r.randint(2, 6)):
            w.parts.append(f"<a href='/x'>{_words(r, 1, 3)}</a>" + r.choice(["<br>", "<br>", " "]))
        w.parts.append("</td><td>")
    opening, closing = ("", "") if table else r.choice([("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<section>", "</section>"), ("", "")])
    w.parts.append(opening)
    if r.random() < 0.85:
        w.element(r.choice(["h1", "h1", "h2"]), _words(r, 1, 8), True)
    for _ in range(r.randint(2, 6)):
        kind = r.random()
        if kind < 0.65:
            w.element("p", _sentence(r, 2, 80), True)
        elif kind < 0.75:  # cue words occur in main texts as well
            w.element("p", " ".join([*r.sample(CUES, r.randint(1, 3)), _words(r, 1, 12)]).capitalize() + ".", True)
        elif kind < 0.85:
            w.element("h3", _words(r, 1, 4), True)
        elif kind < 0.9:
            terms = r.choice([["dt", "dd"], ["th", "td"]])
            w.parts.append("<dl>" if terms[0] == "dt" else "<table><tr>")
            for tag in terms * r.randint(1, 3):
                w.element(tag, _words(r, 1, 9), True)
            w.parts.append("</dl>" if terms[0] == "dt" else "</tr></table>")
        elif kind < 0.95:
            w.parts.append("<ul>")
            for _ in range(r.randint(2, 4)):
                w.element("li", _sentence(r, 1, 15), True)
            w.parts.append("</ul>")
        else:
            _link_row(w)
    w.parts.append(closing + ("</td></tr></table>" if table else ""))
    if r.random() < 0.35:
        w.element(r.choice(["h3", "h4", "p"]), f"{r.randint(1, 40)} comments", False)
        w.parts.append("<ol>")
        for _ in range(r.randint(1, 5)):
            w.parts.append("<li>")
            w.element(r.choice(["p", "div"]), _sentence(r, 3, 25), False)
            w.parts.append("</li>")
        w.parts.append("</ol>")
    if r.random() < 0.6:
        _link_row(w)
    if r.random() < 0.5:
        w.parts.append("<hr>")
        w.element(r.choice(["div", "font", "p", "footer"]), r.choice(["Copyright ", "© "]) + _words(r, 1, 8), False)
    w.parts.append("</body></html>")
    return "".join(w.parts), w.content


def _link_row(w: _Writer) -> None:
    """Links in a row, a list or the cells of a table."""
    kind = w.r.choice(["div", "div", "p", "ul", "table"])
    before, after = {"ul": ("<li>", "</li>"), "table": ("<td>", "</td>")}.get(kind, ("", w.r.choice([" ", " | "])))
    links = "".join(f"{before}<a href='/x'>{_words(w.r, 1, 4)}</a>{after}" for _ in range(w.r.randint(1, 7)))
    w.parts.append(f"<{kind}>{'<tr>' * (kind == 'table')}{links}</{kind}>")


def _notice(w: _Writer) -> None:
    w.parts.append(f"<div{_named(w.r, 'cookie-notice', 'notice', 'cookie-banner', 'consent', 'alert', 'gdpr', 'banner', 'popup modal')}>")
    w.element(w.r.choice(["p", "div", "span"]), w.r.choice(["We use cookies. ", "This site uses cookies ", "", "Please accept our terms. ", ""]) + _sentence(w.r, 3, 30), False)
    if w.r.random() < 0.5:
        w.parts.append("<button>Accept</button>")
    w.parts.append("</div>")


def _advert(w: _Writer) -> None:
    tag = w.r.choice(["div", "div", "div", "aside", "section", "p"])
    w.parts.append(w.r.choice(["", "<!-- ad -->"]) + f"<{tag}{_named(w.r, 'ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'advertisement', 'sponsor')}>")
    w.element(w.r.choice(["span", "p", "div"]), _sentence(w.r, 2, 40), False) if tag != "p" and w.r.random() < 0.5 else w.text(_sentence(w.r, 2, 40), False)
    w.parts.append(f"</{tag}>")


def _crumbs(w: _Writer) -> None:
    w.links(w.r.randint(2, 4), "div", _named(w.r, "breadcrumb", "breadcrumbs", "crumbs"))


def _side(w: _Writer) -> None:
    tag, names = w.r.choice([("aside", ""), ("aside", ""), ("div", _named(w.r, "sidebar", "side", "widget", "sidebar-right"))])
    w.parts.append(f"<{tag}{names}>")
    w.element(w.r.choice(["h3", "h4", "p", "div"]), _words(w.r, 1, 5), False)
    for _ in range(w.r.randint(0, 3)):
        w.element(w.r.choice(["p", "div", "li"]), _sentence(w.r, 3, 60), False)
    if w.r.random() < 0.6:
        w.links(w.r.randint(1, 5), "div")
    w.parts.append(f"</{tag}>")


def _related(w: _Writer) -> None:
    w.parts.append(f"<{(t := w.r.choice(['div', 'section']))}{_named(w.r, 'related', 'related-posts', 'recommended', 'more-stories')}>")
    w.element("h3", _words(w.r, 1, 3), False)
    w.links(w.r.randint(2, 6), "div")
    w.parts.append(f"</{t}>")


def _share(w: _Writer) -> None:
    w.links(w.r.randint(2, 4), "div", _named(w.r, "share", "social", "share-buttons", "tags", "meta"))


def _form(w: _Writer) -> None:
    w.parts.append("<form" + (_named(w.r, "newsletter", "search", "login", "subscribe", "contact") if w.r.random() < 0.7 else "") + ">")
    w.element(w.r.choice(["label", "p", "div"]), w.r.choice(["Subscribe ", "Sign up ", "Search ", "Your email ", ""]) + _words(w.r, 1, 12), False)
    w.parts.append("<input type='text'><select><option>one</option></select><button>Send</button>" + "</form>")


def _comments(w: _Writer) -> None:
    tag = w.r.choice(["section", "div", "ol"])
    w.parts.append(f"<{tag}{_named(w.r, 'comments', 'comment-list', 'discussion', 'responses', 'reader-comments', 'disqus')}>")
    if w.r.random() < 0.7:
        w.element("h3", w.r.choice(["Comments", _words(w.r, 1, 3)]), False)
    for _ in range(w.r.randint(1, 6)):
        inner = w.r.choice(["div", "li", "article", "p"])
        w.parts.append(f"<{inner}" + (_named(w.r, "comment", "reply", "comment-body") if w.r.random() < 0.8 else "") + ">")
        if inner == "p":
            w.text(_sentence(w.r, 2, 60), False)
        else:
            if w.r.random() < 0.6:
                w.element("span", _words(w.r, 1, 3), False)
            w.element("p", _sentence(w.r, 2, 60), False)
        w.parts.append(f"</{inner}>")
    w.parts.append(f"</{tag}>")


def _foot(w: _Writer) -> None:
    tag, names = w.r.choice([("footer", ""), ("footer", ""), ("div", _named(w.r, "footer", "site-footer", "bottom", "copyright"))])
    w.parts.append(f"<{tag}{names}>")
    for _ in range(w.r.randint(1, 3)):
        w.element(w.r.choice(["p", "div", "span"]), w.r.choice(["© ", "Copyright ", "", ""]) + _sentence(w.r, 2, 40), False)
    if w.r.random() < 0.4:
        w.links(w.r.randint(2, 5), "div")
    w.parts.append(f"</{tag}>")


def labels_of(page: list[Block], content: list[str]) -> list[int]:
    """Labels of a page's blocks, from the content texts in order."""
    out, k = [], 0
    wanted = [" ".join(t.split()) for t in content]
    for b in page:
        hit = k < len(wanted) and b.text == wanted[k]
        out.append(CONTENT if hit else OTHER)
        k += hit
    return out


_model: dict[int, Model] = {}


def default_model(pages: int = 400) -> Model:
    """The model of ``pages`` labelled pages; trained once in a process."""
    if pages not in _model:
        read = [(blocks(h), content) for h, content in labelled_pages(pages)]
        _model[pages] = train([(features(b), labels_of(b, content)) for b, content in read])
    return _model[pages]


def known(model: Model) -> tuple[frozenset[str], frozenset[str]]:
    """The tags and names that a model, or a feature, knows."""
    told = {"in": set(TOLD), "name": set()}
    for name in model.index:
        kind, _, what = name.partition(":")
        if kind in told:
            told[kind].add(what.partition(",")[0])
    return frozenset(told["in"]), frozenset(told["name"])


def main_text(page: str | None, model: Model, seen: tuple[frozenset[str], frozenset[str]] | None = None) -> str:
    found = blocks(page or "", *(seen or known(model)))
    return " ".join(b.text for b, label in zip(found, model.viterbi(model.scores(features(found))), strict=True) if label == CONTENT)


def extracted(pages: DataFrame, column: str = "html", model: Model | None = None) -> Column:
    """The column of main texts, for use in ``pages.withColumn``."""
    model = model or default_model()
    seen = known(model)

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(v.as_py(), model, seen) for v in batch], pa.string())

    return F.arrow_udf(extract, "string")(F.col(column))
