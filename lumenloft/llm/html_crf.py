"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks at the tags that break lines; each block has the tags and the class and id names of its
ancestors, its text and how much of it is linked. A two-state chain (main, rest) over features of these is trained by
gradient steps on the likelihood of labelled pages, which `labelled_pages` builds from a seeded generator in many
layouts, and decoded by Viterbi. The text of scripts, styles, comments, titles and the like never makes blocks; that of
formulas and of objects, which stands in for what can't be shown, does.

Null html counts as empty; a page without main blocks gives an empty text. Broken markup is read as far as it goes: an
element that isn't closed ends with the one that holds it, a tag that isn't ended ends the page, and a quote that isn't
closed before its tag's end is a character like others. Ties in Viterbi go to the rest. Repeated rows are extracted alike,
and other columns change nothing; an empty table gives an empty result. Each page is read whole, in time linear in its
length whatever is left open; memory follows the longest page."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, pieces

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements by their part in a page's layout.
RAW = frozenset("script style noscript template textarea title iframe svg select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input button "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded semantics annotation mfenced menclose".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS = ("article", "main", "body", "td", "table")  # an end tag of something outside doesn't close these
SPACES = re.compile(r"[\s\xa0]+")
WORDS = re.compile(r"[a-z]+")


class Block:
    """tags: of all ancestors; leaf: the innermost; names: features of their classes, ids and roles; linked: characters."""

    __slots__ = ("tags", "leaf", "names", "text", "linked")

    def __init__(self, tags, leaf, names, text, linked):
        self.tags, self.leaf, self.names, self.text, self.linked = tags, leaf, names, text, linked


def _names(attributes: str, known) -> tuple[str, ...]:
    """A class or id of one word is a name; one of several words is a whole, and each word is only a part of it."""
    out = []
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind in ("hidden", "aria-hidden"):
                out += ["name:hidden"] * (kind == "hidden" or value == "true")
                continue
            for token in value.split():
                words = WORDS.findall(token)
                out += ["name:" + words[0]] if len(words) == 1 else ["whole:" + "-".join(words), *["part:" + w for w in words]] if words else []
    return tuple(o for o in out if known is None or o in known)


def blocks(page: str, known=None) -> list[Block]:
    """The page's leaf blocks with text, in order. `known`: the names to keep, where they are bounded; none means all."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    where: dict[str, list[int]] = {}  # places of each open tag
    names: dict[str, int] = {}  # open names, counted
    out: list[Block] = []
    held: list[str] = []
    own: set[str] = set()  # names of inline elements in this block
    unclosed: set[str] = set()
    linked, link_at = 0, -1  # how deep the open link stands
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if held:
            text = SPACES.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append(Block([t for t, w in where.items() if w], stack[-1][0] if stack else "", own.union(names), text, min(linked, len(text))))
            held.clear()
        linked = 0
        own.clear()

    def cut(depth):
        nonlocal link_at
        while len(stack) > depth:
            tag, had = stack.pop()
            where[tag].pop()
            for x in had:
                names[x] -= 1
                if not names[x]:
                    del names[x]
        if link_at > depth:
            link_at = -1

    while at < n:
        m = TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            held.append(page[at:upto])
            if link_at >= 0:
                linked += upto - at
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    link_at = -1
                continue
            flush()
            if where.get(tag):
                place = where[tag][-1]
                if not any(where.get(t) and where[t][-1] > place for t in HOLDS):
                    cut(place)
            continue
        if tag in RAW:
            if tag == "title":  # what isn't shown doesn't break a block
                flush()
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = n
            else:
                unclosed.add(tag)
            continue
        if tag == "br" or tag == "img":
            held.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link_at = len(stack)
            own.update(_names(m[3], known))
            continue
        flush()
        if tag in BREAKS_P or tag in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i][0]
                if t == "p" and tag in BREAKS_P or t in CLOSES.get(tag, ()):
                    cut(i)
                    break
                if t != "p":
                    break
        if tag in VOID:
            continue
        had = _names(m[3], known)
        for x in had:
            names[x] = names.get(x, 0) + 1
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, had))
    flush()
    return out


def features(page_blocks: list[Block]) -> list[list[str]]:
    out = []
    for b in page_blocks:
        words = b.text.count(" ") + 1
        f = ["bias", "len" + str(min(6, words.bit_length())), "link" + str(int(4 * b.linked / max(1, len(b.text)))), "end" if b.text[-1] in ".!?:\"'”»" else "open"]
        f += ["in:" + t for t in b.tags]
        if b.leaf:
            f.append("leaf:" + b.leaf)
        f += b.names
        if b.text[0] in "©|»›":
            f.append("mark")
        out.append(f)
    return out


class Chain:
    """Two states: 0 rest, 1 main."""

    def __init__(self):
        self.weight: dict[str, np.ndarray] = {}
        self.step, self.first = np.zeros((2, 2)), np.zeros(2)

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        w = self.weight
        out = []
        for f in rows:
            a = b = 0.0
            for k in f:
                v = w.get(k)
                if v is not None:
                    a += v[0]
                    b += v[1]
            out.append((a, b))
        return out

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        if not rows:
            return []
        s = self.scores(rows)
        (t00, t01), (t10, t11) = self.step.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for x, y in s[1:]:
            back.append((a + t00 < b + t10, a + t01 < b + t11))
            a, b = max(a + t00, b + t10) + x, max(a + t01, b + t11) + y
        state = int(b > a)
        path = [state]
        for p in reversed(back):
            state = int(p[state])
            path.append(state)
        return path[::-1]

    def marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(s)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = s[0] + self.first
        for i in range(1, n):
            f[i] = s[i] + np.logaddexp(f[i - 1, 0] + self.step[0], f[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            v = s[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.step[:, 0] + v[0], self.step[:, 1] + v[1])
        z = np.logaddexp(*f[-1])
        pair = np.exp(f[:-1, :, None] + self.step + (s + b)[1:, None, :] - z)
        return np.exp(f + b - z), pair.sum(0)

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3):
        """Gradient ascent on the conditional likelihood, with step sizes by coordinate."""
        rng, seen = np.random.default_rng(seed), {}
        squares, first_sq, step_sq = {}, np.full(2, 1e-6), np.full((2, 2), 1e-6)
        for rows, _ in pages:
            for f in rows:
                for k in f:
                    seen[k] = seen.get(k, 0) + 1
        for k, c in seen.items():
            if c >= 3:
                self.weight[k], squares[k] = np.zeros(2), np.full(2, 1e-6)
        for _ in range(rounds):
            for p in rng.permutation(len(pages)):
                rows, labels = pages[p]
                if not rows:
                    continue
                y = np.eye(2)[labels]
                node, pair = self.marginals(np.array(self.scores(rows)))
                gap = y - node
                grads: dict[str, np.ndarray] = {}
                for f, g in zip(rows, gap, strict=True):
                    for k in f:
                        if k in self.weight:
                            grads[k] = grads[k] + g if k in grads else g
                for k, g in grads.items():
                    g = g - decay * self.weight[k]
                    squares[k] += g * g
                    self.weight[k] += rate * g / np.sqrt(squares[k])
                first_sq += gap[0] ** 2
                self.first += rate * gap[0] / np.sqrt(first_sq)
                g = (y[:-1].T @ y[1:] - pair) if len(rows) > 1 else np.zeros((2, 2))
                step_sq += g * g
                self.step += rate * g / np.sqrt(step_sq)
        return self


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages in many layouts, with a label for each of their leaf blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    flip = lambda p: rng.random() < p
    word = lambda: "".join(pick(*"bcdfghlmnprstvw") + pick(*"aeiou") for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    line = lambda a, b: words(a, b).capitalize() + pick(".", ".", ".", "!", "?", "")
    # words that mark the rest of a page where they stand alone, and mean nothing as a part of a longer name
    marks = "ad ads advert banner promo sponsored cookie consent notice popup newsletter share social breadcrumb sidebar related widget menu navbar header footer masthead comments comment login search subscribe".split()
    plain = "lead intro text body content entry chapter section main part row column wrap inner block box item page story grid fact case hoc free board note card".split()

    def attribute(name: str) -> str:
        quote = pick('"', '"', "'")
        return f" {pick('class', 'class', 'id')}={quote}{name}{quote}"

    def inside() -> str:
        if flip(0.5):
            return ""
        return attribute(pick(word(), pick(*plain), f"{pick(*plain)}-{pick(*plain)}", f"{word()}-{word()}", f"{pick(*marks)}-{pick('board', 'free', 'hoc', 'case', 'note', 'text')}", f"{word()}{int(rng.integers(1, 99))}"))

    def outside(*names: str) -> str:
        """Attributes of elements of the rest: a mark, alone or with its usual company."""
        name = pick(*names)
        return attribute(pick(name, name, f"{name} {word()}", f"site-{name}", f"{name}-{pick('area', 'wrapper', 'container', 'list', 'bar', 'inner')}", f"page-{name}", f"{name}s"))

    def page() -> tuple[str, list[int]]:
        parts: list[str] = []
        labels: list[int] = []

        def put(text, label, open_="", close=""):
            parts.append(f"{open_}{text}{close}")
            labels.append(label)

        def links(tag):
            parts.append(pick("<ul>", "<ul class='menu'>", "<ol>") if tag else "")
            for _ in range(int(rng.integers(2, 9))):
                put(words(1, 4), 0, f'<li><a href="/{word()}">', pick("</a></li>", "</a></li>", "</a>"))
            parts.append("</ul>" if tag else "")

        def chrome(kind):
            if kind == "nav":
                tag, own = pick(("nav", ""), ("nav", outside("menu", "navbar")), ("div", outside("nav", "navigation", "menu", "navbar")), ("div", ' id="navigation" role="navigation"'))
                parts.append(f"<{tag}{own}>")
                links(True)
            elif kind == "header":
                tag, own = pick(("header", ""), ("header", outside("header", "masthead", "banner")), ("div", outside("header", "masthead", "top", "banner")))
                parts.append(f"<{tag}{own}>")
                put(words(1, 5), 0, "<p>", "</p>")
                if flip(0.5):
                    links(True)
            elif kind == "footer":
                tag, own = pick(("footer", ""), ("footer", outside("site", "footer")), ("div", outside("footer", "bottom", "copyright")))
                parts.append(f"<{tag}{own}>")
                put(pick("&copy; ", "Copyright ", "", "All rights reserved ") + words(2, 14) + pick("", ".", " &middot; " + words(3, 12) + "."), 0, pick("", "<p>"), "")
                if flip(0.3):
                    links(True)
            elif kind == "aside":
                tag, own = pick(("aside", ""), ("aside", outside("related", "sidebar", "widget")), ("div", outside("sidebar", "related", "widget", "recommended")), ("section", outside("related", "sidebar")), ("div", ' role="complementary"'))
                parts.append(f"<{tag}{own}>")
                put(words(1, 4), 0, "<h3>", "</h3>")
                for _ in range(int(rng.integers(1, 4))):
                    put(line(4, 25), 0, pick("<p>", "<li>"), pick("</p>", ""))
                if flip(0.3):
                    links(True)
            elif kind == "ad":
                tag, own = pick(("div", outside("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")), ("ins", ' class="adsbygoogle"'), ("aside", outside("ad", "promo")))
                parts.append("<div>" if tag == "ins" else "")
                put(line(3, 30), 0, f"<{tag}{own}>" + pick("", "<p>" if tag != "ins" else ""), "")
                parts.append("</ins></div>" if tag == "ins" else "")
            elif kind == "notice":
                tag, own = pick(("div", outside("cookie", "notice", "consent", "popup", "newsletter", "breadcrumb", "share", "alert", "social")), ("div", ' role="alert"'), ("p", outside("notice", "cookie")), ("div", ' id="cookie-notice"'), ("section", outside("cookie", "newsletter")))
                put(line(5, 30), 0, f"<{tag}{own}>" + pick("", "<p>" if tag != "p" else ""), "")
            elif kind == "form":
                tag, own = "form", pick("", outside("search", "subscribe", "login"))
                parts.append(f"<form{own}>")
                put(words(1, 6), 0, "<label>", "</label><input>")
                if flip(0.4):
                    put(words(2, 12), 0, "<p>", "</p><select><option>a<option>b</select>")
            elif kind == "comments":
                tag, own = pick(("section", outside("comments")), ("div", outside("comments", "comment", "responses", "discussion")), ("ol", ' class="comment-list"'))
                parts.append(f"<{tag}{own}>")
                if flip(0.5):
                    put(words(1, 3), 0, "<h3>", "</h3>")
                for _ in range(int(rng.integers(1, 5))):
                    put(line(4, 60), 0, *pick(('<div class="comment"><p>', "</p></div>"), ("<p>", "</p>"), ('<article class="comment"><p>', "</p></article>"), ("<li>", "</li>"), ("<blockquote>", "</blockquote>")))
            elif kind == "hidden":
                parts.append(f"<script>var a='{word()}</p>';</script><style>p{{}}</style><!-- {words(2, 9)} --><noscript>{words(2, 6)}</noscript>")
                return
            if tag != "ins":
                parts.append(f"</{tag}>")

        def body(kind):
            """One piece of the article."""
            if kind == "text":
                put(pick("", "<b>", f"<span{inside()}>") + line(1, 60) + pick("", "<br>", f" <a href='#'>{word()}</a>", f' <a href="#" title="{word()}>{word()}"> {word()} </a>', " " + line(5, 60)), 1, f"<p{inside()}>", pick("</p>", "</p>", ""))
            elif kind == "heading":
                h = pick("h2", "h2", "h3", "h4")
                put(words(1, 7), 1, f"<{h}{inside()}>", f"</{h}>")
            elif kind == "list":
                tag = pick("ul", "ol")
                parts.append(f"<{tag}{inside()}>")
                for _ in range(int(rng.integers(1, 6))):
                    put(line(1, 20), 1, *pick(("<li>", "</li>"), ("<li>", ""), ("<li><p>", "</p></li>"), ("<li><a href='/x'>", "</a></li>") if flip(0.2) else ("<li>", "</li>")))
                parts.append(f"</{tag}>")
            elif kind == "quote":
                put(line(3, 30), 1, f"<blockquote{inside()}>" + pick("", "<p>"), "</blockquote>")
            elif kind == "table":
                parts.append(f"<table{inside()}>" + pick("", "<tbody>"))
                if flip(0.4):
                    put(words(1, 6), 1, "<caption>", "</caption>")
                for r in range(int(rng.integers(1, 5))):
                    parts.append("<tr>")
                    for _ in range(int(rng.integers(1, 4))):
                        cell = "th" if not r and flip(0.6) else "td"
                        put(pick(words(1, 4), str(int(rng.integers(1, 9999))), line(2, 12)), 1, f"<{cell}>", pick(f"</{cell}>", ""))
                    parts.append("</tr>")
                parts.append("</table>")
            elif kind == "pre":
                put("\n".join(words(1, 6) for _ in range(int(rng.integers(1, 5)))), 1, *pick(("<pre>", "</pre>"), ("<pre><code>", "</code></pre>"), (f"<pre{inside()}>", "</pre>")))
            elif kind == "terms":
                parts.append(f"<dl{inside()}>")
                for _ in range(int(rng.integers(1, 4))):
                    put(words(1, 4), 1, "<dt>", pick("</dt>", ""))
                    put(line(2, 20), 1, "<dd>", pick("</dd>", ""))
                parts.append("</dl>")
            elif kind == "figure":
                parts.append(f"<figure{inside()}><img src='a.png' alt='{word()}'>")
                put(line(2, 15), 1, "<figcaption>", "</figcaption>")
                parts.append("</figure>")
            elif kind == "formula":
                put(f"{words(1, 8)} <math><mi>{word()}</mi><mo>=</mo><mn>{int(rng.integers(9))}</mn></math> {line(1, 9)}", 1, "<p>", "</p>")
            elif kind == "object":
                put(f"<object data='a.swf'>{line(2, 12)}</object>", 1, "<p>", "</p>")
            elif kind == "box":
                tag = pick("div", "div", "section", "details")
                parts.append(f"<{tag}{inside()}>")
                for _ in range(int(rng.integers(1, 4))):
                    body(pick("text", "text", "heading", "list", "table", "pre", "bare"))
                parts.append(f"</{tag}>")
            elif kind == "bare":
                put(line(1, 40), 1, f"<div{inside()}>", "</div>")

        wrap = flip(0.3)
        parts.append(f"<div{inside()}>" if wrap else "")
        often = pick(0.6, 0.6, 0.1)
        for k in rng.permutation(["hidden", "header", "nav", "notice", "ad", "form"]):
            if flip(often):
                chrome(k)
        title = line(3, 12)
        opened, closed = pick(
            ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>"), ('<div class="content">', "</div>"),
            ('<div id="content" class="article">', "</div>"), ('<div class="post entry">', "</div>"), ('<div class="story text">', "</div>"), ('<div class="post-content">', "</div>"), ('<div id="main-content">', "</div>"),
        )
        parts.append(opened)
        if flip(0.8):
            put(title, 1, *pick(("<h1>", "</h1>"), ('<h1 class="title">', "</h1>"), ("<header><h1>", "</h1></header>") if flip(0.3) else ("<h1>", "</h1>")))
        if flip(0.9):
            for _ in range(int(rng.integers(1, pick(3, 12)))):
                kind = rng.random()
                if kind < 0.55:
                    body("text")
                elif kind < 0.9:
                    body(pick("heading", "list", "quote", "table", "pre", "terms", "figure", "formula", "object", "box", "bare"))
                elif kind < 0.97:
                    chrome(pick("ad", "notice", "aside", "form", "nav"))
                else:
                    chrome("hidden")
        else:  # an article without paragraphs
            for _ in range(int(rng.integers(1, 4))):
                body(pick("table", "pre", "terms", "list", "figure"))
        if flip(0.25):
            chrome("comments")
        parts.append(closed if flip(0.95) else "")
        for k in rng.permutation(["aside", "comments", "ad", "footer", "notice", "nav"]):
            if flip(0.5 if k != "footer" else 0.0):
                chrome(k)
        if flip(0.9):
            chrome("footer")
        parts.append("</div>" if wrap else "")
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{''.join(parts)}</body></html>", labels

    return [page() for _ in range(n)]


@lru_cache(maxsize=2)
def trained(n: int = 600, seed: int = 17) -> Chain:
    pages = [(features(blocks(text)), labels) for text, labels in labelled_pages(n, seed)]
    return Chain().fit(pages, rounds=8)


@lru_cache(maxsize=2)
def ready(spark: SparkSession) -> Chain:
    """The trained chain, from the shared folder where it was trained before."""

    def fit():
        c = trained()
        return {"names": np.array(list(c.weight)), "weights": np.array(list(c.weight.values())), "step": c.step, "first": c.first}

    kept, chain = fitted(spark, "main-text", trained.__wrapped__.__defaults__, fit), Chain()
    chain.weight = dict(zip(kept["names"].tolist(), kept["weights"], strict=True))
    chain.step, chain.first = kept["step"], kept["first"]
    return chain


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "", chain.weight)
    return "\n".join(b.text for b, keep in zip(found, chain.viterbi(features(found)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    chain = chain or ready(pages.sparkSession)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for b in batches:
            for c in pieces(b, "html", 8 << 20):
                texts = [main_text(p, chain) for p in c["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([c["page_id"], c["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    df = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages)
