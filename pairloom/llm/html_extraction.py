"""Main text of web pages: boosted trees judge DOM nodes, a tree-wide decoding makes the judgements agree."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.boosting import Trees, fit
from pairloom.llm.words import column
from pairloom.sources.tables import stage

#: Pages whose nodes the model is fitted on, in their own markup and in made-up ones.
SAMPLE_PAGES = 200
#: Characters of a page beyond which it is not used for fitting (extraction reads all).
SAMPLE_CHARS = 100_000
VARIANTS = 4
#: How often a page's own markup counts.
OWN_WEIGHT = 2
_SEED = 5

UNREAD = frozenset("script style noscript template head title svg iframe object canvas".split())
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Tags that end an svg that isn't closed, but for those in its parts that hold HTML.
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span"
    " strong strike sub sup table tt u ul var article section main aside header footer nav figure form".split())
HTML_IN_SVG = frozenset("foreignobject desc title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GROUPS = {
    "page": "html body", "nav": "nav menu", "header": "header", "footer": "footer address", "aside": "aside", "article": "article main",
    "section": "section div center td th tr table tbody thead tfoot caption", "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl", "item": "li dt dd", "control": "form button select option textarea label fieldset legend input dialog",
    "figure": "figure figcaption picture", "quote": "blockquote pre details summary hr",
}
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags.split()}
RUN = len(GROUPS)
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar",
    "head": "header masthead topbar logo branding", "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar aside widget rail secondary related recommended more popular trending tags",
    "ad": "ad ads adv advert advertisement banner promo promoted sponsor sponsored",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies discussion respond disqus review reviews",
    "share": "share sharing social follow login search form author meta byline",
    "main": "article content main post entry story body text page news blog",
}
TOKEN_OF = {word: k for k, words in enumerate(TOKENS.values()) for word in words.split()}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_SPLIT = re.compile(r"[^a-z]+")


class Page(HTMLParser):
    """Block elements and runs of text, in page order, with their parents.

    An element that is not closed ends where its parent does, a paragraph where
    a block begins, a list item where the next one does, a head at the first tag
    or text that can't stand in it. So do elements that are not read. Inline
    elements give no nodes; ``br`` and images are white space.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.group, self.tag, self.tokens, self.text, self.links = [-1], [0], ["html"], [()], [""], [0]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.skipped: list[str] = []  # an element that is not read, and what is open in it
        self.inline: list[tuple[str, int]] = []
        self.body = False
        self.link, self.run, self.linked = False, [], 0
        self.feed(html)
        self.close()
        self._end_run()

    def _end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self._node("", RUN, ())
            self.text[-1], self.links[-1] = text, min(self.linked, len(text))
        self.run, self.linked = [], 0

    def _node(self, tag: str, group: int, tokens: tuple[int, ...]) -> int:
        for values, x in ((self.parent, self.open[-1][1]), (self.group, group), (self.tag, tag), (self.tokens, tokens), (self.text, ""), (self.links, 0)):
            values.append(x)
        return len(self.parent) - 1

    def _close_back_to(self, tags: set[str], scopes: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                return
            if self.open[k][0] in scopes:
                return

    def _end_svg(self) -> None:
        for k in range(len(self.skipped) - 1, -1, -1):
            if self.skipped[k] in HTML_IN_SVG or self.skipped[k] in UNREAD and self.skipped[k] != "svg":
                return
            if self.skipped[k] == "svg":
                del self.skipped[k:]

    def _is_open(self, tag: str) -> bool:
        return tag in ("html", "body") or any(t == tag for t, _ in self.open) or (tag, len(self.open)) in self.inline

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" and not self.body or self.skipped == ["head"] and tag not in IN_HEAD:
            self.skipped.clear()
        self.body |= tag == "body"
        if tag in ENDS_SVG and "svg" in self.skipped:
            self._end_svg()
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag not in VOID and tag not in GROUP_OF and tag not in UNREAD:
            self.inline.append((tag, len(self.open)))
        if tag in UNREAD:
            self._end_run()
            self.skipped.append(tag)
        elif tag == "a":
            self.link = True
        elif tag in ("br", "img"):
            self.run.append(" ")
        elif tag in GROUP_OF and tag not in ("html", "body"):
            self._end_run()
            self.link = False
            self._close_back_to({"p"}, {"td", "th", "li", "dd", "blockquote", "div", "section", "article", "button"})
            if tag in _CLOSED_BY:
                self._close_back_to(_CLOSED_BY[tag], _SCOPES[tag])
            words = " ".join(v for a, v in attrs if v and a in ("class", "id", "role", "aria-label")).lower()
            node = self._node(tag, GROUP_OF[tag], tuple(TOKEN_OF[w] for w in _SPLIT.split(words) if w in TOKEN_OF))
            if tag not in VOID:
                self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                return
            if not self._is_open(tag):
                return
            self.skipped.clear()
        if (tag, len(self.open)) in self.inline[-1:]:
            self.inline.pop()
        if tag == "a":
            self.link = False
        elif tag in GROUP_OF and tag not in ("html", "body"):
            self._end_run()
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        if self.skipped == ["head"] and data.strip():
            self.skipped.clear()
        if not self.skipped:
            self.run.append(data)
            self.linked += len(data) if self.link else 0


def features(page: Page) -> np.ndarray:
    """One row for each node: kind, attribute tokens of it and of those above, place among siblings, density of its subtree."""
    n, parent = len(page.parent), page.parent
    chars, links, tags, stops = [len(t) for t in page.text], list(page.links), [1] * n, [t.count(".") + t.count(",") for t in page.text]
    runs = [int(g == RUN) for g in page.group]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        tags[p] += tags[k]
        stops[p] += stops[k]
        runs[p] += runs[k]
    for k in range(1, n):
        children[parent[k]].append(k)
    own = np.zeros((n, RUN + 1 + len(TOKENS)))
    above = np.zeros((n, RUN + 1 + len(TOKENS)))
    numbers = np.zeros((n, 14))
    depth = [0] * n
    for k in range(n):
        own[k, page.group[k]] = 1
        for t in page.tokens[k]:
            own[k, RUN + 1 + t] = 1
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        above[k] = np.maximum(above[p], own[p])
    for p in range(n):
        kin = children[p]
        same: dict[int, int] = {}
        for k in kin:
            same[page.group[k]] = same.get(page.group[k], 0) + 1
        for i, k in enumerate(kin):
            numbers[k, :7] = (
                i / len(kin), math.log1p(len(kin)), same[page.group[k]] / len(kin), math.log1p(chars[p]), links[p] / (chars[p] or 1),
                math.log1p(chars[kin[i - 1]]) if i else 0, math.log1p(chars[kin[i + 1]]) if i + 1 < len(kin) else 0)
    for k in range(n):
        c = chars[k] or 1
        numbers[k, 7:] = (depth[k], math.log1p(chars[k]), links[k] / c, math.log1p(tags[k]), math.log1p(chars[k] / tags[k]), stops[k] / c, chars[k] / (chars[0] or 1))
    return np.concatenate([own, above, numbers], axis=1)


def decode(parent: list[int], odds: np.ndarray, is_text: list[bool]) -> list[bool]:
    """The likeliest choice of nodes in which no node is chosen under one that is not, nor an element without chosen text under it."""
    n = len(parent)
    none = -1e9
    keep, drop = [0.0] * n, [0.0] * n
    gain, best_child, chosen_below = [0.0] * n, [none] * n, [False] * n
    for k in range(n - 1, -1, -1):
        log_keep, log_drop = -math.log1p(math.exp(-max(-500.0, min(500.0, odds[k])))), -math.log1p(math.exp(max(-500.0, min(500.0, odds[k]))))
        drop[k] += log_drop
        if is_text[k]:
            keep[k] = log_keep
        elif chosen_below[k]:
            keep[k] = log_keep + gain[k]
        else:
            keep[k] = log_keep + gain[k] + best_child[k]
        p = parent[k]
        if p >= 0:
            drop[p] += drop[k]
            gain[p] += max(keep[k], drop[k])
            chosen_below[p] = chosen_below[p] or keep[k] > drop[k]
            best_child[p] = max(best_child[p], keep[k] - max(keep[k], drop[k]))
    chosen, forced = [False] * n, [False] * n
    needs = [not c and not t for c, t in zip(chosen_below, is_text)]
    chosen[0] = keep[0] > drop[0]
    best: dict[int, int] = {}
    for k in range(1, n):
        p = parent[k]
        if needs[p] and (p not in best or keep[k] - max(keep[k], drop[k]) > keep[best[p]] - max(keep[best[p]], drop[best[p]])):
            best[p] = k
    for p, k in best.items():
        forced[k] = True
    for k in range(1, n):
        chosen[k] = chosen[parent[k]] and (keep[k] > drop[k] or forced[k])
    return chosen


def extract(pages: list[Page], model: Trees) -> list[str]:
    tables = [features(p) for p in pages]
    odds = model.log_odds(np.concatenate(tables)) if tables else np.empty(0)
    out, at = [], 0
    for page, table in zip(pages, tables):
        kept = decode(page.parent, odds[at : at + len(table)], [g == RUN for g in page.group])
        at += len(table)
        out.append("\n\n".join(t for t, k in zip(page.text, kept) if k and t))
    return out


def _teacher(page: Page) -> np.ndarray:
    """Labels of a page from its own markup: text in an article is main, but for what is marked as something else."""
    bad_groups = {k for k, name in enumerate(GROUPS) if name in ("nav", "footer", "aside", "control")}
    good_group, good_token = list(GROUPS).index("article"), list(TOKENS).index("main")
    state = [0] * len(page.parent)
    for k in range(1, len(page.parent)):
        state[k] = state[page.parent[k]]
        if page.group[k] in bad_groups or any(t != good_token for t in page.tokens[k]):
            state[k] = -1
        elif page.group[k] == good_group and state[k] == 0:
            state[k] = 1
    return _labels(page, [s == 1 for s in state])


def _labels(page: Page, main: list[bool]) -> np.ndarray:
    y = np.array([m and g == RUN for m, g in zip(main, page.group)])
    for k in range(len(y) - 1, 0, -1):
        if y[k]:
            y[page.parent[k]] = True
    return y.astype(np.float64)


def _variant(texts: list[str], other: list[str], rng: random.Random) -> tuple[str, set[str]]:
    """A page in made-up markup with the given paragraphs as its article, and those texts."""
    words = " ".join(other).split() or ["more"]

    def some(a: int, b: int) -> str:
        start = rng.randrange(len(words))
        return " ".join((words * 2)[start : start + rng.randint(a, b)]) or "more"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{escape(some(1, 3))}</a></li>' for k in range(n))

    def tagged(tags: str, names: str, inner: str) -> str:
        tag = rng.choice(tags.split())
        name = rng.choice(names.split())
        attr = f' {rng.choice(["class", "id"])}="{name}"' if tag in ("div", "section", "ul", "span") or rng.random() < 0.5 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def line(a: int, b: int) -> str:
        inner = escape(some(a, b))
        return inner if rng.random() < 0.5 else f"<p>{inner}</p>"

    extras = [
        lambda: tagged("nav div nav", "menu navbar navigation breadcrumb", f"<ul>{links(rng.randint(2, 9))}</ul>"),
        lambda: tagged("header div", "header masthead site-header", rng.choice(["<h1>{}</h1>", "<a href='/'>{}</a>", "<div>{}</div>"]).format(escape(some(1, 6)))),
        lambda: tagged("aside div", "sidebar related widget recommended", f"<h3>{escape(some(1, 3))}</h3>" + rng.choice([f"<ul>{links(5)}</ul>", f"<p>{escape(some(8, 40))}</p>"])),
        lambda: tagged("div aside section", "ad ads advert promo sponsored banner", line(3, 30)),
        lambda: tagged("div section", "cookie-notice notice consent gdpr newsletter", line(5, 30) + rng.choice(["", "<button>OK</button>"])),
        lambda: f"<form>{tagged('div p', 'search login field', escape(some(1, 8)))}<label>{escape(some(1, 3))}</label><button>{escape(some(1, 2))}</button></form>",
        lambda: tagged("section div ul", "comments comment discussion replies", "".join(
            rng.choice(["<p>{}</p>", "<div class='comment'><p>{}</p></div>", "<li>{}</li>"]).format(escape(some(5, 60))) for _ in range(rng.randint(1, 5)))),
        lambda: tagged("footer div", "footer site-footer copyright", line(3, 25)),
        lambda: tagged("div", "share social tags author meta", f"<a href='#'>{escape(some(1, 2))}</a> " * rng.randint(1, 4)),
    ]
    def named(share: float) -> str:
        """An attribute of any words, also of such as mark other things."""
        if rng.random() >= share:
            return ""
        own = [rng.choice(["story", "lead", "x1", "c-body", "wrap", "col", "t2", "prose", *TOKEN_OF]) for _ in range(rng.randint(1, 2))]
        return f' {rng.choice(["class", "id"])}="{" ".join(own)}"'

    body, kept = [], set()
    for k, text in enumerate(texts):
        form = rng.choice(["p"] * 8 + ["div", "blockquote", "h2", "pre", "li"]) if k else rng.choice(["h1", "h1", "h2", "p"])
        inner = escape(text)
        kept.add(" ".join(text.split()))
        if form == "p" and rng.random() < 0.2:
            inner = f"<b>{inner}"
        body.append(f"<ul><li>{inner}</li></ul>" if form == "li" else f"<p{named(0.12)}>{inner}" + rng.choice(["</p>", "</p>", ""]) if form == "p" else f"<{form}{named(0.12)}>{inner}</{form}>")
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        body.insert(rng.randint(1, len(body)), rng.choice(extras[2:7] + extras[8:])())
    inner = "".join(body)
    main = rng.choice([
        lambda: tagged("article article main div section", "content post entry-content article story main-text", inner),
        lambda: tagged("article main div section", "content post entry-content article story main-text", inner),
        lambda: f"<article{named(0.3)}>{inner}</article>",
        lambda: f"<div id=x{rng.randint(1, 99)}>{inner}</div>",
        lambda: f"<div>{inner}</div>",
        lambda: f"<table{rng.choice(['', ' class=layout'])}><tr><td>{inner}</td></tr></table>",
        lambda: inner,
    ])()
    if rng.random() < 0.2:
        main = f"<div{named(0.1)}>{main}</div>"
    before = [e() for e in rng.sample(extras[:6], rng.randint(0, 4))]
    after = [e() for e in rng.sample(extras[2:], rng.randint(0, 4))]
    return "<html><head><title>t</title></head><body>" + "".join([*before, main, *after]), kept


def fit_model(htmls: list[str]) -> Trees:
    """Fit on sample pages as they are, labelled by their markup, and on the same texts in markup made up around them."""
    rng = random.Random(_SEED)
    pages = [Page(h) for h in htmls]
    tables, labels = [], []
    for k, page in enumerate(pages):
        y = _teacher(page)
        tables += [features(page)] * OWN_WEIGHT
        labels += [y] * OWN_WEIGHT
        texts = [t for t, m in zip(page.text, y) if m and t]
        rest = [t for t in pages[k - 1].text if t]
        for _ in range(VARIANTS if texts else 0):
            html, kept = _variant(texts[: rng.randint(1, len(texts))], rest, rng)
            made = Page(html)
            inside = [t in kept for t in made.text]
            tables.append(features(made))
            labels.append(_labels(made, inside))
    if not tables:
        width = len(features(Page(""))[0])
        return fit(np.zeros((0, width)), np.zeros(0))
    return fit(np.concatenate(tables), np.concatenate(labels))


def main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html are read): page_id, url, text, n_chars.

    Blocks in page order, joined by two line feeds; white space inside a block
    is one space; character references are decoded. Null or empty html gives an
    empty text. Repeated rows get equal rows. The model is fitted on the
    ``sample_pages`` pages (at most 100,000 characters each) that have the
    smallest hashes, alike pages once; extraction reads every page whole. An empty table gives an
    empty result.
    """
    sample = pages.where(F.char_length("html") <= SAMPLE_CHARS).select(F.xxhash64("page_id", "html").alias("h"), "html")
    bound = stage(sample.select("h").orderBy("h").limit(sample_pages), "sample").agg(F.max("h")).first()[0]
    few = sample.where(F.col("h") <= bound).distinct() if bound is not None else sample.limit(0)  # the hashes alone were sorted
    htmls = [r.html for r in few.orderBy("h", "html").limit(sample_pages).collect()]
    shared = pages.sparkSession.sparkContext.broadcast(fit_model(htmls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                texts = extract([Page(h or "") for h in column(batch, "html").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([
                    column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
