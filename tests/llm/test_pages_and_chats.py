"""URL filter, page texts and chat formats beside plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from pairloom.llm import boosting, chat, html_extraction, urls

SF = "/root/testdata/sf0.001"


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail.split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


ODD = ["", None, "no scheme", "http://", "HTTP://A.Example.ORG", "https://www.example.org/es/x?y#z", "x://example.org/en/12#a?b", "http://notexample.org/en/1",
       "http://a.com/fr/", "http://com/de/x", "http://b.com?x=/fr/", "a://b://c.org/d", "http://org/"]


@pytest.mark.parametrize("array_bytes", [40, 1 << 20])
def test_urls(spark, array_bytes):
    rows = [(k, u, "h") for k, u in enumerate(ODD)] + [(r.page_id + 100, r.url, "h") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame([*urls.RULES, (None, "block"), ("noslash", "block")], "entry string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed, array_bytes=array_bytes).collect()}
    assert got == {k: plain_verdict(u, urls.RULES) for k, u, _ in rows}
    assert urls.judge_urls(pages.limit(0), listed).count() == 0
    assert urls.judge_urls(pages, listed.limit(0)).where("rule is not null").count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda text: len(text))
    array = urls.DigestArray(str(tmp_path), urls.DigestArray.pack([("ab/", "block"), ("cd/", "allow"), ("é/", "block")]))
    assert array.probe(["cd/", "xy/", "ab/", "é/", "q"]) == [("cd/", "allow"), None, ("ab/", "block"), ("é/", "block"), None]


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.main_text(pages).collect()}
    for r in pages.collect():
        page = html_extraction.Page(r.html or "")
        wanted = "\n\n".join(t for t, y in zip(page.text, html_extraction._teacher(page)) if y and t)
        assert got[r.page_id].text == wanted and got[r.page_id].n_chars == len(wanted)
        assert "<" not in wanted or "&lt;" in r.html


@pytest.fixture(scope="module")
def model(spark):
    return html_extraction.fit_model([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(60).collect()])


@pytest.fixture(scope="module")
def full_model(spark):
    """As fitted by the query on a larger table."""
    return html_extraction.fit_model([r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(html_extraction.SAMPLE_PAGES).collect()])


def test_markup_not_seen_before(spark, model):
    rng, right, total = random.Random(77), 0, 0
    pages = [html_extraction.Page(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id", ascending=False).limit(40).collect()]
    for k, page in enumerate(pages):
        texts = [t for t, y in zip(page.text, html_extraction._teacher(page)) if y and t]
        html, kept = html_extraction._variant(texts, [t for t in pages[k - 1].text if t], rng)
        made = html_extraction.Page(html)
        right += html_extraction.extract([made], model)[0] == "\n\n".join(t for t in made.text if t in kept)
        total += 1
    assert right >= 0.9 * total


LONG = [" ".join(f"{x}{k}" for k in range(60)) + "." for x in ("alpha", "beta", "gamma")]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in LONG)
NAV = '<nav><ul><li><a href="/">Home</a><li><a href="/n">News</a><li><a href="/s">Sport</a></ul></nav>'
FOOT = "<footer><p>Copyright 2020 by us.</p></footer>"


@pytest.mark.parametrize("inner", [
    f"<div id=x1>{PARAGRAPHS}</div>", f"<table><tr><td>{PARAGRAPHS}</td></tr></table>", PARAGRAPHS, f"<article>{PARAGRAPHS}</article>",
    f"<div><div>{PARAGRAPHS}</div></div>", "<article>" + "".join(f'<p class="{c}">{t}</p>' for c, t in zip(("lead", "story review", "story"), LONG)) + "</article>",
    f'<div class="content">{PARAGRAPHS}</div>', f"<main><section>{PARAGRAPHS}</section></main>"])
@pytest.mark.parametrize("around", [("", ""), (NAV, FOOT)])
def test_layouts_that_no_generator_made(full_model, inner, around):
    page = html_extraction.Page(f"<html><head><title>t</title></head><body>{around[0]}{inner}{around[1]}</body></html>")
    assert html_extraction.extract([page], full_model)[0] == "\n\n".join(LONG)


@pytest.mark.parametrize("extra", [
    NAV, FOOT, '<div class="cookie-notice"><p>We use cookies to make this site work.</p><button>OK</button></div>',
    '<div class="comments"><div class="comment"><p>I think so too, and more of it.</p></div></div>', '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/a">One</a></ul></aside>',
    '<form class="search"><label>Search</label><button>Go</button></form>', '<div class="ad">Buy this now</div>'])
def test_what_is_around_articles_is_left_out(full_model, extra):
    for page in (f"<body>{extra}<article>{PARAGRAPHS}</article></body>", f"<body><article>{PARAGRAPHS}</article>{extra}</body>", f'<body><div class="content">{PARAGRAPHS}</div>{extra}</body>'):
        assert html_extraction.extract([html_extraction.Page(page)], full_model)[0] == "\n\n".join(LONG)


def test_decoding_is_the_best_choice():
    """Every choice that doesn't contradict itself, on small trees."""
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randint(2, 9)
        parent = [-1] + [rng.randrange(k) for k in range(1, n)]
        leaf = [k not in parent for k in range(n)]
        odds = np.array([rng.uniform(-3, 3) for _ in range(n)])
        gain = lambda c: sum((-np.log1p(np.exp(-o)) if x else -np.log1p(np.exp(o))) for o, x in zip(odds, c))

        def allowed(c):
            below = [any(c[k] for k in range(n) if parent[k] == p) for p in range(n)]
            return all(not c[k] or (k == 0 or c[parent[k]]) and (leaf[k] or below[k]) for k in range(n))

        best = max(gain(c) for c in ([bool(x >> k & 1) for k in range(n)] for x in range(1 << n)) if allowed(c))
        got = html_extraction.decode(parent, odds, leaf)
        assert allowed(got) and abs(gain(got) - best) < 1e-9


@pytest.mark.parametrize("html", ["", "text only", "<p", "<div><script>x</script>", "<!-- c -->", "<ul><li>a<li>b", "</p></div>", "<a><a><p>&amp;&#x41;&bogus;", "<div>" * 3000 + "deep"])
def test_odd_pages(model, html):
    text = html_extraction.extract([html_extraction.Page(html)], model)[0]
    assert "\n\n\n" not in text and text == text.strip()


@pytest.mark.parametrize("html", [
    "<html><head><title>t</title><meta charset=x><body><article><p>the text</p></article></body></html>",
    "<head><title>t</title><script>x < y</script><style>p {}</style><article><p>the text</article>",
    "<html><head><meta name=a>the text</html>",
    "<head><title>t</title><b>the text</b>",
    "<head><noscript><p>no script</p><body><p>the text",
    "<head><noscript><img src=x><p>no script</p></noscript><title>t</title><div>the text</div>",
    "<head><title>t</title><template><p>x</head><body><p>the text",
    "<body><div><noscript><div>no script</div></div><p>the text</p>",
    "<body><div><template><p>row</p></div><p>the text</p>",
    "<body><div><svg><path d=x></div><p>the text</p>",
    "<body><a><svg><g><path d=x></a>the text",
    "<body><svg><path d=x><text>label</text><p>the text</p>",
    "<body><svg><foreignObject><div><p>label</p></div></foreignObject></svg><p>the text</p>",
    "<body><noscript><svg><p>label</p></svg></noscript><p>the text</p>",
    "<body><object><p>no player</p></object><p>the text</p>",
])
def test_unread_elements_that_are_not_closed(html):
    assert [t for t in html_extraction.Page(html).text if t] == ["the text"]


def test_odd_page_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (None, "u", "", 5), (2, "u", "<article><p>a b" + " c" * 60_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = html_extraction.main_text(pages).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got)[:3] == [0, 0, 0]
    assert html_extraction.main_text(pages.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 30)
        parent = [-1] + [rng.randrange(k) for k in range(1, n)]
        inner = set(parent)
        is_text = [k not in inner and rng.random() < 0.7 for k in range(n)]
        chosen = html_extraction.decode(parent, np.array([rng.gauss(0, 3) for _ in range(n)]), is_text)
        for k in range(1, n):
            assert not chosen[k] or chosen[parent[k]]


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def plain_turns(rows):
    turns, learnt, n = hashlib.sha256(), "", 0
    for _, role, text in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] or "")):
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
        learnt += (text or "") if role == "assistant" else ""
        n += 1
    return n, turns.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chats_round_trip(spark):
    rng = random.Random(9)
    bits = ["###", "#", "### assistant: ", "</turn>", "</turn>\n", "\\", "<", "/turn>", ": ", "é中", "\n", "a b", ""]
    rows = [(k, t, rng.choice(["user", "assistant", "system", "we: ird\\", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) if rng.random() < 0.9 else None)
            for k in range(80) for t in range(rng.randint(1, 9))]
    rows += [(500, 0, "user", "q"), (500, 1, "assistant", "a"), (501, 0, "user", "q"), (501, 0, "user", "q"), (502, t, ["user", "assistant"][t % 2], "x" * 50_000) if False else (502, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(r)
    got = {r.conv_id: r for r in chat.read_back(chat.segments(df)).collect()}
    for c, own in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_turns(own)
    assert got[500].valid and not got[501].valid and not got[502].valid
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0
    only = chat.segments(df.where("conv_id = 500")).orderBy("segment").collect()
    assert "".join(s.text for s in only) == "### user: q</turn>\n### assistant: a</turn>\n"
    assert [s.text for s in only if s.loss] == ["a"]


def test_long_conversation(spark):
    rows = [(None, t, ["user", "assistant"][t % 2], "word " * 300) for t in range(12_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.segments(df)).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars, r.valid) == (None, 12_000, 6_000 * 1500, True)
