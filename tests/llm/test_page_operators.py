"""Operators on pages and vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pulsegrid.llm import embed_dedup, html_text, url_filter
from pulsegrid.llm.html_text import Page
from pulsegrid.llm.queries import RULES

# --- 1: vectors


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 7])
def test_vectors(corpus_spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "BUCKET", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(int(k), (base[k % 60] + 0.02 * (k // 60) * rng.standard_normal(16)).tolist()) for k in range(400)]
    rows += [(900 + k, base[3].tolist()) for k in range(30)] + [(950, (base[3] * 1e300).tolist()), (951, (base[3] * 1e-300).tolist())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0])]
    rows += [(None, base[3].tolist()), (3, base[3].tolist())]
    table = corpus_spark.createDataFrame([(i, v, 1, 2, None) for i, v in rows], "vec_id long, embedding array<double>, label int, n long, bytes string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(table).collect()), key=str)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    ids = np.array([i for i, _ in good])
    root = ids.copy()
    while True:
        low = np.array([root[near[k]].min() for k in range(len(ids))])
        if (low == root).all():
            break
        root = low
    want = [(int(i), int(near[k].sum() - 1), int(root[k]), bool(root[k] == i)) for k, i in enumerate(ids)]
    rest = [i for i, v in rows if i is None or i >= 1000]
    want += [(i, 0, i, True) for i in rest]
    assert got == sorted(want, key=str)
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0


# --- 6: URLs


def test_urls(corpus_spark):
    rng = random.Random(2)
    hosts = ["example.org", "a.example.org", "notexample.org", "org", "x.com", "X.CoM", "com", "example.org.", "..org", "", "b.example.org:80", "net", "community"]
    paths = ["", "/", "/es/1", "/es", "/en/1", "/en/19", "/en/2", "/fr/a", "/de/b", "/de", "/ES/1", "/en/1?x=/fr/", "?a=1", "#/es/", "/fr/é\n"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c/d", "://org/x"]
    pages = corpus_spark.createDataFrame([(k % 100 or None, u, None, "clash", "clash", "clash") for k, u in enumerate(urls * 2)], "page_id long, url string, html string, host string, path string, verdict string")
    rules = RULES + [("Example.ORG", "/en/", "allow"), ("com", "/fr/", "block"), (None, "/", "block"), ("", "/", "block"), ("example.org", None, "block")]

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:]
            path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = {}
        for h, p, v in rules:
            h, p = (h or "").lower(), p or ""
            if h and (host == h or host.endswith("." + h)) and path.startswith(p):
                fits[h, p] = "block" if "block" in (v, fits.get((h, p))) else "allow"
        if not fits:
            return host, path, None, "allow"
        best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
        return host, path, "".join(best), fits[best]

    table = corpus_spark.createDataFrame(rules, "host string, path string, verdict string")
    for buckets in (1, 7):
        got = sorted(map(tuple, url_filter.filter_urls(pages, table, buckets=buckets).collect()), key=str)
        assert got == sorted(((k % 100 or None, *judge(u)) for k, u in enumerate(urls * 2)), key=str)
    assert url_filter.filter_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, table.limit(0), default="block").collect()} == {"block"}


# --- 10: HTML

PAGES = {
    "<html><body><nav><a href=/>Home</a><a>More</a></nav><article><h1>T &amp; t</h1><p>One  two\nthree.<p>Four <b>five</b>.<br>Six</article><footer>(c) me and you</footer></body>": "T & t\nOne two three.\nFour five. Six",
    "<body><div class='sidebar'><p>Left out text that is long enough to count.</p></div><div><p>First part of the story, told at length.</p><p>Second part of it.</p></div><div id=comments><p>nice article, thanks a lot for it</p></div>": "First part of the story, told at length.\nSecond part of it.",
    "<script>var a='</p><p>no';</script><style>p{}</style><p>Only &lt;this&gt; &#233;&nbsp;x</p><!-- <p>not this</p> -->": "Only <this> é x",
    "<article><h1>Title</h1><p>Text 1 < 2 and \"a > b\".</p><form><input><button>Send</button></form><aside>More to read</aside><ul><li>one<li>two</ul>": "Title\nText 1 < 2 and \"a > b\".\none\ntwo",
    "<main><header><h2>Head</h2></header><p>Body of the page.</p></main><header>Site</header>": "Head\nBody of the page.",
    "plain text, no markup": "plain text, no markup",
    "<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>": "yes",
    "": "",
    "<<<>>><a <b": "<<<>>>",
}


@pytest.mark.parametrize("source", PAGES)
def test_page(source):
    if source.startswith("<<<"):
        Page(source).main_text()  # no markup at all: whatever it gives, it ends
    else:
        assert Page(source).main_text() == PAGES[source]


def test_extract(corpus_spark):
    rows = [(k, f"http://h/{k}", s) for k, s in enumerate(PAGES)] + [(None, None, None), (3, "u", "<p>x</p>"), (4, None, "<div>" * 3000 + "deep" + "</div>" * 3000)]
    table = corpus_spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(table).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert any(r.text == "deep" for r in got) and any(r.page_id is None and r.text == "" for r in got)
    assert html_text.extract(table.limit(0)).count() == 0
