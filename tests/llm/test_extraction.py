"""Extraction on pages whose main text is known, and the cut against every labelling."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from fundlens.llm import extraction
from fundlens.llm.queries import catalog

SHAPE = "page_id bigint, url string, html string"


def value(kept, gain, edges):
    lost = sum(max(g, 0) if not k else max(-g, 0) for k, g in zip(kept, gain))
    return lost + sum(c for a, b, c in edges if kept[a] != kept[b])


def test_cut_is_least():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        gain = [rng.choice([rng.uniform(-3, 3), rng.randrange(-2, 3), 1e9, -1e9]) for _ in range(n)]
        edges = [(*sorted(rng.sample(range(n), 2)), rng.choice([0.5, 1.0, rng.uniform(0, 3)])) for _ in range(rng.randrange(0, 14))] if n > 1 else []
        best = min(value(k, gain, edges) for k in itertools.product([False, True], repeat=n))
        assert value(extraction.cut(gain, edges), gain, edges) == pytest.approx(best, abs=1e-6)


def test_cut_of_a_long_chain():
    n = 20_000
    gain = [1.0 if (i // 7) % 3 else -1.3 for i in range(n)]
    kept = extraction.cut(gain, [(i, i + 1, 0.9) for i in range(n - 1)])
    assert 0 < sum(kept) < n


SENTENCE = "The committee met on Monday, and nobody objected to the plan that had been made in spring."
PAGES = {
    "marked": (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><h2>Site</h2></header>"
        "<nav><a href='/'>Home</a></nav><article><header><h1>Head &amp; more</h1></header><p>One  <b>t</b>wo\n three.<br>Four<p>Five"
        "<div class='ad'>Buy.</div><ul><li>Six<li>Seven</ul><aside>Side</aside><section class='comments'><article><p>Nice!</p></article></section>"
        "<article><p>Teaser</p></article></article><footer>&copy; x</footer></body></html>",
        "Head & more One two three. Four Five Six Seven",
    ),
    "broken": ("<p>Lost</nav></div></p><main><p title='a>b hidden c'>1 < 2 &lt;b&gt; &eacute;&#233;&nbsp;x<script>if(a<b)'</p>'</script><!-- <p>no</p> --></main", "1 < 2 <b> éé x"),
    "notices": (
        "<main><div class='cookie-banner'>We use cookies.</div><div id=page-footer>Foot</div><span class='sponsored'>Paid <span>x</span> y</span>"
        "<div role='alert'>Beware.</div><p hidden>Gone</p><p style='display: none'>Gone</p><form><label>Mail</label><input><button>Send</button></form>"
        "<div class='has-sidebar'><p>Kept.</p></div></main>",
        "Kept.",
    ),
    "plain": (
        f"<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><div class=content><h1>About it</h1><p>{SENTENCE}</p><p>Yes.</p><p>{SENTENCE}</p>"
        "</div><div><a href=c>Jobs</a> <a href=d>Press</a></div><div>&copy; 2020 Copyright</div></body>",
        f"About it {SENTENCE} Yes. {SENTENCE}",
    ),
    "empty": ("", ""),
    "no text": ("<html><body><script>x</script> </body></html>", ""),
    "words only": (SENTENCE, SENTENCE),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert extraction.main_text(page, extraction.PRIOR) == text


def test_short_block_follows_its_neighbours():
    """Alone "Read on" is boilerplate to the classifier; between paragraphs it is content."""
    blocks = extraction.blocks_of("<div>Read on</div>")
    assert (extraction.features(blocks) @ extraction.PRIOR)[0] < 0
    inside = f"<div><div>{SENTENCE}</div><div>Read on</div><div>{SENTENCE}</div></div>"
    assert "Read on" in extraction.main_text(inside, extraction.PRIOR)


def test_learning():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.standard_normal((400, len(extraction.PRIOR) - 1))]
    y = (x[:, 3] > 0.2).astype(float)
    weights = extraction.learn(x, y)
    assert np.mean((x @ weights > 0) == (y > 0)) > 0.95
    assert (extraction.learn(x[:0], y[:0]) == extraction.PRIOR).all()


def test_table(spark):
    long = "<main>" + f"<p>{SENTENCE}</p>" * 20_000 + "</main>"
    rows = [(1, None, PAGES["marked"][0]), (1, None, PAGES["marked"][0]), (None, "u", None), (2, "u", ""), (3, "u", long)]
    table = spark.createDataFrame([(*r, 7) for r in rows], SHAPE + ", key int")
    found = sorted(((r.page_id, r.text, r.n_chars, r.key) for r in extraction.extract(table).collect()), key=repr)
    whole = " ".join([SENTENCE] * 20_000)
    text = PAGES["marked"][1]
    expected = [(1, text, len(text), 7)] * 2 + [(None, "", 0, 7), (2, "", 0, 7), (3, whole, len(whole), 7)]
    assert found == sorted(expected, key=repr)
    assert extraction.extract(table.limit(0)).collect() == []


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>|<br>", inner)
    return " ".join(" ".join(html.unescape(re.sub("<[^>]+>", "", p)) for p in parts).split())


def test_query(spark, folder):
    given = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = catalog.plans["op12_html_extraction"](spark, folder).collect()
    assert len(found) == len(given)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, article(given[r.page_id].html), len(r.text))


def test_learned_weights_extract_without_marks(spark, folder):
    """Held out: the same pages with their telling elements made plain."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    weights = extraction.fit(pages)
    hit = total = wrong = 0
    for r in pages.collect():
        plain = re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", r.html)
        kept = extraction.main_text(plain, weights).split()
        true = article(r.html).split()
        hit += sum(a == b for a, b in zip(kept, true)) if kept[: len(true)] == true else 0
        total += len(true)
        wrong += max(0, len(kept) - len(true))
    assert hit > 0.9 * total and wrong < 0.05 * total
