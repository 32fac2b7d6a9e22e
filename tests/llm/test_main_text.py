"""Main text: parsing, decoding against brute force, pages by hand, and laid-out pages that the model has not seen."""

import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from attestor.llm import layouts, main_text

PAGES = "page_id long, url string, html string"
A = "The committee met on Tuesday to discuss the plan for the northern harbour, and most members agreed with it."
B = "Work on the first pier starts in May. It should be done before winter, if the weather allows."
C = "Short."


@pytest.fixture(scope="module")
def model(spark):
    return main_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def runs(text):
    nodes = main_text.Nodes()
    main_text.parsed(text, 0, nodes, {})
    return [t for t in nodes.text if t is not None]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<b>c</p>d", ["a", "bc", "d"]),
        ("<p>a\n\t b<br>c&nbsp; d</p>", ["a b c d"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>e", ["a", "b", "c", "e"]),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style>y<!-- <p>no</p> -->z", ["xyz"]),
        ("<title>t</title><textarea><p>no</p></textarea>x", ["x"]),
        ("x<script>never closed <p>no", ["x"]),
        ("<title>never closed<p>a", ["never closed", "a"]),
        ('<p title="a > b" class=x>in</p>', ["in"]),
        ("<p title='it\"s'>in</p><p x=\">out", ["in", "out"]),
        ("1 < 2 <3 &lt;b&gt;", ["1 < 2 <3 <b>"]),
        ("a<p>b</p><a href='cut", ["a", "b"]),
        ("a<!-- b <p>c</p> d", ["a"]),
        ("</div></p>a<![CDATA[x]]><?php ?>b", ["ab"]),
        ("&#233;&eacute;&#x1F600;&notanentity;&#0;", ["éé😀¬anentity;�"]),
    ],
)
def test_parsing(page, want):
    assert runs(page) == want


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 100_000 + "x", "<a " * 100_000, '<a ="' * 100_000, "<p>" * 100_000 + "x", "<title>" * 100_000, "<!--" * 100_000, "<ul>" + "<li>x" * 50_000, "</p>" * 100_000 + "<" * 100_000):
        runs(page)


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = np.array([rng.gauss(0, 2) for _ in range(n)])
        score = lambda labels: sum(-np.logaddexp(0, -o if y else o) for o, y in zip(odds, labels, strict=True))  # noqa: E731, B023
        best = max((y for y in itertools.product([False, True], repeat=n) if all(i == 0 or not y[i] or y[parent[i]] for i in range(n))), key=score)
        assert tuple(main_text.kept(odds, np.array(parent), np.array(depth))) == best


PAGES_BY_HAND = {
    "semantic": (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav><article><h1>Harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><aside><h3>Related</h3><p>{A[:50]}</p></aside><footer>&copy; 2020 The Post</footer></body>", f"Harbour {A} {B} {C}"),
    "names": (f"<div class='site-header'><a href=/>The Post</a></div><div class='cookie-notice'><p>We use cookies to make this site better. Accept them, or read more.</p><button>OK</button></div><div id=content><h1>Harbour</h1><p>{A}</p><div class='ad'>Buy two pairs of shoes and pay for one, today only.</div><p>{B}</p></div><div id=comments><h2>2 comments</h2><div class=comment><b>Jo</b><p>I was there myself and saw nobody from the committee at all.</p></div><div class=comment><b>Al</b><p>Great news, and about time.</p></div></div><div class=footer>Terms | Privacy</div>", f"Harbour {A} {B}"),
    "bare": (f"<p>{A}</p><p>{B}</p>", f"{A} {B}"),
    "text only": (A, A),
    "form and sidebar": (f"<main><h1>Harbour</h1><p>{A}</p><ul><li>first pier</li><li>second pier</li></ul><p>{B}</p></main><form><label>Mail</label><input><p>Sign up for our letter and miss nothing.</p></form><div class=sidebar><h3>Popular</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div>", f"Harbour {A} first pier second pier {B}"),
    "entities": (f"<article><p>Caf&eacute; &amp; bar &lt;b&gt;</p><p>{A}</p></article><footer>x</footer>", f"Café & bar <b> {A}"),
    "no main text": ("<nav><a href=/>Home</a> | <a href=/b>B</a></nav><footer>&copy; 2001 X <a href=/i>Imprint</a></footer>", ""),
}


@pytest.mark.parametrize("name", PAGES_BY_HAND)
def test_pages_by_hand(model, name):
    page, want = PAGES_BY_HAND[name]
    assert main_text.main_texts([page], model, {}) == [want]


def test_unseen_layouts(model):
    exact, right, made, wanted = 0, 0, 0, 0
    for seed in range(400):
        page = layouts.page(5 * 10**9 + seed, [])
        want = " ".join(t.replace(layouts.MARK, "") for t in runs(page) if layouts.MARK in t).split()
        got = main_text.main_texts([page.replace(layouts.MARK, "")], model, {})[0].split()
        both = sum((Counter(got) & Counter(want)).values())
        exact, right, made, wanted = exact + (got == want), right + both, made + len(got), wanted + len(want)
    assert exact >= 320 and right / made > 0.97 and right / wanted > 0.97


def test_extracted_rows(spark, model):
    rows = [(1, "u", PAGES_BY_HAND["names"][0]), (1, "u", PAGES_BY_HAND["names"][0]), (None, None, None), (2, "v", ""), (3, "w", "<article>" + f"<p>{A}</p>" * 20_000 + "</article>")]
    got = main_text.extracted(spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", text string"), model).collect()
    want = [(1, "u", PAGES_BY_HAND["names"][1])] * 2 + [(None, None, ""), (2, "v", ""), (3, "w", " ".join([A] * 20_000))]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted((i or 0, t, len(t)) for i, _, t in want)
    assert main_text.extracted(spark.createDataFrame([], PAGES), model).count() == 0


def test_articles_of_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in main_text.extracted(pages, model).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*)</article>", r.html).group(1))
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert got[r.page_id] == " ".join(t for t in texts if t)


def test_an_empty_table_gives_a_model(spark):
    trees = main_text.fit(spark.createDataFrame([], PAGES))
    assert main_text.main_texts([PAGES_BY_HAND["semantic"][0]], trees, {}) == [PAGES_BY_HAND["semantic"][1]]
