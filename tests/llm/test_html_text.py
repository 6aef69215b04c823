from __future__ import annotations

import html
import itertools
import math
import re
import time

import pytest

from medallion.llm import html_text as h
from medallion.llm.common import table
from medallion.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model(llm):
    return h.fit(llm)


def test_held_out_accuracy(model):
    right = total = 0
    for page in labelled_pages(300, seed=7):
        nodes, blocks = h.parse(page, labelled=True)
        content = model.marginals(nodes, h.features(nodes, blocks))
        for node, _ in blocks:
            total += 1
            right += (content[node] >= 0.5) == bool(nodes[node].label)
    assert total > 4000 and right / total > 0.98


def test_messages_give_the_marginals_of_all_states(model, monkeypatch):
    monkeypatch.setattr(h, "SIBLINGS", 1e9)
    page = "<div class=x><nav><a href=a>b c</a></nav><p>Some text, and more.</p><section><p>Words here</p></section></div>"
    nodes, blocks = h.parse(page, labelled=True)
    own = h.features(nodes, blocks)
    weights = [0.0] * len(nodes)
    total = 0.0
    for states in itertools.product((0, 1), repeat=len(nodes)):
        log = -30.0 if states[0] == 0 else 0.0
        for i, s in enumerate(states):
            log += sum(model.own.get(f, (0.0, 0.0))[s] for f in model.known(own[i]))
            if i:
                log += model.edge.get(h._edge(nodes[i]), model.any_edge)[states[nodes[i].parent]][s]
        p = math.exp(log)
        total += p
        weights = [w + p * s for w, s in zip(weights, states, strict=True)]
    assert model.marginals(nodes, own) == pytest.approx([w / total for w in weights], abs=1e-9)


PAGES = {
    "": "", "just text": "just text",
    "<article><h1>Title</h1><p>One &lt;b&gt; &amp;amp;\n two<br>three</p><p>Four <b>bold</b>word, five.</article>": "Title\nOne <b> &amp; two three\nFour boldword, five.",
    "<script>var a='<p>x</p>';</script><style>p{}</style><!-- <p>no</p> --><main><p>Only this, really.</p></main>": "Only this, really.",
    "<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><article><p>The story, told.</p><ul><li>one thing<li>another thing</ul></article>"
    "<section class='reader-comments'><p>Great post, thanks!</p><p>I agree, well said.</p></section><footer>&copy; me</footer>":
        "The story, told.\none thing\nanother thing",
    "<div class=cookie-notice><p>We use cookies, accept.</p></div><div id=content><p>Text of the page, long enough.</p></div>"
    "<form><p>Subscribe now</p><input><button>Go</button></form><aside><p>See also this, and that.</p></aside>": "Text of the page, long enough.",
    "<p>unclosed <script>never ends": "unclosed", "<div><p>a</div></p></p></section> tail of the page, kept.": None, "<" * 500: "<" * 500,
    "<article>" + "<div>" * 3000 + "<p>Deep text, still here.</p>": "Deep text, still here.",
}


def test_pages(model):
    for page, text in PAGES.items():
        got = model.main_text(page)
        assert text is None or got == text, page[:80]


HEADS = {
    "<html><head><title>x</title><body><article><h1>Title</h1><p>The story, told.</p></article>": "Title\nThe story, told.",
    "<html><head><meta charset=utf-8><title>x</title><article><p>The story, told.</p></article>": "The story, told.",
    "<head><script>for (i=0; i<n; i++) // don't</script><title>x</title></head><body><article><p>It's the story, told.</p></article>": "It's the story, told.",
    "<body><script>if (i<n) // don't</script><article><p>It's the story, told.</p></article>": "It's the story, told.",
    "<article><button><script>i<n; // don't</script>Go</button><p>It's the story, told.</p></article>": "It's the story, told.",
    "<article><svg><style/><title>x</svg><p>The story, told.</p><svg><title>y</title></svg></article>": "The story, told.",
}
LINES = {
    "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, here.</p></article>": "So x=2 holds, here.",
    "<article><p>See <object data=a><param name=b>the drawing</object>, please.</p></article>": "See the drawing, please.",
    "<article><p>See <noscript>the picture</noscript>, please.</p></article>": "See the picture, please.",
    "<article><p>One, two.</p><object><p>The drawing, told.</p></object><p>Three, four.</p></article>": "One, two.\nThe drawing, told.\nThree, four.",
    "<article><p>One, two.</p><noscript><p>The picture, told.</p></noscript><p>Three, four.</p></article>": "One, two.\nThe picture, told.\nThree, four.",
}


def test_heads_without_end_and_scripts(model):
    for page, text in HEADS.items():
        assert model.main_text(page) == text, page


def test_text_of_formulas_and_stand_ins(model):
    for page, text in LINES.items():
        assert model.main_text(page) == text, page


def test_given_pages(llm, sf, model):
    for r in h.main_texts(table(llm, sf, "pages"), ["html"], model).collect():
        article = re.search(r"<article>(.*)</article>", r["c0"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_odd_rows(llm, model):
    pages = llm.createDataFrame([(None, "x", "<p>Text, here it is.</p>", 1), (1, None, None, 2), (1, None, None, 2), (2, "", "", 3)], "page_id long, url string, html string, c0 int")
    assert sorted(r["text"] for r in h.main_texts(pages, pages.columns, model).collect()) == ["", "", "", "Text, here it is."]
    assert h.main_texts(pages.limit(0), ["page_id"], model).count() == 0


def test_training_labels_mean_nothing_on_real_pages():
    for value in ("12.5", "", "10px", "0", "x"):
        page = f'<body><div class="article" data-y="{value}"><p>Some words, and more.</p></div></body>'
        nodes, blocks = h.parse(page)
        assert [n.label for n in nodes] == [1, 1, 1] and blocks == [(2, "Some words, and more.")]


def test_broken_pages_take_time_in_proportion_to_their_length():
    n = 100_000
    pages = {
        "quote": "<a " * 300_000 + '"', "quotes": '<a "x" ' * 100_000 + "'", "tags": "<p" * 300_000, "open": "<div>" * n + "</p></x></b>" * n,
        "items": "<li><ul>" + "<div>" * n + "<li></li>" * n, "headers": "<div>" * n + "<header></header>" * n, "less": "<" * 1_000_000,
        "objects": "<div>" * n + "</object>" * n, "comments": "<!-" * 300_000, "scripts": "<script>" * n, "ends": "</script" * n,
    }
    for name, page in pages.items():
        began = time.process_time()
        h.parse(page)
        assert time.process_time() - began < 5, name  # a second or so; hours if each tag read all that follows


def test_unclosed_quotes_are_text():
    assert h.parse('<p>one <a href="x>two</p>')[1] == [(1, 'one <a href="x>two')]
    assert h.parse("<p>it's <b title='a>b'>bold</b> \"so\"</p>")[1] == [(1, "it's bold \"so\"")]
    assert h.parse("<p>one<div")[1] == [(1, "one")]
