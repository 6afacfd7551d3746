import html
import itertools
import re
import time

import numpy as np
import pytest

from pixelloom.llm.common import table
from pixelloom.llm.html_blocks import Block, attribute_words, leaf_blocks
from pixelloom.llm.main_text import Chain, extract, labelled_pages, main_blocks, path_features, text_features, train


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b<br>c</p>", ["a", "b c"]),
        ("<p>a &amp; b&#233;\n\t c</p>", ["a & bé c"]),
        ("<script>var t='</p>';</script><style>x</style><p>a<b>b</b>", ["ab"]),
        ("<SCRIPT>x", []),
        ("<head><title>t</title></head><body>x", ["x"]),
        ("<head><title>t</title><body>x", ["x"]),
        ("<a title=\"x>y\">k</a><!-- <p>no --><div>z", ["k", "z"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("a < b <p", ["a < b <p"]),
        ("<p title='open>x</p>", ["x"]),
        ("İ" * 50 + "<script>no</script><p>é", ["İ" * 50, "é"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in leaf_blocks(page)] == texts


@pytest.mark.parametrize("tag", "math svg object canvas audio video noscript".split())
def test_text_in_embedded_elements(tag):
    assert [b.text for b in leaf_blocks(f"<p>a <{tag} id=k><title>no</title><b>x=1</b></{tag}> b</p><p>c")] == ["a x=1 b", "c"]
    assert [b.text for b in leaf_blocks(f"<{tag} id=k><p>a</p><p>b")] == ["a", "b"]
    page = f"<body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1><p>First, a sentence <{tag}>of it.</p><p>Second one, of some more words.</p></article><footer>&copy; us</footer></body>"
    assert main_blocks(page, train()) == ["Title of it", "First, a sentence of it.", "Second one, of some more words."]


def test_attribute_words():
    assert attribute_words(' class="mainContent ad-box" id=top style="display: none"') == ["main", "content", "ad", "box", "top", "hidden"]


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(1)
    chain = Chain(["a", "b", "c"])
    chain.w, chain.step, chain.start = rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    rows = [["a"], ["b", "c"], ["c"], [], ["a", "b"]]

    def score(labels):
        e = chain.emissions(rows)
        return chain.start[labels[0]] + sum(e[i, k] for i, k in enumerate(labels)) + sum(chain.step[i, j] for i, j in zip(labels, labels[1:]))

    paths = list(itertools.product([0, 1], repeat=5))
    assert chain.decode(rows) == list(max(paths, key=score))
    gold = (1, 0, 0, 1, 1)

    def loss():
        return np.log(sum(np.exp(score(p)) for p in paths)) - score(gold)

    x = np.zeros((1, 7, 3))
    for k, row in enumerate(rows):
        x[0, k, [chain.index[f] for f in row]] = 1
    y = np.zeros((1, 7), int)
    y[0, :5] = gold
    grads = chain._gradient(x, y, np.arange(7)[None] < 5)
    for p, g in zip((chain.w, chain.step, chain.start), grads):
        for at in np.ndindex(p.shape):
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_unseen_layouts():
    chain = train()
    wrong = total = 0
    for rows, labels in labelled_pages(200, 4242):
        wrong += sum(a != b for a, b in zip(chain.decode(rows), labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_whole_pages_of_a_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in extract(pages, train()).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = (re.sub(r"[ \t\n\r\f\v]+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?p>|</?h1>", inner))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_edges(spark):
    big = "<article>" + "<p>Some words of an article here.</p>" * 5000 + "</article><footer>&copy; x</footer>"
    rows = [(1, "u", None, "a"), (2, None, "", "a"), (None, "u", big, None), (3, "u", big, "b"), (3, "u", big, "b"), (4, "u", "<nav><a href=x>Home</a></nav>", "b")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), train()).collect()
    words = len("Some words of an article here.")
    assert sorted(r["n_chars"] for r in got) == [0] * 3 + [5000 * (words + 1) - 1] * 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].count("\n") == 4999 for r in got) == 3 and sum(r["text"] == "" for r in got) == 3
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), train()).count() == 0


def test_parts_that_are_not_the_article():
    page = (
        '<body><header class="site-header"><p>Brand name and motto here.</p></header><div id="cookie-notice">We use cookies to make this work.</div><article><h1>Title of it</h1><p>First, a sentence.</p>'
        '<div class="ad">Buy this now please.</div><p>Second one.</p><aside class="related"><h3>Related</h3><p>Another story to read.</p></aside><form><label>Mail</label><button>Go</button></form></article>'
        '<section id="comments"><h3>Comments</h3><div class="comment"><p>I like it a lot, thanks.</p></div></section><footer>&copy; us</footer></body>'
    )
    assert main_blocks(page, train()) == ["Title of it", "First, a sentence.", "Second one."]


def test_whole_texts_and_paths_count():
    filler = "Plain filler words of a long enough run of text here, and then some. " * 9
    assert {"says=all rights reserved", "says=©"} <= set(text_features(Block(filler + "© us. All Rights Reserved.", (), 0.0)))
    article = "<article><h1>Title of it</h1><p>First, a sentence.</p><p>Second one, of some more words than that.</p></article>"
    main = ["Title of it", "First, a sentence.", "Second one, of some more words than that."]
    notice = f"<div>{filler}We use cookies. Sponsored. Subscribe to our newsletter. Share this. &copy; us</div>"
    assert main_blocks(f"<body>{article}{notice}</body>", train()) == main
    inside, out = "<div>" * 14, "</div>" * 14
    assert main_blocks(f"<body><nav>{inside}<p>Home of things and more of it</p>{out}</nav>{article}</body>", train()) == main
    for head, end in (("<footer>", "</footer>"), ("<aside>", "</aside>"), ("<section id=comments>", "</section>")):
        assert main_blocks(f"<body>{article}{head}{inside}<p>{filler[:69]}</p>{out}{end}</body>", train()) == main


HOSTILE = {
    "open": "<div>x ", "tag": "<a ", "quote": "<a x=' ", "quoted end": "<a '>", "close": "<div></p></td>", "item": "<div><dd>x", "head": "<head>", "remark": "<!--", "bang": "<!", "raw": "<script>",
    "nest": "<tr><td><table><div>x", "less": "<", "slash": "</", "hint": "<div class=nav>x ", "word": "<p>x",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_is_linear_in_hostile_pages(name):
    """Eight times the page takes no more than about eight times as long, however tags are nested or broken."""
    chain, part = train(), HOSTILE[name]

    def took(n):
        page = part * (n // len(part)) + "'" * (name == "quoted end")
        began = time.process_time()
        main_blocks(page, chain)
        return time.process_time() - began

    took(20_000)
    assert took(240_000) < 16 * max(took(30_000), 0.02)


def test_paths_are_shared():
    blocks = leaf_blocks("<nav>" + "<div>x " * 2000)
    assert len(blocks) == 2000 and blocks[-1].path.parent is blocks[-2].path
    path_features(blocks[-1].path)
    assert blocks[-1].path.features.inside is blocks[5].path.features.inside
    assert path_features(()) == ("near=-", "tag=-")
