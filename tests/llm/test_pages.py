"""The page labeller on hand-labelled pages of layouts that its training pages don't have, long pages, and edge cases of the table."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

from curatrix.llm import pages

#: Things beside an article, by kind; every text in them is none of the article.
SIDES = {
    "menu": [
        "<nav><ul><li>Home</li></ul></nav>",
        "<nav class='k1'><a href=/a>Start</a></nav>",
        "<div class='menu'><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li><li><a href=3>Contact</a></li></ul></div>",
        "<div id='top-nav'><ol><li><a href=/x>News</a></li><li><a href=/y>Sport</a></li></ol></div>",
    ],
    "header": [
        "<header><h1>My Site</h1></header>",
        "<header class='zq'><div><h2>The Daily Page</h2><p>News for all of us</p></div></header>",
        "<div class='site-header'><h1>The Daily Page</h1><p>News for all</p></div>",
        "<div class='masthead'><h2>Gazette</h2></div>",
    ],
    "footer": [
        "<footer><p>Copyright 2020</p></footer>",
        "<footer class='unten'><ul><li><a href=/i>Imprint</a></li><li>Terms</li></ul></footer>",
        "<div id='footer'><p>All rights are with their owners, and no part may be used without a word from them.</p></div>",
        "<section class='page-footer dark'><div>Printed on the web since 1999.</div></section>",
    ],
    "aside": [
        "<aside><h3>Related</h3><p>Some other story that you may like, told at length in two lines.</p></aside>",
        "<aside class='rechts'><p>See also the second part.</p></aside>",
        "<div class='sidebar'><h3>Popular</h3><p>Another story.</p></div>",
        "<div class='related col-4'><ul><li><a href=1>A tale of two</a></li><li><a href=2>On the road</a></li></ul></div>",
    ],
    "notice": [
        "<div class='cookie-consent'>We use cookies to make this site better for you.</div>",
        "<dialog><p>Please agree to our terms.</p></dialog>",
        "<div id='gdpr' role='dialog'><p>Your privacy matters. Please agree.</p><button>Agree</button></div>",
        "<div class='notice'><p>This site will be down on Sunday from two to four in the morning.</p></div>",
    ],
    "comments": [
        "<section id=comments><h2>Comments</h2><p>I think that this was a very good article, thanks.</p></section>",
        "<ol class='comment-list'><li>Nice post!</li><li>I do not agree with any of this, sorry to say.</li></ol>",
        "<div id='disqus'><div><p>First!</p></div><div><p>What an odd thing to say about the matter, if you ask me.</p></div></div>",
        "<div class='replies'><p>So true.</p></div>",
    ],
    "form": [
        "<form><label>Email</label><p>Sign up for our letter</p></form>",
        "<form class='x'><fieldset><label>Name</label></fieldset></form>",
        "<div class='newsletter'><p>Get the best of it by mail each week.</p></div>",
        "<div class='login'><h3>Members</h3><p>Enter your name</p></div>",
    ],
    "advert": [
        "<div class='ad'>Buy this now.</div>",
        "<div class='banner advert'><p>Cheap shoes for the whole family, this week only.</p></div>",
        "<section class='sponsored'><h4>Sponsor</h4><p>Drink more tea.</p></section>",
        "<div id='promo'>Half the price until Friday</div>",
    ],
    "unknown name": [
        "<div class='werbung'>Jetzt kaufen</div>",
        "<div id='kommentare'><p>Sehr gut!</p></div>",
        "<div class='k1'><ul><li>Eins</li><li>Zwei</li></ul></div>",
        "<section class='bot'><p>Impressum</p></section>",
    ],
}
INNER = "<h1>A title</h1><p>The first paragraph says what the matter is about, at some length.</p><p>The second one goes on.</p><ul><li>a point</li><li>Another point that needs more words.</li></ul><p>The third one ends it here.</p>"
MAINS = [f"<article>{INNER}</article>", f"<main>{INNER}</main>", "<div class='wrap9'><article class='qq'>" + INNER.replace("<h1>A title</h1>", "<header><h1>A title</h1></header>") + "</article></div>", f"<main id='m'><div class='grid'><article>{INNER}</article></div></main>", f"<div class='content'>{INNER}</div>", f"<div class='post-body x7'>{INNER}</div>"]
ARTICLE = [t for _, t, _ in pages.blocks(INNER)]


def labelled():
    """(kind, blocks, which are the article's) of each side before and after each article, and of pages with four sides at once."""
    out = []
    for kind, sides in SIDES.items():
        for main in MAINS[:4] if kind == "unknown name" else MAINS:
            for side in sides:
                out += [(kind, side + main), (kind, main + side)]
    draw = random.Random(4)
    known = [s for k in SIDES if k != "unknown name" for s in SIDES[k]]
    for _ in range(60):
        a, b, c, d = draw.sample(known, 4)
        out.append(("many", a + b + draw.choice(MAINS) + c + d))
    return [(kind, pages.blocks(f"<html><body>{html}</body></html>")) for kind, html in out]


@pytest.fixture(scope="module", params=[0, 1])
def model(request):
    """Trained on the given pages alone, in two orders."""
    htmls = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    random.Random(request.param).shuffle(htmls)
    return pages.train(htmls[: pages.TRAIN_PAGES])


def shares(model):
    """The share of blocks labelled rightly, by kind."""
    right, every = {}, {}
    for kind, blocks in labelled():
        p = model.predict([blocks])[0]
        for (_, text, _), v in zip(blocks, p):
            k = "article" if text in ARTICLE else kind
            right[k], every[k] = right.get(k, 0) + ((v > 0.5) == (text in ARTICLE)), every.get(k, 0) + 1
    return {k: right[k] / every[k] for k in every}


def test_layouts_that_training_does_not_have(model):
    found = {k: v for k, v in shares(model).items() if k != "unknown name"}
    assert len(found) == 10 and min(found.values()) >= 0.98, found


@pytest.mark.xfail(reason="short prose in a box of a meaningless name beside an article is taken for the article: 0.78 to 0.85")
def test_boxes_of_unknown_names(model):
    assert shares(model)["unknown name"] >= 0.98


def test_landmarks_inside_an_article(model):
    for side in ["<nav><ul><li>Home</li></ul></nav>", "<footer><p>Copyright 2020</p></footer>", "<aside><p>See also the second part.</p></aside>", "<form><label>Email</label></form>"]:
        blocks = pages.blocks(f"<html><body><article>{INNER.replace('<p>The second', side + '<p>The second')}</article></body></html>")
        assert [t for (_, t, _), v in zip(blocks, model.predict([blocks])[0]) if v > 0.5] == ARTICLE


def test_long_page_takes_no_more_memory():
    """Pieces give what the whole gives, and one long page doesn't widen the others."""
    model = pages.Labeller()
    long = pages.blocks("".join(f"<p>a {k % 97}</p><div class=c{k % 5}>b</div>" for k in range(30_000)))
    short = [long[k : k + 1 + k % 3] for k in range(127)]
    tracemalloc.start()
    got = model.predict([long, [], *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) == len(long) == 60_000 and len(got[1]) == 0 and peak < 100 << 20
    x, mask = pages.padded(model.features([long[:20_000]]))
    assert np.allclose(model.forward(x, mask)[0][:, 0], model.predict([long[:20_000]])[0], atol=1e-5)
    for page, p in zip(short, got[2:]):
        x, mask = pages.padded(model.features([page]))
        assert np.allclose(model.forward(x, mask)[0][:, 0], p, atol=1e-5)


def test_empty_table_and_clashing_columns(spark):
    """No pages give no rows; columns of the same names as the result's, and others, are left out."""
    schema = "page_id long, url string, html string, text string, n_chars long, h long, _h long"
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", f"<html><body><nav><li>Home</li></nav><article>{INNER}</article></body></html>", "old", 5, 1, 1), (2, None, None, "old", 5, 1, 1), (None, "u", "", "old", 5, 1, 1)]
    got = pages.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = "\n\n".join(ARTICLE)
    assert {tuple(r) for r in got.collect()} == {(1, "u", text, len(text)), (2, None, "", 0), (None, "u", "", 0)}
