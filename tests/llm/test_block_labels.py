"""The block labeller: parsing against hand-made cases, gradients against differences, labels against pages that declare their text."""

import html as references
import random
import re

import numpy as np
import pytest

from asofkit.llm import block_labels as labels
from tests.conftest import DATA


def texts(page):
    return [t for _, t, _ in labels.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []), ("", []), ("plain &lt;text&gt;", ["plain <text>"]),
        ("<p>a<b>b</b>c<br>d\n\t e&nbsp; f</p>g", ["abc d e f", "g"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><title>no</title ><p>yes", ["yes"]),
        ("<textarea>typed</textarea><!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]),
        ('<p title="a>b" class=x>yes</p><p title=\'', ["yes"]), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]), ("<p>5 < 6 &amp &am", ["5 < 6 & &am"]), ("</p></div><P>UP</P>", ["UP"]),
        ("<script>never closed <p>no", []), ("<p>cut off <b", ["cut off"]), ("<!doctype html><?xml?><p>a</ p>b", ["ab"]),
    ],
)
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths():
    (path, _, linked), = labels.blocks_of('<body><div class="Main-Text x2" id=top><p>go <a href="/x">there</a></p></div>')
    assert path == (("body", ()), ("div", ("main", "text", "x", "top")), ("p", ())) and linked == 5


def test_gradients():
    rng = np.random.default_rng(0)
    net = labels.start(rng)
    pages = [(rng.normal(size=(n, labels.WIDTH)), rng.integers(0, 2, n).astype(float)) for n in (5, 3)]

    def loss():
        total = 0
        for x, y in pages:
            logits = net["bias"]
            for side in "fb":
                turn = slice(None, None, 1 if side == "f" else -1)
                h, _ = labels.recur((x[turn] @ net["w" + side] + net["c" + side])[:, None], net["u" + side], labels._zero(1, float))
                logits = logits + (h[:, 0] @ net["o" + side])[turn]
            p = labels._sigmoid(logits)
            total -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
        return total / 8

    for name, found in labels._gradients(net, pages).items():
        at = np.unravel_index(np.abs(found).argmax(), found.shape)
        value, sides = net[name][at], []
        for step in (1e-5, -1e-5):
            net[name][at] = value + step
            sides.append(loss())
        net[name][at] = value
        assert found[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4)


@pytest.fixture(scope="module")
def net(spark):
    return labels.weights(spark.read.parquet(f"{DATA}/pages.parquet"))


OTHER = """<html><body><div class="site-header"><a href="/">Some Site</a></div><div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div class="cookie-box">We use cookies on this site. Accept them.</div><div class="post-body"><h1>A title of the text</h1><p>The first paragraph, which is long enough to be read, has words.</p>
<div class="advert">Buy now and save.</div><p>The second one goes on &amp; on, with <b>bold</b> parts.</p></div>
<div class="comments"><h3>Replies</h3><div class="comment"><b>Ann</b><p>I read this text and liked all of it, thank you for writing.</p></div></div>
<form><label>Your mail</label><input><button>Send</button></form><div class="footer">&copy; Some Site &middot; all rights.</div></body></html>"""


def test_other_names(net):
    blocks = labels.blocks_of(OTHER)
    (found,) = labels.Labeller(net).label([blocks])
    text = " ".join(t for (_, t, _), p in zip(blocks, found, strict=True) if p >= 0.5)
    assert text == "A title of the text The first paragraph, which is long enough to be read, has words. The second one goes on & on, with bold parts."


def test_held_out(net):
    """Pages made from other seeds than those of training."""
    rng, wrong, total, run = random.Random(123), 0, 0, labels.Labeller(net)
    words = [f"word{k}" for k in range(300)]
    paragraph = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) + "."
    for _ in range(200):
        page = labels.made_page(rng, [("h1", paragraph())] + [("p", paragraph()) for _ in range(rng.randint(1, 12))], [paragraph() for _ in range(5)])
        blocks = labels.blocks_of(page)
        truth = np.array([t[0] == labels.MARK for _, t, _ in blocks])
        (found,) = run.label([[(path, t.lstrip(labels.MARK), n) for path, t, n in blocks]])
        wrong, total = wrong + ((found >= 0.5) != truth).sum(), total + len(truth)
    assert wrong / total < 0.03


def test_pieces_of_long_pages(net):
    run = labels.Labeller(net)
    page = labels.blocks_of(OTHER) * 40
    whole, pieces = run.label([page], chunk=10_000), run.label([page], chunk=7)
    assert np.allclose(whole[0], pieces[0], atol=1e-5)
    some = [page[:k] for k in (0, 1, 3, 50, 2, 0, 9)]
    for together, alone in zip(run.label(some, chunk=60), some, strict=True):
        assert np.allclose(together, run.label([alone])[0] if alone else [], atol=1e-5)


def declared_text(page):
    """The text of the only article of a driver page, by a plain pattern."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    return " ".join(t for t in (" ".join(references.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts) if t)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_driver_pages(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    expected = {r.page_id: (r.url, declared_text(r.html), len(declared_text(r.html))) for r in rows}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in labels.query(spark, folder).collect()} == expected


def test_odd_rows(spark, net):
    long = "<article>" + "<p>A long page has many paragraphs, and all of them are read.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<article><p>Some words stand here, in the text.</p></article>"), (2, "u", "<article><p>Some words stand here, in the text.</p></article>"), (3, "u", long), (4, "u", "<nav><a href='/'>x</a></nav>")]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id int, url string, html string, text string, n_chars int")
    out = sorted((r.page_id or 0, r.url, r.n_chars, r.text[:10]) for r in labels.main_text(frame, net).select("page_id", "n_chars", "text", "url").collect() if r.url)
    one = len("A long page has many paragraphs, and all of them are read.")
    assert out == [(1, "u", 0, ""), (2, "u", 35, "Some words"), (2, "u", 35, "Some words"), (3, "u", (one + 1) * 20_000 - 1, "A long pag"), (4, "u", 0, "")]
    assert labels.main_text(frame.limit(0)).collect() == []
