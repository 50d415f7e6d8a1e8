import numpy as np
import pytest

from arbora.llm import html_text as H

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a></li><li>More</ul></nav><div class="cookie-notice">We use cookies</div>'
        '<!-- <p>gone</p> --><article><h1>Title &amp; more</h1><p><b>First  line.<br><p>Second\n line &eacute;&#33;'
        '<div class="ad">Buy</div><p>Third <a href=x>link</a> end.</article>'
        '<section id="comments"><div class="comment"><p>Nice post</p></div></section><form><label>Mail</label></form>'
        "<footer>&copy; us</footer>")
WANT = "Title & more\nFirst line.\nSecond line é!\nThird link end."


def by_layout(page):
    return "\n".join(b.text for b in H.leaf_blocks(page) if H.teacher(b.path))


@pytest.fixture(scope="module")
def model(spark):
    return H.fit_block_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_blocks():
    assert by_layout(PAGE) == WANT
    texts = [b.text for b in H.leaf_blocks(PAGE)]
    assert "T" not in texts and "gone" not in texts and not any("article" in t for t in texts)
    assert H.leaf_blocks("") == [] and [b.text for b in H.leaf_blocks("a < b <p>c")] == ["a < b", "c"]
    assert [b.text for b in H.leaf_blocks("<p>x<a href='>'>y</a>z<br/>w</p><p")] == ["xyz w"]


def test_pages(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<article><p>" + "long text " * 30_000 + "</article>"),
            (5, "x", "<div>" * 3000 + "deep"), (6, "y", "<" * 5000 + "a='" * 2000), (None, None, PAGE), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = H.extract_text(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in (1, None):
            assert r.text == WANT
        if r.page_id in (2, 3):
            assert r.text == ""
        if r.page_id == 4:
            assert r.text == ("long text " * 30_000).strip()
        assert r.n_chars == len(r.text)


def test_accuracy_on_given_and_composed_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_text(pages, model).collect()}
    wrong = sum(got[r.page_id] != by_layout(r.html) for r in pages.collect())
    assert wrong == 0
    rng = np.random.default_rng(77)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 999, 12)) for _ in range(300)]
    blocks = [H.leaf_blocks(H.compose(rng, texts)) for _ in range(150)]
    right = total = 0
    for b, keep in zip(blocks, H.label_pages(blocks, model, {})):
        right += sum(int(k) == H.teacher(x.path) for k, x in zip(keep, b))
        total += len(b)
    assert right >= 0.97 * total


def test_gradients():
    rng = np.random.default_rng(0)
    h, f = 2, 3
    x, live = rng.normal(0, 1, (5, 4, f)).astype(np.float32), np.ones((5, 4), bool)
    live[3:, 1] = False
    p = {"fW": rng.normal(0, 0.5, (f, 4 * h)), "fU": rng.normal(0, 0.5, (h, 4 * h)), "fb": rng.normal(0, 0.5, 4 * h)}
    d_out = rng.normal(0, 1, (5, 4, h))
    grads, cache = {k: np.zeros_like(v) for k, v in p.items()}, []
    H._lstm(x, live, p, "f", cache)
    H._lstm_back(x, p, "f", cache, d_out, grads)
    for name, g in grads.items():
        for i in np.argsort(-np.abs(g), axis=None)[:5]:
            at = np.unravel_index(i, g.shape)
            old, ends = p[name][at], []
            for step in (1e-3, -1e-3):
                p[name][at] = old + step
                ends.append(float((H._lstm(x, live, p, "f") * d_out).sum()))
            p[name][at] = old
            assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[at], rel=0.03, abs=5e-3)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.fit_block_labeller(pages) is None
    assert H.extract_text(pages, None).count() == 0
