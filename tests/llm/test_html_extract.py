import time

import numpy as np
from plumbline.llm import html_extract as H
from plumbline.llm import html_pages


def test_held_out_accuracy():
    w = H.default_weights()
    test = html_pages.labelled_pages(80, seed=1234)
    trees = [H.parse(p) for p, _ in test]
    y = np.array([v for t, (_, labels) in zip(trees, test) for v in [1, *labels]])
    p, _ = H.marginals(H.Forest(trees), w)
    assert ((p > 0.5) == y).mean() > 0.97


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    f = H.Forest([H.parse("<html><body><nav><ul><li>a</li></ul></nav><div><p>b c d</p><p>e</p></div></body></html>"), H.parse("<p>x</p>")])
    w = r.normal(size=H.N_WEIGHTS)
    got, joint = H.marginals(f, w)
    n = len(f.parent)
    u, pair = f.features @ w[: H.N_FEATURES], w[H.N_FEATURES :].reshape(-1, 2, 2)
    total, one = 0.0, np.zeros(n)
    for state in range(1 << n):
        x = [(state >> i) & 1 for i in range(n)]
        s = sum(u[i] for i in range(n) if x[i]) + sum(pair[f.tag[i], x[f.parent[i]], x[i]] for i in range(n) if f.parent[i] >= 0)
        e = np.exp(s)
        total += e
        one += e * np.array(x)
    assert np.allclose(got, one / total)
    assert np.allclose(joint[f.parent >= 0][:, :, 1].sum(1), got[f.parent >= 0])


def test_pages(spark):
    page = (
        '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<header class="site-header"><p>The Site</p></header><div class="cookie-notice"><p>We use cookies to make this better for you.</p></div>'
        "<article><h1>A  title</h1><p>Fish &amp; chips,<br>caf&eacute; &#8212; and <b>bo</b>ld\n words that go on for a while.<p>Second <i>one</i> here."
        '<div class="advert">Buy now</div><p>Third.</p></article><aside><h3>More</h3><p>Other story</p></aside>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked it a lot, thanks.</p></div></section>'
        "<form><p>Search</p><input></form><footer>&copy; 2020 Us</footer></body></html>"
    )
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "just some text without any markup at all", "x"), (4, "z", "<p>" * 3000 + "deep", "x"), (5, "q", "<a <b> <p class='x>broken & &amp", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    want = "A title Fish & chips, café — and bold words that go on for a while. Second one here. Third."
    assert by[1]["text"] == want and by[1]["n_chars"] == len(want)
    assert by[2]["text"] == "" and by[None]["text"] == ""
    assert H.extract(df.limit(0)).collect() == []


def test_broken_pages_take_linear_time():
    pages = {
        "open quotes": '<a title="b ' * 80_000, "open scripts": "<script>x " * 100_000, "half ends": "<script>" + "</script " * 100_000, "signs": "<" * 1_000_000,
        "quotes at the end": '<p title="x>y ' * 60_000 + ">", "deep": "<div>" * 60_000 + "</p>" * 60_000, "comments": "<!-- " * 200_000, "svg": "<svg>x" * 150_000,
    }
    took = {}
    for name, page in pages.items():
        for part in (page[: len(page) // 8], page):
            at = time.process_time()
            H.Forest([H.parse(part)])
            took[name, len(part) == len(page)] = time.process_time() - at
    assert all(took[n, True] < 20 * took[n, False] + 1 for n in pages), took


def test_what_is_left_open():
    inner = lambda page: [x for _, x in H.parse(page).segments]
    assert inner("<p>kept</p><script>var leaked = 'code';") == ["kept"]
    assert inner("<p>kept</p><STYLE media=x>.a { color: red }<p>no</p>") == ["kept"]
    assert inner("<p>kept</p><script>a</script ><p>3 < 4 & x <1</p><script src='>'>b</script\n>c") == ["kept", "3 < 4 & x <1", "c"]
    assert inner("<html><head><meta a><title>t</title><body><p>in") == ["in"]
    assert inner("<p title='a>b'>q<!-- x --> r<!--> s<svg>t") == ["q r st"]
    assert inner("a <b never closed") == ["a <b never closed"]
    assert inner('<p title="never closed>text<p>more') == ["text", "more"]
    assert inner("<p>a<!-- to the end <p>b") == ["a"]
