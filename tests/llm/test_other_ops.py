"""Pages, vectors and conversations."""

import numpy as np
import pytest

from lookalike.llm import ann, html_text, quoting

LONG = "Words of the article that go on for a while and then some more. " * 6


def page(body: str) -> str:
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>{body}</body></html>'


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        (page(""), ""),
        (page("<nav><ul><li><a>Home</a></li></ul></nav>"), ""),
        (page(f"<nav><a>Home</a></nav><div class='ad'>{LONG}</div><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>"), f"Head {LONG}Short."),
        (page(f"<header><h2>Site</h2></header><div id='content'><p>{LONG}<p>One &eacute;\n  two&nbsp;three<br>four</div><div class='comments'><p>{LONG}</p></div><form><input>Send</form>"), f"{LONG}One é two three four"),
        (page(f"<article><header><h1>Own</h1></header><p><b>{LONG}<br><p>more<aside>{LONG}</aside></article><aside><p>{LONG}</p></aside>"), f"Own {LONG}more"),
        ("<p>a<b>b</b>c<br/>d<!-- e --><p>&lt;f&gt;", "abc d <f>"),
        (page(f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p><ul><li>one<li>two</ul></main>"), f"{LONG}one two"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("name", ["has-sidebar", "content no-sidebar", "single share-price", "post tag-politics", "header-image-story", "adventure"])
def test_names_that_only_mention_other_parts(name):
    assert html_text.main_text(page(f"<div class='{name}'><p>{LONG}</p></div>")) == LONG.strip()
    assert html_text.main_text(page(f"<div id='x' class='{name}'><article><p>{LONG}</p></article></div>")) == LONG.strip()


@pytest.mark.parametrize("name", ["ad", "ad-300x250", "left-sidebar", "site_footer", "comment-list", "comments", "article-comments", "cookie-notice", "Related", "wide share-buttons"])
def test_names_of_other_parts(name):
    assert html_text.main_text(page(f"<div class='{name}'><p>{LONG}</p></div><div class='story'><p>{LONG}</p></div>")) == LONG.strip()


def test_clustering_chooses_regions(monkeypatch):
    links = "<ul>" + "".join(f"<li><a href='{i}'>see {i}</a>" for i in range(30)) + "</ul>"
    html = page(f"<div class='x1'>{links}</div><div class='x2'><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div class='x3'>{links}</div>")
    assert html_text.main_text(html) == f"{LONG}{LONG}Short."
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert "see 1" in html_text.main_text(html)


def test_a_short_article_beside_a_long_one():
    html = page(f"<article><p>{LONG * 5}</p></article><article><p>{LONG}</p></article>")
    assert html_text.main_text(html) == (LONG * 6).strip()


def test_broken_markup():
    import time

    start = time.time()
    for broken in ("<![foo[x]]>", "<![", "<!x", "<?", "</", "<![if x]>", "<![cdata[z]]>"):
        assert "Words of the article" in html_text.main_text(f"<p>{LONG}</p>{broken}<p>{LONG}</p>")
    assert html_text.main_text("<b>" * 100_000 + "x" + "</i>" * 100_000 + LONG) == ("x" + LONG).strip()
    assert html_text.main_text("<p>" * 100_000 + LONG) == LONG.strip()
    assert time.time() - start < 30


def test_smoothing():
    flat = np.full(20, 5.0)
    assert np.allclose(html_text.smoothed(flat), flat) and html_text.threshold(flat) < 5
    values = np.array([1, 2, 1, 80, 90, 100.0])
    assert 2 < html_text.threshold(values) < 80


def test_extract(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (2, None, None, "y"), (None, "u", "<p>" * 500 + "deep", "z"), (1, "u", page(f"<article><p>{LONG}</p></article>"), "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "deep"), (1, LONG.strip()), (1, LONG.strip()), (2, "")]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out, done = {}, set()
    for i, v in ok:
        if i % every == 0 and i not in done:
            done.add(i)
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)
            out[i] = d[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[200:300] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2010, [0.0] * 16, 0), (2020, [1.0] * 15 + [None], 0), (2030, [float("nan")] * 16, 0), (2040, [1.0] * 3, 0), (None, [1.0] * 16, 0), (2050, [float("inf")] + [0.0] * 15, 0)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "rank"), 10, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(rows, 10, 10)
    assert set(got) == set(want)
    hits = sum(len({v for _, _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / (10 * len(want)) > 0.97
    assert [v for _, _, v in sorted(got[100])] == [v for _, v in want[100]] == list(range(200, 210))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
        for _, s, v in found:
            assert s == pytest.approx(float(np.sqrt(((x[q].astype(np.float64) - x[v]) ** 2).sum())), abs=1e-12)


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1)], VECTORS)
    assert [tuple(r)[:3] for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    for rows in ([], [(0, None, 1)], [(0, [0.0], 1)], [(0, [1.0], 1)]):
        assert ann.nearest(spark.createDataFrame(rows, VECTORS)).count() == 0


MESSAGES = "conv_id long, turn long, role string, text string"


def test_quoting(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you?"),
        (1, 1, "a", "On Monday X wrote:\n> How are you?\nI am fine.\nAnd you?"),
        (1, 2, "u", "> > How are you?\n>  I am  FINE.\nGood"),
        (1, 3, "a", "unrelated"),
        (1, 4, "u", "> unrelated\nok"),
        (1, 5, "a", "> Hello there\nlate"),
        (1, 6, "a", "> good\nvery late"),
        (1, 7, "a", ">> How are you?\nonly nested"),
        (2, 0, "u", None),
        (2, 1, "a", "> nowhere\nx > y"),
        (2, 2, "a", ">\n> \nempty quote"),
        (None, None, "u", "> a"),
        (None, 3, "u", "a"),
        (3, 0, "u", "> I quote the future"),
        (3, 1, "u", "I quote the future"),
        (3, 1, "u", "I quote the future"),
    ]
    got = quoting.unquoted(spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS h", "2 AS path", "3 AS level")).collect()
    assert len(got) == len(rows)
    at = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["path"], r["n_quoted"], r["text"]) for r in got}
    assert at[1, 1] == (0, [0, 1], 1, "I am fine.\nAnd you?")
    assert at[1, 2] == (1, [0, 1, 2], 2, "Good")
    assert at[1, 4] == (3, [3, 4], 1, "ok") and at[1, 5] == (0, [0, 5], 1, "late")
    assert at[1, 6] == (2, [0, 1, 2, 6], 1, "very late") and at[1, 7] == (0, [0, 7], 1, "only nested")
    assert at[2, 0] == (None, [0], 0, "") and at[2, 1] == (None, [1], 1, "x > y") and at[2, 2][3] == "empty quote"
    assert at[None, None][:2] == (None, [None]) and at[3, 0] == (None, [0], 1, "")
    order = [r["turn"] for r in quoting.reply_order(spark.createDataFrame(rows, MESSAGES)).where("conv_id = 1").orderBy("path").collect()]
    assert order == [0, 1, 2, 6, 5, 7, 3, 4]


def test_long_threads(spark):
    rows = [(9, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(21)]
    got = {r["turn"]: r["path"] for r in quoting.unquoted(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert all(got[i] == list(range(i + 1)) for i in range(21))


def test_no_messages(spark):
    assert quoting.unquoted(spark.createDataFrame([], MESSAGES)).count() == 0
