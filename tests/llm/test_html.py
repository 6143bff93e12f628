import random

import pytest

from tallyloom.llm import html_extraction as hx
from tallyloom.llm.html_extraction import extract_main_text, main_text

LONG = "Plain words of an article, with commas, that go on for a while and then stop at last."
PAGE = f"""<!doctype html><html><head><title>no</title><style>p{{x:1}}</style><script>var a = "</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice"><p>{LONG} cookies</p></div>
<div id="wrap"><aside><p>{LONG} aside</p></aside><div class="content"><h1>Head &amp; line</h1><p>{LONG}<p>Second <b>bold  and
 <i>more</i></b>&nbsp;x<br>y &lt;tag&gt; &#233;&#x20AC;</p><div class="ad">{LONG} buy</div><ul><li>one<li>two</ul><form><p>{LONG} form</p></form>
<!-- <p>hidden</p> --><blockquote>Short.</blockquote></div><div class="comments"><p>{LONG} reader</p></div></div><footer>{LONG} foot</footer></body></html>"""


def test_the_article_is_kept_and_all_else_goes():
    assert main_text(PAGE) == "\n\n".join(["Head & line", LONG, "Second bold and more x y <tag> é€", "one", "two", "Short."])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("a < b and <b>c</b>", "a < b and c"), ("<p>", ""), ("<", "<"),
        ("<p>one<p>two", "one\n\ntwo"), ("<div><p>x</div></p></span>y", "x"), ("<script>p</script>", ""), ("<p>a &amp;amp; b", "a &amp; b"),
        (f"<article><section><p>{LONG}</p></section><section><p>tiny</p></section></article><p>{LONG} out", f"{LONG}\n\ntiny"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


FOUR = [f"{LONG} {word}" for word in ("One", "Two", "Three", "Four")]
BODY = "".join(f"<p>{p}</p>" for p in FOUR)
SIDE = f'<div class="sidebar"><p>{LONG} side</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="x"><div class="layout has-sidebar"><div>{BODY}</div>{SIDE}</div></body>',
        f'<div class="post no-comments">{BODY}</div>{SIDE}',
        f'<div class="post tags-news">{BODY}</div>{SIDE}',
        f'<div id="sidebar-left-layout"><div class="text">{BODY}</div>{SIDE}</div>',
        f"<body><form action='/'><div><div>{BODY}</div>{SIDE}</div></form></body>",
        f'<div role="dialog"><div>{BODY}</div></div>',
        f'<div class="single comments-open">{BODY}<div class="comments"><p>{LONG}</p></div></div>',
        f'<div class="page with-header">{BODY}</div>',
        # Readers wrote more than the author.
        f'<div class="post">{BODY}</div><div id="comments">{"".join(f"<p>{LONG} {n}</p>" for n in range(40))}</div>',
        f'<div class="promo-story"><div>{BODY}</div><div class="comment-list">{"".join(f"<p>{LONG} {n}</p>" for n in range(40))}</div></div>',
        f'<div>{BODY}<form class="newsletter"><p>{LONG}</p></form></div>',
        f'<div>{BODY}<div class="promo"><p>{LONG}</p></div></div>',
    ],
)
def test_words_of_wrappers_do_not_cut_the_article(page):
    assert main_text(page) == "\n\n".join(FOUR)


def test_points_against_a_plain_scorer():
    """Every container adds up all paragraphs up to four levels below it, pair by pair."""
    rng = random.Random(7)
    for _ in range(60):
        page, depth = "", 0
        for _ in range(rng.randint(1, 40)):
            kind = rng.random()
            if kind < 0.35:
                page, depth = page + "<div>", depth + 1
            elif kind < 0.6 and depth:
                page, depth = page + "</div>", depth - 1
            else:
                page += f"<p>{'word, ' * rng.randint(0, 70)}x <a>{'link ' * rng.randint(0, 9)}</a></p>"
        order = hx._measure(hx.parse(page))
        hx._score(order)
        got = [n.points for n in order]
        share = {1: 1, 2: 1 / 2, 3: 1 / 6, 4: 1 / 9}

        def levels(low, top):
            n = 0
            while low is not None and low is not top:
                low, n = low.parent, n + 1
            return n if low is top else 0

        long = [p for p in order if p.tag == "p" and p.text >= 25] or [p for p in order if p.tag == "p" and p.text]
        if not long:
            continue
        for node, points in zip(order, got):
            plain = sum((1 + p.commas + min(p.text / 100, 3)) * (1 - p.linked / p.text) * share.get(levels(p, node), 0) for p in long)
            assert points == pytest.approx(plain)


def test_deep_and_long_pages():
    deep = "<div>" * 5_000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    many = "<body><article>" + "".join(f"<p>{LONG} {n}</p>" for n in range(3_000)) + "</article></body>"
    assert main_text(many).count("\n\n") == 2_999


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x"), (2, "v", "<p>ü", "z")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got.collect()) == sorted([("1", len(main_text(PAGE)))] * 2 + [("None", 0), ("2", 1)])
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
