import itertools
import random

import pytest

from newsloom.llm import html_blocks, html_text

ARTICLE = "<article><h1>A title &amp; more</h1><p>First   <b>bold</b>\n text.<br>Next</p><ul><li>item</li></ul><p>Ti.</article>"
PAGES = {
    "tags": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>{ARTICLE}<aside>See also this other long text, really.</aside><footer>&copy; us</footer></body></html>",
    "classes": f"<body><div id='cookie-notice'>We use cookies.</div><div class='topMenu'>One two</div>{ARTICLE}<div class='ad'>Buy this now. It is good.</div><section class='user-comments'><p>I like it. A lot. Very much so, indeed.</p></section><form><input><label>Mail</label></form></body>",
    "inside": ARTICLE.replace("</ul>", "</ul><div class='advert'>Buy, buy, buy.</div><script>x='</p>'</script><aside>Side.</aside>"),
}
TEXT = "A title & more\nFirst bold text. Next\nitem\nTi."


@pytest.mark.parametrize("name", PAGES)
def test_article_without_boilerplate(name):
    assert html_text.main_text(PAGES[name]) == TEXT


PARAGRAPHS = [f"Paragraph {k} of an ordinary article, with commas and so on. It has sentences, too." for k in "abcde"]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
SIDE = "<aside class='widget'><p>Most read. See what others like, today.</p></aside><div class='ad'>Buy it. Now.</div>"
REMARKS = "<section class='comments-area'><ol><li><article class='comment-body'><p>I like it. A lot. Very much so, indeed.</p></article></li></ol></section>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article class='post with-comments'>{BODY}</article>", PARAGRAPHS),
        (f"<div class='content has-sidebar'><article>{BODY}</article></div>", PARAGRAPHS),
        (f"<main class='no-sidebar'><article>{BODY}</article></main>", PARAGRAPHS),
        (f"<div class='elementor-widget elementor-widget-text-editor'>{BODY}</div>", PARAGRAPHS),
        (f"<form id='aspnetForm'><input type=hidden><div>{BODY}</div></form>", PARAGRAPHS),
        (f"<form id='f'><main>{BODY}</main></form>", PARAGRAPHS),
        (f"<article><div class='entry-header'><h1>The title</h1></div>{BODY}</article>", ["The title", *PARAGRAPHS]),
        (f"<article><header class='entry-header'><h1>The title</h1></header>{BODY}</article>", ["The title", *PARAGRAPHS]),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so. It is one.</p></article>", ["Let x=1 be so. It is one."]),
    ],
)
@pytest.mark.parametrize("around", ["{}", "<body class='single has-sidebar'>{}</body>", "<div class='wrapper search-page'>{}</div>"])
def test_articles_in_frames_of_any_name(page, text, around):
    """Whole, and without what is beside them or below."""
    assert html_text.main_text(around.format(page)) == "\n".join(text)
    assert html_text.main_text(around.format(page + SIDE + REMARKS)) == "\n".join(text)


def test_remarks_longer_than_the_article_stay_out():
    page = f"<div class='page'><article>{BODY}</article>{REMARKS * 30}</div>"
    assert html_text.main_text(page) == "\n".join(PARAGRAPHS)
    page = f"<div class='sidebar'><p>{PARAGRAPHS[0]}</p></div><div class='text'>{BODY}</div>"
    assert html_text.main_text(page) == "\n".join(PARAGRAPHS)


def test_pages_without_an_article():
    long = "This is a paragraph of an ordinary text, with commas and so on. It has sentences."
    page = f"<div class=menu><a href=x>a</a> <a href=y>b</a></div><div><p>{long}</p><p>Short.</p><p>{long}</p></div>"
    assert html_text.main_text(page) == f"{long}\nShort.\n{long}"
    links = "".join(f"<li><a href=/{i}>Some page {i}</a></li>" for i in range(9))
    assert html_text.main_text(f"<ul>{links}</ul><p>{long}</p>") == long


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<", "<"), ("<!-- x", ""), ("<script>x", ""), ("a &lt; b &am &amp", "a < b &am &"),
        ("<p>x<![CDATA[y]]>z", "xz"), ("<p>a<p>b</b></p>c", "a\nb\nc"), ("<td>a<td>b</table>", "a\nb"),
        ("<p title='a>b'>c", "c"), ("<P CLASS=x>up</P>", "up"), ("&nbsp;a&#32;&#x20;b", "a b"), ("</p></p>a", "a"),
        ("<article><p>a</article></div><footer>b", "a"), ("<p hidden>a</p><p>It is seen. Is it? Yes!</p>", "It is seen. Is it? Yes!"),
    ],
)
def test_broken_markup(page, text):
    assert html_text.main_text(page) == text


def test_cut_is_the_least_of_all_labellings():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 8)
        gains = [rnd.uniform(-3, 3) for _ in range(n)]
        links = [(a, b, rnd.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]

        def cost(labels):
            single = sum(max(-g, 0) if x else max(g, 0) for g, x in zip(gains, labels))
            return single + sum(w for a, b, w in links if labels[a] != labels[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_text.minimum_cut(gains, links)) == pytest.approx(best)


def test_smoothness_carries_a_short_block_along():
    page = "<div>" + "<p>A sentence of ordinary length, it seems. Fine.</p>" * 3 + "<p><a href=x>link</a></p>" + "<p>A sentence of ordinary length, it seems. Fine.</p>" * 3 + "</div>"
    blocks = html_blocks.read_blocks(page)
    alone = [html_text.log_odds(b) > 0 for b in blocks]
    assert alone == [True] * 3 + [False] + [True] * 3
    cheap = [0.9 if a else -0.9 for a in alone]
    assert all(html_text.minimum_cut(cheap, html_text.edges(blocks)))


def test_deep_and_long_pages():
    page = "<div>" * 30_000 + "x. " * 1000 + "<p>a b. <b>c" * 5_000
    assert len(html_text.main_text(page)) > 30_000
    framed = "<div class='sidebar'>" * 30_000 + "<p>A text. It is in many frames, all around it.</p>" * 1000
    assert html_text.main_text(framed).count("A text.") == 1000


def test_table(spark):
    rows = [(1, "u", PAGES["tags"]), (1, "u", PAGES["tags"]), (None, None, None), (2, "v", ""), (3, "w", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' AS text", "1 AS n_chars", "2 AS frame", "'c' AS content", "'b' AS blocks", "'p' AS part")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found.collect()) == sorted(
        [("1", TEXT, len(TEXT))] * 2 + [("None", "", 0), ("2", "", 0), ("3", "", 0)]
    )
    assert html_text.extract(pages.limit(0)).collect() == []
