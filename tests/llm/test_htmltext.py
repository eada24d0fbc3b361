import random
import time

import pytest

from tessella.llm import htmltext
from tessella.llm.htmltext import extract, main_text

LONG = "The cat of the house is in the garden and it was with them for the day of it all."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>" + LONG + "</p><p>Short.</p><ul class=menu><li><a href=x>Home</a></ul>", LONG + "\n\nShort."),
        ("<header><h1>Site</h1></header><main><h2>T</h2><p>x<b>y</b>  z<br>w</main><footer>f", "T\n\nxy z w"),
        ("<article><p>a<aside>no</aside>b</p><form><p>q</p></form><div id='reader-comments'><p>c</div><p>&lt;d&gt; &amp;c &eacute;</article>", "a\n\nb\n\n<d> &c é"),
        ("<article><p>one<script>var t='</p>';</script> two<!-- <p>no --></p><p hidden>no</p><p>three</article>", "one two\n\nthree"),
        ("<nav><p>" + LONG + "</nav><article><h1>A</h1><p>" + LONG + "<p>cut off <a hre", "A\n\n" + LONG + "\n\ncut off"),
        ("<div class='cookie-notice'><p>" + LONG + "</div><div><p>" + LONG + "</div>", LONG),
        ("just text, no markup", "just text, no markup"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_table_with_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article>" + "<p>word</p>" * 20_000, "x"), (3, "u", "<p>same</p>", "x"), (3, "u", "<p>same</p>", "x"), (None, None, "<p>é  é</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract(pages).collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    assert sorted(r.n_chars for r in found) == [0, 0, 3, 4, 4, 20_000 * 6 - 2]
    assert extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><script>for(var i=0;i<n;i++){f(i)}</script><p>one</p><script>x</script><p>two</p></article>", "one\n\ntwo"),
        ("<script>for(i=0;i<n;i++){}</SCRIPT ><article><p>one</p></article>", "one"),
        ("<article><script><!-- x = '<p>'</script><p>one</p></article>", "one"),
        ("<article><style>a<b{}</style><svg><title>no</title></svg><p>one</p><script>no end <p>no", "one"),
        ("<article><p>one<p hidden>no<p>two<p hidden>no<h2>three</h2><p>four</article>", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><ul><li>one<li hidden>no<p>no</p><ul><li>no</li></ul>no<li>two</ul><p>three</article>", "one\n\ntwo\n\nthree"),
        ("<article><div><p hidden>no</div><p>one</p><ul><li hidden>no</ul><p>two</article>", "one\n\ntwo"),
        ("<article><blockquote hidden>no<blockquote>no</blockquote>no</blockquote><p>one</article>", "one"),
        ("<article><table><tr><td hidden>no<td>one</tr></table></article>", "one"),
    ],
)
def test_scripts_and_hidden_elements_end(html, text):
    assert main_text(html) == text


FINNISH = "Talon takana seisoi vanha kuusi, jonka oksilla linnut lauloivat aamusta iltaan koko pitkän kesän ajan."
NAMES = "Virtanen Matti, Korhonen Liisa, Nieminen Pekka, Laine Anna, Heikkinen Juhani, Koskinen Maria, Salo Eero"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div><p>" + LONG + "</p></div><section class=comments><article><p>" + LONG + " no</p></article></section>", LONG),
        ("<div><p>" + LONG + "</p></div><aside><main><p>no</p></main></aside>", LONG),
        ("<div><p>" + FINNISH + "</p><p>" + FINNISH + "</p></div>", FINNISH + "\n\n" + FINNISH),
        ("<div class=menu><p>no</p></div><table><tr><td>" + NAMES + "</td></tr></table>", NAMES),
        ("<div><p>" + FINNISH + "</p><p><a href=x>" + FINNISH + "</a></p></div>", FINNISH),
        ("<div><p>" + LONG + "</p><p>" + LONG + "</p><p>" + NAMES + "</p></div>", LONG + "\n\n" + LONG),
    ],
)
def test_main_text_without_an_article(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-nav", "post comments-open", "content-search", "article share-enabled", "notice-board", "page-header-visible", "social-history", "promoted", "sidebar", "comments"])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_names_on_what_holds_the_text(tag, name):
    page = f"<nav><p>{LONG} no</p></nav><{tag} class='{name}'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></{tag}><footer>no</footer>"
    assert main_text(page) == f"Head\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "related-posts", "site-footer", "page-header", "ad", "ad-slot", "social share-buttons", "cookie_banner", "newsletter-signup", "widget-area", "main-menu"])
def test_names_of_what_is_no_text(name):
    page = f"<div class=content><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{LONG} no</p></div>"
    assert main_text(page) == f"{LONG}\n\n{LONG}"
    assert main_text(page.replace("div class=content", "article").replace("</div><div", "</article><div", 1)) == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<form action=x><nav><p>no</p></nav><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n\n{LONG}"),
        (f"<form><article><p>{LONG}</p><form><p>{LONG} no</p></form></article></form>", LONG),
        (f"<div><p>{LONG}</p><form><p>{LONG} no</p></form></div>", LONG),
        (f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><section class='related'><article><p>{LONG} no</p></article></section>", f"{LONG}\n\n{LONG}"),
        (f"<div class=ad>{LONG}</div><article><h1>Head</h1><p>Short.</article>", "Head\n\nShort."),
        # comments longer than the article are comments
        (f"<article><p>{LONG}</p></article><div class=comments>{f'<p>{LONG} no</p>' * 9}</div>", LONG),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=comments>{f'<p>{LONG} no</p>' * 5}</div>", f"{LONG}\n\n{LONG}"),
        (f"<div class=overlay><p>{LONG}</p><p>{LONG}</p><div class=comments><p>{LONG} no</p></div></div>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_forms_and_names_around_a_page(html, text):
    assert main_text(html) == text


def test_articles_that_hold_little_do_not_stand_for_the_page():
    page = f"<div id=content>{f'<p>{LONG}</p>' * 5}</div><section class=more-stories><article><p>A teaser.</p></article></section>"
    assert main_text(page).startswith("\n\n".join([LONG] * 5))


def brute_labels(found, has_main):
    """Both passes by their description, each ambiguous block searched outward."""
    first = htmltext.first_labels(found, has_main)
    out = list(first)
    for i, b in enumerate(found):
        if first[i] != htmltext.SHORT:
            continue
        by = sorted((abs(i - j), first[j]) for j in range(len(found)) if first[j] in (0, 1))
        near = {x for d, x in by if d == by[0][0]} or {1}
        if near == {1} or len(near) == 2 and b.main:
            out[i] = 1
        elif near == {0} and not b.main:
            out[i] = 0
        else:
            out[i] = int(b.heading or b.text[-1] in ".!?" or b.stop_share() >= htmltext.STOPS)
    return out


def test_two_passes_equal_a_search_for_each_block():
    rng = random.Random(5)
    parts = ["<p>Short one.</p>", "<p>no end</p>", f"<p>{LONG}</p>", f"<p>{NAMES}</p>", "<p><a href=x>link</a></p>", "<h2>Head</h2>", "<aside><p>no</p></aside>", "<ul><li>item<li><a href=y>to</a></ul>", "<div class=menu><p>off</p></div>", "<article>", "</article>", "<div>", "</div>"]
    for _ in range(400):
        found = htmltext.blocks("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
        assert [x == 1 for x in htmltext.labels(*found)] == [x == 1 for x in brute_labels(*found)]


def test_pages_of_many_blocks_take_time_in_proportion():
    # each of these took minutes when a block searched outward and a tag walked over all open elements
    for page, n in [("<p>word</p>" * 100_000, 100_000), ("<div>" * 30_000 + "<p>w" * 30_000, 30_000), ("<svg>" * 50_000 + "x", 1), ("<ul><li hidden>" + "<div>" * 3_000 + "<li>x" * 20_000, 20_000)]:
        began = time.perf_counter()
        assert len(main_text(page).split("\n\n")) == n
        assert time.perf_counter() - began < 20
