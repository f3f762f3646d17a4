import html
import re
import time

import numpy as np

from martlens.llm.htmltext import _stretches, extract, main_text, window_sums
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
<nav class=menu><ul><li><a>Home<li><a>More</ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of the readers.</div>
<main><article><header><h1>Title &amp; more</h1><p class=byline>By X</p></header>
<p>First  paragraph
of <b>text</b><i>ual</i> 3 &lt; 4 &nbsp; ok<p>Second<br>line
<table><tr><td>a<td>b</table><div class="ad">Buy now</div><p>End.
<section id="comments"><p>Nice post, thanks a lot for it!</p></section></article></main>
<aside>side</aside><form><input><p>Subscribe</p></form><footer>(c)</footer>
<script>if (a<b) "</scrip"</script><!-- <p>hidden</p> --></body>"""


def test_query_against_marked_articles(spark):
    pages = {r.page_id: r for r in read(ready(spark), SF, "pages").collect()}
    rows = QUERIES["op6_html_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_that_are_no_main_text():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph of textual 3 < 4 ok", "Second line", "a b", "End."]


def test_surge_and_dive_without_an_article():
    long = "words of some length that make up a paragraph of the text. " * 3
    page = (
        "<div><a href=1>one</a></div><div><a>two</a></div><p>menu</p><p>x</p><p>y</p><p>z</p>"
        f"<h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p><ul><li><a>l</a><li><a>m</a></ul>"
        "<p>a</p><p>b</p><p>c</p><div id=footer>" + long * 5 + "</div>"
    )
    got = main_text(page).split("\n\n")
    assert got[-1] == long.strip() and "Head" in got and "short" in got
    assert "a" not in got and not any("one" == x for x in got)


def test_broken_and_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article></article><p>x") == ""
    assert main_text("<article><p>kept<!-- open <p>gone") == "kept"
    assert main_text("<article><p a='>'>q</p><p>&am &amp</p></article>") == "q\n\n&am &"
    assert main_text("<article><p>" + "w " * 200_000 + "</article>").count("w") == 200_000
    assert main_text('<div class="sidebar"><article><p>in</p></article></div>') == "in"
    assert main_text("<article>" + "<div>" * 3_000 + "deep") == "deep"


def test_window_sums():
    assert window_sums(np.array([1, 2, 3, 4]), 3).tolist() == [6, 9, 7, 4]


def test_nulls_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, "u", None, "t"), (1, None, "<article><p>é x", "t"), (None, "v", "", "t")],
        "page_id long, url string, html string, text string",
    )
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("é x", 3)]
    assert extract(df.limit(0)).count() == 0


def test_names_that_only_look_like_margins():
    body = "<p>" + "text of the article. " * 20 + "</p><p>end.</p>"
    page = f'<article><div class="entry-header"><h1>T</h1><p>by x</p></div><div>{body}</div></article>'
    assert main_text(page).split("\n\n")[0] == "T" and "by x" not in main_text(page)
    assert main_text(page).endswith("end.")
    assert main_text(f'<article><div class="ad-free">{body}</div></article>').endswith("end.")
    assert main_text(f'<div class="page header"><article>{body}</article></div>').endswith("end.")


def test_the_element_around_the_heavy_lines_sets_the_edges():
    long = "<p>" + "words of a paragraph here. " * 8 + "</p>"
    page = f"<p>stray</p><div><p>first</p>{long}<p>mid</p>{long}<p>last</p></div><p>stray</p>"
    got = main_text(page).split("\n\n")
    assert got[0] == "first" and got[-1] == "last" and "stray" not in got


LONG = "words of some length that make up a paragraph of the text. " * 5


def test_a_head_without_its_end_tag():
    for body in (f"<body><p>{LONG}", f"<body><article><p>{LONG}</article>", f"<div><p>{LONG}</div>"):
        got = main_text(f"<html><head><meta charset=utf-8><title>T</title><link href=x>{body}")
        assert got == LONG.strip()
    assert main_text(f"<head><title>T</title>{LONG}") == LONG.strip()
    assert main_text(f"<head><title>T</title></head><body><p>{LONG}") == LONG.strip()


def test_a_form_around_the_page():
    form = "<form id=aspnetForm action=/><input type=hidden><nav>menu</nav>"
    assert main_text(f"<body>{form}<article><p>in</article></form>") == "in"
    assert main_text(f"<body>{form}<main><p>in</main></form>") == "in"
    assert main_text(f"<body>{form}<div><p>{LONG}<p>{LONG}</div></form>") == "\n\n".join([LONG.strip()] * 2)
    page = f"<body><p>{LONG}<p>{LONG}<form><p>{LONG}</form>"
    assert main_text(page) == "\n\n".join([LONG.strip()] * 2)
    assert main_text("<article><p>in<form><p>x</form></article>") == "in"


def test_words_that_are_the_subject_of_an_article():
    page = (
        '<article><h2 id="search">Search</h2><p>a<section id="related-work"><h3 class="share">R</h3>'
        '<p>b</section><div class="related">gone</div><div role="navigation">gone</div>'
        '<div id="comments">gone</div><p hidden>gone</p><p id="notice">c</p></article>'
    )
    assert main_text(page).split("\n\n") == ["Search", "a", "R", "b", "c"]
    long = LONG.strip()
    assert main_text(f'<h2 id="search">Search</h2><p>{LONG}').split("\n\n") == ["Search", long]


def test_inline_text_is_judged_by_itself():
    for inline in ("<button>gone</button>", "<select><option>gone</select>", "<i hidden>gone</i>"):
        assert main_text(f"<article><p>{inline} one <b>two</b></p></article>") == "one two"
        assert main_text(f"<article><p>one {inline} two</p></article>").split() == ["one", "two"]
    page = '<article><p><span class="social">one</span> two<p><a class="reply">x</a> is it</article>'
    assert main_text(page) == "one two\n\nx is it"
    assert main_text(f'<p><span class="social">gone</span> {LONG}') == LONG.strip()


def test_every_stretch_stays():
    long = LONG.strip()
    items = "<ul>" + "".join(f"<li>{w}</li>" for w in "abcd") + "</ul>"
    got = main_text(f"<body><p>{LONG}<p>{LONG}{items}<p>{LONG}</body>")
    assert got.split("\n\n") == [long, long, *"abcd", long]
    chapters = "".join(
        f"<section><h2>{k}</h2><p>{LONG}<p>x<p>y<p>z<p>v<p>{LONG}</section>" for k in "123"
    )
    links = "<ul>" + "<li><a href=/>menu</a>" * 5 + "</ul>"
    for page in (f"<body>{links}{chapters}{links}", f"<body><div>{links}{chapters}{links}</div>"):
        want = [x for k in "123" for x in (k, long, *"xyzv", long)]
        assert main_text(page).split("\n\n") == want
    assert "menu" not in main_text(f"<div>{LONG}</div>{links}<div><p>{LONG}<p>{LONG}</div>")


def test_short_lines_only():
    verse = [f"a line of verse {k}" for k in "abcdefgh"]
    assert main_text("<p>" + "<p>".join(verse)).split("\n\n") == verse
    got = main_text(f"<p>{LONG}<p>" + "<p>".join(verse) + f"<p>{LONG}").split("\n\n")
    assert got == [LONG.strip(), *verse, LONG.strip()]
    assert main_text(f"<p>{LONG}<p>" + "<p>".join(verse)).split("\n\n") == [LONG.strip(), *verse]
    assert main_text("<ul>" + "<li><a>some link of a menu</a>" * 9 + "</ul>") == ""


def test_marks_widen_surge_and_dive():
    long = LONG.strip()
    page = f"<main><h1>Title</h1><p>lead</p><article><p>{LONG}</article></main>"
    assert main_text(page).split("\n\n") == ["Title", "lead", long]
    page = f"<p>stray<article><p>{LONG}</article><article><p>short</article><article><p>{LONG}</article>"
    assert main_text(page).split("\n\n") == [long, "short", long]
    page = f"<article><p>outer<article><p>{LONG}<p>{LONG}</article><p>{LONG}</article>"
    assert main_text(page).split("\n\n") == ["outer", long, long, long]
    # the windows decide where the marked part is not the heavy one
    page = f"<article><p>teaser</article><div><p>{LONG}<p>{LONG}<p>end</div>"
    assert main_text(page).split("\n\n") == ["teaser", long, long, "end"]


TWO = f"<p>{LONG}</p><p>{LONG}</p>"


def test_names_never_empty_a_page():
    both = "\n\n".join([LONG.strip()] * 2)
    widget = f'<h1>Title</h1><div class="elementor-widget-container">{TWO}</div>'
    for page in (f"<main>{widget}</main>", f"<body>{widget}</body>"):
        assert main_text(page) == f"Title\n\n{both}"
    for names in (
        'class="layout no-sidebar"', 'class="post category-social"', 'id="notice-of-appeal"',
        'class="page-header-fixed"', 'class="header"', 'class="widget"', 'id="search"',
        'class="related" role="alert"', 'class="footer"', 'class="comments"',
    ):
        assert main_text(f"<body><div {names}>{TWO}</div></body>") == both, names
        nested = f"<body><div {names}><div {names}>{TWO}</div></div><p>x</p></body>"
        if "footer" not in names and "comments" not in names:
            assert both in main_text(nested), names
    article = f'<article><p>{LONG}</p><section class="related-work"><p>b</p></section></article>'
    assert main_text(article).split("\n\n") == [LONG.strip(), "b"]


def test_names_that_are_margins_beside_a_text():
    long = LONG.strip()
    for names in (
        'class="cookie-notice"', 'class="siteFooter"', 'id="comment-list"', 'class="sidebar_left"',
        'class="related-posts"', 'class="c-share-bar"', "hidden", 'class="x y ads"',
    ):
        page = f"<body><div><p>{LONG}</p></div><div {names}><p>{LONG}</p></div></body>"
        assert main_text(page) == long, names
    # a mixed name counts where nothing solid stands
    page = f'<body><div><p>{LONG}<p>{LONG}</div><div class="mc-newsletter"><p>Join us</div>'
    assert main_text(page) == "\n\n".join([long] * 2)
    # a short text keeps its long comments out
    page = f'<body><div><p>Short news of the day.</p></div><div class="comments">{TWO}</div></body>'
    assert main_text(page) == "Short news of the day."


def test_short_pages_without_an_article():
    assert main_text("<p>Hello there.</p><p>Two short ones.</p>") == "Hello there.\n\nTwo short ones."
    assert main_text("<body>Only this") == "Only this"
    assert main_text("<ul><li><a href=/>Home</a></ul><p>Short.</p>") == "Short."


def brute_stretches(weight):
    """Runs of windows, one window at a time."""
    windows = [sum(weight[i : i + 3]) for i in range(len(weight))]
    for least, whole in ((80, 80), (1, 80), (1, 1)):
        out, run = [], []
        for i, w in enumerate([*windows, 0]):
            if w >= least and i < len(windows):
                run.append(i)
            elif run:
                lines = [k for k in range(run[0], min(run[-1] + 3, len(weight))) if weight[k]]
                if sum(weight[k] for k in lines) >= whole:
                    out.append((lines[0], lines[-1] + 1))
                run = []
        if out:
            return out
    return []


def test_stretches_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(500):
        kinds = [0, 0, 0, 3, 30, 90] if rng.random() < 0.7 else [0, 0, 2]
        weight = rng.choice(kinds, rng.integers(1, 40))
        assert _stretches(weight) == brute_stretches(weight.tolist())


def test_every_line_between_surge_and_dive_stays():
    rng = np.random.default_rng(3)
    for k in range(60):
        sizes = rng.choice([1, 4, 40], rng.integers(3, 25))
        texts = [f"{i} " + "w " * n for i, n in enumerate(sizes)]
        texts = [LONG, *texts, LONG]
        body = "".join(f"<p>{t}</p>" for t in texts)
        for page in (body, f"<div>{body}</div>", f"<article>{body}</article>", f"<main>{body}</main>"):
            want = [" ".join(t.split()) for t in texts]
            assert main_text(f"<body><nav>menu</nav>{page}</body>").split("\n\n") == want, k


def test_open_elements_cost_no_more_than_their_number():
    def took(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    for part in ("<div>", "<b>", "<article>", "<div>x", "<b>x</p>", "<li>x", "<a><p>" + "long text " * 9,
                 "</div>", "<span class='ad x'>y"):
        assert took(part * 100_000 if len(part) < 20 else part * 20_000) < 8, part
