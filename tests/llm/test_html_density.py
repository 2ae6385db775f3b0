import html
import math
import random
import re
import time

import pytest

from tallyframe.llm.html_density import Page, densities, extract, main_text

PROSE = "Here is a paragraph with a good number of plain words in it, enough to weigh more than a menu."


def article_blocks(source):
    """The article's blocks where a page is one article of h1 and p."""
    m = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " "))
    parts = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*(>|$)", "", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.id: r for r in extract(pages).collect()}
    want = {r.page_id: article_blocks(r.html) for r in pages.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("chrome", [
    "<nav><a href=a>Home</a> <a href=b>About the whole wide world</a></nav>", "<header><h2>Site name</h2><p>" + PROSE + "</p></header>",
    "<footer>&copy; me <p>" + PROSE + "</p></footer>", "<aside><p>" + PROSE + "</p></aside>", '<div class="cookie-notice"><p>' + PROSE + "</p></div>",
    '<div id="sidebar"><p>' + PROSE + "</p></div>", '<div class="ad">' + PROSE + "</div>", "<form><label>Name</label><input name=x><button>Go</button></form>",
    "<script>var t = '</p><p>" + PROSE + "';</script>", "<style>p { color: red }</style>", "<!-- <p>" + PROSE + "</p> -->",
    '<section id="comments"><h3>Comments</h3><div><p>' + PROSE + "</p></div></section>", '<div role="complementary">' + PROSE + "</div>"])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>'])
def test_chrome_goes_and_all_blocks_stay(chrome, frame):
    body = f"<h1>A title</h1><p>{PROSE}<br>More &amp; more<p>Second <b>bo</b>ld one, {PROSE}<ul><li>one<li>two</ul>"
    want = f"A title\n{PROSE} More & more\nSecond bold one, {PROSE}\none\ntwo"
    for page in (chrome + frame.format(body), frame.format(body) + chrome):
        assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == want


def test_broken_markup():
    assert main_text("") == "" and main_text("<p") == "" and main_text("<!-- open") == ""
    assert main_text("a < b &lt; c &am") == "a < b < c &am"
    assert main_text('<p title="a>b">x</p><p class="y>z') == "x\nz" and main_text('<p>x</p><p class="y') == "x"
    assert main_text("<script>never closed") == ""
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("</b></p>x<table><tr><td>a<td>b<tr><td>c</table>") == "x\na\nb\nc"
    assert main_text('<div class="ad"><p>only this') == "only this"  # nothing is left without it


def test_density_prefers_text_to_links():
    p = Page(f"<div><a href=1>{PROSE}</a></div><div>{PROSE}</div>")
    d, _ = densities(p)
    link_div, text_div = (i for i, t in enumerate(p.tag) if t == "div")
    assert d[text_div] > d[link_div]


def test_rows_and_nulls(spark):
    rows = [(1, "u", "<p>x</p>", "e"), (1, "u", "<p>x</p>", "e"), (None, None, None, None), (2, None, "", "t"), (3, "v", "<p>" + "word " * 200_000 + "</p>", "l")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted(((r.id, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, None, "", 0), (3, "v", ("word " * 200_000).strip(), 999_999)], key=str)
    assert extract(df.where("1 = 0")).count() == 0


SECOND = "Another part of the same text follows in a block of its own, with a fair number of plain words as well."


def test_sibling_and_nested_articles():
    one, two = f"<article><h1>One</h1><p>{PROSE}</p><p>{PROSE}</p></article>", f"<article><p>{SECOND}</p><p>{SECOND}</p></article>"
    menu = "<ul>" + "<li><a href=x>Go</a></li>" * 12 + "</ul>"
    want = f"One\n{PROSE}\n{PROSE}\n{SECOND}\n{SECOND}"
    assert main_text(f"<body>{menu}<main>{one}{two}</main></body>") == want
    assert main_text(f"<body>{menu}<div>{one}{two}</div></body>") == want
    nested = f"<article><p>{PROSE}</p><article><p>{SECOND}</p><p>{SECOND}</p><p>{SECOND}</p></article><p>{PROSE}</p></article>"
    assert main_text(f"<body>{menu}{nested}</body>") == "\n".join([PROSE, SECOND, SECOND, SECOND, PROSE])


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "content-with-sidebar", "post-header", "ad-free", "share-price", "sidebar", "related"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "{}"])
def test_wrappers_named_like_chrome_stay(name, inner):
    text = f"<p>{PROSE}</p><p>{PROSE}</p>"
    assert main_text(f'<body><p>One line.</p><div class="{name}">{inner.format(text)}</div></body>').endswith(f"{PROSE}\n{PROSE}")


@pytest.mark.parametrize("mark", ['class="user-comments"', 'id="disqus_thread"', 'class="ad-slot"', 'class="advert-unit"', 'class="post-comments-area"', "id=comment-42"])
def test_comments_and_adverts_go_whatever_they_are_called(mark):
    text, other = f"<p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p>", f"<div {mark}><p>{SECOND}</p><p>{SECOND}</p></div>"
    for page in (f"<article>{text}{other}</article>", f"<article>{text}</article>{other}", f"{other}<main>{text}</main>", f"<div><div>{text}</div>{other}</div>"):
        assert main_text(f"<body>{page}</body>") == "\n".join([PROSE] * 3)
    assert main_text(f"<body><div {mark}><article>{text}</article></div></body>") == "\n".join([PROSE] * 3)


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "</section>" * 60_000, "<b>" * 120_000 + "</i>" * 120_000, "<i><div>" + "<b>" * 120_000 + "</i>" * 120_000,
                                    "<div>" * 60_000 + "<li></li>" * 60_000, "<div>" * 50_000 + "<header></header>" * 30_000, "</p>" * 250_000])
def test_a_megabyte_of_stray_tags(source):
    began = time.process_time()
    assert main_text(source + "text") in ("text", "")
    assert time.process_time() - began < 15


def plain_density(page, i):
    """Composite density of node ``i`` by walking its subtree."""
    def chars(j, inside):
        return sum(len(t.strip()) for n, t in page.pieces if t and j <= n < page.end[j] and (not inside or under_link(n)))

    def under_link(n):
        while n > 0:
            if page.tag[n] == "a":
                return True
            n = page.parent[n]
        return False

    c, lc = chars(i, False), chars(i, True)
    tags, link_tags = page.end[i] - i - 1, sum(page.tag[j] == "a" for j in range(i + 1, page.end[i]))
    if not c:
        return 0.0
    all_c, all_l = chars(0, False), chars(0, True)
    t, l, lt = max(1, tags), max(1, lc), max(1, link_tags)
    base = math.log(c / max(1, c - lc) * lc + all_l / all_c * c + math.e)
    value = math.log(c / l * t / lt) / math.log(max(base, 1 + 1e-9)) if base > 1 else math.log(max(1.0, c / l * t / lt))
    return c / t * max(0.0, value)


def test_densities_of_random_trees():
    rng = random.Random(6)

    def tree(depth):
        out = ""
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["div", "p", "a", "span", "section"])
            out += rng.choice(["", "some words ", "x" * rng.randint(1, 90)]) + f"<{tag}>{tree(depth - 1) if depth else ''}</{tag}>"
        return out + rng.choice(["", " tail of text"])

    for _ in range(150):
        page = Page(tree(4))
        density, total = densities(page)
        for i in range(len(page.tag)):
            assert math.isclose(density[i], plain_density(page, i), rel_tol=1e-9, abs_tol=1e-12)
            own = sum(len(t.strip()) for n, t in page.pieces if t and n == i)
            assert math.isclose(total[i], own + sum(density[j] for j in range(len(page.tag)) if page.parent[j] == i), rel_tol=1e-9, abs_tol=1e-9)
