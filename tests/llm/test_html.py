import html
import random
import re

import pytest
from samples import words

from fundtrace.llm import html_text
from fundtrace.llm.dom import blocks, match, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>Home<li>News</ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Head %d</h1><p><b>First</b> para%d &amp; <i>m</i>ore<br>line<p>Second&nbsp;&eacute; x%d<p>All rights of this constant paragraph<div class="comments"><p>reader says</div></article>
<aside>Side</aside><form><input>Send</form><footer>&copy; us</footer></body>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS text", "2 AS template")


def test_article_without_template(spark):
    rows = [(i, "https://a.example/x?y", PAGE % (i, i, i)) for i in range(8)] + [(100 + i, "https://a.example/", PAGE % (1, 1, 1)) for i in range(20)]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert got[3].text == "Head 3 First para3 & more line Second é x3" and got[3].n_chars == len(got[3].text)
    # Copies of a page don't make its text template.
    assert got[105].text == "Head 1 First para1 & more line Second é x1"


def test_page_without_article_tag_and_odd_input(spark):
    body = "<body><div class=menu><a>m</a></div><div id=main-text><p>One two three four</p><p>Five <b>six</b> seven</p></div><div class=footer>f</div></body>"
    rows = [(1, "http://b.example/", body), (2, None, None), (3, "not a url", ""), (4, "http://c.example", "plain &lt;text&gt;"), (5, "http://c.example", "<p>" * 3000 + "deep" + "<div>" * 2000)]
    got = {r.page_id: r.text for r in html_text.extract(pages(spark, rows)).collect()}
    assert got == {1: "One two three four Five six seven", 2: "", 3: "", 4: "plain <text>", 5: "deep"}
    assert html_text.extract(pages(spark, [])).count() == 0


def largest(a, b):
    """Size of the largest matching by the plain recursion over all cells."""
    if a.label != b.label:
        return 0
    xs, ys = a.children, b.children
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest(x, y))
    return 1 + best[-1][-1]


def random_tree(rng, depth=0):
    kids = "".join(random_tree(rng, depth + 1) for _ in range(rng.randrange(4 if depth < 4 else 1)))
    tag = rng.choice(["div", "section", "ul"])
    return f"<{tag}>{rng.choice(['a', 'b', ''])}{kids}</{tag}>"


def test_tree_matching_is_as_large_as_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        a, b = (blocks(parse(random_tree(rng))) for _ in range(2))
        pairs = match(a, b)
        assert len(pairs) == largest(a, b) and len({x.slot for x, _ in pairs}) == len({y.slot for _, y in pairs}) == len(pairs)


def test_tree_matching_aligns_what_is_constant():
    a = blocks(parse("<body><p>same<p>one<div><p>x</div></body>"))
    b = blocks(parse("<body><p>new<p>same<p>two<div><p>x</div></body>"))
    pairs = match(a, b)
    assert len(pairs) == 6 and match(a, blocks(parse("<section>x</section>"))) and sum(x.own == y.own != 0 for x, y in pairs) >= 1


def test_pages_of_any_size_and_depth_are_matched_in_full():
    wide = lambda n: blocks(parse("<body>" + "".join(f"<p>{i}<ul><li>x</ul>" if i % 3 else f"<h2>{i}</h2>" for i in range(n)) + "</body>"))
    assert len(match(wide(600), wide(600))) == wide(600).size
    deep = lambda n, t: blocks(parse("<div>" * n + t + "<p>y</p>" * (n % 2)))
    assert len(match(deep(3000, "a"), deep(3001, "b"))) == 3001


BODY = """<body><div>{nav}</div><div>{ad}</div><{tag}><h1>Head {i}</h1>{body}<p>All rights of this constant paragraph</{tag}><div>&copy; host {ad}</div></body>"""


def site(tag, n=12):
    """Pages whose elements have no names, menus and adverts that vary, and one to 600 paragraphs."""
    out = []
    for i in range(n):
        paras = [" ".join(f"w{i}x{k}x{j}" for j in range(25)) for k in range(600 if i == 3 else 1 + i % 5)]
        nav = "".join(f'<a href="/{i}">{words(i, 1)} {k}</a> ' for k in range(6))
        out.append((BODY.format(nav=nav, ad=words(i + 50, 6), tag=tag, i=i, body="".join(f"<p>{p}" for p in paras)), f"Head {i} " + " ".join(paras)))
    return out


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_slots_decide_where_elements_have_no_names(spark, tag):
    made = site(tag)
    got = {r.page_id: r for r in html_text.extract(pages(spark, [(i, "https://w.example/" + str(i), h) for i, (h, _) in enumerate(made)])).collect()}
    assert all(r.by_wrapper for r in got.values())
    assert [got[i].text for i in range(len(made))] == [t for _, t in made]


def test_whole_table_goes_through_wrappers(spark):
    """Every page's text is its article without markup, and wrappers of hosts decide most of them."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        plain = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert got[r.page_id].text == " ".join(plain.split()) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert sum(r.by_wrapper for r in got.values()) > 0.6 * len(rows)


NAV = '<div><a href="/a">{0}</a> <a href="/b">{1}</a> <a href="/c">{2}</a></div>'


def host(spark, article, n=8):
    """Texts of n pages with a menu that varies, read as one host; article(i): html and expected text."""
    made = [article(i) for i in range(n)]
    rows = [(i, f"https://h.example/{i}", "<body>" + NAV.format(*words(i + 900, 3).split()) + h + '<div class="ad">' + words(i + 500, 6) + "</div></body>") for i, (h, _) in enumerate(made)]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(r.by_wrapper for r in got.values())
    assert [got[i].text for i in range(n)] == [t for _, t in made]


def prose(i, n=60):
    return [words(1000 * i + k, n) for k in range(4)]


@pytest.mark.parametrize("n", [2, 3, 8])
def test_lines_beside_the_body_are_kept_at_any_length(spark, n):
    def article(i):
        lead, closing, body = words(i, 4), words(i + 70, 3), prose(i)
        return f"<article><h1>T{i}</h1><p>{lead}</p><div>{''.join(f'<p>{p}</p>' for p in body)}</div><p>{closing}</p></article>", " ".join([f"T{i}", lead, *body, closing])

    host(spark, article, n)


def test_lines_beside_a_body_without_heading_or_article(spark):
    def article(i):
        lead, closing, body = words(i, 4), words(i + 70, 3), prose(i)
        return f"<div><p>{lead}</p><div>{''.join(f'<p>{p}</p>' for p in body)}</div><p>{closing}</p></div>", " ".join([lead, *body, closing])

    host(spark, article)


def test_names_alone_drop_nothing_within_an_article(spark):
    def article(i):
        body, more, side = prose(i), prose(i + 40), words(i, 9)
        html = f"<article><h1>T{i}</h1>{''.join(f'<p>{p}</p>' for p in body)}<section id='discussion'><h2>D{i}</h2>{''.join(f'<p>{p}</p>' for p in more)}</section><p class='related'>{side}</p></article>"
        return html, " ".join([f"T{i}", *body, f"D{i}", *more, side])

    host(spark, article)


def test_references_of_an_article_are_kept(spark):
    def article(i):
        body, refs = prose(i), [words(i + 10 * k, 5) for k in range(4)]
        return f"<article><h1>T{i}</h1>{''.join(f'<p>{p}</p>' for p in body)}<ul>{''.join(f'<li><a href=x>{r}</a></li>' for r in refs)}</ul></article>", " ".join([f"T{i}", *body, *refs])

    host(spark, article)


def test_comments_and_forms_within_an_article_go(spark):
    def article(i):
        body, said = prose(i), [words(i + 10 * k, 12) for k in range(i % 4)]
        comments = "".join(f"<div class='comment'><p>{c}</p></div>" for c in said)
        related = "".join(f"<li><a href=x>{words(i + k, 3)}</a>" for k in range(5))
        return f"<article><h1>T{i}</h1>{''.join(f'<p>{p}</p>' for p in body)}<ul class='related'>{related}</ul><form>Name {words(i, 2)} <input></form><div id='comments'><h3>{i} comments</h3>{comments}</div></article>", " ".join([f"T{i}", *body])

    host(spark, article)


def test_equal_rows_are_answered_each(spark):
    row = (7, "https://r.example/", "<body><p>one two three</p></body>")
    assert [tuple(r) for r in html_text.extract(pages(spark, [row] * 3)).select("page_id", "text").collect()] == [(7, "one two three")] * 3
