from hypothesis import given, settings, strategies as st

from tables import SF
from reelquery.llm import html


def text(page):
    return html.without(html.Page(page, html._digest()).blocks, [])


def test_blocks():
    page = '<body><div class="content"><p>One &amp; two<p>three <ul><li>x<li>y</ul> tail</div><div id="comments">no</div><form>f</form><aside>s</aside><!-- c --><script>"<p>js</p>"</script> free <b>bold</i></b> text'
    assert text(page) == "One & two\nthree\nx\ny\ntail\nfree bold text"
    assert text("<main><header><h1>T</h1></header><p>a<br>b  c</p><footer>f</footer></main><p>outside</p>") == "T\na b c"
    assert text("<article><p>a</p><div class='ad'>b</div><p hidden>c</p></article><div role='navigation'>d</div>") == "a"
    assert text('<div class="page has-sidebar"><div class="content-sidebar-wrap"><p>a</p><div class="left sidebar-left">b</div><div id="site-footer">c</div></div></div>') == "a"
    assert text("") == "" and text("<") == "<" and text("a < b") == "a < b"
    assert text("<p title='a>b'>x</p>") == "x" and text("<P>A</P>b") == "A\nb"


@given(st.text(alphabet="<>/pdiv=\"' abc&;!-", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_string_is_read(page):
    assert isinstance(text(page), str)


def test_templates_go_and_copies_stay(spark):
    frame = '<html><body><div class="top"><p>Site of things</p></div>{}<div><p>All about us</p><p>Second line</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", frame.format(f"<div><p>Story number {i}</p></div>")) for i in range(20)]
    rows += [(100 + i, "http://h.example/copy", frame.format("<div><p>The very same story</p></div>")) for i in range(30)]
    rows += [(200, None, None), (201, "http://other/", ""), (202, "x", frame.format("alone")), (202, "x", frame.format("alone"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, text long")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert {(i, f"Story number {i}", len(f"Story number {i}")) for i in range(20)} <= got
    assert {(100 + i, "The very same story", 19) for i in range(30)} <= got
    assert (200, "", 0) in got and (201, "", 0) in got
    assert (202, "Site of things\nalone\nAll about us\nSecond line", 45) in got
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_articles_of_the_tables(spark):
    import re

    import pandas as pd

    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    for r in html.op4_template_free_text(spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages.html[r["page_id"]], re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_articles_that_are_not_the_page():
    assert text("<main></main><div>story</div>") == "story"
    assert text("<article><p>teaser</p></article><div><p>the story is in a div</p><p>and goes on</p></div>") == "teaser\nthe story is in a div\nand goes on"
    assert text("<article><p>the story is in here</p></article><div><p>aside</p></div>") == "the story is in here"


def test_names_inside_an_article():
    marked = '<article><h2 id="related-work">A</h2><section id="social-security"><p>b</p></section><h2 id="navigation">C</h2><p class="notice">d</p><div class="related">e</div><section class="x comments">f</section></article>'
    assert text(marked) == "A\nb\nC\nd"
    assert text('<article><p class="share-price">a</p><div class="notice-of-motion">b</div><div class="login-tutorial">c</div></article>') == "a\nb\nc"
    assert text('<div class="share-price">a</div><div class="comment-list">x</div><div id="left-sidebar">y</div><div class="cookie notice">z</div>') == "a"
    assert text('<main><p>a</p></main><article class="comment"><p>me too</p></article>') == "a"


def test_hostile_pages_are_read_in_linear_time():
    import time

    n = 1_000_000
    pages = ["<img " + "a=b " * (n // 4), "<a " * (n // 3), "<div>" * (n // 5), "<a x='" * (n // 6), "<a x=\">\"" * (n // 8), "=  " * (n // 3), "<p " + "=  " * (n // 3), "<p a" + " " * n, "<p " + "a " * (n // 2) + ">x"]
    pages += ["<p><object>" + "<div>" * (n // 5), "<!" * (n // 2), "<!--" * (n // 4), "</script" * (n // 8), "<script>" + "</script " * (n // 9), "<b>" * (n // 3) + "</i>" * (n // 4), "<table>" * (n // 7), "<div>a" * (n // 6), "<li>a" * (n // 5), "<p style='" + "display " * (n // 8) + "'>x", "&" * n, "<p>&amp" * (n // 7)]
    for page in pages:
        began = time.process_time()
        found = html.Page(page, html._digest())
        html.without(found.blocks, [(a, b) for *_, a, b in found.subtrees])
        assert time.process_time() - began < 5, page[:30]
    assert text("<p>story</p><img src=x alt='cut") == "story"


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def story(i, k=3):
    return "".join(f"<p>Paragraph {j} of story {i} tells of {i * j} things nobody else has told before</p>" for j in range(k))


def extracted(spark, pages, **options):
    df = spark.createDataFrame([(i, url, text) for i, (url, text) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html.extract(df, **options).collect()}


def plain(i, k=3):
    return "\n".join(f"Paragraph {j} of story {i} tells of {i * j} things nobody else has told before" for j in range(k))


def test_what_recurs_on_many_pages_goes_whatever_the_hosts_size(spark):
    advert = lambda i: f"<div><p>Advert number {i % 11} for the kind of shoes that everybody wants</p></div>"
    site = lambda n: [("http://h/", page("<div><p>The site's name</p></div>", advert(i), f"<div>{story(i)}</div>")) for i in range(n)]
    for n in (60, 400):
        assert extracted(spark, site(n), marks=False) == {i: plain(i) for i in range(n)}
    assert extracted(spark, site(3), marks=False)[0].startswith("The site's name")


def test_near_copies_of_a_story_are_no_template(spark):
    near = [("http://h/", page("<div><p>The site's name</p></div>", "<div>", *(f"<p>A paragraph, number {j}, that all copies of this page share{' now' if i % 12 == j else ''}</p>" for j in range(12)), "</div>")) for i in range(40)]
    others = [("http://h/", page("<div><p>The site's name</p></div>", f"<div>{story(i)}</div>")) for i in range(40)]
    got = extracted(spark, near + others, marks=False)
    assert got[0].count("\n") == 11 and got[0].startswith("A paragraph, number 0") and got[45] == plain(5)


def test_promotions_in_articles_go_and_shared_passages_stay(spark):
    promo = lambda i: f"<div><p>Read our letter every morning to know more than all of your friends do</p></div>"
    rows = [("http://h/", page("<article>", story(i), promo(i), "<p>More soon.</p>" * (i % 3 == 0), "</article>")) for i in range(30)]
    assert extracted(spark, rows) == {i: plain(i) + "\nMore soon." * (i % 3 == 0) for i in range(30)}


def test_templates_against_a_count_by_host(spark):
    """Without any marks the recurring subtrees are those of a plain count, and frames go where hosts have enough pages."""
    from collections import defaultdict

    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    stands, told, total = defaultdict(dict), defaultdict(set), defaultdict(set)
    for _, url, text in pages:
        site, found = url.split("/")[2].split(":")[0].lower(), html.Page(text, html._digest(), False)
        total[site].add(found.identity)
        for h, *_ in found.subtrees:
            stands[site, h][found.identity] = found.longest()
    want = set()
    for (site, h), on in stands.items():
        n = len(on)
        differ = max(len({x[i] for x in on.values()}) for i in range(html.LONGEST))
        if n >= 4 and n >= min(10, 0.05 * len(total[site])) and differ >= max(0.5 * n, 4):
            want.add((site, h))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["host"], r["subtree"] % 2**64) for r in html.templates(html.parsed(df, False)).collect()}
    assert got == want and len(want) > 5
