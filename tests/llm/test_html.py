import random
import re
import time

from graphloom.llm import html
from graphloom.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="news">
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div>{main}
<aside>Side</aside><div id="comments"><p>First!</p></div><form><label>Mail</label><input><button>Go</button></form><div class="cookie-notice">Cookies</div><footer>&copy; 2020</footer></body></html>"""


def test_named_main_part():
    page = PAGE.replace("{main}", "<article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>Short.<ul><li>x<li>y</ul><div class=share>Share</div><section class='comments'><p>me too</p></section><p>a &lt;b&gt; c&nbsp;d</p></article>")
    assert html.main_text(page) == "Head & more\n\nOne two three\n\nShort.\n\nx\n\ny\n\na <b> c d"


def test_unnamed_main_part():
    long = " ".join(["plain words of the story"] * 8)
    page = PAGE.replace("{main}", f"<div class='content'><h2>Title</h2><p>{long}</p><p>Brief.</p><p>{long}</p></div>")
    assert html.main_text(page) == f"Title\n\n{long}\n\nBrief.\n\n{long}"


def test_odd_pages(spark):
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == html.main_text("<script>x") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<article><p>cut &am") == "cut &am" and html.main_text("<article><p>cut <b") == "cut"
    assert html.main_text("<div id='comments'><p>" + "First! " * 40 + "</p></div>") == html.main_text("<div class='cookie-notice'>We use cookies</div>") == ""
    assert html.main_text("<article>1 < 2 and <!-- no --> yes</article>") == "1 < 2 and yes"
    assert len(html.main_text("<main>" + "<p>x</p>" * 5000)) == 5000 + 2 * 4999
    assert html.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "u", None, "c"), (None, None, "<p>hi</p>", "c"), (1, "u", None, "c")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html.extract(df).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "hi", 2)]
    assert html.extract(df.limit(0)).count() == 0


def test_names_on_wrappers():
    assert html.main_text("<div class='page has-sidebar'><p>text of the page</p><div class='sidebar'>side</div></div>") == "text of the page"
    assert html.main_text("<div class='widget'><article><p>kept</p></article></div>") == "kept"
    assert html.main_text("<form id='f'><div class='menu-wrapper'><article><p>kept</p></article></div></form><p>out</p>") == "kept"
    assert html.main_text("<div class='post social-history'><p>A history of it.</p></div>") == "A history of it."


def test_hidden_and_quotes():
    assert html.main_text("<p hidden>no</p><p>yes</p><div style='display: none'>no</div><p aria-hidden=true>no</p>") == "yes"
    assert html.main_text("<p style='overflow:hidden'>a</p><p title='the hidden gem'>b</p><p style='x:y; VISIBILITY:hidden'>no</p>") == "a\n\nb"
    assert html.main_text("<p>a</p><div title=\"5\" tall\">b</div><a href='x>link</a> I don't") == "a\n\nb\n\nlink I don't"
    assert html.main_text("<article><p title='a > b' class=x>c</p></article>") == "c"


def test_malformed_pages_take_linear_time():
    for part in ("<a b='x ", "<p>x</p><x", '<a b="', "</b></p>"):
        began = time.time()
        html.main_text(part * 20_000)
        assert time.time() - began < 20


def test_region():
    assert html.between([0, 5, 0, 0, 0, 100, 50, 0, 3, 0, 0, 0, 9], 3, 120) == (5, 9)
    assert html.between([0, 5, 0, 7], 3, 120) == (1, 4) and html.between([], 3, 120) == (0, 0)
    assert html.regions([9, 9, 9, 200, 0, 0, 0, 4], 3, 120) == [(0, 4)]  # short lines before the surge belong to it
    assert html.distribution([1, 2, 3, 4], 2) == [3, 5, 7, 4]


def brute_regions(lengths, window, surge):
    """Lines with text fall apart where `window` empty ones lie between; parts with a surge are regions."""
    parts, last = [], None
    for k, x in enumerate(lengths):
        if x:
            if last is None or k - last > window:
                parts.append([k, k])
            parts[-1][1] = last = k
    return [(i, j + 1) for i, j in parts if any(lengths[k] and sum(lengths[k : k + window]) >= surge for k in range(i, j + 1))]


def test_regions_against_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        lengths = [rng.choice((0, 0, 0, 3, 20, 60, 150)) for _ in range(rng.randrange(30))]
        assert html.regions(lengths, 3, 120) == brute_regions(lengths, 3, 120)


def test_the_distribution_decides_on_named_pages_too():
    page = "<p>Teaser that is long enough to surge all alone, since it has more than one hundred and twenty characters, one would think.</p><article><h1>H</h1><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>Short.</p></article><p>after</p>"
    found, _ = html.parse(page)
    lengths = html.lengths_of(found)
    assert [x.text for x, n in zip(found, lengths) if n] == ["H", "Short."] and min(n for n in lengths if n) > html.SURGE
    assert len(html.regions(lengths)) == 2 and html.main_text(page) == "H\n\nShort."


def test_unnamed_pages_of_the_table(spark):
    for r in table(spark, "/root/testdata/sf0.001", "pages").collect():
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html.main_text(bare) == html.main_text(r["html"])


def test_whole_table_against_articles(spark):
    import html as std

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(std.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_unnamed_page_keeps_all_of_its_part():
    long, other = " ".join(["plain words of the story"] * 8), " ".join(["more words of it"] * 9)
    head = "<h1>Head</h1><div class='by'>By A</div><div>1 May</div>"
    want = ["Head", "By A", "1 May", "Dear all,", long, "Brief.", other]
    for away in ("<aside><p>a</p><p>b</p><p>c</p><p>d</p></aside>", "<ul class='menu'><li>a<li>b<li>c<li>d</ul>", "<form><p>a</p><p>b</p><p>c</p></form>", "<div class='ad'><p>a</p><p>b</p><p>c</p></div>"):
        body = f"<p>Dear all,</p><p>{long}</p>{away}<p>Brief.</p>{away}<p>{other}</p>"
        assert html.main_text(PAGE.replace("{main}", f"<div class='content'>{head}{body}</div>")) == "\n\n".join(want)
        assert html.main_text(PAGE.replace("{main}", f"<div class='post'>{head}<div class='text'>{body}</div></div>")) == "\n\n".join(want)
        assert html.main_text(PAGE.replace("{main}", head + body)).split("\n\n")[-4:] == want[-4:]
        parts = f"<div class='part'><h2>One</h2><p>{long}</p></div>{away}<div class='part'><h2>Two</h2><p>{other}</p></div>"
        assert html.main_text(PAGE.replace("{main}", f"<div>{parts}</div>")) == f"One\n\n{long}\n\nTwo\n\n{other}"
    verse = "".join(f"<p>line {i}</p>" for i in range(9))
    assert html.main_text(PAGE.replace("{main}", f"<div>{verse}<p>{long}</p></div>")).startswith("line 0\n\nline 1\n\n")
    # another part of the page stays away
    teaser = f"<aside><p>a</p><p>b</p><p>c</p></aside><div class='teasers'><p>{other}</p><p>x</p></div>"
    assert html.main_text(PAGE.replace("{main}", f"<div class='content'><p>{long}</p><p>End.</p></div>{teaser}")) == f"{long}\n\nEnd."


def test_names_inside_a_named_part():
    kept = (
        "<section id='discussion'><h2>Discussion</h2><p>We discuss.</p></section><section id='comments'><p>On comments.</p></section><h2 id='related-work'>Related work</h2>"
        "<h2 id='search-and-replace'>Search</h2><div class='section' id='menus'><p>On menus.</p></div><p class='share-price'>The price fell, says <a href='/r'>Reuters</a>.</p><div id='alert-levels'><p>Level 1</p></div>"
    )
    gone = "<div class='share-bar'><a href='/f'>F</a> <a href='/t'>T</a></div><ul class='related-posts'><li><a href='/1'>One</a><li><a href='/2'>Two</a></ul><div id='login-box'><p>Log in</p><input name='u'></div><div class='social'>Like us</div><div class='alert'>Old</div><div class='comments'><p>First!</p></div><div class='ad-slot'>Buy</div>"
    want = "Discussion We discuss. On comments. Related work Search On menus. The price fell, says Reuters. Level 1"
    for tag, end in (("<article>", "</article>"), ("<main>", ""), ("<div role='main' class='search-results'>", "</div>")):
        assert html.main_text(PAGE.replace("{main}", f"{tag}{kept}{end}")).replace("\n\n", " ") == want
        assert html.main_text(PAGE.replace("{main}", f"{tag}{gone}{kept}{gone}{end}")).replace("\n\n", " ") == want
    assert html.main_text("<article><p>x</p><div class='related-links'><a>unclosed") == "x"
