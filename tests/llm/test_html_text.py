import html
import re

from hazardframe.llm import html_text as ht
from hazardframe.llm.queries import QUERIES


def texts(spark, pages, **options):
    rows = spark.createDataFrame([(i, u, h, "low", "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, low string, host string")
    got = ht.main_text(rows, **options).orderBy("page_id").collect()
    assert all(r.low == "low" and r.host == "x" for r in got)
    return [r.main_text for r in got]


def only(page):
    return "\n".join(t for _, _, t in ht.page_blocks(page))


def test_blocks():
    assert only("<p>a <b>b</b>c<br>d &amp;&lt;&#233;&nbsp;e<p>f<ul><li>g<li>h</ul>tail") == "a bc d &<é e\nf\ng\nh\ntail"
    assert only("<script>var t='</p>';if(a<b){}</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes") == "yes"
    assert only("<nav><ul><li>x</nav><header>h</header><div class='side-bar sidebar'>no</div><footer>f</footer><div id=cookie-notice>c</div><p>ok</div></p>") == "ok"
    assert only("a < b and c > d") == "a < b and c > d"
    assert only("<table><tr><td>1<td>2<tr><th>3</table><div hidden>no</div><div style='display: none'>no</div>") == "1\n2\n3"
    page = "<body><div>before</div><main><header><h1>T</h1></header><p>x<form>f</form><div class=comments><p>bad</div><aside>z</aside></main>after"
    assert [(a, t) for _, a, t in ht.page_blocks(page)] == [(False, "before"), (True, "T"), (True, "x"), (False, "after")]


def test_broken_pages_take_linear_time():
    for page in ("<" * 200000, "<a \"" * 50000, "<!--" * 50000, "</p>" * 50000, "<script>" * 3000, "&" * 100000):
        ht.page_blocks(page)


def test_repeated_branches_of_a_host_are_removed(spark):
    page = lambda i: f"<div class=top>Welcome to our site</div><div class=story><p>Story number {i} is told here.</p><p>Same line.</p></div><div class=end>See you</div>"
    pages = [(f"http://a.com/{i}", page(i)) for i in range(12)] + [("http://b.com/1", page(1)), (None, page(2)), ("http://a.com/x", page(3)), ("http://c.com", None), ("http://c.com", "")]
    got = texts(spark, pages)
    assert got[:12] == [f"Story number {i} is told here.\nSame line." for i in range(12)]
    assert got[12].startswith("Welcome") and got[13].startswith("Welcome") and got[14] == got[3] and got[15:] == ["", ""]


def test_copies_of_an_article_are_not_furniture(spark):
    copy = "<article><h1>Title</h1><p>The same story again.</p></article>"
    other = lambda i: f"<article><h1>Title</h1><p>Story {i}.</p></article>"
    got = texts(spark, [("http://a.com/", copy)] * 40 + [("http://a.com/", other(i)) for i in range(10)])
    assert got[:40] == ["Title\nThe same story again."] * 40 and got[40:] == [f"Title\nStory {i}." for i in range(10)]


def test_importance_is_the_entropy(spark):
    rows = spark.createDataFrame([(f"http://h/{i}", f"<div class=a>{i % 2}</div><div class=b>{i}</div><div class=c>k</div>") for i in range(8)], "url string, html string")
    got = {r.branch: (r.pages, round(r.importance, 6)) for r in ht.style_tree(rows).collect()}
    assert got == {"/div.a": (8, 1.0), "/div.b": (8, 1.0), "/div.c": (8, 1.0)} or got["/div.c"] == (8, 0.0)
    assert ht.style_tree(rows.limit(0)).count() == 0 and ht.main_text(rows.limit(0)).count() == 0


def test_query_matches_a_direct_version(spark):
    sf = "/root/testdata/sf0.01"
    for r in QUERIES["op8_html_text"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_a_wrapper_named_like_furniture_keeps_its_article(spark):
    story = "<article><div class='post-header'><h1>Head</h1></div><p>Long story.</p></article>"
    for around in ("<div class='layout has-sidebar'>{}</div>", "<div class=sidebar>{}</div>", "<form id=f>{}</form>", "<aside>{}</aside>", "<div class=nav><form>{}</form></div>"):
        assert only(around.format(story)) == "Head\nLong story.", around
    assert only("<form action=x><div class=nav-menu>a b</div><div class=text>The whole text of the page.</div><footer>f</footer></form>") == "The whole text of the page."
    assert only("<div class='no-comment'><p>x</p></div><div class=comments>bad</div><div class='share-social'>bad</div><p>y and z and more</p>") == "x\ny and z and more"
    assert only("<div class=nav>" * 2000 + "menu" + "</div>" * 2000 + "<p>text</p>") == "text"
    pages = [(f"http://a.com/{i}", f"<form><div class=has-menu>Page {i}</div><p>Story {i} is told.</p></form>") for i in range(10)]
    assert texts(spark, pages) == [f"Page {i}\nStory {i} is told." for i in range(10)]


def test_named_branches_are_in_the_tree_with_lower_importance(spark):
    page = "<div class=notice>A notice far longer than all that this page has to say.</div><p>Story {}</p><div class=nav>menu</div>"
    pages = [(f"http://a.com/{i}", page.format(i)) for i in range(10)]
    got = {r.branch: (r.pages, round(r.importance, 6)) for r in ht.style_tree(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["/div.notice"] == (10, 0.0) and got["/div.nav"] == (10, 0.0)
    own = spark.createDataFrame([(u, h.replace("menu", u)) for u, h in pages], "url string, html string")
    assert {r.branch: round(r.importance, 6) for r in ht.style_tree(own).collect()}["/div.nav"] == 0.5
    assert texts(spark, pages) == [f"Story {i}" for i in range(10)]
