import pytest
from jobweave.llm import html_main


def test_furniture_and_blocks():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookieNotice">no</div>
    <main><article><header><h1>T &amp; x</h1><span>by me</span></header><p>One<br>two &lt;b&gt; <i>a</i>b<p>Three&nbsp;&eacute;<ul><li>x<li>y</ul>
    <form><input>Sub</form><div id="comments"><article><p>c</p></article></div><table><tr><td>1<td>2</table></article></main><aside>s</aside><footer>f</footer></body></html>"""
    assert html_main.main_text(page) == "T & x\nOne two <b> ab\nThree é\nx\ny\n1\n2"


def test_pages_without_article():
    assert html_main.main_text('Hi <b>you</b><div>in</div>out<script>"<p>x</p>"</script><nav>n</nav><!-- <p>no</p> --> tail') == "Hi you\nin\nout\ntail"
    assert [html_main.main_text(x) for x in (None, "", "<p", "a < b", "<nav>x</nav>", "</p></div>", "<!--")] == ["", "", "", "a < b", "", "", ""]


def test_deep_and_long_pages():
    assert html_main.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(html_main.main_text("<article><p>" + "word " * 200_000 + "</article>")) == 999_999


def test_repeated_boxes_leave(spark):
    pages = [(i, f"http://site.example/{i}", f"<body><div class='brand'><p>Our shop since 1900</p></div><div class='story'><p>Story {i} {'abc' * i}</p></div></body>") for i in range(12)]
    pages += [(50, "http://alone.example/", "<body><div class='brand'><p>Our shop since 1900</p></div></body>"), (51, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_main.extract(df).collect()}
    assert all(got[i].text == " ".join(f"Story {i} {'abc' * i}".split()) for i in range(12))
    assert got[50].text == "Our shop since 1900" and got[51].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    tree = {r.path: r for r in html_main.style_trees(df).where("host = 'site.example'").collect()}
    assert tree["/body/div.brand"].importance < 0.1 < 0.9 < tree["/body/div.story/p"].importance


def test_copies_of_an_article_stay(spark):
    same = "<body><article><h1>T</h1><div><p>One text</p></div></article></body>"
    df = spark.createDataFrame([(i, "http://site.example/", same) for i in range(6)] + [(9, "http://x/", "<article><p>Só</article>")], "page_id long, url string, html string")
    assert {r.text for r in html_main.extract(df).collect()} == {"T\nOne text", "Só"}


def test_names_alone_remove_nothing(spark):
    pages = {
        "<body><article class='post share-enabled'><h1>T</h1><p>One</p></article></body>": "T\nOne",
        "<body><div class='has-sidebar'><article><p>One</p></article></div></body>": "One",
        "<body><main><div class='page-widget'><article><p>One</p></article></div></main></body>": "One",
        "<article><h2 id='related-work'>Related work</h2><p id='notice'>One</p><section id='discussion'><p>Two</p></section></article>": "Related work\nOne\nTwo",
        "<body><h2 id='http-header-fields'>Fields</h2><div class='with-header'><p>One</p></div><section id='discussion'><p>Two</p></section></body>": "Fields\nOne\nTwo",
    }
    for page, text in pages.items():
        assert html_main.main_text(page) == text, page
    # Low importance takes no box that is or holds the article.
    assert html_main.main_text("<div class='has-sidebar'><article><p>One</p></article></div>", frozenset(["/div.has-sidebar"])) == "One"
    # One line of three new: enough for a box without a name, too little for one named like furniture.
    page = "<body><div class='{}'><p>Our shop since 1900</p><p>Open all day</p><p>Offer {} of today</p></div><div class='story'><p>Story {} told</p></div></body>"
    rows = [(100 * k + i, f"http://h{k}.example/{i}", page.format(name, i, i)) for k, name in enumerate(("plain", "sidebar")) for i in range(12)]
    rows += [(300 + i, f"http://h3.example/{i}", f"<body><div class='has-sidebar'><div class='promo'><ul><li>Buy</li></ul></div><h1>T {i}</h1><p>Story {i}</p></div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Our shop since 1900\nOpen all day\nOffer {i} of today\nStory {i} told" and got[100 + i] == f"Story {i} told" for i in range(12))
    assert all(got[300 + i] == f"T {i}\nStory {i}" for i in range(12))


def test_classless_boxes_are_judged_by_their_place(spark):
    menu = "<div>" + "".join(f"<a href='/{k}'>Item {k}</a> " for k in range(10)) + "</div>"
    def page(host, i):
        story = f"<h1>Title {i}</h1>" + "".join(f"<p>Story {host} {i} {k}</p>" for k in range(3 + (i % 3) * (host == 1) + 40 * (host == 2)))
        listed = f"<ul><li>Point {i}</li></ul>" * (i % 2)
        if host == 3:  # not in a box of its own, with lists here and there
            return f"<body>{menu}{story}{listed}<div>All rights reserved</div></body>"
        return f"<body>{menu}{'<div>Buy now</div>' if i % 2 and host == 1 else ''}<div>{story}{listed}</div><div>All rights reserved</div></body>"
    rows = [(100 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h in range(4) for i in range(12)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(4):
        for i in range(12):
            lines = [f"Title {i}"] + [f"Story {h} {i} {k}" for k in range(3 + (i % 3) * (h == 1) + 40 * (h == 2))] + [f"Point {i}"] * (i % 2)
            assert got[100 * h + i].split("\n") == lines, (h, i)


@pytest.mark.parametrize(("page", "want"), [
    # a stray quote is a character of its tag
    ("<article><p style=\"color:red\"\">One</p><p class=\"x\">Two</p><p it's>Three</p></article>", "One\nTwo\nThree"),
    ("<article><p title = \"a > b\">One</p><p title='>'>Two</p><p title=a>Three</p></article>", "One\nTwo\nThree"),
    # a list of comments, in boxes or articles, within the article or behind it
    ("<article><p>Body</p><section id=\"comments\"><div class=\"comment\"><p>nice post</p></div><div class=\"comment\"><p>agreed</p></div></section></article>", "Body"),
    ("<div class=post><h1>T</h1><p>Body</p></div><div id=comments><article class=comment><p>nice post</p></article></div>", "T\nBody"),
    # a single element of that name is text
    ("<article><section class=\"comment\"><p>A comment on the law</p></section></article>", "A comment on the law"),
    # articles that only tease other pages
    ("<div class=post><h1>T</h1><p>Main body of the page</p></div><div class=teasers><article><h3>Other story</h3></article></div>", "T\nMain body of the page"),
    ("<h1>Blog</h1><article><h2>One</h2><p>A long story of its own.</p></article><article><h2>Two</h2><p>And another one.</p></article>", "One\nA long story of its own.\nTwo\nAnd another one."),
])
def test_quotes_comments_and_teasers(page, want):
    assert html_main.main_text(page) == want
