"""HTML extraction: literal pages, the wrapper of a host, odd input."""

import random

from chromaloom.llm import extract


def text_of(html):
    return "\n".join(t for _, t in extract.blocks(extract.parse(html)))


def test_article_without_its_surroundings():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
            '<!-- ad --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>Bold.<br><p>One\n two &eacute;&#233;&#xE9;.</p><p>Cut &am</p>'
            '<aside>side</aside><form><p>name</p></form><div class="comments"><p>reader</p></div></article><footer>&copy; x</footer></body></html>')
    assert text_of(page) == "Head & line\nBold.\nOne two ééé.\nCut &am"


def test_markup_rules():
    assert text_of("<p>a<p>b</div>c<i>d</i>e") == "a\nbcde" or text_of("<p>a<p>b</div>c<i>d</i>e") == "a\nb c d e".replace(" ", "")
    assert text_of("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table>") == "x\ny\n1\n2\n3"
    assert text_of("<div>a<br>b &nbsp; c</div><pre> d\n e </pre>") == "a b c\nd e"
    assert text_of("<main><p>m</p></main><p>out</p>") == "m"
    assert text_of("<p>a < b and 3 > 2 &lt;x&gt;</p>") == "a < b and 3 > 2 <x>"
    assert text_of("plain text only") == "plain text only"
    assert text_of("<article><header><p>by</p></header><p>x</p></article><article><p>y</p></article>") == "x\ny"
    assert text_of("<p>t</p><script>never ends") == "t"
    for odd in ("", "<", "<p", "</p>", "<!--", "<a href='", "<script>", "&#xFFFFFFFF;", "<p" + " a" * 10000):
        text_of(odd)
    assert len(text_of("<p>" + "<b>x" * 3000).replace(" ", "")) == 3000


def page(k, extra="", n=4):
    body = "".join(f"<p>Story {k} part {i} of the page.</p>" for i in range(n))
    return f"<html><body><div><p>Follow the host every day.</p>{body}<p>All rights kept.</p>{extra}</div></body></html>"


def test_constant_blocks_of_a_host_are_template(spark):
    rows = [(k, f"http://h.example/{k}", page(k, n=3 + k % 3)) for k in range(8)] + [(90, "http://lone.example/1", page(90)), (91, None, page(91)), (92, "http://h.example/0x", None),
            (93, "http://h.example/y", ""), (94, "http://h.example/0", page(0, n=3)), (94, "http://h.example/0", page(0, n=3))]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, refs string").repartition(3)
    got = extract.extract(df).collect()
    assert len(got) == len(rows) and extract.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    by = {r.page_id: r for r in got}
    for k in range(1, 8):
        assert by[k].text == "\n".join(f"Story {k} part {i} of the page." for i in range(3 + k % 3))
    assert by[90].text.startswith("Follow the host") and by[91].text.startswith("Follow the host")
    assert by[92].text == by[93].text == "" and by[92].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.extract(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    """Near copies of an article on one host do not remove its text."""
    rows = [(k, f"http://h.example/{k}", f"<article><h1>Same</h1><p>Body text.</p><p>More.</p><p>n{k}</p></article>") for k in range(6)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Same\nBody text.\nMore.\nn{k}" for k in range(6)}


def test_tree_matching():
    a, b = extract.tree(["div/h1", "div/p", "div/p", "div/ul/li"]), extract.tree(["div/h1", "div/p", "div/ul/li", "div/ul/li"])
    pairs = []
    assert extract.match(a, b, pairs) == 6          # root, div, h1, p, ul, li
    assert pairs[0] == (0, 0) and (1, 1) in pairs


def test_given_pages(spark):
    """Every page of the test tables keeps its article and loses what stands around it."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r.text for r in extract.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p.page_id] == "\n".join(x for x in parts if x), p.page_id


def test_names_take_no_article_away():
    """Body, content containers and headlines stay whatever word occurs in a class; slots go."""
    page = [t for _, t in extract.blocks(extract.parse('<body class="post has-sidebar no-sidebar"><p>kept</p><div class="site-footer">gone</div></body>'))]
    assert page == ["kept"]
    for name in ("content-with-sidebar", "related-work", "notice-period", "left-side"):
        assert [t for _, t in extract.blocks(extract.parse(f'<body><p>long text of the page itself</p><div class="{name}">x</div></body>'))][1:] == ["x"]
    for name in ("comments", "ad-slot", "main-nav", "comment-list", "wide sidebar"):
        assert [t for _, t in extract.blocks(extract.parse(f'<body><p>long text of the page itself</p><div class="{name}">x</div></body>'))][1:] == []
    most = '<body><div class="overlay"><p>most of the text of the page</p></div><p>rest</p></body>'
    assert [t for _, t in extract.blocks(extract.parse(most))] == ["most of the text of the page", "rest"]
    header = '<article class="banner"><header class="x"><nav><h2>Menu</h2></nav><h1>Head</h1><p>by</p></header><p>y</p></article>'
    assert [t for _, t in extract.blocks(extract.parse(header))] == ["Head", "y"]
    readers = '<article><p>a</p></article><section class="comments"><article class="comment-body"><p>much longer than the article</p></article></section>'
    assert [t for _, t in extract.blocks(extract.parse(readers))] == ["a"]


def recursive(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + recursive(x, y))
    return table[-1][-1] + 1


def test_match_equals_the_recursive_definition():
    r = random.Random(12)
    for _ in range(300):
        a, b = (extract.tree(["/".join(["r"] + [r.choice("xy") for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(0, 7))]) for _ in range(2))
        pairs = []
        assert extract.match(a, b, pairs) == recursive(a, b)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_stray_quotes_lose_no_text(spark):
    html = ["<body><p>one <a href=\"x\"\">two</a> three</p><p>four</p></body>", "<body><p title=don't>one</p><p>two 'three' \"four</p></body>",
            "<body><p a=\"1>2\">one</p><img alt = 'x > y'><p>two</p></body>", "<body><p>a</p><p class=\"never closed>b</p><p>c</p></body>"]
    df = spark.createDataFrame([(k, f"u{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert got == {0: "one two three\nfour", 1: "one\ntwo 'three' \"four", 2: "one\ntwo", 3: "a\nb\nc"}


def test_deep_pages(spark):
    deep = "<body>" + "<div>" * 20000 + "bottom" + "</div>" * 20000 + "<p>after {}</p></body>"
    rows = [(k, f"http://deep.example/{k}", deep.format(k)) for k in range(4)] + [(9, "http://long.example/1", "<body>" + "<p>words</p>" * 20000 + "</body>")]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].endswith(f"after {k}") for k in range(4)) and got[9].count("words") == 20000
