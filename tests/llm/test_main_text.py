from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, main_text, queries


def text(page):
    return "\n\n".join(main_text.blocks(page)[0])


@pytest.mark.parametrize(("page", "expected"), [
    (None, ""), ("", ""), ("plain  words", "plain words"), ("<p>", ""),
    ("<nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>four</b>&nbsp;five</article><footer>f</footer>", "A & B\n\none two three\n\nfour five"),
    ("<article><p>a</p><aside>side</aside><form>f<input></form><div class='x comments'>c<p>d</p></div><p>b</p></article>", "a\n\nb"),
    ("<main><script>if (a<b) '</p>'</script><style>p{}</style><p>t<!-- no <p>x</p> --></p></main>", "t"),
    ("<article><header><h1>title</h1></header><p>body</p></article>", "title\n\nbody"),
    ("<div class=ad>buy</div><article><p>cut off", "cut off"),
    ("<article><ul><li>x<li>y</ul></article>", "x\n\ny"),
    ("<article><p>1 &lt; 2 &#233;&eacute;&#x1F600;</p></article>", "1 < 2 éé😀"),
    ("<body class='advert page'><div id=cookie-notice>ok?</div><p>kept</p></body>", "kept"),
])
def test_blocks(page, expected):
    assert text(page) == expected


class Plain(HTMLParser):
    """The blocks of the article of a simple page."""

    def __init__(self):
        super().__init__()
        self.blocks, self.part, self.inside = [], [], False

    def cut(self):
        t = " ".join("".join(self.part).split())
        if t and self.inside:
            self.blocks.append(t)
        self.part = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p", "footer"):
            self.cut()
            self.inside = self.inside and tag != "footer" or tag == "article"
        elif tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.cut()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.part.append(data)


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in common.table(spark, sf, "pages").collect()}
    got = queries.QUERIES["op6_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = Plain()
        p.feed(pages[r.page_id].html)
        p.close()
        p.cut()
        assert (r.text, r.n_chars, r.url) == ("\n\n".join(p.blocks), len(r.text), pages[r.page_id].url)


def page(i, own, shared="Terms of use privacy contact imprint jobs press"):
    return f"<body><div>{shared}</div><div>{own}</div><div>Page {i}</div></body>"


@pytest.mark.parametrize("tokens", [1_000_000, 40])
def test_repeats_of_a_host_go(spark, monkeypatch, tokens):
    monkeypatch.setattr(main_text, "HOST_TOKENS", tokens)
    rows = [(i, f"http://a.example/{i}", page(i, f"unique words {i} " + " ".join(f"w{i}x{k}" for k in range(20)))) for i in range(40)]
    rows += [(100, "http://b.example/", page(100, "alone on its host")), (101, None, None), (102, "http://a.example/q", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    assert len(got) == len(rows)
    kept = [i for i in range(40) if "Terms of use" in got[i].text]
    assert not kept
    assert all(f"unique words {i} " in got[i].text for i in range(40))
    assert "Terms of use" in got[100].text and got[101].text == "" and got[102].n_chars == 0
    assert main_text.extract(pages.where("false")).count() == 0


def test_suffix_array_finds_repeats_across_distinct_pages():
    same = "a b c d e f g"
    assert main_text.repeated([[same, "p q"], [same], ["x " + same + " y z w v u t s r q p o n"]]) == [[1.0, 0.0], [1.0], [7 / 20]]
    assert main_text.repeated([[same, same, same], [same]]) == [[0.0, 0.0, 0.0], [0.0]]  # two distinct pages only
    assert main_text.repeated([[], ["a"]]) == [[], [0.0]]


@pytest.mark.parametrize("tokens", [1_000_000, 40])
def test_short_menus_and_half_covered_blocks(spark, monkeypatch, tokens):
    monkeypatch.setattr(main_text, "HOST_TOKENS", tokens)
    menu = "".join(f"<li>{x}</li>" for x in ("Home", "Terms", "Privacy", "Our jobs", "Press", "Contact", "Imprint"))
    notice = "all offers on these pages are without guarantee and may change at any time"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(4))
    long = lambda i: " ".join(f"v{i}x{k}" for k in range(40))
    rows = [(i, f"http://a.example/{i}", f"<body><ul>{menu}</ul><div>{notice} {own(i)}</div><div>{long(i)} {notice}</div></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got == {i: f"{own(i)}\n\n{long(i)}" for i in range(9)}


@pytest.mark.parametrize("page", ["<a " * 400_000, "<a \"" * 300_001, "<a '" * 300_001, "<a " * 300_000 + "'>", "<b>" * 60_000 + "</i>" * 60_000, "<script>" + "</script " * 100_000, "<p>" * 100_000, "<!-- " * 100_000, "&lt" * 100_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    main_text.blocks(page)
    assert time.process_time() - began < 10


def test_head_of_an_article_stays():
    assert text('<article><div class="article-header"><h1>Title</h1></div><p>Body</p><div class="article-share">Share</div></article>') == "Title\n\nBody"
    assert text('<div class="site-header">Site</div><article><p>a<b</p><p x="1>2">c</p><br <p>d</article>') == "a\n\nc\n\nd"


def test_repeated_rows_and_long_pages(spark):
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "http://a.example/", "<article><p>x</p></article>")] * 3 + [(2, None, long), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit("clash"))
    got = sorted((r.page_id or 0, r.n_chars) for r in main_text.extract(pages).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 999_999)]
