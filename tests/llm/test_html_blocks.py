from html.parser import HTMLParser

from quantspan.llm import html_blocks
from quantspan.llm.html_blocks import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h2>Site of all things</h2></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies and would like you to accept every one of them.</div>
%s<aside><p>Sidebar text which is rather long as well, but not part of what the page is about.</p></aside>
<section id="comments"><h3>Comments</h3><p>What a fine article, said the reader, and wrote on and on.</p></section>
<footer>&copy; somebody</footer></body></html>"""
BODY = """<h1>The   title &amp; more</h1><p>First paragraph with a <a href=y>link</a>, a <b>bold</b> word and&nbsp;enough text to count.</p>
<form><label>Your address for our letters, please</label></form><div class="ad">Buy now</div>
<p>Second one<br>goes on for a while,
   as paragraphs do &#8211; and ends.</p>"""
WANT = (
    "The title & more\n\nFirst paragraph with a link, a bold word and enough text to count.\n\n"
    "Second one goes on for a while, as paragraphs do – and ends."
)


def test_article_and_plain_page():
    assert main_text(PAGE % f"<article>{BODY}</article>") == WANT
    assert main_text(PAGE % f"<div class='content'>{BODY}</div>") == WANT


class Reference(HTMLParser):
    """The article's blocks by the standard parser, for pages like the given ones."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_blocks.extract(pages).collect()}
    for r in pages.collect():
        parser = Reference()
        parser.feed(r.html)
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_defined_results():
    for page in (None, "", "<p>", "<script>var x", "<div></div>"):
        assert main_text(page) == ""
    assert main_text("only text") == "only text"
    assert main_text("<div class=ad>never closed <p>" + "text that stays " * 20).startswith("text that stays")
    assert main_text("<p>" + "a&lt;b &amp;amp; " * 30 + "</p>").startswith("a<b &amp; a<b")
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(main_text(long)) == 999_999


def test_rows_and_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x", 1), (None, None, "", "x", 2), (3, "u", PAGE % BODY, "x", 3), (3, "u", PAGE % BODY, "x", 3)],
        "page_id bigint, url string, html string, text string, n_chars int",
    )
    got = html_blocks.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, len(WANT), len(WANT)]
    assert html_blocks.extract(pages.limit(0)).count() == 0
