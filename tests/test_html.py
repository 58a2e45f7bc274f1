"""The tokenizer against nested, unclosed and broken markup, and against the standard library's parser on the given pages."""

import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tailorbird.functions.html import elements, selector_steps, take
from tailorbird.operators.frontier import extract_item_urls
from tailorbird.sources.sites import captures_to_signals, selector_signals

DATA = "/root/testdata/sf0.001"


def text(page, selector, rendered=False, what="text"):
    return take(page, {"x": (selector, what)}, rendered)["x"]


@pytest.mark.parametrize(
    "page, selector, pieces, rendered",
    [
        ('<div class="ItemDescription"><div>a</div>b <b>c</b></div>d', ".ItemDescription", "a\nb\nc", "a\nb c"),
        ("<div class=D>x<div>y<div>z</div></div>w</div>no", "div.D", "x\ny\nz\nw", "x\ny\nz\nw"),
        ("<p class=q>one<p>two", ".q", "one", "one"),
        ("<ul><li class=q>one<ul><li>in</ul>out<li>two</ul>", ".q", "one\nin\nout", "one\nin\nout"),
        ("<table class=q><tr><th>a<td>b<tr><td>c</table>d", "table", "a\nb\nc", "a\tb\nc"),
        ("<b class=q>x</i></p>y</b>z", ".q", "x\ny", "xy"),  # ends of nothing are ignored
        ("<div class=q><b><i>x</div>y", ".q", "x", "x"),  # an end closes what is open inside
        ("<div class=q>never closed", ".q", "never closed", "never closed"),
        ("<h1 CLASS='a q'>a&amp;b &lt;c&gt;  d\n e</h1>", "H1.q", "a&b <c>  d\n e", "a&b <c> d e"),
        ("<!-- <b class=q>no</b> --><b class=q>yes</b>", ".q", "yes", "yes"),
        ("<script>'<b class=q>no</b>'</script><b class=q>y<style>p{}</style>es</b>", ".q", "y\nes", "yes"),
        ('<a title="> class=q">no</a><a class=q>yes</a>', ".q", "yes", "yes"),
        ("<a class='q>broken <b class=r>x</b>", ".r", "x", "x"),
        ("<title>t <b>u</title>v", "title", "t <b>u", "t <b>u"),
        ("a < b <b class=q>c</b>", ".q", "c", "c"),
        ("<p id=x data-testid=price>1</p>", "[data-testid=price]", "1", "1"),
        ("<div id=x><p><b>1</b></p></div><b>2</b>", "#x b", "1", "1"),
        ("<b>2</b><div id=x><b>1</b></div>", "i, #x b", "1", "1"),
        ("text alone", "body", "text alone", "text alone"),
        ("", "body", "", ""), ("<b>", "b", "", ""), ("<br class=q>x", ".q", "", ""),
    ],
)
def test_elements_of_broken_pages(page, selector, pieces, rendered):
    assert text(page, selector) == pieces and text(page, selector, True) == rendered


def test_all_elements_and_attributes():
    page = "<img class=I src=1.jpg><p>a<img src='2.jpg?x=1&amp;y=2'></p><img class='x I' SRC=\"3.jpg\"/><img class=I><p>b"
    assert text(page, "img.I", what="@src") == ["1.jpg", "3.jpg"] and text(page, "img", what="@src")[1] == "2.jpg?x=1&y=2"
    assert text(page, "p", what="texts") == ["a", "b"] and text(page, "img[src$='.jpg']", what="@src") == ["1.jpg", "3.jpg"]
    assert text("<p>a<b>b</b></p>", "p, b", what="texts") == ["a\nb", "b"]
    for wrong in ("", "a > b", "p:first", "a,,b"):
        with pytest.raises(ValueError, match="no selector"):
            selector_steps(wrong)


def test_anything_ends_soon():
    r = random.Random(4)
    parts = ["<", ">", "</", "<p", " class=q", "'", '"', "<b>", "</b>", "<!--", "-->", "<script>", "</script>", "x", " ", "<li>", "<td>", "&amp;", "=", "/", "<!"]
    for _ in range(3000):
        take("".join(r.choice(parts) for _ in range(r.randint(0, 40))), {"a": (".q", "texts"), "b": ("body", "text"), "c": ("p", "@class")}, bool(r.randint(0, 1)))
    take("<div>" * 20_000 + "x", {"a": ("div", "text")})
    take("<a b='" * 20_000, {"a": ("a", "text")})


def test_text_of_given_pages_equals_another_parsers():
    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden and data.strip():
                self.parts.append(data.strip())

    for page in pq.read_table(f"{DATA}/pages.parquet")["html"].to_pylist():
        other = Text()
        other.feed(page[page.index("<body>") :])
        other.close()
        assert text(page, "body") == "\n".join(other.parts)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "<div class=A><p>x</div><img src=i>"), (2, None), (3, "")], "k int, h string")
    e = elements(F.col("h"), {"a": (".A", "text"), "i": ("img", "@src"), "p": ("p", "texts")})
    got = {r["k"]: r["e"] for r in rows.select("k", e.alias("e")).collect()}
    assert got[1].asDict() == {"a": "x", "i": ["i"], "p": ["x"]} and got[2] is None and got[3].asDict() == {"a": "", "i": [], "p": []}
    signals = selector_signals(F.col("h"), {"title_text": ".A"}, images="img")
    assert rows.select(*[c.alias(k) for k, c in signals.items()]).collect()[1] == ("", [])


def test_links_and_fallbacks_of_loose_markup(spark):
    html = "<!-- <a href=/item/m9> --><A HREF=/item/m1>x</A><a class='y' href='/item/m2?a=1&amp;b=2'>z</a><script>'<a href=\"/item/m8\">'</script>"
    d = spark.createDataFrame([(html,)], "html string")
    assert [r["url"] for r in extract_item_urls(d, "mercari").collect()] == ["https://jp.mercari.com/item/m1", "https://jp.mercari.com/item/m2"]
    page = "<body><h1>無地 <span>スーツ<b>!</b></span></h1><div class=ItemPrice><span>¥</span><b>6,699</b></div>送料込み<img src=https://static.mercdn.net/1.jpg><img src=other.jpg></body>"
    rows = spark.createDataFrame([("https://jp.mercari.com/item/m2", page)], "url string, html string").withColumn("retrieved_at", F.current_timestamp())
    got = captures_to_signals(rows).first()
    assert got["title_text"] == "無地 スーツ !" and got["price_text"] == "即決 6,699円\n送料込み" and got["image_urls"] == ["https://static.mercdn.net/1.jpg"]
