import html
import html.entities
import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from corpusloom.functions import html as page
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "template", "rt", "rp"}


class Collector(HTMLParser):
    """Ground truth for well-formed markup: text nodes outside hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.nodes.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN
        self.nodes.append("")

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.nodes[-1] += data


def truth(markup):
    parser = Collector()
    parser.feed(markup)
    parser.close()
    return "\n".join(node.strip() for node in parser.nodes if node.strip())


CASES = [
    "<html><head><title>T</title><style>p{x:1}</style></head><body><h1>H</h1><p>one</p><p>two</p></body></html>",
    "a<!-- no <script> --> b <script>var x = '</p><!--';</script>c",
    "<p>x<!-- <b>gone</b> -->y</p>",
    '<a title="1 > 0" href=\'x>y\'>link</a> tail',
    "&amp;lt; &lt;b&gt; &copy; &middot; &eacute; &#233; &#xE9; &notit; &unknown; AT&T a & b &amp",
    "a < b and 3 <4 but <i>c</i>",
    "<p>left <b>open <p>next</p>",
    "  \n\t ",
    "",
    "plain",
    "<!DOCTYPE html><?xml version='1.0'?><p>\xa0x </p>",
    "<script type='x'>if (a<b) {}</SCRIPT >after",
    "<TEMPLATE><p>hidden</p></TEMPLATE>shown<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>",
    "<ruby>a<rt>b<b>c</b></rt></ruby><template>x<i>y</i>\n</template>d",
    "<scripted>shown</scripted><style-x>too</style-x>",
    "<br/><hr /><img src=a.png alt='x'/>z",
    "<p\nclass='a'\n>multi\nline</p>",
]


@pytest.mark.parametrize("markup", CASES)
def test_text_of_small_pages(evaluate, markup):
    assert evaluate([markup], page.html_text) == [truth(markup)]


def test_text_of_the_given_pages(spark):
    source = "/root/testdata/sf0.01/pages.parquet"
    rows = spark.read.parquet(source).select("page_id", page.html_text(F.col("html")).alias("t")).collect()
    given = {r["page_id"]: truth(r["html"]) for r in pq.read_table(source).to_pylist()}
    assert {r.page_id: r.t for r in rows} == given


def test_unclosed_constructs(evaluate):
    assert evaluate(["a<script>b", "a<style>b", "a<!-- b"], page.html_text) == ["a", "a", "a"]


def test_character_references_agree_with_the_library(evaluate):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    values = [f"x&{n}y" for n in rng.sample(names, 300)] + [f"&{n.rstrip(';')}" for n in rng.sample(names, 200)]
    values += [f"&#{n};" for n in [0, 1, 9, 10, 13, 65, 127, 128, 129, 150, 159, 160, 233, 55296, 65534, 64976, 128512, 1114111, 1114112, 99999999999]]
    values += ["&#x1F600;&#X41", "&#;", "&#x;", "&;", "&&amp;&", "&amp;amp;", "&ampx", "&notin;&notit;", "&#65a", "&#0065;"]
    values += ["&eacute", "&lt", "&Lt;", "a&b=c&copy=1", "&nbsp;&#160;"]
    assert evaluate(values, page.decode_references) == [html.unescape(v) for v in values]


def test_elements_in_reading_order(evaluate):
    markup = """<head><title> T &amp; x </title></head><body><h1>Head<br>ing</h1><p>one <b>bold</b></p>
      <ul><li>first</li><li><a href="x">second</a><ol><li>inner</li></ol></li></ul><h2>Next</h2><p>open<p>closed</p>
      <table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr><tr></tr></table>after
      <table><tr><td>only</td></tr></table></body><!-- <h1>no</h1> -->"""
    found = [tuple(e) for e in evaluate([markup], page.html_elements)[0]]
    assert found == [
        ("title", "T & x"), ("h1", "Heading"), ("p", "one bold"), ("h2", "Next"), ("p", "open"), ("p", "closed"),
        ("li", "first"), ("li", "second"), ("li", "inner"),
        ("table", ""), ("row", "A | B"), ("row", "1 | "), ("table", ""), ("row", "only"),
    ]


def test_outline(evaluate):
    markup = "<title>T</title><h1>H</h1><p>p</p><ul><li>i</li></ul><table><tr><td>a</td><td>b</td></tr></table>"
    rule = "=" * 40
    assert evaluate([markup], page.html_outline) == [f"Title: T\n\n\nH\n{rule}\n\np\n• i\n\nTable:\na | b"]


def test_references(spark, evaluate):
    markup = """<img src="a/b.png"><img alt='>' src='/root.png'/><IMG SRC=http://h/x.png><img data-src="no" src="data:x">
      <img src=""><img alt="x"><!-- <img src="gone.png"> --><image src="other"><img src="q?a=1&amp;b=2">
      <img width=10 src="x.png" title=' src="no" '><img src = sp.png><img title="src=no">"""
    found = evaluate([markup], page.html_references)[0]
    assert found == ["a/b.png", "/root.png", "http://h/x.png", "data:x", "q?a=1&b=2", "x.png", "sp.png"]
    assert evaluate(found, page.is_local_reference) == [True, True, False, False, True, True, True]
    resolved = evaluate(found[:2], lambda c: page.resolve_reference(c, F.lit("site/p")))
    assert resolved == ["site/p/a/b.png", "/root.png"]


def test_large_and_hostile_pages_stay_linear(evaluate):
    many = "<p " + " ".join(f'a{i}="{i}"' for i in range(20000)) + ">x</p>"
    data = '<img src="data:' + "A" * 3_000_000 + '">y'
    opens = "<script>" * 20000
    angle = "<" * 50000 + "z"
    quotes = "<a b=\"" * 300 + "t"
    found = evaluate([many, data, opens, angle, quotes], lambda c: F.length(page.html_text(c)))
    assert found[:4] == [1, 1, 0, 50001]
    ruby = "<ruby>" + "<rt>kan " * 20000 + "</ruby>"
    hidden = "<template>" + "<p>x " * 50000 + "</template>y"
    assert evaluate([ruby, hidden], lambda c: F.length(page.html_text(c))) == [79999, 1]
    assert evaluate([many], lambda c: page.html_references(c, "p", "a19999")) == [["19999"]]
    assert evaluate([many, opens], lambda c: F.size(page.html_elements(c))) == [1, 0]


def test_markup_inside_attributes_is_no_markup(evaluate):
    markup = '<p title="<li>no</li> <p>no">yes <b data-x="</p>">bold</b></p><td>\x01stray\x02</td>'
    assert [tuple(e) for e in evaluate([markup], page.html_elements)[0]] == [("p", "yes bold")]
    assert evaluate([markup], page.html_text) == ["yes\nbold\n\x01stray\x02"]
