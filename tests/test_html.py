"""The HTML tokenizer: references, attributes, raw elements, odd markup."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convolake.functions.html import attributes, page_text
from convolake.operators import documents as DOC


@pytest.mark.parametrize("page, text", [
    ("a &middot; &#233;&#xE9; &copy; &nbsp;&lt;b&gt; &amp;lt; &bogus; &amp", "a · éé © <b> &lt; &bogus; &"),
    ('<a class="x" href="/q?a=1&amp;b=2">one</a>', "[one](/q?a=1&b=2)"),
    ("<A HREF='/single'>two</A> <a href=/bare>three</a> <a name=x>four</a>", "[two](/single) [three](/bare) four"),
    ('<a title="a > b" href="/x">t</a>', "[t](/x)"),
    ("<a href='/x'>never closed <a href='/y'>y</a>", "never closed [y](/y)"),
    ("<p title='unbalanced>x</p>y", "x\ny"),
    ("<script>if (a<b) document.write('</p>')</script>x<style>p>a{}</style>", "x"),
    ("<head><title>T</title><script>'</head>'</script></head><body>b", "b"),
    ("<head><meta><body>no end of head", "no end of head"),
    ("a<!-- <p> -->b<!-- open", "a b"), ("a<!-- open > tail", "a"),
    ("<h2>Head</h2><ul><li>x<li>y</ul><b>bold</b> <em>it</em>", "## Head\n* x\n* y\n**bold** _it_"),
    ("1 < 2 and <notatag", "1 < 2 and <notatag"), ("", ""), ("\t\n ", "")])
def test_page_text(page, text):
    assert page_text(page)[0] == text


def test_titles_and_attributes():
    assert page_text("<TITLE> A &amp; <b> </TITLE><title>second</title>")[1] == "A & <b>"
    assert attributes(" Href=a href='b' c = \"d>\" e") == {"href": "a", "c": "d>"}


def test_columns(spark):
    df = spark.createDataFrame([("<title>t</title><p>x</p>", "clash"), (None, "clash")], "html string, title string")
    assert [tuple(r) for r in DOC.html_to_text(df).select("text", "title").collect()] == [("t\nx", "t"), (None, None)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "a", " href=", '"', "'", "<p>", "</p>", "&", "&lt;", "&#1;", "<!--", "-->", "<script>", "</script>", "<head>", "\n", "é"]), max_size=30).map("".join))
def test_any_page_parses(page):
    text, title = page_text(page)
    assert text == text.strip() and "\n\n" not in text


def test_long_pages_take_linear_time():
    began = time.process_time()
    for page in ("<p " * 200_000, "<a href='" * 2, "<" * 500_000, "&" * 500_000, "<b>" * 200_000, "x " * 500_000, "\n" * 500_000):
        page_text(page)
    assert time.process_time() - began < 20
