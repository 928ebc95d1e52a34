import html
import time

import pytest

from filigree.functions.html_markdown import _Table, page_markdown, table_lines

PAIRS = {
    "nested lists": (
        "<p>Before<ul><li>one<ul><li>inner a<li>inner b</ul><li>two</ul><ol start=3><li>three</li><li>four<ol><li>deep</ol></ol>after",
        "Before\n\n- one\n  - inner a\n  - inner b\n- two\n3. three\n4. four\n  1. deep\n\nafter",
    ),
    "links": (
        "see <a href='/x y(1)'>the <b>filing</b></a>, <a href='#top'>top</a> and <a href=\"javascript:go()\">go</a> <a name=n>named</a>.",
        "see [the filing](/x%20y(1%29), top and go named.",
    ),
    "entities": ("<p>&eacute;&frac12;&deg;&#151;&#x2019;&nbsp;&nbsp;x &amp;lt; AT&T &bogus; a < b", "é½°—’ x &lt; AT&T &bogus; a < b"),
    "a table with spans and a header": (
        "<table><caption>In millions</caption><thead><tr><th rowspan=2>Item<th colspan=2>Year<tr><th>2023<th>2024</thead>"
        "<tr><td>Net <br>sales<td>1|2<td><a href='n'>3</a><tr><td colspan=3>Total</table>end",
        "In millions\n\n| Item | Year |  |\n| --- | --- | --- |\n|  | 2023 | 2024 |\n| Net sales | 1\\|2 | [3](n) |\n| Total |  |  |\n\nend",
    ),
    "a filing's table with spacer columns": (
        "<div><table><tr><td>Revenue</td><td>&nbsp;</td><td>$</td><td>1,234</td><td> </td></tr><tr><td>Cost</td><td></td><td></td><td>(56)</td></tr></table></div>",
        "| Revenue | $ | 1,234 |\n| --- | --- | --- |\n| Cost |  | (56) |",
    ),
    "a table for layout": ("<table><tr><td><p>Only</p><p>text</p><tr><td>more</table>", "Only text\n\nmore"),
    "a table in a table": ("<table><tr><td>a<td><table><tr><td>x<td>y</table><tr><td>b<td>c</table>", "| a | x y |\n| --- | --- |\n| b | c |"),
    "dropped parts": (
        "<head><title>t</title></head><body><script>if (a<b) '</p>'</script><style>p{}</style><nav><a href=x>n</a></nav>kept<!-- <p>no --> <noscript>no</noscript>too",
        "kept too",
    ),
    "headings": ("<h1>A  <i>b</i></h1>text<h3>C</h3><h2></h2><p>d", "# A b\n\ntext\n\n### C\n\nd"),
    "page breaks": ("one<p style='page-break-before: always'>two<div style=\"break-after:page\"></div>three", "one\n\n\ftwo\n\n\fthree"),
    "quotes and pre": ("<blockquote>said<br>so</blockquote><pre>  a\n   b &lt;\n</pre>x", "> said\n> so\n\n```\n  a\n   b <\n```\n\nx"),
    "definitions": ("<dl><dt>term<dd>meaning<dt>other<dd>more</dl>", "term\nmeaning\nother\nmore"),
    "unclosed": ("<p>one<p>two<li>three<nav>never closed <b>bold", "one\n\ntwo\n\n- threenever closed bold"),
    "attributes with brackets": ("<p title='a > b' data-x=\"<p>\">text</p>o'neil's", "text\n\no'neil's"),
    "nothing": ("", ""),
    "white space": (" \n\t a \r\n b&#10;c ", "a b c"),
}


@pytest.mark.parametrize("name", PAIRS)
def test_hand_written_pages(name):
    page, expected = PAIRS[name]
    assert page_markdown(page) == expected


def test_null_and_all_named_references():
    assert page_markdown(None) is None
    names = sorted(n for n in html.entities.html5 if n.endswith(";") and html.entities.html5[n].strip("\xa0 \t\n  "))
    assert len(names) > 2000
    for name in names:
        assert page_markdown(f"x&{name}y") == f"x{html.entities.html5[name]}y", name


def test_grid_of_overlapping_spans():
    table = _Table()
    table.rows = [[("a", 1, 3), ("b", 2, 1)], [("c", 1, 2), ("d", 1, 1)], [("e", 1, 1)]]
    assert table.grid() == [["a", "b", ""], ["", "c", "d"], ["", "", "e"]]
    assert table_lines([]) == ""


@pytest.mark.parametrize(
    "broken",
    ['<a "x ', "<div>", "<p class='", "<table><tr><td>", "<ul><li>", "<!-- ", "<", "&amp", "<nav>", "<td colspan=99999 rowspan=9999>", "</a><a href=x>", "<![CDATA["],
)
def test_broken_pages_take_time_in_proportion(broken):
    page = broken * (1_000_000 // len(broken))
    begin = time.perf_counter()
    page_markdown(page)
    page_markdown(page + ">text</p>")
    assert time.perf_counter() - begin < 30
