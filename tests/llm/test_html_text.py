import random

import pytest

from verdigris.llm import html_text
from verdigris.llm.html_text import render

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>": "- x\n- y\n\n  - z\n- w",
    "<ol start=9><li>i<li>j<li value=3>k</ol>": "9. i\n10. j\n3. k",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<table><tr><th>name<th>n<tr><td>a long one<td>1<td>!</table>": "name        n\na long one  1  !",
    "<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>": "ab     c\nd   e  f",
    "<table><td>漢字<td>x<tr><td>a<td>y</table>": "漢字  x\na     y",
    "<table><tr><td>1<br>2<td>z</table>": "1  z\n2",
    "<p>a<table><tr><td>b</table>c": "a\n\nb\n\nc",
    "<head><title>T</title><style>p{}</style></head><script>var t='</p>';</script>x": "x",
    "<script>a</scripty>b": "",
    "<p hidden>no<p style='display : none'>no<p aria-hidden=true>seen<p>yes": "seen\n\nyes",
    "<div style='visibility:hidden'>no<b>no</b></div>yes": "yes",
    "<noscript>no</noscript><template><p>no</template>yes": "yes",
    "<svg><title>no</title><defs><text>no</text></defs><g><text>in the image</text></g></svg>yes": "in the image\nyes",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "x=1",
    "<pre>  a\n    b</pre>c": "  a\n    b\n\nc",
    "a <b>b</b> <i> c</i>d": "a b cd",
    "<p>a</b></div></p>b": "a\n\nb",
    "x < y and <b>z": "x < y and z",
    "<p title='it>'>q</p><p title=it's>r</p>": "q\n\nr",
    "<!-- no --><![CDATA[no]]><!doctype html>yes<!-- open": "yes",
    "<a href=x>link</a> <img alt='pic' src=y>": "link pic",
    "<blockquote><p>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "&nbsp;&copy;&#233;&bogus;": " ©é&bogus;",
    "<b>unclosed": "unclosed",
    "</p>x": "x",
    "<select><option>first<option selected>chosen<option>no</select><textarea>so\nit is</textarea>yes": "chosen\nso\nit is\nyes",
    "<select multiple><optgroup label=g><option>a<option>b</select>": "g\na\nb",
    "<input value=v> <input type=submit> <input type=hidden value=no><input type=checkbox value=no><input placeholder=p><button>b</button>": "v Submit pb",
    "<ol reversed><li>x<li>y</ol>": "2. x\n1. y",
    "<ol type=a start=26><li>x<li>y</ol><ol type=I><li>p<li value=9>q</ol>": "z. x\naa. y\n\nI. p\nIX. q",
    "<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>": "A  b\n   c\nd  e",
    "<table><tr><td>a<td rowspan=2 colspan=2>big<td>x<tr><td>b<td>y</table>": "a  big    x\nb         y",
    "<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>": "a  b\nc  d",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>": "a  b\n   c\n   d",
    "<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p>": "yes",
    "<style>.h, #i{display:none} p{visibility:hidden}</style><div class='a h'>no</div><div id=i>no</div><p>no</p>yes": "yes",
    "<style>/* .x{ */ @media print{.y{display:none}} .h{display:none} div.z{display:none}</style><p class=y>1<p class=z>2<b class=h style='display:inline'>3</b>": "1\n\n23",
    "<style media=print>p{display:none}</style><p>yes<style>.s{display:block}</style><p hidden class=s>too": "yes\n\ntoo",
}


@pytest.mark.parametrize("source", CASES)
def test_render(source):
    assert render(source) == CASES[source]


def test_deep_and_long_pages():
    assert render("<div>" * 5000 + "x").strip() == "x"
    assert render("<b>" * 5000 + "x" + "</b>" * 5000) == "x"
    assert len(render("<p>word " * 20_000).split()) == 20_000
    assert render("<" * 3000).count("<") == 3000


@pytest.mark.parametrize("depth", [300, 20_000])
def test_elements_below_many_open_ones(depth):
    for tag in ("div", "font", "b"):
        deep = f"<{tag}>" * depth
        assert render(deep + "<script>var a;</script><style>p{}</style>x").strip() == "x"
        assert render(deep + "<p hidden>no<b>no</b></p><div style='display:none'>no</div>x").strip() == "x"
        assert render(deep + "<ul><li>x<li>y</ul>z").strip() == "- x\n- y\n\nz"
        assert render(deep + "<table><tr><td>a<td>b<tr><td>cc<td>d</table>").strip() == "a   b\ncc  d"
        assert render(f"<p hidden>{deep}no</p>" if tag == "b" else f"<section hidden>{deep}no</section>").strip() == ""
    # The end tags of deep elements don't end outer ones of the same name.
    assert render("<div hidden>" + "<div>" * depth + "</div>" * depth + "no</div>x") == "x"
    assert html_text._title(html_text.parse("<div>" * depth + "<title>t</title>")) == "t"


def test_deep_pages_take_time_in_proportion():
    assert render("<p><td>" + "<div>" * 100_000 + "</i></section>" * 50_000 + "x").strip() == "x"


def visible_words(source):
    """By another way: drop what is hidden in the given pages, then all tags."""
    import html
    import re

    source = re.sub(r"<!--.*?-->", " ", source, flags=re.S)
    source = re.sub(r"<(script|style|title)\b.*?</\1>", " ", source, flags=re.S | re.I)
    block = r"</?(?:p|div|li|ul|nav|article|footer|h\d|body|html|head|br|td|tr|table)\b[^>]*>"
    source = re.sub(r"<[^>]*>", "", re.sub(block, " ", source))
    return [w for w in html.unescape(source).split() if w != "-"]


def test_pages_keep_all_visible_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {row.page_id: row.html for row in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    for row in got:
        assert [w for w in row.text.split() if w != "-"] == visible_words(rows[row.page_id] or "")
        assert row.title and row.title not in ("", None)


def test_odd_rows(spark):
    kind = "page_id long, url string, html string, text string, title string"
    rows = [(1, "u", None, "x", "y"), (None, None, "<title>A  b</title>c", "x", "y"), (2, "u", "", "", ""), (2, "u", "", "", "")]
    got = html_text.extract(spark.createDataFrame(rows, kind)).collect()
    assert sorted((row.page_id or 0, row.title, row.text) for row in got) == [(0, "A b", "c"), (1, "", ""), (2, "", ""), (2, "", "")]
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0


def placed(rows):
    """By another way: where the cells of a table (text, colspan, rowspan) lie, by filling a grid of taken slots."""
    taken, grid = set(), {}
    for y, row in enumerate(rows):
        x = 0
        for text, across, down in row:
            while (x, y) in taken:
                x += 1
            grid[x, y] = text
            taken |= {(x + i, y + j) for i in range(across) for j in range(down)}
            x += across
    return grid


def test_cells_stand_where_a_grid_puts_them():
    draw = random.Random(4)
    for _ in range(200):
        rows = [
            [(draw.choice(["a", "bb", "ccc"]) + str(draw.randrange(99)), draw.randint(1, 3), draw.randint(1, 3)) for _ in range(draw.randint(1, 4))]
            for _ in range(draw.randint(1, 5))
        ]
        source = "<table>" + "".join(
            "<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}" for t, a, d in row) for row in rows
        )
        grid = placed(rows)
        columns = 1 + max(x for x, _ in grid)
        widths = [max([len(t) for (x, _), t in grid.items() if x == k], default=0) for k in range(columns)]
        lines = ["  ".join(grid.get((x, y), "").ljust(widths[x]) for x in range(columns)).rstrip() for y in range(len(rows))]
        assert render(source + "</table>") == "\n".join(lines).strip("\n")
