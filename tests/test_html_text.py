import re

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.text import replaced
from quillmesh.operators import html, tables, textops
from quillmesh.operators.html_steps import decoded, rewrite


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_replaced_is_sub(spark):
    for s in ("", "a1b22c", "11", "x", "1"):
        assert one(spark, s, lambda x: replaced(x, r"(\d+)", lambda n: F.concat(F.lit("<"), n, F.lit(">")))) == re.sub(r"(\d+)", r"<\1>", s)
    assert one(spark, None, lambda x: replaced(x, r"(\d)", lambda n: n)) is None


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1> A <b>b</b></h1>", "# A b"),
        ('<a href="/x">L</a>', "[L](https://e.example/x)"),
        ('<a href="#t">L</a><a href="z"></a>', "L"),
        ('<a href="../q">L</a>', "[L](https://e.example/q)"),
        ('<img src="data:x" data-src="https://i.example/r.png">', "![](https://i.example/r.png)"),
        ('<img alt="a" src="//c.example/p.png">', "![a](https://c.example/p.png)"),
        ("<pre><code>a &amp;&amp; b</code></pre>", "```\na && b\n```"),
        ("x <code>1 &lt; 2</code>", "x `1 < 2`"),
        ("<strong> b </strong><i>i</i>", "**b***i*"),
        ("<blockquote>a\n  b</blockquote>", "> a\n> b"),
        ("<ul><li>a</li><li> b </li></ul>", "- a\n- b"),
        ("a<br>b<hr>c", "a\nb\n---\nc"),
        ("&amp;lt; &#65; &#x42; &copy;", "< A B &copy;"),
        ("", ""),
    ],
)
def test_rewrite(page, want):
    assert rewrite(page, "https://e.example/p/q") == want


def test_decoded_order():
    assert decoded("&amp;#39;") == "'" and decoded("&#128512;") == "" and decoded("&#55357;") == "�"


def test_region_and_chrome(spark):
    page = "<body><nav>n</nav><article>a<script>s</script><!-- c -->b</article></body>"
    assert one(spark, page, lambda x: html.without_chrome(html.region(x))) == "ab"
    assert one(spark, "<body>x</body>", html.region) == "x" and one(spark, "plain", html.region) == "plain"


def test_document_rows_are_independent(spark):
    pages = [(i, f"<title> T {i} </title><main><p>{'w ' * i}</p></main>", "https://e.example/") for i in range(20)] + [(20, None, None)]
    df = spark.createDataFrame(pages, "i int, h string, u string")
    together = {r.i: r.d for r in df.select("i", html.document(F.col("h"), F.col("u")).alias("d")).collect()}
    alone = {i: df.where(F.col("i") == i).select(html.document(F.col("h"), F.col("u")).alias("d")).first().d for i in (0, 7, 20)}
    assert together[7].startswith("# T 7\n\nw") and together[20] is None
    assert all(together[i] == d for i, d in alone.items())


def test_text_steps(spark):
    assert one(spark, "a\n\n\n\nb\t\tc\nSign up here\nd", textops.clean_text) == "a\n\nb c\nd"
    assert one(spark, "soft\nwrap.\nnext\n\n\n\nlast", textops.reflowed) == "soft wrap.\nnext\n\nlast"
    assert one(spark, "a\n14\n99\n\nViews\nb\n5\nc", textops.without_metrics) == "a\nb\n5\nc\n"
    assert one(spark, "> 1.9M\n> Views\nx", textops.without_metrics) == "x\n"
    assert one(spark, "😀 body\n- Trending now\nx", textops.cut_at_chrome) == "😀 body\n"
    assert one(spark, "http://\na.b\n/c\nrest", textops.joined_urls) == "http://a.b/crest"
    assert one(spark, "x 12 — next", textops.restored_breaks) == "x\n\n12 — next\n"
    assert one(spark, "code\n. That\nwrote\nabout", textops.merged_lines) == "code\n. That wrote about"
    assert one(spark, "Thanks to these:\nAnna from A\nBert from B\n\nx", textops.colon_lists) == "Thanks to these:\n- Anna from A\n- Bert from B\n\nx"
    assert one(spark, "word " * 20, lambda x: textops.short_name(x, 20)) == "word word word word…"
    assert one(spark, "<!-- i -->\na", textops.without_comments) == "a"
    assert one(spark, None, textops.reflowed) is None


def test_tables(spark):
    df = spark.createDataFrame([([["A", "B"], ["1", "x|y"], ["", ""]],), ([["a", "b", ""], ["c"]],), ([],), ([[""]],)], "r array<array<string>>")
    got = [r.g for r in df.select(tables.grid(F.col("r")).alias("g")).collect()]
    assert got == ["| A | B |\n| --- | --- |\n| 1 | x\\|y |", "| a | b |\n| --- | --- |\n| c |  |", "", ""]
    t = "<table><tr><td colspan=2>C</td></tr><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"
    assert one(spark, t, tables.html_grid) == "**C**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert one(spark, "<table><tr><td>a</td></tr></table>", tables.html_grid) is None
