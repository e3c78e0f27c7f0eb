import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import detect, identity

KINDS = {
    "https://www.youtube.com/watch?v=abcdefghijk": "youtube",
    "https://youtu.be/abcdefghijk": "youtube",
    "https://m.youtube.com/shorts/abcdefghijk": "youtube",
    "https://www.youtube.com/embed/abcdefghijk?x=1": "youtube",
    "https://www.youtube.com/playlist?list=x": None,
    "https://m.youtube.com/playlist?list=x": "html",
    "https://e.example/a.PDF?x=1": "pdf",
    "/tmp/a.pdf": "pdf",
    "https://e.example/a?f=b.pdf": "html",
    "a.docx?x": "docs",
    "https://e.example/b.PPTX": "docs",
    "notes.markdown": "text",
    "https://e.example/notes.md": "html",
    "pic.tif": "image",
    "https://e.example/p.webp": "image",
    "https://e.example/": "html",
    "junk": None,
    "": None,
}


def test_kinds(spark):
    df = spark.createDataFrame([(k, v) for k, v in KINDS.items()] + [(None, None)], "raw string, want string")
    got = detect.detected(df).collect()
    assert [(r.raw, r.kind) for r in got] == [(r.raw, r.want) for r in got]
    assert {r.exit_code for r in got if r.kind is None} == {30}


def test_video_ids_and_forced(spark):
    df = spark.createDataFrame([("https://www.youtube.com/watch?list=a&v=abcdefghijk",), ("https://youtube.com/watch?v=short",), ("https://youtube.com:80/watch?v=abcdefghijk",)], "raw string")
    got = df.select(detect.video_id(F.col("raw")).alias("v"), detect.forced(F.col("raw"), "pdf").alias("c"), detect.forced(F.col("raw"), "none").alias("u")).collect()
    assert [r.v for r in got] == ["abcdefghijk", None, None]
    assert {r.c for r in got} == {11} and {r.u for r in got} == {2}


def plain_slug(title, most=80):
    s = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    s = "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())
    if len(s) > most:
        s = s[:most]
        s = s[: s.rindex("-")] if s.find("-") > 0 else s
    return s.rstrip("-")


@pytest.mark.parametrize("most", [80, 12])
def test_slug_equals_plain_python(spark, most):
    titles = ["Hello, World!", "Ünïcödé — Straße", "ﬁne ½ ™ … ①", "日本語", "a" * 100, "word " * 30, "--x--", "", "Ångström Øre", "Tiếng Việt", "Ἀθῆναι x", "ＦＵＬＬ width"]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", identity.slug(F.col("t"), most).alias("s")).collect()
    assert {r.t: r.s for r in got} == {t: plain_slug(t, most) for t in titles}


def test_collisions_keep_order(spark):
    rows = [(1, "s", "aaaaaaaa1"), (2, "s", "aaaaaaaa2"), (3, "s", "aaaaaaaa3"), (4, "", "id4"), (5, "t", "x")]
    got = identity.disambiguated(spark.createDataFrame(rows, "ord int, slug string, source_id string")).collect()
    assert {r.ord: r.final_slug for r in got} == {1: "s", 2: "s--aaaaaaaa", 3: "s--aaaaaaaa3", 4: "id4", 5: "t"}


def test_titles(spark):
    rows = [("## A title\nx",), ("#\nnext",), ("\n\n  \n",), ("| a |\n<!-- c -->\n**Bold**\n",), (None,)]
    got = spark.createDataFrame(rows, "b string").select(*[f(F.col("b"), F.lit("fb")).alias(n) for n, f in (("p", identity.page_title), ("t", identity.text_title), ("s", identity.scan_title))]).collect()
    assert [r.p for r in got] == ["A title", "next", "fb", "| a |", "fb"]
    assert [r.t for r in got] == ["A title", "fb", "fb", "| a |", "fb"]
    assert [r.s for r in got][3] == "Bold"


def test_probe_login_disposition(spark):
    row = spark.range(1).select(
        detect.probed(F.lit("https://e.example/x"), F.lit("application/pdf; q=1")).alias("a"), detect.probed(F.lit("https://e.example/x.CSV")).alias("b"), detect.probed(F.lit("https://arxiv.org/abs/1")).alias("c"),
        detect.is_login_wall(F.lit("Sign in Sign up")).alias("d"), detect.is_login_wall(F.lit("sign in Sign up")).alias("e"), detect.named_in(F.lit("attachment; filename*=UTF-8''a%20b.pdf")).alias("f"),
    ).first()
    assert (row.a.source_type, row.a.ext) == ("paper", "pdf") and row.b.mime == "text/csv" and row.c.ext == "pdf"
    assert row.d and not row.e and row.f == "a b.pdf"
