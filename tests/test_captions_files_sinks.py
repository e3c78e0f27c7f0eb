import io
import zipfile

from pyspark.sql import functions as F

from quillmesh.operators import captions, files, sinks, social
from quillmesh.operators.files import extract_bytes
from quillmesh.plans.pipeline import Engine
from quillmesh.runtime import blocked_last


def test_cues(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:00:00.000 --> 00:00:01.000 align:start\nHello <b>you</b>\nand &amp; me\n\n00:01.100 --> 00:02.000\nHello you and & me\n\n00:03.000 --> 00:04.000\n\n"
    df = spark.createDataFrame([(vtt,), ("",), (None,)], "v string")
    got = [r.c for r in df.select(captions.merged_cues(captions.parsed_cues(F.col("v"))).alias("c")).collect()]
    assert [(s.start_ms, s.end_ms, s.text) for s in got[0]] == [(0, 2000, "Hello you and & me")]
    assert got[1] == [] and got[2] is None


def test_stamps_tracks_slices(spark):
    r = spark.range(1).select(
        captions.stamp_ms(F.lit("1:02:03.004")).alias("a"), captions.stamp_ms(F.lit("x")).alias("b"), captions.iso_day(F.lit("20240506")).alias("c"), captions.whole_ms(F.lit(0.0025)).alias("d"),
        captions.chosen_track(captions.track_list(F.array(F.lit("de")), F.array(F.lit("en"), F.lit("de")))).alias("e"), captions.transcript_slices(F.lit("a\n\nb\n\nc"), F.lit(100)).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e.lang) == (3723004, None, "2024-05-06", 2, "de")
    assert [(s.start_ms, s.end_ms) for s in r.f] == [(0, 33), (33, 66), (66, 100)]


def test_paragraph_gap_is_strict(spark):
    rows = [(1, 0, 0, 1000, "a"), (1, 1, 2500, 3000, "b"), (1, 2, 4501, 5000, "c")]
    got = captions.paragraphs(spark.createDataFrame(rows, "k int, i int, s int, e int, t string"), "k", "i", "t", "s", "e").orderBy("para").collect()
    assert [r.text for r in got] == ["a b", "c"]


def archive(entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, x in entries.items():
            z.writestr(n, x)
    return b.getvalue()


def test_zip_formats():
    slide = lambda t: f'<p xmlns:a="u"><a:t>{t}</a:t></p>'
    pptx = archive({f"ppt/slides/slide{i}.xml": slide(f"s{i}") for i in (10, 2, 1)} | {"docProps/core.xml": '<c xmlns:dc="d"><dc:title>T</dc:title></c>'})
    got = extract_bytes(pptx, "pptx")
    assert [u["text"] for u in got["units"]] == ["s1", "s2", "s10"] and got["title"] == "T"
    xlsx = archive({"xl/workbook.xml": '<w><sheets><sheet name="One"/></sheets></w>', "xl/sharedStrings.xml": "<s><si><t>hi</t></si></s>", "xl/worksheets/sheet1.xml": '<w><c t="s"><v>0</v></c><c><v>5</v></c></w>', "xl/worksheets/sheet2.xml": "<w><c><is><t>in</t></is></c></w>"})
    got = extract_bytes(xlsx, "xlsx")
    assert [(u["label"], u["text"]) for u in got["units"]] == [("One", "| hi | 5 |\n| --- | --- |"), ("Sheet2", "| in |\n| --- |")] and got["text"].startswith("## One\n\n| hi")
    assert extract_bytes(archive({"word/document.xml": slide("w")}), "docx")["text"] == "w"
    assert extract_bytes(archive({"b.xhtml": "<p>two</p>", "a.html": "<p>one  x</p>", "META-INF/c.html": "no"}), "epub")["text"] == "one x\n\ntwo"
    assert extract_bytes(b"junk", "docx")["error"] and extract_bytes(None, "pdf")["error"] and extract_bytes(b"%PDF", "pdf")["error"]


def test_office_structure():
    w = "xmlns:w='w'"
    p = lambda t, st="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{st}{chr(34)}/></w:pPr>' if st else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Name", "Title") + p("Part", "h2") + p("plain") + p("  ") + "<w:tbl>" + row("a", "b|c") + row("1", "") + "</w:tbl>" + p("end")
    docx = archive({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {w}><w:style w:styleId='h2'><w:name w:val='heading 2'/></w:style></w:styles>"})
    got = extract_bytes(docx, "docx")
    assert got["text"] == "# Name\n\n## Part\n\nplain\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n\nend" and got["tier"] == "ooxml" and got["units"] is None
    frame = "<a:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc><a:tc><a:p><a:t>y</a:t></a:p></a:tc></a:tr></a:tbl></a:graphicFrame>"
    slide = f"<a:sld xmlns:a='a'><a:sp><a:txBody><a:p><a:t>one</a:t></a:p><a:p><a:t>two</a:t></a:p></a:txBody></a:sp>{frame}</a:sld>"
    got = extract_bytes(archive({"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": "<a:sld xmlns:a='a'/>"}), "pptx")
    assert got["text"] == "## Slide 1\n\none\ntwo\n\n| x | y |\n| --- | --- |\n\n## Slide 2" and [u["label"] for u in got["units"]] == ["1", "2"]
    sheet = "<w><row><c r='A1' t='b'><v>1</v></c><c r='C1'><v>2.5</v></c></row><row><c r='B2'><v>3</v></c></row></w>"
    assert extract_bytes(archive({"xl/worksheets/sheet1.xml": sheet}), "xlsx")["text"] == "## Sheet1\n\n| True |  | 2.5 |\n| --- | --- | --- |\n|  | 3 |  |"
    assert extract_bytes(archive({"xl/worksheets/sheet1.xml": "<w/>"}), "xlsx")["text"] == ""


def test_engines_travel_to_workers(spark):
    chunks = [{"text": " first ", "metadata": {"page_number": 5}}, {"text": "next", "metadata": {"page": 6}}, {"text": "", "metadata": {}}]
    broken = lambda data: 1 / len(data[:0])
    engines = {"pdf": [lambda data: None, lambda data: {"chunks": chunks, "tier": "pymupdf4llm", "title": "T"}], "png": [lambda data: {"text": "a line\nends here.\nNext", "tier": "ocr", "wrapped": True}], "jpg": [broken]}
    df = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.png", bytearray(b"x")), ("c.jpg", bytearray(b"x")), ("d.pdf", None)], "raw string, content binary")
    got = {r.raw: r for r in Engine(engines=engines).run(df).collect()}
    assert got["a.pdf"].text == "first\n\nnext\n\n" and [s.text for s in got["a.pdf"].segments] == [" first ".strip(), "next"] and [x.page for x in got["a.pdf"].detail.locators] == [5, 7] and got["a.pdf"].detail.structured
    assert got["b.png"].text == "a line ends here.\nNext" and not got["b.png"].detail.structured
    assert got["c.jpg"].exit_code == 10 and "ZeroDivisionError" in got["c.jpg"].error and got["d.pdf"].error == "file not found"


def test_assembled(spark):
    data = archive({"ppt/slides/slide1.xml": "<p><t>x</t></p>", "ppt/slides/slide2.xml": "<p/>"})
    df = spark.createDataFrame([("a", "st", bytearray(data), "pptx"), ("b", "st", bytearray(b""), "md"), ("c", "st", bytearray(b"?"), "docx")], "raw string, stem string, content binary, ext string")
    got = {r.raw: r for r in files.assembled(df.select("raw", "stem", files.extracted_file("content", "ext").alias("file"))).collect()}
    assert got["a"].exit_code == 0 and got["a"].extractor.locators[0].slide == 1 and len(got["a"].segments) == 1
    assert got["b"].exit_code == 30 and got["c"].exit_code == 10


def test_sinks(spark):
    rows = [("success", "html", "u", "id", "T", "s", None, 1500, None, "en", "# x", None, None, None, None, "now"), ("failed", "pdf", "u2", "id2", None, "s2", None, None, None, None, None, None, None, "bad: thing", 10, "now")]
    schema = "status string, kind string, source string, source_id string, title string, slug string, author string, duration_ms long, posted string, language string, text string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, extractor struct<extractor:string>, error string, exit_code int, extracted_at string"
    df = spark.createDataFrame(rows, schema)
    md = sinks.success_markdown(df).first().md
    assert md.startswith("---\nsource: u\n") and "duration_seconds: 2\n" in md and md.endswith("---\n\n# x\n")
    assert '"author":null' in sinks.success_json(df).first().json
    assert "bad: thing" in sinks.failure_stub(df).first().md
    done = spark.createDataFrame([("a--b", "1", "success"), ("c", "2", "failed")], "slug string, source_id string, status string")
    new = spark.createDataFrame([("a", "1"), ("c", "2"), ("a", "9")], "slug string, source_id string")
    assert {(r.slug, r.source_id) for r in sinks.uncached(new, done).collect()} == {("c", "2"), ("a", "9")}
    assert sinks.uncached(new, done, force=True).count() == 3 and sinks.cached(new, done).first().hit_slug == "a--b"


def test_threads(spark):
    items = [("text", "Jane Doe\n@jane\n", None), ("img", None, "u"), ("text", "Headline here\n107\n3.9K\nThe body is a long line that ends in a stop.", None), ("img", None, "v")]
    df = spark.createDataFrame([(items,), ([],), (None,)], "i array<struct<type:string,value:string,url:string>>")
    got = [r.o for r in df.select(social.body_items("i").alias("o")).collect()]
    assert [x.value for x in got[0]][:2] == ["**Headline here**\n", "The body is a long line that ends in a stop.\n"] and got[1] == [] and got[2] is None


def test_blocked_last_equals_plain_fill(spark):
    rows = [("a" if i % 3 else "b", i, i if i % 7 == 0 else None) for i in range(300)] + [("a", None, None), (None, 5, 1)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    for include in (True, False):
        got = {(r.k, r.o): r.f for r in blocked_last(df, ["k"], "o", F.col("v"), "f", block=16, include_self=include).collect()}
        want, last = {}, {}
        for k, o, v in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
            if not include:
                want[k, o] = last.get(k)
            if v is not None:
                last[k] = v
            if include:
                want[k, o] = last.get(k)
        assert got == want
