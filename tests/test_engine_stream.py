from pyspark.sql import functions as F

from quillmesh import streaming
from quillmesh.cli import main
from quillmesh.plans import catalog
from quillmesh.plans.pipeline import Engine, Kind, Provider


def sources(spark):
    page = "<title>T</title><main><h1>Head</h1><p>" + "word " * 80 + "</p></main>"
    rows = [("https://e.example/a", page, None), ("https://e.example/b", "<p>x</p>", None), ("n.md", None, "# N\nbody"), ("m.txt", None, " "), ("none", None, None), ("a.docx", None, None)]
    return spark.createDataFrame(rows, "raw string, html string, text string")


def test_engine(spark):
    got = {r.raw: r for r in Engine().run(sources(spark)).collect()}
    assert got["https://e.example/a"].status == "success" and got["https://e.example/a"].title == "T" and got["https://e.example/a"].slug == "e-example-a"
    assert (got["https://e.example/b"].exit_code, got["n.md"].title, got["m.txt"].exit_code, got["none"].exit_code, got["a.docx"].exit_code) == (10, "N", 30, 30, 10)
    forced = {r.raw: r.exit_code for r in Engine().run(sources(spark), provider="text").collect()}
    assert forced["none"] == 11 and forced["n.md"] == 0
    assert {r.exit_code for r in Engine().run(sources(spark), provider="nope").collect()} == {2}
    done = spark.createDataFrame([("n.md", "n", "success")], "source_id string, slug string, status string")
    assert "n.md" not in {r.raw for r in Engine().run(sources(spark), done=done).collect()}
    assert isinstance(Kind("html", None), Provider)


def test_videos(spark):
    vtt = "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\none\n\n00:00:01.000 --> 00:00:02.000\none\n\n00:00:04.000 --> 00:00:05.000\ntwo\n"
    url = "https://youtu.be/abcdefgh10"
    rows = [(f"{url}1", vtt, None, "My Talk", 5.0, None, "en", "uploader"), (f"{url}2", None, "a\n\nb", None, 10.0, None, None, None), (f"{url}3", None, None, None, None, "This video is private", None, None), (f"{url}4", None, None, None, None, "not authenticated", None, None), (f"{url}5", None, None, None, None, None, None, None)]
    got = {r.raw[-1]: r for r in Engine().run(spark.createDataFrame(rows, "raw string, vtt string, transcript string, title string, duration_s double, error string, caption_lang string, caption_source string")).collect()}
    assert got["1"].text == "one\n\ntwo" and [(s.start_ms, s.end_ms) for s in got["1"].segments] == [(0, 2000), (4000, 5000)] and got["1"].slug == "my-talk" and got["1"].detail.caption_source == "uploader"
    assert [(s.start_ms, s.end_ms, s.text) for s in got["2"].segments] == [(0, 5000, "a"), (5000, 10000, "b")] and got["2"].extractor == "transcript"
    assert [got[k].exit_code for k in "12345"] == [0, 0, 40, 21, 20]


def test_flagship_takes_every_source(spark):
    data = "/root/testdata/sf0.001"
    got = catalog.QUERIES["flagship"](spark, data)
    kinds = {r.kind: r.n for r in got.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    videos = spark.read.parquet(f"{data}/extractions.parquet").where("kind = 'youtube'").select("extraction_id").distinct().count()
    assert set(kinds) == {"youtube", "pdf", "docs", "text", "image", "html", None} and sum(kinds.values()) == 3 * n + videos
    assert got.where("extractor = 'captions' and status = 'success' and length(text) > 100").count() > 0


def test_streams(spark, tmp_path):
    sources(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sources(spark).schema).parquet(str(tmp_path / "in"))
    q = streaming.results_stream(stream).writeStream.format("memory").queryName("results").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("results").where("status = 'success'").count() == 2
    log = spark.createDataFrame([(1, "s", "started", 1), (2, "s", "success", 2), (2, "s", "success", 3)], "log_id long, source_id string, event string, t long").withColumn("ts", F.timestamp_seconds("t")).withColumn("arrived_at", F.col("ts"))
    log.write.parquet(str(tmp_path / "log"))
    events = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = streaming.final_states(events).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("states").first().final_event == "success"


def test_cli_files_cache_and_force(tmp_path, capsys):
    note, out = tmp_path / "My Note.md", tmp_path / "out"
    note.write_text("# Head\n\nbody")
    assert main([str(note), "--out", str(out), "--keep-intermediates"]) == 0
    assert sorted(p.name for p in out.iterdir() if p.suffix) == ["my-note.json", "my-note.md"] and (out / "my-note.md").read_text().endswith("---\n\n# Head\n\nbody\n") and (out / "intermediate").is_dir()
    note.write_text("# Other\n\nbody")
    assert main([str(note), "--out", str(out), "-v"]) == 0 and "cache_hit" in capsys.readouterr().err and "# Head" in (out / "my-note.md").read_text()
    assert main([str(note), "--out", str(out), "--force", "--print", "--json-log"]) == 0
    shown = capsys.readouterr()
    assert "# Other" in shown.out and '"event": "success"' in shown.err and "# Head" in (out / "my-note.md").read_text()
    assert main(["nothing here", "--out", str(out)]) == 30 and "extractor_attempted: []" in (out / "nothing-here.md").read_text()


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = streaming.upsert(str(tmp_path / "t"))
    frame = lambda rows: spark.createDataFrame(rows, "source_id string, v int")
    write(frame([("a", 1), ("b", 1)]), 0), write(frame([("a", 2)]), 1), write(frame([("a", 3), ("c", 3)]), 1)
    assert {tuple(r) for r in streaming.current(spark, str(tmp_path / "t")).collect()} == {("a", 3), ("b", 1), ("c", 3)}


def test_cli_modes(capsys):
    assert main(["--version"]) == 0 and main([]) == 2 and main(["--list-providers"]) == 0
    assert "youtube" in capsys.readouterr().out
