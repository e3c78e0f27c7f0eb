"""Timed segments: cue parsing, merging, paragraphs, tracks and video metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import bind, trimmed
from quillmesh.runtime import blocked_last, cut

GAP_MS = 1500
STAMP = r"(?:(\d{1,2}):)?(\d{1,2}):(\d{2})[.,](\d{3})"
SEGMENT = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def stamp_ms(stamp: Column) -> Column:
    """[hours:]minutes:seconds.thousandths as milliseconds, else null."""
    part = lambda g: F.coalesce(F.regexp_extract(stamp, rf"^{STAMP}$", g).try_cast("bigint"), F.lit(0))
    return F.when(stamp.rlike(rf"^{STAMP}$"), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def plain_cue(x: Column) -> Column:
    x = F.regexp_replace(x, "<[^>]+>", "")
    for name, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(name), F.lit(c))
    return trimmed(x)


def parsed_cues(vtt: Column) -> Column:
    """Cues of a caption file as segments; a cue ends at a blank line; empty ones are dropped."""
    blocks = F.split(F.regexp_replace(vtt, r"\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)*\n|^\n+")
    cue = rf"(?m)^\s*((?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}[.,]\d{{3}})\s+-->\s+((?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}[.,]\d{{3}})[^\n]*$"
    body = lambda b: F.regexp_extract(b, rf"(?s){cue}\n?(.*)", 3)
    text = lambda b: F.array_join(F.filter(F.transform(F.split(body(b), "\n"), plain_cue), lambda s: s != ""), " ")
    found = F.transform(F.filter(blocks, lambda b: b.rlike(cue)), lambda b: F.struct(stamp_ms(F.regexp_extract(b, cue, 1)).alias("start_ms"), stamp_ms(F.regexp_extract(b, cue, 2)).alias("end_ms"), text(b).alias("text")))
    return F.filter(found, lambda s: s["text"] != "")


def merged_cues(segments: Column) -> Column:
    """Neighbours of equal text joined: first start, last end. Starts and ends of runs are found by place, in one pass each."""

    def merged(all_: Column) -> Column:
        text = lambda i: F.get(all_, i)["text"]
        place = F.transform(all_, lambda s, i: i)
        starts = F.filter(place, lambda i: (i == 0) | ~text(i - 1).eqNullSafe(text(i)))
        ends = F.filter(place, lambda i: (i == F.size(all_) - 1) | ~text(i + 1).eqNullSafe(text(i)))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(F.get(all_, r["a"])["start_ms"].alias("start_ms"), F.get(all_, r["b"])["end_ms"].alias("end_ms"), text(r["a"]).alias("text")))

    return bind(segments, merged).cast(SEGMENT)


def paragraph_text(segments: Column, gap_ms: int = GAP_MS) -> Column:
    """The cues' texts in paragraphs: a blank line where the pause exceeds gap_ms, else a space."""

    def said(all_: Column) -> Column:
        pause = lambda s, i: F.when(i == 0, "").when(s["start_ms"] - F.get(all_, i - 1)["end_ms"] > gap_ms, "\n\n").otherwise(" ")
        return F.array_join(F.transform(all_, lambda s, i: F.concat(pause(s, i), s["text"])), "")

    return bind(segments, said)


def _runs(df: DataFrame, key: str, order: str, carried: tuple[str, ...], begins) -> DataFrame:
    """Adds __run, the order value at which the run of each row began; begins(row before) says where one does.

    Rows see the one before them and their run's start by fills in blocks of positions, so that
    no task windows a whole long transcript. Order values are whole numbers, unique in a key.
    """
    before = cut(blocked_last(df, [key], order, F.struct(*carried), "__before", include_self=False))
    first = F.col("__before").isNull() | F.coalesce(begins(F.col("__before")), F.lit(False))
    return blocked_last(before.withColumn("__begin", F.when(first, F.col(order))), [key], order, F.col("__begin"), "__run").drop("__before", "__begin")


def merged_rows(df: DataFrame, key: str, order: str, text: str, start: str, end: str) -> DataFrame:
    """As merged_cues on rows."""
    marked = _runs(df, key, order, (text,), lambda last: ~last[text].eqNullSafe(F.col(text)))
    return marked.groupBy(key, "__run").agg(F.min(order).alias(order), F.min(start).alias("start_ms"), F.max_by(end, order).alias("end_ms"), F.first(text).alias("text"), F.count("*").alias("n")).drop("__run")


def paragraphs(df: DataFrame, key: str, order: str, text: str, start: str, end: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Paragraphs (key, para, start_ms, end_ms, text): a new one where the pause exceeds gap_ms. They are numbered after they are made."""
    marked = _runs(df, key, order, (end,), lambda last: F.col(start) - last[end] > gap_ms)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    made = marked.groupBy(key, "__run").agg(F.min(start).alias("start_ms"), F.max_by(end, order).alias("end_ms"), said.alias("text"))
    return made.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__run")) - 1).cast("bigint").alias("para"), "start_ms", "end_ms", "text")


def transcript_slices(text: Column, duration_ms: Column) -> Column:
    """Paragraphs of a transcript given equal shares of its duration; the last ends with it."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n+"), trimmed), lambda p: p != "")
    share = F.floor(duration_ms / F.size(parts)).cast("bigint")
    return F.transform(parts, lambda p, i: F.struct((i * share).alias("start_ms"), F.when(i == F.size(parts) - 1, duration_ms).otherwise((i + 1) * share).alias("end_ms"), p.alias("text")))


def track_list(uploaded: Column, automatic: Column) -> Column:
    """Uploaded languages in order, then automatic ones not among them."""
    named = lambda langs, source: F.transform(langs, lambda x: F.struct(x.alias("lang"), F.lit(source).alias("source")))
    return F.concat(named(uploaded, "uploader"), named(F.array_except(automatic, uploaded), "auto-generated"))


def chosen_track(tracks: Column, preferred: str | None = None) -> Column:
    """Preferred language, else English by the uploader, uploader, English, any; the first of each; null if none."""
    pick = lambda test: F.try_element_at(F.filter(tracks, test), F.lit(1))
    ways = [lambda t: (t["lang"] == "en") & (t["source"] == "uploader"), lambda t: t["source"] == "uploader", lambda t: t["lang"] == "en", lambda t: F.lit(True)]
    if preferred is not None:
        ways.insert(0, lambda t: t["lang"] == preferred)
    return F.coalesce(*[pick(w) for w in ways])


def chosen_track_rows(tracks: DataFrame, key: str, order: str) -> DataFrame:
    """As chosen_track on rows (key, order, lang, source)."""
    rank = F.when((F.col("lang") == "en") & (F.col("source") == "uploader"), 0).when(F.col("source") == "uploader", 1).when(F.col("lang") == "en", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("r"), F.col(order).alias("o"), "lang", "source"))
    return tracks.groupBy(key).agg(best.alias("b")).select(key, "b.lang", "b.source")


def iso_day(day: Column) -> Column:
    return F.when(F.length(day) == 8, F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))


def whole_ms(seconds: Column) -> Column:
    return F.bround(seconds * 1000, 0).cast("bigint")


def restriction_exit(error: Column) -> Column:
    """40 for messages that speak of restricted videos, else 10."""
    return F.when(F.lower(error).rlike("private|age|members-only|sign in|unavailable in your country"), 40).otherwise(10)
