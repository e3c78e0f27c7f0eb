"""Texts cut off by field limits: strict prefixes of longer copies, and how often each source cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.runtime import cut, once

MOST_LIMITS = 10_000  # source limits that are broadcast
MOST_HASHES = 2_000_000  # hashes of two words that are broadcast, 8 bytes each; more are joined by a shuffle
LEAST_CUTS, LEAST_SHARE = 5, 0.2  # confirmed cuts, and their share at one length, that make a source's limit

# Marks of omission, characters and pictures that close a text, and spaces.
MARK = r"\s*(?:\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|…|\.{3,}|&hellip;|\[(?:more|mehr|suite|más|mais|meer|ещё)\])\s*$"
STOPS = (".", "!", "?", "。", "！", "？")
AFTER_STOP = ")\"'»”’*_"
PICTURE = r"[\p{So}\p{Sk}\p{M}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{FE0F}\x{200D}❤★☆♥]"
SPACES = " \t\n\x0b\f\r"
UNSEEN = "​‌﻿­"


def _after(text: Column, mark: str) -> Column:
    """What follows the last ``mark``, or null without one: ends are read by it, so that no pattern scans a whole text."""
    return F.when(text.contains(mark), F.substring_index(text, mark, -1))


def is_marked(text: Column) -> Column:
    """Whether a mark of omission ends the text."""
    end = F.rtrim(text, F.lit(SPACES))
    word = r"^(?:\s*(?:…|\.{3})\s*|more|mehr|suite|más|mais|meer|ещё)\]$"
    return end.endswith("…") | end.endswith("...") | end.endswith("&hellip;") | F.coalesce(_after(end, "[").rlike(word), F.lit(False)) | F.coalesce(_after(end, "(").rlike(r"^\s*(?:…|\.{3})\s*\)$"), F.lit(False))


def is_closed(text: Column) -> Column:
    """Whether the text ends in a stop, a closing mark, a tag, an entity, a picture, a score or a smiley."""
    end = F.rtrim(text, F.lit(SPACES))
    score = F.substring_index(end, "/", -1)
    before = F.left(end, F.length(end) - F.length(score) - 1)
    return (
        F.right(F.rtrim(text, F.lit(SPACES + AFTER_STOP)), F.lit(1)).isin(*STOPS) | F.right(end, F.lit(1)).isin(")", '"', "»", "”") | F.right(end, F.lit(1)).rlike(PICTURE)
        | F.coalesce(_after(end, "<").rlike(r"^(?:/\w+|br ?/?)>$"), F.lit(False)) | F.coalesce(_after(end, "&").rlike(r"^\w+;$"), F.lit(False))
        | (end.contains("/") & score.rlike(r"^ ?\d+$") & F.right(before, F.lit(2)).rlike(r"\d ?$")) | F.right(end, F.lit(3)).rlike(r"[:;]-?[)(DP]$")
    )


def is_broken(text: Column) -> Column:
    """Whether the text ends in half a character, entity, escape or tag."""
    end = F.rtrim(text)
    return F.right(end, F.lit(1)).isin("�", "\\") | F.coalesce(_after(end, "&").rlike(r"^#?\w{0,7}$"), F.lit(False)) | F.coalesce(_after(end, "<").rlike(r"^/?(?:[a-zA-Z][^<>]{0,80})?$"), F.lit(False))


def _plain(text: Column) -> Column:
    """Spaces made equal and digits masked, so that copies that differ in a number meet."""
    tags = F.regexp_replace(F.regexp_replace(text, r"<br ?/?>", "\n"), r"(?i)</?(?:b|i|p|em|strong|span|div)>", "")
    c = F.when(text.contains("<"), tags).otherwise(text)
    c = F.replace(F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'"))
    c = F.translate(c, "\r\t\x0b\f" + UNSEEN, "\n   ")  # the unseen ones have no counterpart and go
    return F.regexp_replace(F.when(c.contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(c), r"\d+", "0")


def _sentences(plain: Column) -> Column:
    return F.filter(F.transform(F.split(plain, r"(?<=[.!?…])[\s]+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def _bare(sentence: Column) -> Column:
    return F.rtrim(F.lower(sentence), F.lit(".!?…" + SPACES))


def prefixes(tails: DataFrame, known: DataFrame) -> DataFrame:
    """(bare, complete, continued) of distinct tails against the distinct known sentences.

    complete: it is a known one; continued: it is a strict prefix of a known one. Both are
    sorted into one order by ranges. All strings that begin with a tail follow it at once, so
    the next known sentence decides; read backwards, that is the one seen last. Only where a
    range has none after a tail is the least of the next ranges asked (one row a range). Each
    text is one row, whatever its beginning, so no prefix is a hot key.
    """
    both = tails.select("bare", F.lit(0).alias("known")).unionByName(known.select("bare", F.lit(1).alias("known")))
    ordered = both.repartitionByRange("bare").sortWithinPartitions(F.desc("bare"), F.asc("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen, waiting = TaskContext.get().partitionId(), None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["bare", "place", "tail", "complete", "continued"])

        def verdict(tail: str, complete: bool) -> tuple:
            return tail, place, True, complete, None if seen is None else seen.startswith(tail)

        for batch in batches:
            rows = []
            for text, is_known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if waiting is not None:
                    rows.append(verdict(waiting, bool(is_known) and text == waiting))
                    waiting = None
                if is_known:
                    seen = text
                else:
                    waiting = text
            yield made(rows)
        yield made([*([verdict(waiting, False)] if waiting is not None else []), (seen, place, False, None, None)])

    read = cut(ordered.mapInArrow(run, "bare string, place int, tail boolean, complete boolean, continued boolean"))
    later = Window.orderBy("place").rowsBetween(1, Window.unboundedFollowing)  # one row a range
    ends = read.where("not tail").select("place", F.first("bare", ignorenulls=True).over(later).alias("next"))
    return read.where("tail").join(F.broadcast(ends), "place", "left").select("bare", "complete", F.coalesce("continued", F.startswith("next", "bare"), F.lit(False)).alias("continued"))


def by_last_words(rare: DataFrame, known: DataFrame) -> DataFrame:
    """(bare, complete, continued) of tails that occur nowhere, by their last three words.

    Mostly a misspelling further ahead hides them. complete: a known sentence ends in these
    words; continued: one has the first two of them and then a word that begins with the third.
    Sentences give only runs of words whose first two are asked for.
    """
    words = F.split("bare", " ")
    last = rare.select("bare", words.alias("w")).where("size(w) >= 3").select("bare", F.array_join(F.slice("w", -3, 3), " ").alias("end"), F.xxhash64(F.array_join(F.slice("w", -3, 2), " ")).alias("h"))
    last = cut(last)
    asked = last.select("h").distinct()
    runs = known.select(words.alias("w")).where("size(w) >= 3").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.xxhash64(F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))).alias("h"), F.array_join(F.slice("w", i, 4), " ").alias("bare")))).alias("r")).select("r.*")
    runs = runs.join(F.broadcast(asked) if asked.count() <= MOST_HASHES else asked, "h", "left_semi").select("bare").distinct()
    # A run of three words can only be a sentence's last ones.
    verdicts = prefixes(last.select(F.col("end").alias("bare")).distinct(), runs)
    return last.join(verdicts.withColumnRenamed("bare", "end"), "end").select("bare", "complete", "continued")


def evidence(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", title: str = "title") -> DataFrame:
    """For each text with an open end: (key, source, chars, bytes, marked, broken, tail, complete, continued).

    tail is what follows the last full sentence. complete: it is a whole sentence or title
    elsewhere. continued: it is a strict prefix of a longer sentence elsewhere (see prefixes).
    """
    t = F.col("t")
    d = documents.select(F.col(key).alias("k"), F.col(source).alias("src"), F.col(text).alias("t"), F.col(title).alias("ti")).where("k is not null and t is not null and trim(t) <> ''")
    d = once(d, marked=is_marked(t)).withColumn("body", F.when(F.col("marked"), F.regexp_replace("t", MARK, "")).otherwise(t))
    read = once(d, parts=_sentences(_plain(F.col("body"))), open=F.col("marked") | ~is_closed(t), broken=is_broken(F.col("body")))
    plain = cut(read.select("k", "src", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), "marked", "broken", "open", "parts", _plain(F.coalesce("ti", F.lit(""))).alias("ti")))
    # Only sentences that something follows, or that end in a stop, show how sentences go on.
    whole = F.when(F.col("open"), F.slice("parts", 1, F.greatest(F.lit(0), F.size("parts") - 1))).otherwise(F.col("parts"))
    known = cut(plain.select(F.explode(F.concat(whole, F.array("ti"))).alias("s")).select(_bare(F.col("s")).alias("bare")).where("bare <> ''").distinct())
    tail = F.element_at("parts", -1)
    open_ends = plain.where("open or broken").select("k", "src", "chars", "bytes", "marked", "broken", F.lower(tail).alias("tail"), _bare(tail).alias("bare"), tail.rlike(r"[.!?…]$").alias("stopped"))
    verdicts = prefixes(open_ends.select("bare").where("bare is not null and bare <> ''").distinct(), known)
    verdicts = cut(verdicts)
    second = by_last_words(verdicts.where("not complete and not continued"), known).select("bare", F.col("complete").alias("c2"), F.col("continued").alias("n2"))
    verdicts = verdicts.join(second, "bare", "left").select("bare", (F.col("complete") | F.coalesce("c2", F.lit(False))).alias("complete"), (F.col("continued") | F.coalesce("n2", F.lit(False))).alias("continued"))
    out = open_ends.join(verdicts, "bare", "left")
    return out.select(
        F.col("k").alias(key), F.col("src").alias(source), "chars", "bytes", "marked", "broken", "stopped", "tail", F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("continued", F.lit(False)).alias("continued")
    )


def source_limits(ends: DataFrame, source: str = "source") -> DataFrame:
    """Lengths at which a source cuts: (source, unit, size), from the confirmed cuts alone."""
    sure = ends.where("continued and not complete and not stopped")
    sizes = sure.select(F.col(source).alias("ls"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x")).select("ls", "x.*")
    counted = sizes.groupBy("ls", "unit", "size").agg(F.count("*").alias("n"))
    total = sure.groupBy(F.col(source).alias("ts")).agg(F.count("*").alias("total"))
    return counted.join(total, F.col("ls").eqNullSafe(F.col("ts"))).where((F.col("n") >= LEAST_CUTS) & (F.col("n") >= LEAST_SHARE * F.col("total"))).select("ls", "unit", "size")


def truncated(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", title: str = "title") -> DataFrame:
    """(key, source, why) of each text that was cut inside a sentence, word, character or markup.

    A text is cut if its tail is a strict prefix of a longer sentence elsewhere and nowhere a
    whole one (why = prefix), if it ends in half a character or tag (broken), or if its tail
    is no whole sentence and its length is one at which its source is seen to cut (limit).
    Null, empty and blank texts are no cases; null sources form a source of their own;
    repeated rows give one row.
    """
    ends = cut(evidence(documents, key, text, source, title))
    limits = source_limits(ends, source)
    at = ends.select("*", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x"))
    reach = F.when(limits["unit"] == "bytes", 3).otherwise(1)  # what a trimmed space or half a character leaves
    near = at.join(F.broadcast(limits) if limits.count() <= MOST_LIMITS else limits, at[source].eqNullSafe(limits["ls"]) & (at["x.unit"] == limits["unit"]) & (at["x.size"] <= limits["size"]) & (at["x.size"] >= limits["size"] - reach), "left_semi")
    by_limit = near.where("not stopped and (not complete or continued)").select(key, source, F.lit("limit").alias("why"))
    direct = ends.where("broken or (continued and not complete and not stopped)").select(key, source, F.when(F.col("broken"), "broken").otherwise("prefix").alias("why"))
    return direct.unionByName(by_limit).groupBy(key, source).agg(F.max("why").alias("why"))


def cut_rates(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", title: str = "title") -> DataFrame:
    """(source, n_texts, n_cut, cut_share): how often each source cuts, over all its non-blank texts."""
    cases = truncated(documents, key, text, source, title).groupBy(F.col(source).alias("cs")).agg(F.countDistinct(key).alias("n_cut"))
    every = documents.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(key).isNotNull()).groupBy(source).agg(F.countDistinct(key).alias("n_texts"))
    joined = every.join(cases, F.col(source).eqNullSafe(F.col("cs")), "left")
    return joined.select(source, "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_texts")).alias("cut_share"))
