"""Repeated consecutive events: runs of the same or nearly the same text by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.runtime import cut

BLOCK = 4096  # rows of one sequence that are windowed together

# Named character entities that stand for a letter or mark.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def comparable(text: Column) -> Column:
    """Text without case, punctuation, spacing, markup and character entities."""
    c = F.regexp_replace(text, r"</?[A-Za-z0-9][^<>]*>", "")
    c = F.regexp_replace(c, r"&amp;(?=#?\w+;)", "&")
    c = F.regexp_replace(c, r"(?i)&(lt|gt|quot|apos|nbsp|amp|hellip|[lr][sd]quo|[mn]dash|middot|copy|shy|#0*(3[2-9]|4[0-7]|160|82\d\d)|#x0*(2[0-9a-f]|a0|20[0-9a-f]{2}));", "")
    c = F.regexp_replace(c, r"&([A-Za-z])(acute|grave|circ|uml|tilde|cedil|ring|slash);", "$1")
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def nearly_same(a: Column, b: Column) -> Column:
    """Equal, or one single letter changed, missing or added; different digits always differ."""
    digits = lambda c: F.regexp_replace(c, r"\P{N}+", "")
    close = (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) >= 0) & (digits(a) == digits(b))
    return (a == b) | close


def links(df: DataFrame, key: str, seq: str, text: str, start: str, end: str) -> DataFrame:
    """One row for each event like its predecessor: (key, seq, end, ptr, ptr_start).

    Predecessors are looked up inside blocks of BLOCK positions; the first event of a block
    takes the last one of the nearest earlier block, so no task holds a whole long sequence.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(text).rlike(r"[^\s ​﻿]")).select(
        F.col(key).alias("k"), F.col(seq).cast("long").alias("s"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("e"), comparable(F.col(text)).alias("t")
    )
    block = F.floor(F.col("s") / BLOCK)
    w = Window.partitionBy("k", "b").orderBy("s", "t")
    once = cut(rows.withColumn("b", block).withColumn("again", F.lag("s").over(w) == F.col("s")).where(~F.coalesce("again", F.lit(False))).drop("again"))  # read and compared once
    here = F.struct("s", "t", "a")
    inside = once.withColumn("p", F.lag(here).over(w))
    tails = once.groupBy("k", "b").agg(F.max(here).alias("tail"))
    before = tails.withColumn("tail", F.lag("tail").over(Window.partitionBy("k").orderBy("b"))).where("tail is not null")
    heads = inside.where("p is null").drop("p").join(before, ["k", "b"]).withColumnRenamed("tail", "p")
    both = inside.where("p is not null").unionByName(heads)
    return both.where(nearly_same(F.col("p.t"), F.col("t"))).select("k", "s", "e", F.col("p.s").alias("ptr"), F.col("p.a").alias("ptr_a"))


def collapse_runs(df: DataFrame, key: str = "extraction_id", seq: str = "seq", text: str = "text", start: str = "start_ms", end: str = "end_ms", max_rounds: int = 40) -> DataFrame:
    """Runs of two or more consecutive like events, one row each.

    Result: key, first_seq, last_seq, start_ms (of the first), end_ms (of the last), n_events,
    duration_ms. Method: every event like the one before points to it; self-joins replace
    pointers by pointers' pointers until all reach their run's start, so a run of n events
    takes about log2(n) joins, keyed by (sequence, position) and hence even under hot keys.

    Events with a null key, a null position or a null or blank text are skipped; they neither
    end nor form a run. Repeated deliveries of one position count once. Times that are null
    give null start, end or duration. Other columns are not read; their names can't clash.
    """
    state = cut(links(df, key, seq, text, start, end))
    for _ in range(max_rounds):
        up = state.select(F.col("k").alias("uk"), F.col("s").alias("us"), F.col("ptr").alias("up"), F.col("ptr_a").alias("ua"))
        joined = state.join(up, (F.col("k") == F.col("uk")) & (F.col("ptr") == F.col("us")), "left")
        state = cut(joined.select("k", "s", "e", F.coalesce("up", "ptr").alias("ptr"), F.when(F.col("up").isNotNull(), F.col("ua")).otherwise(F.col("ptr_a")).alias("ptr_a"), F.col("up").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    runs = state.groupBy(F.col("k").alias(key), F.col("ptr").alias("first_seq")).agg(
        F.max("s").alias("last_seq"), F.max("ptr_a").alias("start_ms"), F.max_by("e", "s").alias("end_ms"), (F.count("*") + 1).alias("n_events")
    )
    return runs.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
