"""Composition of thread pages from their item lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "value", "url")]))
COUNTER = re.compile(r"[\d.,]+[KMB]?")
HANDLE = re.compile(r"@\w+", re.A)
DAY = re.compile(r"[A-Z][a-z]+ \d+(?:, \d{4})?")
PERSON = re.compile(r"[A-Z][\w'.-]*(?: [A-Z][\w'.-]*){0,3}")
# Interface words of a post's header.
HEADER_WORDS = frozenset(("·", "Article", "Views", "Show this thread"))


def _body_from(items: list[dict]) -> list[dict]:
    """Items from the first line of a post's own text on, led by its title in bold if it has one.

    Names that a handle follows, handles, counters, dates and interface words are the header;
    a short line that counters follow is the title.
    """
    flat = [(i, n, s.strip()) for i, item in enumerate(items) if item["type"] == "text" for n, s in enumerate((item["value"] or "").split("\n")) if s.strip()]
    title, counted = None, False
    for at, (i, n, s) in enumerate(flat):
        nearby = [x for _, _, x in flat[at + 1 : at + 8]]
        if COUNTER.fullmatch(s):
            counted = True
        elif HANDLE.fullmatch(s) or s in HEADER_WORDS or DAY.fullmatch(s) or (PERSON.fullmatch(s) and any(map(HANDLE.fullmatch, nearby[:3]))):
            pass
        elif not counted and len(s) < 80 and s[-1] not in '.!?…":' and any(map(COUNTER.fullmatch, nearby[:4])):
            title = title or s
        else:
            rest = "\n".join(items[i]["value"].split("\n")[n:]).rstrip()
            lead = [{"type": "text", "value": f"**{title}**\n", "url": None}] if title else []
            return [*lead, {"type": "text", "value": rest + "\n", "url": None}, *items[i + 1 :]]
    return items


@F.pandas_udf(ITEMS)
def body_items(items: pd.Series) -> pd.Series:
    return items.map(lambda x: None if x is None else _body_from([dict(i) for i in x]))


def handle_of(items: Column) -> Column:
    """The first handle that an entry's texts name, or null."""
    named = F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: F.regexp_extract(i["value"], r"@([A-Za-z0-9_]+)", 1))
    return F.try_element_at(F.filter(named, lambda s: s != ""), F.lit(1))


def media_key(url: Column) -> Column:
    found = F.regexp_extract(url, r"pbs\.twimg\.com/media/([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found).otherwise(url)


def image_list(urls: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(urls), 1, most)


def sections_without_repeats(sections: Column) -> Column:
    """array<array<url>> to flags: a section stays if none of its images stood in an earlier one or twice in itself.

    The keys of a dropped section up to its first repeated image count as seen.
    """

    def step(acc: Column, urls: Column) -> Column:
        keys = F.transform(urls, media_key)
        first = F.array_min(F.filter(F.transform(keys, lambda k, i: F.when(F.array_contains(acc["seen"], k) | F.array_contains(F.slice(keys, F.lit(1), i), k), i)), lambda i: i.isNotNull()))
        return F.struct(F.array_union(acc["seen"], F.when(first.isNull(), keys).otherwise(F.slice(keys, F.lit(1), first))).alias("seen"), F.concat(acc["kept"], F.array(first.isNull())).alias("kept"))

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<boolean>").alias("kept"))
    return F.aggregate(sections, start, step, lambda acc: acc["kept"])


def thread_text(entries: Column) -> Column:
    """array<struct<handle, section>> in order: later entries are quoted under the first line that names them, else appended after a rule."""

    def step(text: Column, e: Column) -> Column:
        quote = F.array_join(F.transform(F.split(e["section"], "\n", -1), lambda s: F.when(s == "", ">").otherwise(F.concat(F.lit("> "), s))), "\n")
        ls = F.split(text, "\n", -1)
        at = F.array_min(F.filter(F.transform(ls, lambda s, i: F.when(F.contains(s, F.concat(F.lit("@"), e["handle"])), i)), lambda i: i.isNotNull()))
        under = F.array_join(F.concat(F.slice(ls, F.lit(1), at + 1), F.array(F.lit(""), quote), F.slice(ls, at + 2, F.size(ls))), "\n")
        return F.when(text == "", e["section"]).when(at.isNotNull(), under).otherwise(F.concat(text, F.lit("\n\n---\n\n"), e["section"]))

    return F.aggregate(F.filter(entries, lambda e: F.coalesce(e["section"], F.lit("")) != ""), F.lit(""), step)
