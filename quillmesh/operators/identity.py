"""Slugs, collisions and titles."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import urls
from quillmesh.functions.text import blank_to_null, lines, trimmed


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds ASCII, with that: single letters, and the rest.

    Built from the Unicode tables of the running Python, up to the last block that has any.
    """
    one, more = {}, {}
    for code in range(0x80, 0x20000):
        flat = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if ord(x) < 128) if not 0xD800 <= code < 0xE000 else ""
        if flat:
            (one if len(flat) == 1 and code < 0x2000 else more)[chr(code)] = flat
    return one, more


def folded(text: Column) -> Column:
    """ASCII of a text: letters lose their marks, ligatures and the like are spelt out, the rest goes.

    Single letters take one native translate. Longer decompositions are looked up in a map,
    one literal that is read once, and only where other characters are left.
    """
    one, more = _folds()
    once = F.translate(text, "".join(one), "".join(one.values()))
    table = F.from_json(F.lit(json.dumps(more)), T.MapType(T.StringType(), T.StringType()))
    spelt = F.array_join(F.transform(F.split(once, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.regexp_replace(F.when(once.rlike(r"[^\x00-\x7F]"), spelt).otherwise(once), r"[^\x00-\x7F]", "")


def slug(title: Column, longest: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens; longer ones are cut back to a whole word."""
    full = F.regexp_replace(F.regexp_replace(F.lower(folded(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.left(full, F.lit(longest))
    cut = F.when(head.rlike("^.+-"), F.regexp_extract(head, "^(.+)-[^-]*$", 1)).otherwise(head)
    return F.when(F.length(full) > longest, F.regexp_replace(cut, "-+$", "")).otherwise(full)


def url_slug(raw: Column) -> Column:
    return F.coalesce(F.nullif(slug(F.concat(urls.authority(raw), F.lit(" "), urls.path(raw))), F.lit("")), F.lit("page"))


def _name(raw: Column) -> Column:
    """Last part of a path or URL path, trailing slashes dropped."""
    return F.regexp_extract(F.regexp_replace(F.when(urls.is_http(raw), urls.path(raw)).otherwise(raw), "/+$", ""), "([^/]*)$", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def input_slug(raw: Column, kind: Column, video: Column | None = None) -> Column:
    """Slug of an input by its kind: file stem, URL's last part, host, or a word for the kind."""
    http, name = urls.is_http(raw), _name(raw)
    bare = F.when(kind == "pdf", F.regexp_replace(name, r"(?i)\.pdf$", "")).when(kind == "docs", F.regexp_replace(name, r"(?i)\.(?:docx|xlsx|pptx|epub)$", "")).otherwise(_stem(name))
    some = F.when(http, F.coalesce(F.nullif(bare, F.lit("")), urls.authority(raw))).otherwise(_stem(name))
    page = F.concat(urls.authority(raw), F.lit(" "), urls.path(raw))
    word = F.when(kind == "docs", F.lit("doc")).when(kind == "html", F.lit("page")).otherwise(kind)
    # One slug expression for all kinds keeps the plan small.
    named = slug(F.when(kind == "html", page).when(kind == "youtube", video if video is not None else raw).otherwise(some))
    return F.coalesce(F.nullif(named, F.lit("")), word)


def disambiguated(df: DataFrame, slug_col: str = "slug", key: str = "source_id", order: str = "ord", taken: DataFrame | None = None) -> DataFrame:
    """Adds final_slug: the slug, slug--first eight of the id, or slug--id, for first, second and later owners in order.

    An empty slug becomes the id. taken: slugs that earlier results already own, so that no new
    row is first. Only the first owner of a slug and of a shortened form matter, so two
    aggregates with partial sums find them; no window ranks the rows of a popular slug in one
    task. Rows equal in order and id get the same slug.
    """
    me = F.struct(F.col(order).alias("o"), F.col(key).alias("k"))
    named = df.withColumn("__s", F.when(F.coalesce(F.col(slug_col), F.lit("")) == "", F.col(key)).otherwise(F.col(slug_col))).withColumn("__me", me)
    named = named.withColumn("__short", F.concat("__s", F.lit("--"), F.left(key, F.lit(8))))
    first = named.groupBy(F.col("__s").alias("__t")).agg(F.min("__me").alias("__first"))
    if taken is not None:
        first = first.join(taken.select(F.col(slug_col).alias("__t")).distinct(), "__t", "left_anti")
    ranked = named.join(first, F.col("__s") == F.col("__t"), "left").withColumn("__lead", F.coalesce(F.col("__me") == F.col("__first"), F.lit(False)))
    second = ranked.where("not __lead").groupBy(F.col("__short").alias("__u")).agg(F.min("__me").alias("__second"))
    tried = ranked.join(second, F.col("__short") == F.col("__u"), "left")
    final = F.when(F.col("__lead"), F.col("__s")).when(F.col("__me") == F.col("__second"), F.col("__short")).otherwise(F.concat("__s", F.lit("--"), F.col(key)))
    return tried.select(*df.columns, final.alias("final_slug"))


def page_title(body: Column, fallback: Column) -> Column:
    """First line with words after its heading marks, at most 80 code points."""
    named = F.filter(F.transform(lines(body), lambda x: trimmed(F.regexp_replace(trimmed(x), r"^#+[ \t]*", ""))), lambda x: x != "")
    return F.coalesce(F.left(F.try_element_at(named, F.lit(1)), F.lit(80)), fallback)


def text_title(body: Column, fallback: Column) -> Column:
    """First non-blank line without its heading marks; a line of marks alone gives the fallback."""
    first = F.try_element_at(F.filter(F.transform(lines(body), trimmed), lambda x: x != ""), F.lit(1))
    return F.coalesce(blank_to_null(F.left(trimmed(F.regexp_replace(first, "^#+", "")), F.lit(80))), fallback)


def scan_title(body: Column, fallback: Column) -> Column:
    """As text_title, but table rows and comments are skipped and asterisks around it go."""
    usable = F.filter(F.transform(lines(body), trimmed), lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("<!--"))
    first = F.try_element_at(usable, F.lit(1))
    return F.coalesce(blank_to_null(F.left(trimmed(F.regexp_replace(trimmed(F.regexp_replace(first, "^#+", "")), r"^\*+|\*+$", "")), F.lit(80))), fallback)


def html_title(html: Column) -> Column:
    """Text of the first title element with its white space made even; entities stay."""
    return trimmed(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\n\r\f\x0B\x{00A0}]+", " "))


def work_name(source_id: Column) -> Column:
    return F.left(F.regexp_replace(source_id, r"[^A-Za-z0-9._-]", "_"), F.lit(40))
