"""The engine: sources in, results and events out, in one pass over the sources."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import blank_to_null, trimmed
from quillmesh.operators import captions, detect, html, identity, sinks
from quillmesh.operators.files import extracted_file, file_columns, reflowed_file
from quillmesh.runtime import once

RESULT = ("raw", "kind", "slug", "status", "title", "author", "duration_ms", "language", "text", "extractor", "error", "exit_code", "segments", "detail")
SEGMENTS = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
DETAIL = "struct<extractor:string,structured:boolean,ext:string,caption_lang:string,caption_source:string,locators:array<struct<segment:int,page:int,sheet:string,slide:int>>>"


@runtime_checkable
class Provider(Protocol):
    """A kind of source: rules and work as columns and frames."""

    kind: str

    def matches(self, raw: Column) -> Column: ...

    def slug(self, raw: Column) -> Column: ...

    def extract(self, df: DataFrame) -> DataFrame: ...


def _result(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame of RESULT's columns; what a kind doesn't know is null."""
    kinds = {"duration_ms": "bigint", "exit_code": "int", "segments": SEGMENTS, "detail": DETAIL}
    return df.select("raw", "kind", columns.get("slug", F.col("slug")).alias("slug"), *[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RESULT[3:]])


#: A step adds what it computes for the rows of ``on`` to a frame and says how results follow from it.
Made = tuple[DataFrame, dict[str, Column]]
Step = Callable[[DataFrame, Column], Made]


@dataclass
class Kind:
    """A provider made of a rule of detect.RULES and an extraction step.

    The engine runs the steps of all such kinds one after the other over the same rows, each on
    the inputs of its own kinds only, so that the sources are scanned and detected once.
    """

    kind: str
    step: Step = field(repr=False)

    def matches(self, raw: Column) -> Column:
        return detect.RULES[self.kind](raw)

    def slug(self, raw: Column) -> Column:
        return identity.input_slug(raw, F.lit(self.kind), detect.video_id(raw))

    def extract(self, df: DataFrame) -> DataFrame:
        made, columns = self.step(df, F.lit(True))
        return _result(made, **columns)


def pages(df: DataFrame, on: Column) -> Made:
    """Rows with html: gate, clean-up, login wall, title."""
    md = html.extracted(df.withColumn("__md", F.when(on, F.col("html"))), "__md", "raw")
    md = once(md, __md=F.col("__md"))
    text = F.col("__md")
    wall = F.coalesce(detect.is_login_wall(text), F.lit(False))
    ok = text.isNotNull() & ~wall
    made = F.when(ok, "html2md")
    return md, {
        "status": F.when(ok, "success").otherwise("failed"), "title": F.when(ok, identity.page_title(text, F.col("slug"))).otherwise(""), "text": F.when(ok, text).otherwise(""), "extractor": made, "detail": detail(made, structured=F.lit(True)),
        "error": F.when(wall, "login wall").when(text.isNull(), "page has no content"), "exit_code": F.when(ok, 0).when(wall, detect.EXIT["not_authenticated"]).otherwise(detect.EXIT["primary_failed"]),
    }


def texts(df: DataFrame, on: Column) -> Made:
    """Rows with text: passed on as it is; a missing one fails with 10, a blank one with 30."""
    text = F.col("text")
    ok = F.coalesce(trimmed(text) != "", F.lit(False))
    made = F.when(ok, "text")
    return df, {
        "status": F.when(ok, "success").otherwise("failed"), "title": F.when(ok, identity.text_title(text, F.col("slug"))).otherwise(""), "text": F.when(ok, text).otherwise(""), "extractor": made,
        "detail": detail(made, structured=F.lit(True), ext=detect.suffix(F.col("raw"), detect.TEXTS)), "error": F.when(text.isNull(), "file not found").when(~ok, "empty file"),
        "exit_code": F.when(ok, 0).when(text.isNull(), detect.EXIT["primary_failed"]).otherwise(detect.EXIT["exhausted"]),
    }


def detail(extractor: Column, **known: Column) -> Column:
    """How a result was made, as DETAIL; what isn't known is null."""
    kinds = {n: t for n, t in re.findall(r"(\w+):(string|boolean|array<struct<[^<>]*>>)", DETAIL[7:-1])}
    return F.when(extractor.isNotNull(), F.struct(*[known.get(n, extractor if n == "extractor" else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]))


def files(df: DataFrame, on: Column, engines: dict | None = None) -> Made:
    """Rows with content: by the file engines, with the pages, slides or sheets as segments."""
    ext = F.coalesce(detect.suffix(F.col("raw"), detect.DOCS), detect.suffix(F.col("raw"), detect.IMAGES), F.when(F.col("kind") == "pdf", "pdf"))
    df = once(df, __ext=F.when(on, ext))
    df = reflowed_file(df.withColumn("__file", extracted_file(F.when(on, F.col("content")), F.col("__ext"), engines)), "__file")
    made = file_columns(F.col("__file"), F.col("slug"))
    by = made["extractor"]
    title = F.when((F.col("kind") == "image") & (made["status"] == "success"), identity.scan_title(made["text"], made["title"])).otherwise(made["title"])
    return df, made | {"title": title, "extractor": by["extractor"], "detail": detail(by["extractor"], structured=by["structured"], ext=F.col("__ext"), locators=by["locators"])}


def videos(df: DataFrame, on: Column) -> Made:
    """Rows with vtt, transcript, track info or an error, optionally title and duration_s.

    Captions come first: paragraphs by pauses, cues as segments. Else the transcript, sliced
    over the duration. A message that speaks of a restricted video gives 40, one of a missing
    sign-in 21; a video without either text fails with 20. A known title also names the slug.
    """
    timed = once(df, __cues=captions.merged_cues(captions.parsed_cues(F.when(on, F.col("vtt")))))
    timed = once(timed, __body=blank_to_null(captions.paragraph_text(F.col("__cues"))), __said=blank_to_null(F.col("transcript")))
    text = F.coalesce("__body", "__said")
    ok = text.isNotNull()
    ms = captions.whole_ms(F.col("duration_s"))
    cues, slices = F.col("__cues"), F.coalesce(captions.transcript_slices(F.col("__said"), ms), F.array(F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), F.col("__said").alias("text"))))
    told = F.col("error")
    code = F.when(told.isNotNull() & (captions.restriction_exit(told) == 40), 40).when(told.rlike("(?i)not authenticated|login required|log in"), detect.EXIT["not_authenticated"]).otherwise(detect.EXIT["fallback_failed"])
    slug = F.coalesce(F.nullif(identity.slug(F.col("title")), F.lit("")), F.col("slug"))
    made = F.when(F.col("__body").isNotNull(), "captions").when(ok, "transcript")
    by_captions = F.col("__body").isNotNull()
    lang = F.when(by_captions, F.col("caption_lang"))
    return timed, {
        "slug": slug, "status": F.when(ok, "success").otherwise("failed"), "title": F.coalesce("title", slug), "text": F.coalesce(text, F.lit("")), "duration_ms": ms, "language": lang,
        "extractor": made, "error": F.when(~ok, F.coalesce(told, F.lit("no captions and no transcript"))), "exit_code": F.when(ok, 0).otherwise(code), "segments": F.when(by_captions, cues).when(ok, slices),
        "detail": detail(made, structured=by_captions, caption_lang=lang, caption_source=F.when(by_captions, F.col("caption_source"))),
    }


class Registry:
    """Providers in the order of their priority."""

    def __init__(self, providers: list[Provider] | None = None):
        self._all: list[Provider] = list(providers or [])

    def register(self, provider: Provider) -> None:
        self._all.append(provider)

    def all(self) -> list[Provider]:
        return list(self._all)

    def get(self, kind: str) -> Provider | None:
        return next((p for p in self._all if p.kind == kind), None)

    def kind(self, raw: Column) -> Column:
        return detect.kind(raw, {p.kind: p.matches for p in self._all})


def default_registry(engines: dict | None = None) -> Registry:
    """The kinds in their order; ``engines`` by suffix are used instead of the registered ones."""
    read = lambda df, on: files(df, on, engines)
    return Registry([Kind("youtube", videos), Kind("pdf", read), Kind("docs", read), Kind("text", texts), Kind("image", read), Kind("html", pages)])


class Engine:
    """Runs a frame of sources through detection, cache and the providers."""

    #: what a source row may bring along, by kind
    INPUTS = {"html": "string", "text": "string", "content": "binary", "vtt": "string", "transcript": "string", "title": "string", "duration_s": "double", "caption_lang": "string", "caption_source": "string", "error": "string"}

    def __init__(self, registry: Registry | None = None, engines: dict | None = None):
        self.registry = registry or default_registry(engines)

    def detect(self, sources: DataFrame) -> DataFrame:
        raw = F.col("raw")
        slug = identity.input_slug(raw, F.col("kind"), F.col("__video"))
        for p in reversed(self.registry.all()):
            if not isinstance(p, Kind):
                slug = F.when(F.col("kind") == p.kind, p.slug(raw)).otherwise(slug)
        found = once(sources, kind=self.registry.kind(raw), __video=detect.video_id(raw))
        return once(found, slug=slug).drop("__video")

    def run(self, sources: DataFrame, done: DataFrame | None = None, force: bool = False, provider: str | None = None) -> DataFrame:
        """Results of all sources that have no earlier success in ``done`` (source_id, slug, status).

        A source of no kind fails with 30; with ``provider`` set, one that doesn't match it
        fails with 11, and an unknown provider fails all with 2. The built-in kinds share one
        scan and one detection; a provider of one's own is a branch beside them.
        """
        full = sources.select("raw", *[F.col(c) if c in sources.columns else F.lit(None).cast(t).alias(c) for c, t in self.INPUTS.items()])
        found = self.detect(full)
        wrong = None
        if provider is not None:
            known = self.registry.get(provider)
            fits = F.coalesce(known.matches(F.col("raw")), F.lit(False)) if known else F.lit(False)
            code = detect.EXIT["forced_no_match"] if known else detect.EXIT["invalid_args"]
            wrong = _result(found.where(~fits), status=F.lit("failed"), error=F.lit(f"source does not match provider {provider}" if known else f"unknown provider {provider}"), exit_code=F.lit(code))
            found = found.where(fits).withColumn("kind", F.lit(provider)).withColumn("slug", known.slug(F.col("raw")) if known else F.col("slug"))
        if done is not None and not force:
            found = sinks.uncached(found.withColumn("source_id", F.col("raw")), done).drop("source_id")
        asked = [p for p in self.registry.all() if provider in (None, p.kind)]
        others = [p for p in asked if not isinstance(p, Kind)]
        parts = [self._in_one_pass(found.where(F.col("kind").isNull() | ~F.col("kind").isin(*[p.kind for p in others])) if others else found, [p for p in asked if isinstance(p, Kind)])]
        parts += [p.extract(found.where(F.col("kind") == p.kind)) for p in others]
        if wrong is not None:
            parts.append(wrong)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _in_one_pass(found: DataFrame, kinds: list[Kind]) -> DataFrame:
        """Results of the built-in kinds: every step over the same rows, each on those of its kinds; rows of no kind fail."""
        steps: dict[Step, list[str]] = {}
        for p in kinds:
            steps.setdefault(p.step, []).append(p.kind)
        made = []
        for step, names in steps.items():
            on = F.coalesce(F.col("kind").isin(*names), F.lit(False))
            found, columns = step(found, on)
            made.append((on, columns))
        out: dict[str, Column] = {"slug": F.col("slug"), "status": F.lit("failed"), "error": F.lit("no provider matches"), "exit_code": F.lit(detect.EXIT["exhausted"])}
        for name in ("slug", *RESULT[3:]):
            for on, columns in made:
                if name in columns:
                    out[name] = F.when(on, columns[name]).otherwise(out.get(name, F.lit(None)))
                elif name in out and name != "slug":
                    out[name] = F.when(~on, out[name])
        return _result(found, **out)
