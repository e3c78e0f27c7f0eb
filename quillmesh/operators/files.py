"""File contents to text and units: office formats by the standard library, other engines as hooks."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Mapping, Sequence
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import blank_to_null, trimmed
from quillmesh.operators.tables import rows_grid
from quillmesh.operators.textops import reflowed
from quillmesh.runtime import once

UNITS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]))
KINDS = {"units": UNITS, "wrapped": T.BooleanType()}
RESULT = T.StructType([T.StructField(n, KINDS.get(n, T.StringType())) for n in ("title", "authors", "tier", "text", "unit_key", "units", "error", "wrapped")])
BODY_MOST = 50_000
# Tiers that keep a document's structure.
STRUCTURED = ("ooxml", "pandoc", "pymupdf4llm", "docling", "text")
PLAIN = ("md", "txt", "csv", "markdown", "text")

#: An engine takes a file's bytes and gives a dict or None. Its keys are RESULT's fields, or
#: ``chunks``: pages as dicts of text and metadata; ``wrapped`` marks text whose lines are soft-wrapped.
Engine = Callable[[bytes], "dict | None"]
ENGINES: dict[str, list[Engine]] = {}


def register_engine(ext: str, engine: Engine) -> None:
    """Adds an engine for a suffix, tried before the standard library in the order of registration.

    Plans made afterwards carry the engines along to the workers.
    """
    ENGINES.setdefault(ext, []).append(engine)


def _local(e: Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(root: Element, tag: str) -> list[Element]:
    return [e for e in root.iter() if _local(e) == tag]


def _texts(data: bytes, tag: str) -> list[str]:
    return [e.text for e in _all(ElementTree.fromstring(data), tag) if e.text]


def _attribute(e: Element | None, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "") if e is not None else ""


def _numbered(names: list[str], pattern: str) -> list[str]:
    """Entries of a pattern with one number, by that number."""
    hits = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(hits)]


def _said(e: Element) -> str:
    """The text under an element: runs as they are, tabs and breaks as such, paragraphs on lines of their own."""
    marks = {"tab": "\t", "br": "\n"}
    paragraphs = [p for p in e.iter() if _local(p) == "p"] or [e]
    return "\n".join("".join(x.text or "" if _local(x) == "t" else marks.get(_local(x), "") for x in p.iter()) for p in paragraphs).strip()


def _table(e: Element) -> str:
    return rows_grid([[_said(c) for c in row if _local(c) == "tc"] for row in _all(e, "tr")])


def _docx(z: zipfile.ZipFile) -> dict:
    """Body in order: heading and title styles as headings, tables as grids."""
    styles = {}
    if "word/styles.xml" in z.namelist():
        for st in _all(ElementTree.fromstring(z.read("word/styles.xml")), "style"):
            styles[_attribute(st, "styleId")] = _attribute(next(iter(_all(st, "name")), None), "val")
    root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next(iter(_all(root, "body")), root)
    parts = []
    for e in body:
        if _local(e) == "tbl":
            parts.append(_table(e))
        elif _local(e) == "p":
            named = _attribute(next(iter(_all(e, "pStyle")), None), "val")
            style, text = (styles.get(named) or named).lower(), _said(e)
            digits = re.sub(r"\D", "", style)
            level = min(int(digits), 6) if style.startswith("heading") and digits else 1 if style.startswith("heading") or style == "title" else 0
            parts.append(f"{'#' * level} {text}" if level and text else text)
    return {"text": "\n\n".join(p for p in parts if p)}


def _sections(head: str, units: list[tuple[str, str]]) -> str:
    return "\n\n".join(f"## {head}{label}\n\n{text}" if text else f"## {head}{label}" for label, text in units)


def _pptx(z: zipfile.ZipFile) -> dict:
    """A section for each slide: tables as grids, frames as text."""
    units = []
    for i, n in enumerate(_numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
        shapes = [e for e in ElementTree.fromstring(z.read(n)).iter() if _local(e) in ("sp", "graphicFrame")]
        parts = [_table(t) if t is not None else _said(body) if body is not None else "" for t, body in ((next(iter(_all(e, "tbl")), None), next(iter(_all(e, "txBody")), None)) for e in shapes)]
        units.append((str(i), "\n\n".join(p for p in parts if p)))
    return {"text": _sections("Slide ", units) if any(t for _, t in units) else "", "unit_key": "slide", "units": [{"label": a, "text": t} for a, t in units]}


def _xlsx(z: zipfile.ZipFile) -> dict:
    """A section with a grid for each sheet; sheets without a name are numbered."""
    names = z.namelist()
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    labels = [_attribute(e, "name") for e in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")] if "xl/workbook.xml" in names else []

    def value(c: Element) -> str:
        got, kind = "".join(e.text or "" for e in c.iter() if _local(e) in ("v", "t")), c.attrib.get("t")
        if kind == "s":
            return shared[int(got)] if got.isdigit() and int(got) < len(shared) else got
        return {"1": "True", "0": "False"}.get(got, got) if kind == "b" else got

    def column(c: Element, next_one: int) -> int:
        letters = re.match(r"[A-Z]{1,3}(?=\d)", c.attrib.get("r", ""))
        at = 0
        for x in letters[0] if letters else "":
            at = 26 * at + ord(x) - 64
        return at - 1 if letters else next_one

    units = []
    for i, n in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
        root, rows = ElementTree.fromstring(z.read(n)), []
        for row in _all(root, "row") or [root]:
            cells: dict[int, str] = {}
            for c in _all(row, "c"):
                cells[column(c, max(cells, default=-1) + 1)] = value(c)
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        units.append((labels[i] if i < len(labels) and labels[i] else f"Sheet{i + 1}", rows_grid(rows)))
    return {"text": _sections("", units) if any(t for _, t in units) else "", "unit_key": "sheet", "units": [{"label": a, "text": t} for a, t in units]}


def _epub(z: zipfile.ZipFile) -> dict:
    pages = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", z.read(n).decode("utf-8", "replace"))).strip() for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm")) and not n.startswith("META-INF/")]
    return {"text": "\n\n".join(p for p in pages if p), "tier": "zip"}


def _flat(pattern: str, key: str | None = None) -> Callable[[zipfile.ZipFile], dict]:
    """All runs of text in the entries of a pattern, without structure; with ``key``, each entry is a unit."""

    def read(z: zipfile.ZipFile) -> dict:
        entries = ["\n".join(_texts(z.read(n), "t")) for n in (_numbered(z.namelist(), pattern) if "(" in pattern else [pattern])]
        units = {"unit_key": key, "units": [{"label": str(i), "text": t} for i, t in enumerate(entries, 1)]} if key else {}
        return {"text": "\n".join(t for t in entries if t), "tier": "zip"} | units

    return read


def _core_title(z: zipfile.ZipFile) -> str | None:
    if "docProps/core.xml" not in z.namelist():
        return None
    return next(iter(_texts(z.read("docProps/core.xml"), "title")), None)


#: Readers of an archive by suffix, best first.
ZIPPED = {"docx": (_docx, _flat("word/document.xml")), "pptx": (_pptx, _flat(r"ppt/slides/slide(\d+)\.xml", "slide")), "xlsx": (_xlsx,), "epub": (_epub,)}


def tool_output(command: Sequence[str], data: bytes, ext: str, seconds: int = 60) -> str:
    """What a program prints for a file, whose name takes the place of ``{}``; '' if it is missing, fails or takes too long."""
    if shutil.which(command[0]) is None:
        return ""
    with tempfile.NamedTemporaryFile(suffix=f".{ext}") as f:
        f.write(data), f.flush()
        try:
            done = subprocess.run([f.name if c == "{}" else c for c in command], capture_output=True, timeout=seconds, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return ""
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def _pdf_tool(data: bytes) -> dict:
    """Wrapped text of a PDF with its title and authors, by the programs for it."""
    named = dict(re.findall(r"(?m)^(Title|Author):[ \t]*(.*?)[ \t]*$", tool_output(("pdfinfo", "{}"), data, "pdf", 10)))
    return {"title": named.get("Title"), "authors": named.get("Author"), "text": tool_output(("pdftotext", "-nopgbrk", "{}", "-"), data, "pdf"), "tier": "pdftotext", "wrapped": True}


def _shaped(made: dict) -> dict:
    """An engine's answer with its page chunks as units: page_number, else page + 1, else the place."""
    chunks = made.pop("chunks", None)
    if not chunks:
        return made
    units = []
    for i, c in enumerate(chunks, 1):
        meta = c.get("metadata") or {}
        number = meta["page_number"] if "page_number" in meta else meta["page"] + 1 if "page" in meta else i
        units.append({"label": str(number), "text": (c.get("text") or "").strip()})
    return {"text": "\n\n".join(u["text"] for u in units), "unit_key": "page", "units": units} | made


def extract_bytes(data: bytes | None, ext: str | None, engines: Mapping[str, Sequence[Engine]] | None = None) -> dict:
    """One file's title, authors, tier, text and units; an error text instead of an exception.

    Engines come first, then the archive's structure, then outside programs, then its flat text.
    """
    out = dict.fromkeys(RESULT.names) | {"text": "", "wrapped": False}
    if data is None:
        return out | {"error": "file not found"}
    try:
        for engine in (ENGINES if engines is None else engines).get(ext or "", ()):
            made = _shaped(dict(engine(data) or {}))
            if (made.get("text") or "").strip():
                return out | {k: v for k, v in made.items() if k in out} | {"text": made["text"][:BODY_MOST]}
        if ext in PLAIN:
            return out | {"tier": "text", "text": data.decode("utf-8", "replace")}
        if ext == "pdf":
            made = _pdf_tool(data)
            return out | (made | {"text": made["text"][:BODY_MOST]} if made["text"].strip() else {"error": "no engine for pdf"})
        if ext not in ZIPPED:
            return out | {"error": f"no engine for {ext}"}
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out |= {"title": _core_title(z), "tier": ""}
            first, *rest = ZIPPED[ext]
            tiers = [lambda: {"tier": "ooxml"} | first(z), lambda: {"text": tool_output(("pandoc", "-f", ext, "-t", "gfm", "{}"), data, ext), "tier": "pandoc"}, *[lambda r=r: r(z) for r in rest]]
            units = {}
            for tier in tiers:
                made = tier()
                units = units or {k: made[k] for k in ("unit_key", "units") if made.get(k)}
                if made["text"].strip():
                    return out | units | made | {"text": made["text"][:BODY_MOST]}
            return out | units
    except Exception as e:  # whatever a file or an engine does, the job goes on
        return out | {"error": f"{type(e).__name__}: {e}"}


def extracted_file(content: Column | str, ext: Column | str, engines: Mapping[str, Sequence[Engine]] | None = None) -> Column:
    """RESULT of each file. The engines known when the plan is made travel with it to the workers."""
    known = {k: list(v) for k, v in (ENGINES if engines is None else engines).items()}

    @F.pandas_udf(RESULT)
    def run(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_bytes(c, e, known) for c, e in zip(content, ext, strict=True)], columns=RESULT.names)

    return run(content, ext)


def grouped_pages(items: DataFrame, key: str, order: str, page: str, text: str) -> DataFrame:
    """(key, segment, page, text): items of a page joined by line feeds, pages in the order they first appear."""
    kept = items.where(F.col(page).isNotNull() & (F.length(text) > 0))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    pages = kept.groupBy(key, page).agg(F.min(order).alias("__first"), said.alias("text"))
    return pages.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("__first")) - 1).alias("segment"), page, "text")


def page_numbers(chunks: Column) -> Column:
    """Page of each chunk: its page_number, else page + 1, else its place."""
    return F.transform(chunks, lambda c, i: F.coalesce(c["page_number"], c["page"] + 1, i + 1))


def locators(units: Column, unit_key: Column) -> Column:
    """Segment numbers with the page, slide or sheet they come from; texts without words have none."""
    kept = F.filter(units, lambda u: trimmed(u["text"]) != "")
    number = lambda u, k: F.when(unit_key == k, u["label"].try_cast("int"))
    return F.transform(kept, lambda u, i: F.struct(i.alias("segment"), number(u, "page").alias("page"), F.when(unit_key == "sheet", u["label"]).alias("sheet"), number(u, "slide").alias("slide")))


def unit_segments(units: Column) -> Column:
    return F.transform(F.filter(units, lambda u: trimmed(u["text"]) != ""), lambda u: F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), u["text"].alias("text")))


def reflowed_file(df: DataFrame, file: str = "file") -> DataFrame:
    """The column of RESULT's shape with soft-wrapped text joined to paragraphs."""
    f = F.col(file)
    return once(df, **{file: f.withField("text", F.when(f["wrapped"], reflowed(f["text"])).otherwise(f["text"]))})


def file_columns(f: Column, stem: Column) -> dict[str, Column]:
    """A file of RESULT's shape as a result: blank text fails with 30, an engine error with 10."""
    ok = F.coalesce(trimmed(f["text"]) != "", F.lit(False))
    detail = F.struct(F.coalesce(f["tier"], F.lit("file")).alias("extractor"), F.coalesce(f["tier"].isin(*STRUCTURED), F.lit(False)).alias("structured"), locators(f["units"], f["unit_key"]).alias("locators"))
    none = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,text:string>>")
    return {
        "status": F.when(ok, "success").otherwise("failed"), "title": F.when(ok, F.coalesce(blank_to_null(f["title"]), stem)).otherwise(""), "author": F.when(ok, blank_to_null(f["authors"])),
        "text": F.when(ok, f["text"]).otherwise(""), "segments": F.when(ok, F.coalesce(unit_segments(f["units"]), none)), "extractor": F.when(ok, detail),
        "error": F.when(~ok, F.coalesce(f["error"], F.lit("no text found"))), "exit_code": F.when(ok, 0).when(f["error"].isNotNull(), 10).otherwise(30),
    }


def assembled(df: DataFrame, stem: str = "stem") -> DataFrame:
    """Files with a column ``file`` of RESULT's shape as results."""
    df = reflowed_file(df)
    made = file_columns(F.col("file"), F.col(stem))
    return df.select(*[c for c in df.columns if c not in ("file", "content")], *[c.alias(n) for n, c in made.items()])
