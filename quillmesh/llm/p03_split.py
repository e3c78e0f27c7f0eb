"""Splitting oversized items at natural boundaries by packing their structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, SEGMENT_LIMIT, OVERLAP = 4000, 1500, 100

HEADING = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]|[ \t]*<h([1-6])\b", re.I)
ITEM = re.compile(r"([ \t]*)(?:[-*+•»]|\d{1,3}[.)])[ \t]+")
FENCE = re.compile(r"[ \t]*(?:```|~~~)")
SENTENCE = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s+|[;:]\s+(?=\S)")

Span = tuple[int, int]


class Node:
    """A stretch of the text; the children of a node tile it."""

    __slots__ = ("start", "end", "children")

    def __init__(self, start: int, end: int, children: list[Node] | None = None):
        self.start, self.end, self.children = start, end, children


def _tile(start: int, end: int, cuts: list[int]) -> list[Span]:
    edges = [start, *[c for c in cuts if start < c < end], end]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def parse(text: str) -> Node:
    """Headings nest by level, blocks within sections, list items by indentation, lines within blocks."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line))
        at += len(line)
    marks, fenced = [], False  # (level, start): headings 1-6, blocks 7, items 8 and deeper, lines 99
    blank = True
    for a, _, line in lines:
        level = 99
        if FENCE.match(line):
            level, fenced = (7 if not fenced else 99), not fenced
        elif not fenced and (h := HEADING.match(line)):
            level = len(h[1]) if h[1] else int(h[2])
        elif not fenced and (i := ITEM.match(line)):
            level = 8 + min(40, len(i[1].expandtabs(4)))
        elif blank and line.strip():
            level = 7
        blank = not line.strip()
        if not blank:
            marks.append((level, a))
    return _nest(0, len(text), marks)


def _nest(start: int, end: int, marks: list[tuple[int, int]]) -> Node:
    """Cuts a stretch at its highest marks; each part holds the lower marks."""
    root = Node(start, end)
    stack = [(root, marks)]
    while stack:
        node, own = stack.pop()
        inner = [m for m in own if m[1] > node.start]
        if not inner:
            continue
        top = min(level for level, _ in inner)
        node.children = [Node(a, b) for a, b in _tile(node.start, node.end, [p for level, p in inner if level == top])]
        k = 0
        for child in node.children:
            part = []
            while k < len(inner) and inner[k][1] < child.end:
                part.append(inner[k])
                k += 1
            stack.append((child, part))
    return root


def _leaves(text: str, start: int, end: int, limit: int) -> list[Span]:
    """A stretch without structure: sentences, then words, then single code points."""
    cuts = [m.end() for m in SENTENCE.finditer(text, start, end)]
    out: list[Span] = []
    for a, b in _tile(start, end, cuts):
        if b - a <= limit:
            out.append((a, b))
            continue
        for c, d in _tile(a, b, [m.end() for m in re.compile(r"\s+").finditer(text, a, b)]):
            out += [(x, min(x + limit, d)) for x in range(c, d, limit)]
    return out


def _pack(spans: list[Span], limit: int) -> list[Span]:
    """Merges neighbours from left to right as long as they stay within the limit."""
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pack(text: str, node: Node, limit: int) -> list[Span]:
    """Subtrees within the limit stay whole and merge with their siblings; only others are entered.

    Children of one node are merged before the results go up, so that a piece crosses the
    border of a section only where the section as a whole fits beside its neighbours.
    """
    done: dict[int, list[Span]] = {}
    order, stack = [], [node]
    while stack:
        n = stack.pop()
        order.append(n)
        if n.end - n.start > limit and n.children:
            stack += n.children
    for n in reversed(order):
        if n.end - n.start <= limit:
            done[id(n)] = [(n.start, n.end)]
        elif n.children:
            done[id(n)] = _pack([s for c in n.children for s in done[id(c)]], limit)
        else:
            done[id(n)] = _pack(_leaves(text, n.start, n.end, limit), limit)
    return done[id(node)]


def split(text: str, limit: int, overlap: int = OVERLAP) -> list[Span]:
    """Pieces as (start, end); each but the first begins up to ``overlap`` code points before the last one's end.

    The overlap begins at a word where one begins in its first fifth. A text within the limit is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    out: list[Span] = []
    for a, b in pack(text, parse(text), limit - overlap):
        back = min(overlap, out[-1][1] - out[-1][0]) if out else 0
        start = a - back
        if back == overlap:
            space = re.compile(r"\s(?=\S)").search(text, start - 1, start + overlap // 5)
            start = space.end() if space else start
        out.append((start, b))
    return out


def split_items(items: DataFrame, key: str = "extraction_id", no: str = "seg_no", text: str = "text", limit: str = "size_limit", overlap: int = OVERLAP) -> DataFrame:
    """Pieces (key, no, piece_no, start, end, piece) of the items longer than their limit.

    Items within their limit, null and empty texts give no rows; pieces tile the text apart
    from the overlap; nothing is dropped. Only the long items reach Python.
    """
    long = items.where(F.length(text) > F.col(limit)).select(F.col(key).cast("long").alias("k"), F.col(no).cast("int").alias("n"), F.col(text).alias("t"), F.col(limit).cast("int").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["k"], r["n"], i, a, b, r["t"][a:b]) for i, (a, b) in enumerate(split(r["t"], r["m"], overlap))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=[key, no, "piece_no", "start", "end", "piece"])

    return long.mapInArrow(run, f"{key} bigint, {no} int, piece_no int, start int, end int, piece string")


def oversized_items(extractions: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts (seg_no -1) and segments of both tables with their limits: (extraction_id, seg_no, text, size_limit)."""
    e = extractions.where("extraction_id is not null")
    texts = e.where(F.length("text") > TEXT_LIMIT).select("extraction_id", F.lit(-1).alias("seg_no"), "text", F.lit(TEXT_LIMIT).alias("size_limit"))
    held = e.where(F.exists("segments", lambda s: F.length(s["text"]) > SEGMENT_LIMIT)).select("extraction_id", F.posexplode("segments").alias("seg_no", "s")).select("extraction_id", "seg_no", "s.text", F.lit(SEGMENT_LIMIT).alias("size_limit"))
    cues = segments.where(F.col("extraction_id").isNotNull() & (F.length("text") > SEGMENT_LIMIT)).select("extraction_id", F.col("seq").alias("seg_no"), "text", F.lit(SEGMENT_LIMIT).alias("size_limit"))
    return texts.unionByName(held).unionByName(cues)


def split_extractions(extractions: DataFrame, segments: DataFrame) -> DataFrame:
    """All pieces of all oversized texts and segments, each delivery counted once."""
    return split_items(oversized_items(extractions, segments)).dropDuplicates(["extraction_id", "seg_no", "piece_no"])
