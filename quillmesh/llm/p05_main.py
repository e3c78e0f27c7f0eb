"""Main body of web pages by consensus paths of their hosts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import cut

HOST_PAGES, EDGE_SHARE = 3, 0.85  # a host's pages that agree on a path, and how often it lies outside the text
WIDE_PAGES, WIDE_HOSTS = 5, 3  # pages and hosts that agree on a path
INSIDE_SHARE = 0.025  # share of the pages, by its lower bound, on which a line between the text's own lines is an insert
CONTAINER_LINES = 10  # lines of a container path from which a host decides for itself
SHORT_WORDS = 14
BROADCAST_PATHS = 200_000  # winning paths that are broadcast, 20 bytes each; more are joined by a shuffle

SENTENCE_END = re.compile(r"[.!?…][\"'»”’)\]]*(?:\s|$)")
SENTENCES = re.compile(r"(?<=[.!?…])\s+")
MARKER = re.compile(r"^\s*(?:([-+])|([*•»›·▪>]+)|(\d{1,3}[.)]))\s+")
LINK = re.compile(r"\[[^\]]*\]\([^)]*\)")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SEPARATED = re.compile(r"\s(?:[|›»/>·•–])\s|\s{2,}")
MEMO = 1 << 16

BLANK, PROSE, HEADING, TABLE, CODE, DASH, MARKED, NAV, PLAIN, INSERTED = range(10)
FIXED = (HEADING, TABLE, CODE)  # shapes that have no text path
Shape = tuple[int, int, tuple[int, ...], tuple[int, ...]]
_shapes: dict[str, Shape] = {}


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) >> 1


def _kind(text: str, n: int) -> int:
    """What kind of container a line is by its marks and its end; no word list is asked."""
    if text[0] == "#" and text.lstrip("#")[:1] in (" ", "\t"):
        return HEADING
    if text[0] == "|" and text[-1] == "|":
        return TABLE
    marker = MARKER.match(text)
    if LINK.search(text) and not LINK.sub("", text).strip(" *-•»›"):
        return NAV
    if n >= 5 and SENTENCE_END.search(text) and not (marker and marker[2]):
        return DASH if marker else PROSE
    if marker:
        return DASH if marker[1] or marker[3] else MARKED
    return NAV if n <= 30 and SEPARATED.search(text) and not SENTENCE_END.search(text) else PLAIN


def shape(line: str) -> Shape:
    """(kind, words, text paths, sentence paths) of a non-blank line.

    The text path is the line without its list mark and, unless it is prose, with its digits
    masked; a label before a colon is a path of its own. Prose has a path for each sentence.
    """
    text = line.strip()
    known = _shapes.get(text)
    if known is None:
        n = len(WORD.findall(text))
        kind, bare = _kind(text, n), MARKER.sub("", text, count=1).lower()
        paths: tuple[int, ...] = ()
        sentences: tuple[int, ...] = ()
        if kind == PROSE:
            paths, sentences = (_hash(bare),), tuple(_hash("~" + x) for x in SENTENCES.split(bare) if x)
        elif kind not in FIXED:
            bare = re.sub(r"\d+", "0", bare)
            label, colon, rest = bare.partition(":")
            paths = (_hash(bare), _hash(label + ":")) if colon and rest.strip() and 0 < len(label.split()) <= 5 else (_hash(bare),)
        known = kind, n, paths, sentences
        if len(text) <= 400:
            if len(_shapes) >= MEMO:
                _shapes.clear()
            _shapes[text] = known
    return known


def lines_of(text: str) -> list[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(line_no, kind, words, text paths, sentence paths) of the non-blank lines of a page."""
    out, fenced = [], False
    for no, line in enumerate(text.split("\n")):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            out.append((no, CODE, 0, (), ()))
        elif line.strip():
            out.append((no, CODE, 0, (), ()) if fenced else (no, *shape(line)))
    return out


def ballots(lines: list[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]) -> dict[int, list[int]]:
    """path: (lines, lines outside the text, lines of dash lists) on a page.

    A line is outside if no line of prose lies before it or none after it.
    """
    prose = [i for i, x in enumerate(lines) if x[1] == PROSE]
    out: dict[int, list[int]] = {}
    for i, (_, kind, _, texts, sentences) in enumerate(lines):
        a, b = (prose[0], prose[-1]) if prose else (-1, -1)
        if i == a:
            a = prose[1] if len(prose) > 1 else -1
        elif i == b:
            b = prose[-2]
        outside = a < 0 or i < a or i > b
        for path in (*texts, *sentences):
            vote = out.setdefault(path, [0, 0, 0])
            vote[0] += 1
            vote[1] += outside
            vote[2] += kind == DASH
    return out


def surroundings(lines: list[tuple[int, int, int]]) -> list[int]:
    """Line numbers that are not main body, from (line_no, shape, vote) in order; vote 1: its path won as surroundings.

    The body runs from the first to the last line of prose that no vote excludes, together
    with headings, tables, code and dash lists next to it. Within it, voted lines, navigation,
    marked and plain lines go.
    """
    kinds = [INSERTED if v and k not in FIXED else k for _, k, v in lines]
    core = [i for i, k in enumerate(kinds) if k == PROSE]
    keep = [False] * len(lines)
    if core:
        first, last = core[0], core[-1]
    else:
        solid = [i for i, k in enumerate(kinds) if k in FIXED]
        if not solid:
            return [no for no, _, _ in lines]
        first, last = solid[0], solid[-1]

    def adjoins(i: int, step: int) -> int:
        """Moves an end outwards over lists, tables, code and headings."""
        edge = i
        while 0 <= i + step < len(lines):
            i += step
            if kinds[i] in FIXED:
                edge = i
            elif kinds[i] != DASH:
                if kinds[i] in (INSERTED, MARKED, PLAIN, NAV):
                    continue
                break
            elif _block_kept(i):
                edge = i
        return edge

    def _block_kept(i: int) -> bool:
        """A dash list stays whole or goes whole, by the majority of its lines' votes."""
        a = b = i
        while a > 0 and lines[a][0] - lines[a - 1][0] == 1 and lines[a - 1][1] == DASH:
            a -= 1
        while b + 1 < len(lines) and lines[b + 1][0] - lines[b][0] == 1 and lines[b + 1][1] == DASH:
            b += 1
        if a > 0 and lines[a][0] - lines[a - 1][0] == 1 and kinds[a - 1] in (INSERTED, MARKED, PLAIN, NAV):
            return False
        return 2 * sum(lines[j][2] for j in range(a, b + 1)) < b - a + 1

    low, high = adjoins(first, -1), adjoins(last, 1)
    for i, (no, kind, _) in enumerate(lines):
        if low <= i <= high:
            if kind == DASH:
                keep[i] = _block_kept(i)
            else:
                keep[i] = kinds[i] in (PROSE, *FIXED)
    return [no for (no, _, _), k in zip(lines, keep, strict=True) if not k]


def containers(lines: list[tuple[int, int, int]], words: list[int], gone: set[int]) -> list[int]:
    """The container path of each line, from (line_no, kind, vote) in order.

    It names the line's kind, its length, its zone (before, within or after the prose that no
    vote excludes), the kind its block begins with, and what the line before and the block
    before are. Lists stay or go as a whole, so theirs names the page's own score instead of a
    length.
    """
    core = [i for i, (_, kind, vote) in enumerate(lines) if kind == PROSE and not vote]
    first, last = (core[0], core[-1]) if core else (len(lines), -1)
    out, head = [], 0
    for i, (no, kind, _) in enumerate(lines):
        if i == 0 or no - lines[i - 1][0] != 1:
            head = i
        zone = 0 if i < first else 2 if i > last else 1
        size = int(words[i] > SHORT_WORDS) if kind == PROSE else min(words[i], 15) // 5
        if kind == DASH:
            size = int(lines[i][0] in gone)
        out.append((((zone * 10 + kind) * 4 + size) * 10 + lines[head][1]) * 22 + (i > head) * 11 + (lines[head - 1][1] + 1 if head else 0))
    return out


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^@/]*@)?(?:www\.)?([^/:?#]+)", 1))


def page_lines(pages: DataFrame, key: str = "extraction_id", text: str = "text", url: str = "source_id") -> DataFrame:
    """(key, host, lines, paths) of each page; the pages' texts go no further.

    lines: no, kind, words, and the places of its text and sentence paths in ``paths``, which
    holds the page's vote on each path.
    """
    rows = pages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), _host(F.col(url)).alias("host"), F.col(text).alias("t"))
    line = pa.struct([("no", pa.int32()), ("kind", pa.int8()), ("words", pa.int32()), ("texts", pa.list_(pa.int32())), ("sentences", pa.list_(pa.int32()))])
    path = pa.struct([("path", pa.int64()), ("lines", pa.int32()), ("outside", pa.int32()), ("dash", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            ls, ps = [], []
            for t in batch.column(2).to_pylist():
                read = lines_of(t)
                votes = ballots(read)
                place = {p: i for i, p in enumerate(votes)}
                ls.append([{"no": a, "kind": b, "words": c, "texts": [place[p] for p in d], "sentences": [place[p] for p in e]} for a, b, c, d, e in read])
                ps.append([{"path": p, "lines": v[0], "outside": v[1], "dash": v[2]} for p, v in votes.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ls, pa.list_(line)), pa.array(ps, pa.list_(path))], names=[key, "host", "lines", "paths"])

    return rows.mapInArrow(
        run, f"{key} bigint, host string, lines array<struct<no:int,kind:tinyint,words:int,texts:array<int>,sentences:array<int>>>, paths array<struct<path:bigint,lines:int,outside:int,dash:int>>"
    )


def winning_paths(paged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text and sentence paths that the pages of a host (host, path), or of many hosts (path), agree to be surroundings.

    A path wins if it lies outside the text nearly always, or if it comes back on so many pages
    that no line of an article would. Votes are combined before they travel, so a path that is
    on every page of a hot host is no hot key.
    """
    pages = paged.groupBy("host").agg(F.count("*").alias("pages"))
    votes = paged.select("host", F.explode("paths").alias("p")).groupBy("host", "p.path").agg(F.count("*").alias("n"), F.sum("p.lines").alias("lines"), F.sum("p.outside").alias("out"), F.sum("p.dash").alias("dash"))
    votes = cut(votes.join(pages, "host"))
    edge = F.col("out") >= EDGE_SHARE * F.col("lines")
    inside = lambda least: (F.col("dash") == 0) & (F.col("n") >= 2 * least) & (F.col("n") - 2 * F.sqrt("n") >= INSIDE_SHARE * F.col("pages"))
    by_host = votes.where((F.col("host") != "") & (F.col("n") >= HOST_PAGES) & (edge | inside(HOST_PAGES))).select("host", "path")
    sums = votes.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "lines", "out", "dash", "pages")], F.count("*").alias("hosts"))
    return by_host, sums.where((F.col("n") >= WIDE_PAGES) & (F.col("hosts") >= WIDE_HOSTS) & (edge | inside(WIDE_PAGES))).select("path")


def scored_lines(paged: DataFrame, by_host: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """(key, host, no, container, voted, gone) of each line, read again with the winning paths.

    voted: its text path won, or most of its sentences' paths (a list goes or stays as a whole,
    by its container); gone: this page's own score says that the container is surroundings.
    """
    small = by_host.count() + wide.count() <= BROADCAST_PATHS
    hint = F.broadcast if small else (lambda df: df)
    each = paged.select(key, "host", F.posexplode("paths").alias("i", "p")).select(key, "host", "i", "p.path")
    won = each.join(hint(wide.withColumn("w", F.lit(1))), "path", "left").join(hint(by_host.withColumn("h", F.lit(1))), ["host", "path"], "left").where("w is not null or h is not null")
    marks = won.groupBy(key).agg(F.collect_list("i").alias("won"))
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            rows = []
            for k, h, ls, ws in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                winners = set(ws or ())
                votes = [int(not winners.isdisjoint(x["texts"]) or 2 * sum(i in winners for i in x["sentences"]) > len(x["sentences"])) for x in ls]
                lines = [(x["no"], x["kind"], v) for x, v in zip(ls, votes, strict=True)]
                gone = set(surroundings(lines))
                rows += [(k, h, no, c, bool(v) and kind != DASH, no in gone) for (no, kind, v), c in zip(lines, containers(lines, [x["words"] for x in ls], gone), strict=True)]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[key, "host", "no", "container", "voted", "gone"])

    return paged.select(key, "host", "lines").join(marks, key, "left").mapInArrow(run, f"{key} bigint, host string, no int, container int, voted boolean, gone boolean")


def surrounding_lines(pages: DataFrame, key: str = "extraction_id", text: str = "text", url: str = "source_id") -> DataFrame:
    """(key, line_no) of each non-blank line that is not main body.

    Pages vote on generalised paths, twice. First on the paths of texts and sentences: those
    that a host's pages, or those of many hosts, keep repeating around the text win. Then every
    page scores its containers with the winners, and the hosts vote on container paths: a line
    is surroundings if its text won, or if most lines of its container path on its host are
    scored so; for container paths that a host has hardly any lines of, all hosts decide.

    Null keys and texts give no rows; pages without a host are judged by the wide votes alone;
    repeated rows of one key give one result if their texts are equal.
    """
    paged = cut(page_lines(pages, key, text, url).dropDuplicates([key]))
    by_host, wide = winning_paths(paged)
    scored = cut(scored_lines(paged, cut(by_host), cut(wide), key))
    votes = scored.where("not voted").groupBy("host", "container").agg(F.sum(F.col("gone").cast("int")).alias("gone"), F.count("*").alias("lines"))
    everywhere = votes.groupBy("container").agg((2 * F.sum("gone") >= F.sum("lines")).alias("anywhere"))
    own = F.when((F.col("host") != "") & (F.col("lines") >= CONTAINER_LINES), 2 * F.col("gone") >= F.col("lines"))
    decided = cut(votes.join(F.broadcast(everywhere), "container").select("host", "container", F.coalesce(own, "anywhere").alias("won")).where("won"))  # containers are numbers below 26,400
    won = F.broadcast(decided) if decided.count() <= BROADCAST_PATHS else decided
    rest = scored.where("not voted").join(won, ["host", "container"], "left_semi")
    return scored.where("voted").unionByName(rest).select(key, F.col("no").alias("line_no"))


def main_body(pages: DataFrame, key: str = "extraction_id", text: str = "text", url: str = "source_id") -> DataFrame:
    """(key, body): each page's text without its surrounding lines, at most one blank line in a row.

    Pages whose lines are all surroundings have an empty body; null keys and texts give no rows;
    of repeated rows of a key one is read.
    """
    gone = surrounding_lines(pages, key, text, url).groupBy(key).agg(F.collect_list("line_no").alias("gone"))
    read = pages.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).dropDuplicates([key]).join(gone, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out = set(g or ())
                bodies.append(re.sub(r"\n\s*\n", "\n\n", "\n".join(line for i, line in enumerate(t.split("\n")) if i not in out)).strip())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=[key, "body"])

    return read.mapInArrow(run, f"{key} bigint, body string")
