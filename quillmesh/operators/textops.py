"""Text clean-up scalars. All built in, but for two line folds that carry merged text along."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import bind, chained, lines, replaced, squeezed, trimmed, unlines

# Interface texts of thread pages.
METRIC_WORDS = (
    "Views", "Show this thread", "Want to publish your own Article?", "Upgrade to Premium", "Subscribe", "|", "Terms of Service", "Privacy Policy", "Cookie Policy", "Accessibility", "Ads info", "More", "Blog", "Careers", "Brand Resources",
    "Advertising", "Marketing", "X for Business", "Developers", "News", "Settings", "About", "Download the X app", "Help Center", "·",
)
# Fixed value: a line that is a counter, a date or a clock time with its date, as thread pages show them.
METRIC_LINE = r"^(?:[\d.,]+[KMB]?|Read \d+ repl(?:y|ies)|[A-Z][a-z]+ \d+(?:, \d{4})?|\d+:\d+\s*[AP]M\s*·\s*[A-Z][a-z]+\s*\d+,?\s*\d*|©\s*20\d\d\s*X Corp\.?)$"
CHROME_STARTS = (
    r"Trending in [A-Z][\w ]+$", r"Trending now$", r"What['’]s happening$", r"Who to follow$", r"Relevant people$", r"Politics · Trending$", r"Sports · Trending$", r"Entertainment · Trending$", r"Read \d+ repl(?:y|ies)$", r"New to X\?$",
    r"Don['’]t miss what['’]s happening", r"© 20\d\d X Corp", r"Sign up with Apple", r"Sign up with Google", r"Sign up now to get your own", r"Create account$", r"By signing up, you agree to the Terms",
)
BODY_CUTS = (
    r"Don[’']t miss what[’']s happening", r"Log in\nSign up", r"About\nDownload the X app", r"Terms of Service", r"© 20\d\d X Corp", r"Privacy Policy\s*\n\s*\|", r"Cookie Policy", r"Show more\nTerms", r"\bNew to X\?",
    r"Sign up now to get your own", r"Read \d+ repl", r"Show this thread", r"^\s*Sign up with Apple",
)


def clean_text(x: Column) -> Column:
    x = F.regexp_replace(squeezed(x), r"\t+", " ")
    return trimmed(F.regexp_replace(x, r"(?i)(?:Sign up|Log in|Sign in|Cookie|Accept all).*\n?", ""))


def reflowed(x: Column) -> Column:
    """Soft-wrapped lines joined: a paragraph ends at a blank line or after closing punctuation.

    What stands between two lines hangs on these two alone: a space after an open line, a line
    feed where a paragraph ends, and one more before a blank line. So no text is carried along.
    """
    stops = lambda line: line.rlike(r"[.!?:\")]$")

    def joined(ls: Column) -> Column:
        def piece(line: Column, i: Column) -> Column:
            before = F.get(ls, i - 1)
            open_ = (i > 0) & (before != "") & ~stops(before)
            return F.when(line == "", F.when(open_, "\n\n").otherwise("\n")).otherwise(F.concat(F.when(open_, " ").otherwise(""), line, F.when(stops(line), "\n").otherwise("")))

        return F.array_join(F.transform(ls, piece), "")

    text = F.regexp_replace(x, r"\r\n?", "\n")
    ended = F.regexp_replace(bind(F.transform(F.split(text, "\n", -1), trimmed), joined), r"\n$", "")
    return squeezed(F.when(text.endswith("\n"), F.regexp_replace(ended, r"\n$", "")).otherwise(ended))


def restored_breaks(x: Column) -> Column:
    """Paragraph breaks before numbered dashes, arrows, pictured headings and dated updates, and between long finished lines."""
    for mark in (r"\d{1,3}\s*[—\-–]\s+\S", "→ ", r"[\x{1F300}-\x{1FAFF}]\s+[A-Z][A-Za-z &/]+", r"Update\s+[A-Z][a-z]+\s+\d+[, ]"):
        x = F.regexp_replace(x, rf"(?<!^)(?<!\n)\s({mark})", "\n\n$1")

    def spread(v: Column) -> Column:
        ls = lines(v)
        after = lambda i: F.coalesce(F.get(ls, i + 1), F.lit(""))
        wide = lambda s: F.length(trimmed(s)) > 30
        return unlines(F.transform(ls, lambda s, i: F.when(wide(s) & wide(after(i)) & ~after(i).rlike(r"^\s*[-*•]\s") & s.rlike(r"[.!?\"')\]…]\s*$"), F.concat(s, F.lit("\n"))).otherwise(s)))

    return F.concat(trimmed(squeezed(bind(x, spread))), F.lit("\n"))


def without_metrics(x: Column) -> Column:
    """Runs of two or more counter and interface lines removed; blanks inside a run go with it.

    A fold marks each line with the number of metric lines of its run: forwards, then backwards
    by taking the largest mark of the run.
    """
    words = F.array(*[F.lit(w) for w in METRIC_WORDS])
    bare = lambda s: trimmed(F.regexp_replace(trimmed(s), r"^(?:>\s*)+", ""))
    metric = lambda s: (bare(s) != "") & (bare(s).rlike(METRIC_LINE) | F.array_contains(words, bare(s)))

    def run(v: Column) -> Column:
        ls = lines(v)
        flags = F.transform(ls, lambda s: F.when(metric(s), F.lit("m")).when(trimmed(s).isin("", ">"), F.lit("b")).otherwise(F.lit("t")))
        # One character a line; a run is metric lines with single or repeated blanks only before another one.
        marks = replaced(F.array_join(flags, ""), r"(m(?:b?m)+)", lambda r: F.repeat(F.lit("x"), F.length(r)))
        return unlines(F.transform(F.filter(F.arrays_zip(ls.alias("s"), F.split(marks, "").alias("f")), lambda p: p["f"] != "x"), lambda p: p["s"]))

    return F.concat(trimmed(squeezed(bind(x, run))), F.lit("\n"))


def before_any(x: Column, patterns: tuple[str, ...]) -> Column:
    """What stands before the earliest match of any pattern; all of it without a match."""
    return F.split(x, "(?m)(?:" + "|".join(patterns) + ")", 2)[0]


def cut_at_chrome(x: Column) -> Column:
    at = (*(r"^(?:-\s+)?" + p for p in CHROME_STARTS), r"^Show more$\nTerms")
    head = before_any(x, at)
    return F.when(head != x, F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("\n"))).otherwise(x)


def conversation_part(x: Column) -> Column:
    """What follows the word Conversation up to the first interface text; under 50 code points counts as nothing."""
    after = F.when(x.rlike(r"\bConversation\b"), trimmed(F.regexp_extract(x, r"(?s)\bConversation\b(.*)$", 1))).otherwise("")
    return bind(trimmed(before_any(after, BODY_CUTS)), lambda c: F.when(F.length(c) < 50, "").otherwise(c))


def joined_urls(x: Column) -> Column:
    """URLs broken over up to six lines joined; an ellipsis right after a URL goes."""

    def made(scheme: Column, rest: Column) -> Column:
        return F.concat(scheme, F.regexp_replace(rest, r"\n", ""))

    x = replaced(x, r"(https?://)\n((?:[a-zA-Z0-9._/\-?=&%#~+]+\n){1,6})", made, (1, 2))
    return F.regexp_replace(x, r"(https?://\S+)…", "$1")


def with_links(x: Column, known: Column) -> Column:
    """Short links replaced by what a lookup map holds for them; unknown ones stay."""
    return replaced(x, r"(https?://t\.co/\w+)", lambda u: F.coalesce(F.try_element_at(known, u), u))


def without_comments(x: Column) -> Column:
    return trimmed(squeezed(unlines(F.filter(lines(x), lambda s: ~trimmed(s).rlike(r"^<!--.*-->$")))))


def body_cap(x: Column, most: int = 50_000) -> Column:
    return F.left(x, F.lit(most))


def short_name(title: Column, limit: Column | int = 200) -> Column:
    """A title within the limit: cut after a natural break in its last fifth, at a space, or hard, with an ellipsis."""
    most = limit if isinstance(limit, Column) else F.lit(limit)
    budget = most - 1
    at = lambda i: F.substring(title, i + 1, F.lit(1))
    stop = F.array_max(F.filter(F.sequence(F.floor(budget * 0.8).cast("int"), budget), lambda i: at(i).isin(":", "—", "|", ",", "。")))
    space = F.array_max(F.filter(F.sequence(F.lit(1), budget), lambda i: at(i).rlike(r"^\s$")))
    cut = F.when(stop.isNotNull(), F.rtrim(F.left(title, stop + 1))).when(space.isNotNull(), F.rtrim(F.left(title, space))).otherwise(F.left(title, budget))
    return F.when(F.length(title) <= most, title).otherwise(F.concat(cut, F.lit("…")))


def tag_text(x: Column) -> Column:
    """Tags as spaces, white space runs as one space."""
    return trimmed(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def entry_number(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"(\d+)\.xml$", 1).try_cast("int"), F.lit(0))


def _merged(text: str | None) -> str | None:
    """Lines that continue the one before, as thread pages break them around links, are joined to it."""
    if not text:
        return text
    out: list[str] = []
    for line in text.split("\n"):
        head, tail = (out[-1].rstrip() if out else ""), line.lstrip()
        if not head or not tail:
            out.append(line)
            continue
        new_sentence = head[-1] in ".!?…" and tail[0].isupper() and len(tail) > 10
        glued = tail[0] in ",;:)]" or head[-1] == "(" or (len(tail) <= 3 and re.match(r"[.,;:!?\s]+\S?", tail))
        spaced = head[-1].isalnum() and (tail[0].islower() or tail[0] in "\"'(")
        if new_sentence or not (glued or spaced):
            out.append(line)
        else:
            out[-1] = head + ("" if glued else " ") + tail
    return "\n".join(out)


def _bulleted(text: str | None) -> str | None:
    """Two or more plain lines after a line that ends in a colon become list items."""
    if not text:
        return text
    rows, i = text.split("\n"), 0
    plain = lambda s: 8 <= len(s) <= 300 and not s.startswith(("- ", "* ", "> ", "#", "|"))
    while i < len(rows):
        end = i + 1
        lead = rows[i].rstrip()
        if lead.endswith(":") and 10 < len(lead) < 200:
            while end < len(rows) and plain(rows[end].strip()):
                end += 1
            if end - i > 2:
                rows[i + 1 : end] = ["- " + s.strip() for s in rows[i + 1 : end]]
                i = end
                continue
        i += 1
    return "\n".join(rows)


@F.pandas_udf(T.StringType())
def merged_lines(text: pd.Series) -> pd.Series:
    return text.map(_merged, na_action="ignore")


@F.pandas_udf(T.StringType())
def colon_lists(text: pd.Series) -> pd.Series:
    return text.map(_bulleted, na_action="ignore")


def notebook_name(title: Column, video: Column, day: Column, limit: int = 200, tag: str | None = None, label: str = "quillmesh") -> Column:
    """Label with tag, title, video and day with bullets between; the title gets what the rest leaves, at least 20 code points."""
    head = label + (f"[{tag}] " if tag else "")
    room = F.greatest(F.lit(20), F.lit(limit - len(head) - 9) - F.length(video) - F.length(day))
    return F.concat_ws(" • ", F.lit(head), short_name(title, room), video, day)


def thread_section(x: Column, known: Column) -> Column:
    """All steps of a thread section in their order."""
    return colon_lists(chained(merged_lines(x), joined_urls, lambda v: with_links(v, known), restored_breaks, cut_at_chrome, without_metrics))
