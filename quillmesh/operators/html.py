"""HTML to Markdown: region, chrome, links and widgets by built-in functions, the rewriting chain in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import urls
from quillmesh.functions.text import WS, bind, lines, replaced, squeezed, through, trimmed, unlines
from quillmesh.operators.html_steps import rewrite
from quillmesh.operators.identity import html_title

# Elements that hold no content, and widget texts of documentation and code sites.
DROPPED = ("script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "iframe")
WIDGETS = (
    "Skip to main content", "Search...", "Search", "⌘K", "⌘KAsk AI", "Ask AI", "Navigation", "On this page", "On this page-", "Table of contents", "Edit this page", "Was this page helpful?", "Yes", "No", "Suggest edits", "Last updated",
    "Start", "Mark Complete", "Mark as Complete", "Mark as Read", "Continue", "Next", "Previous", "×",
    "Show Gist options", "Embed", "Select an option", "Embed this gist in your website.", "Copy sharable link for this gist.", "Clone using the web URL.", "Learn more about clone URLs", "No results found", "Share", "Clone via HTTPS",
    "Instantly share code, notes, and snippets.", "Code", "Revisions", "Stars", "Forks",
)


def untagged(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def region(html: Column) -> Column:
    """Inside of the first article or main, else of the body, else all."""
    main, body = r"(?is)<(?:article|main)[^>]*>(.*?)</(?:article|main)>", r"(?is)<body[^>]*>(.*?)</body>"
    return F.when(html.rlike(main), F.regexp_extract(html, main, 1)).when(html.rlike(body), F.regexp_extract(html, body, 1)).otherwise(html)


def without_chrome(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, rf"(?is)<({'|'.join(DROPPED)})[^>]*>.*?</\1>", ""), r"(?s)<!--.*?-->", "")


@F.pandas_udf(T.StringType())
def _rewritten(body: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else rewrite(x, b) for x, b in zip(body, base, strict=True)], dtype=object)


def markdown(page: Column, base: Column) -> Column:
    """HTML as Markdown without the document title.

    Region and chrome are cut natively, so that only content goes to Python; the chain of
    dependent rewrites runs there, Arrow batch by batch. As one native expression the chain
    works too, but planning it took 17 s (133 s inside the engine's plan) before the first row.
    """
    return _rewritten(without_chrome(region(page)), base)


def document(page: Column, base: Column) -> Column:
    """As markdown, under the document title if there is one."""
    title = F.coalesce(html_title(page), F.lit(""))
    return F.concat(F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), markdown(page, base), F.lit("\n"))


def relative_links(md: Column, base: Column) -> Column:
    """Images, then links that look like paths, made absolute in Markdown; addresses of stored assets stay."""
    relative = lambda u: ~u.rlike(r"^(?i)(?:https?:|data:|mailto:|javascript:|tel:|#)") & ~u.contains("../../assets/") & ~u.rlike("^/?assets/")
    md = replaced(md, r"!\[([^\]]*)\]\(([^)\s]+)((?:\s+\"[^\"]*\")?)\)", lambda a, u, t: F.concat(F.lit("!["), a, F.lit("]("), F.when(relative(u), urls.resolved(u, base)).otherwise(u), t, F.lit(")")), (1, 2, 3))
    path_like = lambda u: relative(u) & (u.contains("/") | u.startswith("."))
    return replaced(md, r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)", lambda a, u: F.concat(F.lit("["), a, F.lit("]("), F.when(path_like(u), urls.resolved(u, base)).otherwise(u), F.lit(")")), (1, 2))


def without_widgets(md: Column) -> Column:
    """Widget texts, progress counts, empty headings and star buttons removed; indentation flattened."""
    # Buttons of code-sharing pages.
    for pattern in (
        r"-\s*\[(?:Star|Fork)\s*\n[\d,]+\s*\n\([\d,]+\)\][^\n]*You must be signed[^\n]*\n?",
        r"-\s*\[(?:Star|Fork)\s*\n[\d,]+\][^\n]*You must be signed[^\n]*\n?",
        r"-\s*\[(?:Star|Fork)\s*\n[\d,]+[KMB]?\s*\n",
        r"(?m)^[-*\s]*Save [\w./]+ to your computer and use it in GitHub Desktop\.\s*$\n?",
        r"Clone this repository at <script src=\"[^\"]+\"></script>\s*\n?",
        r"(?m)^\[Learn more about clone URLs\]\([^)]+\)\s*$\n?",
    ):
        md = F.regexp_replace(md, pattern, "")
    widgets = F.array(*[F.lit(w) for w in WIDGETS])
    bare = lambda v: F.regexp_replace(F.regexp_replace(trimmed(v), r"^[-*+]\s+", ""), r"^#+\s+", "")
    kept = lambda v: ~(F.array_contains(widgets, trimmed(v)) | F.array_contains(widgets, bare(v)) | trimmed(v).rlike(r"^\d+/\d+ (?:completed|done|read)$") | trimmed(v).rlike(r"^#+$") | v.rlike("You must be signed in to (?:star|fork) (?:a|this) gist"))

    def flat(v: Column) -> Column:
        v = F.when(v.contains("## ​"), F.replace(v, F.lit("​"), F.lit(""))).otherwise(v)
        left = F.regexp_replace(v, rf"^{WS}+", "")
        bullet = F.when(left.startswith("- "), F.concat(F.lit("- "), F.regexp_replace(F.substring(left, 3, 1 << 30), rf"^{WS}+", ""))).otherwise(left)
        return F.when(v.startswith(" ") & left.startswith("-"), bullet).when(v.rlike("^ {4}(?! )|^ {8}"), left).otherwise(v)

    return squeezed(bind(md, lambda x: unlines(F.transform(F.filter(lines(x), kept), flat))))


def extracted(df: DataFrame, column: str, base: str) -> DataFrame:
    """Markdown of a page if it has more than 200 code points before and after clean-up, else null."""
    enough = lambda x: F.when(F.length(trimmed(x)) > 200, x)
    return through(df.withColumn(column, document(F.col(column), F.col(base))), column, enough, lambda x: relative_links(x, F.col(base)), without_widgets, enough, trimmed)
