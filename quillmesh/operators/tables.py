"""Tables as Markdown grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import trimmed


def _cell(c: Column) -> Column:
    return trimmed(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def grid(rows: Column) -> Column:
    """array<array<string>> to a grid: trailing empty rows and columns dropped, ragged rows padded; '' if nothing is left."""
    filled = lambda r: F.exists(r, lambda c: trimmed(F.coalesce(c, F.lit(""))) != "")
    last = F.array_max(F.transform(rows, lambda r, i: F.when(filled(r), i + 1).otherwise(0)))
    wide = F.array_max(F.transform(rows, lambda r: F.array_max(F.concat(F.array(F.lit(0)), F.transform(r, lambda c, j: F.when(trimmed(F.coalesce(c, F.lit(""))) != "", j + 1).otherwise(0))))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), wide - 1), lambda j: _cell(F.get(r, j))), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 1, last), line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    return F.when(F.coalesce(last, F.lit(0)) == 0, "").otherwise(F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1 << 30)), "\n"))


def rows_grid(rows: list[list[str | None]]) -> str:
    """As grid, for rows that are read inside a worker."""
    cells = [[(c or "").replace("|", r"\|").replace("\n", " ").strip() for c in r] for r in rows]
    full = [i for i, r in enumerate(cells) if any(r)]
    wide = max((j + 1 for r in cells for j, c in enumerate(r) if c), default=0)
    lines = ["| " + " | ".join((r + [""] * wide)[:wide]) + " |" for r in cells[: full[-1] + 1]] if full else []
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]]) if lines else ""


def html_grid(html: Column) -> Column:
    """An HTML table of at least two rows and columns as a grid with caption, else null.

    Column spans become blanks. One cell over all columns is a bold caption before the grid and
    a plain line after it. Pipes are escaped in body rows only.
    """
    rows = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|$)"), F.lit(1)),
        lambda r: F.transform(
            F.regexp_extract_all(r, F.lit(r"(?is)(<td\b[^>]*>.*?)(?=<td\b|</td>|$)"), F.lit(1)),
            lambda c: F.struct(
                trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)^<td[^>]*>", ""), "<[^>]+>", ""), r"\s+", " ")).alias("text"), F.coalesce(F.regexp_extract(c, r"(?is)^<td[^>]*\bcolspan=[\"']?(\d+)", 1).try_cast("int"), F.lit(1)).alias("span")
            ),
        ),
    )
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    width = lambda r: F.aggregate(r, F.lit(0), lambda n, c: n + c["span"])
    wide = F.array_max(F.transform(rows, width))
    caption = lambda r: (F.size(r) == 1) & (F.get(r, 0)["span"] >= wide) & (wide > 1)
    plain = F.filter(rows, lambda r: ~caption(r))
    spread = lambda r: F.flatten(F.transform(r, lambda c: F.concat(F.array(c["text"]), F.array_repeat(F.lit(""), c["span"] - 1))))
    padded = lambda r: F.slice(F.concat(spread(r), F.array_repeat(F.lit(""), wide)), F.lit(1), wide)
    line = lambda r, esc: F.concat(F.lit("| "), F.array_join(F.transform(padded(r), lambda c: F.replace(c, F.lit("|"), F.lit("\\|")) if esc else c), " | "), F.lit(" |"))
    first = F.array_min(F.filter(F.transform(rows, lambda r, i: F.when(~caption(r), i)), lambda i: i.isNotNull()))
    before = F.transform(F.filter(F.slice(rows, F.lit(1), first), lambda r: caption(r) & (F.get(r, 0)["text"] != "")), lambda r: F.concat(F.lit("**"), F.get(r, 0)["text"], F.lit("**\n")))
    after = F.transform(F.filter(F.slice(rows, first + 1, F.size(rows)), lambda r: caption(r) & (F.get(r, 0)["text"] != "")), lambda r: F.concat(F.lit("\n"), F.get(r, 0)["text"]))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    all_lines = F.concat(before, F.array(line(F.get(plain, 0), False), rule), F.transform(F.slice(plain, 2, 1 << 30), lambda r: line(r, True)), after)
    return F.when((F.size(rows) >= 2) & (wide >= 2) & (F.size(plain) >= 2), F.array_join(all_lines, "\n"))
