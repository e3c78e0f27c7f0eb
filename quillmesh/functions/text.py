"""Column helpers for text: trimming, lines, and regex replacement with a computed replacement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x0B\x{00A0}]"  # what counts as white space; named, since engines differ in \s


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, so that long chains of steps don't multiply their input's expression."""
    return F.transform(F.array(x), f)[0]


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def lines(x: Column) -> Column:
    return F.split(x, "\n", -1)


def unlines(x: Column) -> Column:
    return F.array_join(x, "\n")


def squeezed(x: Column) -> Column:
    """At most one blank line in a row."""
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def blank_to_null(x: Column) -> Column:
    return F.when(trimmed(x) != "", x)


def replaced(x: Column, pattern: str, made: Callable[..., Column], groups: Sequence[int] = (1,)) -> Column:
    """Each match of ``pattern`` in x becomes ``made(*groups)``, computed by built-in functions.

    The pattern must not match the empty string. Null stays null.
    """

    def run(v: Column) -> Column:
        gaps = F.split(v, pattern, -1)
        found = [F.regexp_extract_all(v, F.lit(pattern), F.lit(g)) for g in groups]
        pieces = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.concat(F.when(i > 1, made(*[F.get(c, i - 2) for c in found])).otherwise(""), F.get(gaps, i - 1)))
        return F.when(F.size(gaps) < 2, v).otherwise(F.array_join(pieces, ""))

    return bind(x, run)


def chained(x: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other, each bound once."""
    for step in steps:
        x = bind(x, step)
    return x


def through(df: DataFrame, column: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """The column taken through the steps, one projection each."""
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df
