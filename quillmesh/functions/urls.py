"""Parts of URLs by the generic URI grammar, total on any string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_http(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"^(?i)https?://"), F.lit(False))


def authority(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)


def resolved(link: Column, base: Column) -> Column:
    """A link made absolute: absolute, special, empty and fragment links and links without a base stay."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.concat(F.when(folder == "", "/").otherwise(folder), link)

    def up(p: Column) -> Column:
        """Dots taken out by a fold over the parts."""
        parts = F.split(p, "/", -1)
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
        return F.array_join(kept, "/")

    return (
        F.when(link.isNull() | (link == "") | link.rlike(r"^(?i)(?:https?:|data:|mailto:|tel:)|^#"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(base.isNull() | (root == ""), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("/"), F.concat(root, up(link)))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, up(joined)))
    )
