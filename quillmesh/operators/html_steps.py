"""The ordered rewrites that turn the inside of a page into Markdown: a table of elements and what is made of each.

Each step sees the text that the steps before it left, so the order is part of the meaning:
links come before images (an image inside a link goes with it), code is decoded before tags
are dropped, and entities are decoded once more at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urljoin

# Entities in the order of their decoding, links that are never resolved, and where lazy images keep their address.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
UNRESOLVED = re.compile(r"(?:https?:|data:|mailto:|tel:|#|$)", re.I)
LAZY = ("data-src", "data-lazy-src", "data-original", "data-srcset")

NUMBERED = re.compile(r"&#(?:(\d+)|[xX]([0-9a-fA-F]+));")
TAG = re.compile(r"<[^>]+>")
ATTRIBUTE = re.compile(r'\b([\w-]+)="([^"]*)"')
Maker = Callable[[str, str, "str | None"], str]


def bare(x: str) -> str:
    """Text without its tags and outer white space."""
    return TAG.sub("", x).strip()


def _unit(m: re.Match) -> str:
    """A numbered entity as one UTF-16 unit; halves of pairs, which no text can hold, become U+FFFD."""
    unit = int(m[1] or m[2], 10 if m[1] else 16) % 65536
    return "\ufffd" if 0xD800 <= unit < 0xE000 else chr(unit)


def decoded(x: str) -> str:
    if "&" not in x:
        return x
    for name, c in ENTITIES:
        x = x.replace(name, c)
    return NUMBERED.sub(_unit, x)


def absolute(link: str, base: str | None) -> str:
    """A link as the page at ``base`` means it."""
    if UNRESOLVED.match(link):
        return link
    whole = f"https:{link}" if link.startswith("//") else None
    try:
        return whole or urljoin(base or "", link)
    except ValueError:  # an address that no rule can read stays
        return link


def attributes(tag: str) -> dict[str, str]:
    """Quoted attributes of a tag by lower-case name; the last one of a name counts, as patterns that run to the end find it."""
    return {name.lower(): value for name, value in ATTRIBUTE.findall(tag)}


def _picture(tag: str, _: str, base: str | None) -> str:
    """An image by its attributes, of which the last that ends in src counts; data gives way to the address that lazy pages keep."""
    known = attributes(tag)
    sources = [value for name, value in ATTRIBUTE.findall(tag) if name.lower().endswith("src")]
    if not sources:
        return tag
    data = next((i for i, x in enumerate(sources) if x.lower().startswith("data:")), None)
    kept = (known.get(n, "").split(",")[0].split()[:1] for n in LAZY)
    real = next((u[0] for u in kept if u and re.match("https?:", u[0], re.I)), None)
    if data is not None and real:
        sources[data] = real
    return f"![{known.get('alt', '')}]({absolute(sources[-1], base)})"


def _link(tag: str, inner: str, base: str | None) -> str:
    href, label = attributes(tag).get("href"), bare(inner)
    if href is None or not label or href.startswith(("#", "javascript:")):
        return label if href is not None else f"{tag}{inner}</a>"
    return f"[{label}]({absolute(href, base)})"


def _fenced(x: str) -> str:
    return f"\n```\n{decoded(x).strip()}\n```\n"


def _quoted(_: str, inner: str, __: str | None) -> str:
    return "".join(f"> {line.strip()}\n" for line in bare(inner).split("\n"))


def _around(mark: str) -> Maker:
    return lambda _, inner, __: f"{mark}{bare(inner)}{mark}"


def _heading(tag: str, inner: str, _: str | None) -> str:
    return f"\n{'#' * int(tag[2])} {bare(inner)}\n"


#: (element, what is made of it); an element without an end tag has an empty inside.
ELEMENTS: tuple[tuple[str, Maker], ...] = (
    ("h[1-6]", _heading),
    ("a", _link),
    ("img/", _picture),
    ("pre><code", lambda _, inner, __: _fenced(inner)),
    ("pre", lambda _, inner, __: _fenced(TAG.sub("", inner))),
    ("code", lambda _, inner, __: f"`{decoded(TAG.sub('', inner))}`"),
    ("strong|b", _around("**")),
    ("em|i", _around("*")),
    ("blockquote", _quoted),
    ("li", lambda _, inner, __: f"- {bare(inner)}\n"),
)
# Tags that are line breaks.
BREAKS = ((r"</p>", "\n\n"), (r"<br\s*/?>|</div>", "\n"), (r"<hr[^>]*>", "\n---\n"))


def _pattern(element: str) -> re.Pattern:
    """Start tag, inside and end tag of an element; a/b choices end as they begin."""
    if element.endswith("/"):
        return re.compile(rf"(<{element[:-1]}[^>]*>)()", re.S | re.I)
    if "><" in element:
        outer, inner = element.split("><")
        return re.compile(rf"(<{outer}[^>]*><{inner}[^>]*>)(.*?)</{inner}></{outer}>", re.S | re.I)
    if element == "a":  # only those with an address, however far ahead it stands
        return re.compile(r'(<a[^>]*href="[^"]*"[^>]*>)(.*?)</a>', re.S | re.I)
    return re.compile(rf"(?=<({element})[^>]*>)(<\1[^>]*>)(.*?)</\1>", re.S | re.I)


STEPS = [(_pattern(element), made) for element, made in ELEMENTS]
MARKS = [(re.compile(pattern, re.S | re.I), mark) for pattern, mark in BREAKS]


def spaced(x: str) -> str:
    """Blank lines collapsed first, then line ends stripped, then leading tabs widened."""
    x = re.sub(r"[ \t]+$", "", re.sub(r"\n{3,}", "\n\n", x), flags=re.M)
    return re.sub(r"^[ \t]+", lambda m: m[0].replace("\t", "  "), x, flags=re.M).strip()


def rewrite(body: str, base: str | None) -> str:
    """All steps over the inside of a page."""
    for pattern, made in STEPS:
        body = pattern.sub(lambda m, made=made: made(*m.groups()[-2:], base), body)
    for pattern, mark in MARKS:
        body = pattern.sub(mark, body)
    return spaced(decoded(TAG.sub("", body)))
