"""Evaluation passages in corpus documents by winnowed fingerprints and extension of their hits."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import cut

GRAM, WINDOW = 3, 2  # words hashed together, hashes of which the least is kept: spans of GRAM + WINDOW - 1 equal words always meet
LEAST = 12  # words of an item that make a leak
ERRORS = 8  # one word in so many may be wrong, and one in a shorter stretch
LEAST_HITS = 2  # of k equal words in a row (k - 2) // 2 fingerprints are kept at least, so one stretch that leaks has three or more; of two, each must hold one
RARE = 0.02  # share of the different item texts that may have a gram which still tells items apart
BROADCAST_PRINTS, BROADCAST_BYTES = 2_000_000, 1 << 26  # fingerprints of items, and bytes of their texts, that are broadcast; more are joined by a shuffle


ENTITY = re.compile(r"&amp;(?=#?\w{1,8};)")
INSIDE = re.compile(r"&(?:apos|rsquo|lsquo|shy|#0*39|#x0*27|#8217|#8203);|['’‘​‌‍﻿­]", re.I)
OUTSIDE = re.compile(r"&[A-Za-z]{2,8};|&#x?[0-9A-Fa-f]{2,6};|<[/A-Za-z][^<>]{0,80}>")
WORD = re.compile(r"\w+")
_codes: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Lower-case words without markup, character entities, apostrophes and invisible characters."""
    if "&" in text:
        text = ENTITY.sub("&", text)
    text = INSIDE.sub("", text)
    if "&" in text or "<" in text:
        text = OUTSIDE.sub(" ", text)
    return WORD.findall(text.lower().replace("_", " "))


def gram_hashes(ws: list[str]) -> np.ndarray:
    """The hash of each GRAM consecutive words."""
    n = len(ws) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(_codes) > 1 << 20:
        _codes.clear()
    get = _codes.get
    ids = np.fromiter((get(w) or _codes.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in ws), np.uint64, len(ws))
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the least of each WINDOW consecutive hashes, the last of equal ones; fewer hashes keep their least."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(WINDOW, n)
    best = np.arange(n - w + 1)
    for k in range(1, w):
        other = np.arange(k, n - w + 1 + k)
        best = np.where(hashes[other] <= hashes[best], other, best)
    return np.unique(best)


def prints(df: DataFrame, key: str, text: str, names: tuple[str, str], every: bool = False) -> DataFrame:
    """(key, h, position) of each row's winnowed fingerprints, or of all its grams."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias(names[0]), F.col(text).alias("t"))
    kind = dict(rows.dtypes)[names[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hs, ps = [], [], []
            for t in batch.column(1).to_pylist():
                h = gram_hashes(words(t))
                p = np.arange(len(h)) if every else winnow(h)
                sizes.append(len(p)), hs.append(h[p]), ps.append(p)
            take = np.repeat(np.arange(batch.num_rows), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take)), pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64), pa.int64()), pa.array(np.concatenate(ps) if ps else np.zeros(0, np.int64), pa.int32())], names=[names[0], "h", names[1]]
            )

    return rows.mapInArrow(run, f"{names[0]} {kind}, h bigint, {names[1]} int")


def spans(equal: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, wrong) of the stretches of a diagonal: from an equal word to an equal word, with no more than the wrong words allowed.

    For each number of wrong words and each first word only the longest stretch is given.
    """
    at = np.flatnonzero(equal)
    if not len(at):
        return []
    gaps = at - np.arange(len(at))  # wrong words before each equal one
    out = []
    for i in range(len(at)):
        if i and at[i - 1] == at[i] - 1 and (i == 1 or at[i - 2] != at[i] - 2 or at[i - 1] - at[0] >= 2):
            continue  # a longer one begins at the word before
        for wrong in range((at[-1] - at[i] + 1) // ERRORS + 2):
            j = int(np.searchsorted(gaps, gaps[i] + wrong, "right")) - 1
            n = int(at[j] - at[i]) + 1
            used = int(gaps[j] - gaps[i])
            if used == wrong and used <= max(1, n // ERRORS):
                out.append((int(at[i]), int(at[j]), used))
    return out


def overlap(doc: list[str], item: list[str], hits: list[tuple[int, int]], own: list[int] | None, least: int = LEAST) -> int:
    """Words of the item that the document holds in the item's order, in one stretch or two.

    A stretch lies on one diagonal and holds a hit; at most one word in ERRORS is wrong, in two
    stretches over both together. own: positions of the item's grams that few other items have,
    null if it has none. A stretch shorter than ``least`` must hold one of them, since stock phrases
    that all items of a suite share show no leak.
    """
    lines, right = [], 0  # diagonals with their equal words
    for shift in {d - i for d, i in hits}:
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        equal = [x == y for x, y in zip(item[lo:hi], doc[lo + shift : hi + shift], strict=True)]
        lines.append((shift, lo, hi, equal))
        right += sum(equal)
    if right < least - max(1, least // ERRORS):  # no leak, whatever the stretches
        return 0
    found: list[tuple[int, int, int, int]] = []  # first and last in the item, shift, wrong words
    for shift, lo, hi, flags in lines:
        on = [i for d, i in hits if d - i == shift]
        equal = np.array(flags, bool)
        good = None if own is None else [p for p in own if lo <= p and p + GRAM <= hi and equal[p - lo : p - lo + GRAM].all()]
        for a, b, wrong in spans(equal):
            a, b = a + lo, b + lo
            n = b - a + 1
            if n > GRAM and any(a <= i and i + GRAM - 1 <= b for i in on) and (n >= least or good is None or any(a <= p and p + GRAM - 1 <= b for p in good)):
                found.append((a, b, shift, wrong))
    best = max((b - a + 1 for a, b, _, _ in found), default=0)
    for a, b, s, x in found:
        for c, e, z, y in found:
            if z != s and c > a and e > b and c + z > b + s:  # the later one starts after the first in the document
                n = b - a + 1 + e - max(c, b + 1) + 1
                if n > best and x + y <= max(1, n // ERRORS):
                    best = n
    return best


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_no", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, item_key, n_words): each document with the items of which it holds ``least`` words or more.

    Both sides are fingerprinted alike and joined on the hashes, so every span of GRAM + WINDOW
    - 1 equal words is met; each hit is extended word by word along its diagonal, and one or
    two stretches in the item's order are counted. A pair of one hit is left unread, since it
    can't count: in one stretch of ``least`` words with one in ERRORS wrong there are three hits
    or more, and of two stretches each must hold a hit of its own, which GRAM + WINDOW - 1 equal
    words in a row always give. Null keys and texts and items of fewer than ``least`` words give
    no rows; repeated rows count once; very long texts are read whole.
    """
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).where("item is not null and item_text is not null").dropDuplicates(["item"])
    n_texts, size = asked.agg(F.countDistinct("item_text"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    theirs = cut(prints(asked, "item", "item_text", ("item", "ipos")))
    grams = cut(prints(asked, "item", "item_text", ("item", "p"), every=True))
    # Copies of one text count once, so that many copies don't make their own words a stock phrase.
    once = asked.groupBy("item_text").agg(F.min("item").alias("item")).select("item")
    few = grams.join(once, "item", "left_semi").groupBy("h").agg(F.countDistinct("item").alias("n")).where(F.col("n") <= max(2, RARE * n_texts))
    asked = asked.join(grams.join(few, "h").groupBy("item").agg(F.array_sort(F.collect_set("p")).alias("own")), "item", "left")
    hint = F.broadcast if theirs.count() <= BROADCAST_PRINTS else (lambda df: df)
    text_hint = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    met = prints(documents, key, text, ("doc", "dpos")).join(hint(theirs), "h")
    # Hits along one diagonal are joined before they travel: a long equal span is one row.
    met = met.groupBy("doc", "item", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.array_sort(F.collect_set("ipos")).alias("at")).groupBy("doc", "item").agg(F.collect_list(F.struct("shift", "at")).alias("hits"))
    met = cut(met.where(F.aggregate("hits", F.lit(0), lambda n, x: n + F.size(x["at"])) >= LEAST_HITS))
    texts = documents.select(F.col(key).alias("doc"), F.col(text).alias("dt")).where("doc is not null and dt is not null").join(met.select("doc").distinct(), "doc", "left_semi")
    pairs = met.join(texts, "doc").join(text_hint(asked.select("item", "own", "item_text")), "item")
    kinds = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_words: dict[str, list[str]] = {}
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            out, docs_words = defaultdict(list), {}
            for doc, item, hits, dt, it, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                dw = docs_words.get(doc)
                if dw is None:
                    dw = docs_words[doc] = words(dt)
                iw = items_words.get(it) or items_words.setdefault(it, words(it))
                n = overlap(dw, iw, [(h["shift"] + i, i) for h in hits for i in h["at"]], own, least)
                if n >= least:
                    for name, v in (("doc", doc), ("item", item), ("n", n)):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc"], batch.schema.field(0).type), pa.array(out["item"], batch.schema.field(1).type), pa.array(out["n"], pa.int32())], names=[key, item_key, "n_words"])

    found = pairs.select("doc", "item", "hits", "dt", "item_text", "own").mapInArrow(run, f"{key} {kinds[0]}, {item_key} {kinds[1]}, n_words int")
    return found.groupBy(key, item_key).agg(F.max("n_words").alias("n_words"))
