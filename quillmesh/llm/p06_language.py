"""Language of documents and of their paragraphs by word-first backoff."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru")
SAMPLE_ROWS = 4000  # labelled rows that the model is fitted on
LEAST_WORDS = 8  # of a paragraph that gets a language of its own
ORDERS = (5, 4, 3, 2, 1)  # character n-grams for unseen words, longest first
MEMO = 1 << 18  # unseen words remembered by a worker
MARGIN = 1.0  # log-likelihood per word by which a paragraph's language must lead the main one

# Other spellings of the codes.
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "nl": "nl nld dut dutch nederlands", "ru": "ru rus russian русский",
}

WORD = re.compile(r"(?<![\d_])\b[^\W\d_]+\b(?![\d_])")  # letters beside digits are codes, not words
BREAK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def known_code(label: Column) -> Column:
    """The code of a label in any of its spellings, or null."""
    low = F.lower(F.trim(label))
    code = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        hit = low.isin(*names.split()) | F.regexp_extract(low, r"^([a-z]{2,3})[-_][a-z0-9]{2,8}(?:[-_.@].*)?$", 1).isin(*[n for n in names.split() if len(n) <= 3])
        code = F.when(hit, F.lit(lang)).otherwise(code)
    return code


class Model:
    """Log-frequencies of words, and of character n-grams for words it does not know."""

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        self.grams = grams
        self.ids = {w: i for i, w in enumerate(words)}
        self.table = np.array([*words.values()], np.float32).reshape(-1, len(LANGUAGES))
        self.size = self.known = len(self.ids)

    def unseen(self, word: str) -> np.ndarray:
        padded = f"<{word}>"
        for n in ORDERS:
            found = [g for i in range(len(padded) - n + 1) if (g := self.grams.get(padded[i : i + n])) is not None]
            if len(found) * 2 >= max(1, len(padded) - n + 1):
                return np.mean(found, axis=0) * (0.3 + 0.1 * n)
        return np.zeros(len(LANGUAGES), np.float32)

    def index(self, word: str) -> int:
        """Row of a word in the table; words met for the first time are appended."""
        if self.size - self.known >= MEMO:
            self.ids = {w: i for w, i in self.ids.items() if i < self.known}
            self.size = self.known
        if self.size == len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(4096, len(self.table) // 2), len(LANGUAGES)), np.float32)])
        self.table[self.size] = self.unseen(word)
        self.ids[word] = self.size
        self.size += 1
        return self.size - 1

    def scores(self, paragraphs: list[list[str]]) -> np.ndarray:
        """Sums of log-likelihoods, one row for each list of words."""
        get, out = self.ids.get, np.zeros((len(paragraphs), len(LANGUAGES)))
        for at in range(0, len(paragraphs), 2000):
            part = paragraphs[at : at + 2000]
            before = self.ids
            ids = [i if (i := get(w)) is not None else self.index(w) for ws in part for w in ws]
            if before is not self.ids:  # the memo was emptied meanwhile; the rows of this part must be looked up anew
                get = self.ids.get
                ids = [i if (i := get(w)) is not None else self.index(w) for ws in part for w in ws]
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            full = np.flatnonzero(sizes)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
                out[at + full] = np.add.reduceat(self.table[np.array(ids)], starts, axis=0)
        return out


def _centred(counts: dict[str, list[float]], totals: np.ndarray) -> dict[str, np.ndarray]:
    """Log-frequency of each language less the mean, so that zero is no evidence."""
    out, seen = {}, totals > 0
    size = np.maximum(totals, 0.02 * totals.max(initial=1)) + 1  # so that a language with few words isn't favoured where none is known
    for k, c in counts.items():
        x = np.log((np.array(c) + 0.05) / size)
        x[~seen] = x.min()
        out[k] = (x - x.mean()).astype(np.float32)
    return out


def fit(rows: Iterable[tuple[str, str]], least: int = 2) -> Model:
    """Counts over (language, text); texts' paragraphs are relabelled once by the first model, for labels may be wrong."""
    parts = [(lang, WORD.findall(p.lower())) for lang, text in rows if lang in LANGUAGES for p in BREAK.split(text)]
    model = _count(parts, least)
    scores = model.scores([ws for _, ws in parts])
    best = scores.argmax(1)
    return _count([(LANGUAGES[b] if len(ws) >= 4 else lang, ws) for b, (lang, ws) in zip(best, parts, strict=True)], least)


def _count(parts: list[tuple[str, list[str]]], least: int) -> Model:
    words: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGUAGES))
    for lang, n in Counter((lang, w) for lang, ws in parts for w in ws).items():
        words[lang[1]][LANGUAGES.index(lang[0])] += n
    grams: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGUAGES))
    for w, c in words.items():
        padded = f"<{w}>"
        for n in ORDERS:
            for i in range(len(padded) - n + 1):
                g = grams[padded[i : i + n]]
                for k, x in enumerate(c):
                    g[k] += min(x, 5)
    words = {w: c for w, c in words.items() if sum(c) >= least}
    totals = np.sum([*words.values()], axis=0) if words else np.ones(len(LANGUAGES))
    gram_totals = np.sum([*grams.values()], axis=0) if grams else np.ones(len(LANGUAGES))
    return Model(_centred(words, totals), _centred({g: c for g, c in grams.items() if sum(c) >= 2}, gram_totals))


def labelled_sample(df: DataFrame, key: str, text: str, language: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most about ``rows`` labelled texts, chosen by the hash of the key."""
    labelled = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, F.col(text).alias("t"), known_code(F.col(language)).alias("lang")).where("lang is not null")
    total = df.where(F.col(language).isNotNull()).count()
    step = max(1, -(-total // rows))
    picked = labelled.where(F.pmod(F.xxhash64(F.col(key), F.lit(6)), F.lit(step)) == 0).limit(2 * rows)
    return [(r["lang"], r["t"]) for r in picked.select("lang", "t").collect()]


def languages(df: DataFrame, model: Model, key: str = "extraction_id", text: str = "text", language: str = "language") -> DataFrame:
    """(key, para_no, lang, confidence, stated): para_no -1 for each text, then its paragraphs of LEAST_WORDS words in another language.

    A text's main language is the one that most words stand in, paragraph by paragraph. Null
    and empty texts and texts without letters give no rows; stated is the label's code or null.
    """
    rows = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), known_code(F.col(language)).alias("stated"))
    handed = df.sparkSession.sparkContext.broadcast((model.ids, model.table[: model.size], model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, grams = handed.value
        m = Model({}, grams)
        m.ids, m.table, m.size, m.known = dict(ids), table.copy(), len(ids), len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                owners, words, long, numbers = [], [], [], []
                stated = batch.column(2).to_pylist()
                ks = batch.column(0).to_pylist()
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for no, p in enumerate(BREAK.split(t)):
                        ws = WORD.findall(p.lower())
                        owners.append(i), words.append(ws), numbers.append(no), long.append(len(ws) >= LEAST_WORDS and len(p.split()) >= LEAST_WORDS)
                scores = m.scores(words)
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                best = scores.argmax(1)
                owner = np.array(owners, np.int64)
                votes = np.zeros((len(ks), len(LANGUAGES)))
                np.add.at(votes, (owner, best), sizes * (np.abs(scores).sum(1) > 0))
                total = np.zeros((len(ks), len(LANGUAGES)))
                np.add.at(total, owner, scores)
                main = np.where(votes.max(1) > 0, (votes + 1e-9 * (total - total.min(1, keepdims=True))).argmax(1), -1)
                share = votes.max(1) / np.maximum(1, votes.sum(1))
                out = [(ks[i], -1, LANGUAGES[main[i]], float(share[i]), stated[i]) for i in range(len(ks)) if main[i] >= 0]
                other = np.flatnonzero(np.array(long, bool) & (best != main[owner]) & (main[owner] >= 0)) if len(words) else []
                for j in other:
                    lead = (scores[j, best[j]] - scores[j, main[owners[j]]]) / sizes[j]
                    if lead >= MARGIN:
                        out.append((ks[owners[j]], numbers[j], LANGUAGES[best[j]], float(1 - np.exp(-lead)), stated[owners[j]]))
                columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[key, "para_no", "lang", "confidence", "stated"])

    return rows.mapInArrow(run, f"{key} bigint, para_no int, lang string, confidence double, stated string")


def identify(df: DataFrame, key: str = "extraction_id", text: str = "text", language: str = "language", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Languages of all texts and foreign paragraphs by a model fitted on a sample of ``rows`` labelled texts."""
    return languages(df, fit(labelled_sample(df, key, text, language, rows)), key, text, language)
