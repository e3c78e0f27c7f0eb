"""Noise in scanned text: furniture by page position, misread characters by an averaged-perceptron editor."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import cut

SHARE = 2e-6  # of all words that a word needs for not being looked up again; at most 1 / SHARE words can have it. Spares rows, decides nothing
LEAST_COUNT = 3  # times that a known word stands in the corpus, whatever its size
RATIO = 8  # how many times commoner the corrected word must be
TRAIN_WORDS, TRAIN_PAIRS, EPOCHS = 1200, 6000, 3  # bounds of the sample that the editor is fitted on: commonest words, pairs of them with misread copies; passes
SUPPORT, SUPPORT_SHARE = 3, 0.05  # words, and share of the words that have the characters, in which a way of misreading must be seen
MIDDLE = 2  # characters that one misreading takes or leaves
SHORT = 3
TWICE = (8, 64)  # lengths of the words that are tried with two misreadings
COVERED, FIRM = 0.997, 0.9  # shares of the sample's own edits that lie above the editor's floor, and above what one of two misreadings, or one in a word of SHORT characters, needs
BROADCAST_WORDS = 500_000
HEADER_PAGES = 2

HYPHENS = "-‐‑¬­"
# Words before a page number.
PAGE = r"(?:page|pg\.?|p\.|pag\.?|página|pág\.?|seite|s\.|bladzijde|blz\.?|pagina|стр\.?|страница|с\.)"
DIGITS = r"[0-9OoОоlIi|!SsZBgqb]{1,4}"
NUMBER = re.compile(rf"^[-–—~*·•.\[\(|\s]*(?:{PAGE}\s*)?(?:{DIGITS}|[ivxlcdm]{{1,7}}|[IVXLCDM]{{1,7}})(?:\s*(?:/|of|von|sur|de|van|из)\s*{DIGITS})?[-–—~*·•.\]\)|\s]*$", re.I)
SOLID = re.compile(r"[0-9]|^[\W_]*[ivxlcdm]+[\W_]*$|" + PAGE, re.I)
EDGES = ".,;:()[]{}«»\"“”„?…—–*•"
STOP = re.compile(r"\s+")


def core(token: str) -> str:
    """A token without the marks around it, lower-case."""
    return token.strip(EDGES).rstrip("!'’").lstrip("'‘").lower()


def aligned(seen: str, true: str) -> tuple[int, str, str] | None:
    """(place, seen part, true part) where two words differ in one place, or null."""
    a, most = 0, min(len(seen), len(true))
    while a < most and seen[a] == true[a]:
        a += 1
    b = 0
    while b < most - a and seen[-1 - b] == true[-1 - b]:
        b += 1
    s, t = seen[a : len(seen) - b], true[a : len(true) - b]
    return (a, s, t) if s and len(s) <= MIDDLE and len(t) <= MIDDLE or not s and len(t) == 1 else None


class Editor:
    """Averaged perceptron that gives each character of a word an edit: keep, delete, replace, insert after, or join lines.

    A word is read with ``<`` and ``>`` around it; a line end inside stands as a line feed.
    """

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self.floor = self.firm = 0.0  # what an edit's score may lack to the score of keeping, and one of two
        self.heads: set[str] = set()  # edits that a misreading of the sample begins with

    @staticmethod
    def features(s: str, i: int) -> tuple[str, ...]:
        c = s[i]
        a = s[i - 1] if i else "^"
        b = s[i + 1] if i + 1 < len(s) else "$"
        aa, bb = s[max(0, i - 2) : i], s[i + 1 : i + 3]
        return ("0" + c, "1" + a + c, "2" + c + b, "3" + a + c + b, "4" + aa + c, "5" + c + bb, "6" + aa + c + b, "7" + a + c + bb, "8" + str(c.isdigit()) + str(a.isalpha()) + str(b.isalpha()))

    def scores(self, s: str, i: int) -> dict[str, float]:
        total: dict[str, float] = defaultdict(float)
        for f in self.features(s, i):
            for label, x in self.w.get(f, {}).items():
                total[label] += x
        return total

    @staticmethod
    def gold(seen: str, at: int, old: str, new: str) -> tuple[str, list[str]]:
        """The word as it is read, and the edits that turn ``old`` at a place into ``new``."""
        s, edits = f"<{seen}>", ["keep"] * (len(seen) + 2)
        for k in range(len(old)):
            edits[at + 1 + k] = "delete"
        if old and new:
            edits[at + 1] = "replace" + new  # the first seen character becomes all of the true ones
        elif new:
            edits[at] = "insert" + new
        return s, edits

    def train(self, words: list[str], pairs: list[tuple[str, str]], seed: int = 7) -> Editor:
        """Fits on words as they are, on (seen, true) pairs aligned with each other, and on words divided at line ends."""
        rng = random.Random(seed)
        data = [(f"<{word}>", ["keep"] * (len(word) + 2)) for word in words]
        made = [self.gold(seen, *place) for seen, true in pairs if (place := aligned(seen, true))]
        data += made
        for word in words:
            if len(word) > 4:
                at = rng.randint(2, len(word) - 2)
                s = f"<{word[:at]}{rng.choice(HYPHENS[:4])}\n{word[at:]}>"
                data.append((s, ["join" if x in HYPHENS or x == "\n" else "keep" for x in s]))
        sums: dict[tuple[str, str], float] = defaultdict(float)
        last: dict[tuple[str, str], int] = defaultdict(int)
        step = 0

        def update(f: str, label: str, by: float) -> None:
            row = self.w.setdefault(f, {})
            sums[f, label] += (step - last[f, label]) * row.get(label, 0.0)
            last[f, label] = step
            row[label] = row.get(label, 0.0) + by

        for _ in range(EPOCHS):
            rng.shuffle(data)
            for s, gold in data:
                for i, want in enumerate(gold):
                    step += 1
                    got = self.scores(s, i)
                    best = max(got, key=lambda x: (got[x], x)) if got else "keep"
                    if best != want:
                        for f in self.features(s, i):
                            update(f, want, 1.0)
                            update(f, best, -1.0)
        for f, row in self.w.items():
            for label in row:
                row[label] = (sums[f, label] + (step - last[f, label]) * row[label]) / max(1, step)
        self.w = {f: {k: x for k, x in row.items() if x} for f, row in self.w.items()}
        begun = [(s, i, edits) for s, edits in made for i, e in enumerate(edits) if e not in ("keep", "delete") or (e == "delete" and edits[i - 1] == "keep")]
        self.heads = {edits[i] for _, i, edits in begun}
        gains = sorted(self.gain(*x) for x in begun)
        if gains:
            self.floor, self.firm = (min(0.0, gains[int((1 - share) * len(gains))]) for share in (COVERED, FIRM))
        return self

    def gain(self, s: str, i: int, edits: list[str]) -> float:
        """By how much the edits from place i on, up to the next kept character, beat keeping."""
        total, k = 0.0, i
        while k < len(s) and (k == i or edits[k] == "delete"):
            x = self.scores(s, k)
            total += x.get(edits[k], 0.0) - x.get("keep", 0.0)
            k += 1
        return total

    @staticmethod
    def apply(s: str, edits: dict[int, str]) -> str:
        out = []
        for i, c in enumerate(s):
            e = edits.get(i, "keep")
            if e.startswith("replace"):
                out.append(e[7:])
            elif e.startswith("insert"):
                out.append(c + e[6:])
            elif e not in ("delete", "join"):
                out.append(c)
        return "".join(out).strip("<>")

    def edits(self, word: str) -> list[tuple[float, int, int, dict[int, str]]]:
        """(gain, first place, place after, edits) of every single misreading that the weights propose: gains from the floor on."""
        s = f"<{word}>"
        every = [self.scores(s, i) for i in range(len(s))]
        lead = lambda i, label: every[i].get(label, 0.0) - every[i].get("keep", 0.0)
        out = []
        for i in range(len(s) - 1):
            for label in self.heads.intersection(every[i]):
                kind = label[:6]
                if i or kind == "insert":
                    made, gain = {i: label}, lead(i, label)
                    out.append((gain, i, i + 1, made))
                    k = i + 1  # characters after it that go with it
                    while kind != "insert" and k < len(s) - 1 and k - i < MIDDLE and "delete" in every[k]:
                        made, gain = made | {k: "delete"}, gain + lead(k, "delete")
                        out.append((gain, i, k + 1, made))
                        k += 1
        floor = self.firm if len(word) <= SHORT else self.floor
        return [x for x in out if x[0] >= floor]

    def candidates(self, word: str) -> list[str]:
        """What the word becomes by one proposed misreading, then by two apart from each other, best first."""
        s, ones = f"<{word}>", self.edits(word)
        firm = [x for x in ones if x[0] >= self.firm] if TWICE[0] <= len(word) <= TWICE[1] else []
        ranked = [(gain, self.apply(s, made)) for gain, _, _, made in ones]
        twos = [(x[0] + y[0], self.apply(s, x[3] | y[3])) for x in firm for y in firm if x[2] <= y[1]]
        out = [w for part in (ranked, twos) for _, w in sorted(part, key=lambda r: (-r[0], r[1]))]
        return [w for w in dict.fromkeys(out) if w and w != word]

    def joins(self, a: str, hyphen: str, b: str) -> bool:
        """Whether the line end between the two parts divides one word."""
        s = f"<{a}{hyphen}\n{b}>"
        at = len(a) + 1
        x, y = self.scores(s, at), self.scores(s, at + 1)
        return x.get("join", 0.0) + y.get("join", 0.0) >= x.get("keep", 0.0) + y.get("keep", 0.0)


def pages_of(df: DataFrame, key: str, segments: str, title: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.size(segments) > 0)).select(
        F.col(key).cast("long").alias("k"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))).alias("pages")
    )


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over all pages: every token counted, the two parts of a divided word left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: Counter[str] = Counter()
            for texts in batch.column(0).to_pylist():
                for t in texts:
                    raw.update(t.split())
                    lines = t.split("\n")
                    for line, after in zip(lines, [*lines[1:], ""], strict=True):
                        if line and line[-1] in HYPHENS and line.strip():
                            raw[line.split()[-1]] -= 1
                            if after.strip():
                                raw[after.split()[0]] -= 1
            words: Counter[str] = Counter()
            for token, n in raw.items():
                words[core(token)] += n
            kept = [(w, n) for w, n in words.items() if w and n > 0 and any(c.isalpha() for c in w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    return pages.select("pages").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def holes(word: str) -> Iterator[tuple[str, str]]:
    """(before, after) of each way to take up to MIDDLE characters out of a word."""
    for n in range(MIDDLE + 1):
        for i in range(len(word) - n + 1):
            yield word[:i], word[i + n :]


def training_pairs(counts: DataFrame, words: dict[str, int], limit: int = TRAIN_PAIRS) -> list[tuple[str, str]]:
    """(seen, true): aligned pairs of the corpus's words with the given common ones that they may be misread copies of.

    A pair differs in one place, and its true word is RATIO times as common. A way of
    misreading counts only if it is seen in SUPPORT of the words that have its true characters
    and in SUPPORT_SHARE of them, since inflections and the like touch few words alike. At most
    ``limit`` pairs, chosen by their hash, are collected; they are all that the editor learns
    misreadings from.
    """
    if not words:
        return []
    keys: dict[tuple[str, str], list[str]] = defaultdict(list)
    for w in words:
        for a, b in holes(w):
            keys[a, b].append(w)
    handed = counts.sparkSession.sparkContext.broadcast((dict(keys), words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, common = handed.value
        for batch in batches:
            out = set()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in holes(w):
                    for t in index.get((a, b), ()):
                        if t != w and common[t] >= RATIO * n and (place := aligned(w, t)):
                            out.add((w, t, place[1], place[2]))
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["seen", "true", "old", "new"])

    pairs = cut(counts.where(F.length("word") > 2).select("word", "n").mapInArrow(run, "seen string, true string, old string, new string"))
    ways = pairs.groupBy("old", "new").agg(F.countDistinct("true").alias("words")).where(F.col("words") >= SUPPORT)
    holding = Counter(x for w in words for x in {w[i : i + n] for n in range(MIDDLE + 1) for i in range(len(w) - n + 1)})
    table = counts.sparkSession.createDataFrame([*holding.items()], "new string, holding int")  # of a bounded list of words
    sure = ways.join(F.broadcast(table), "new").where(F.col("words") >= SUPPORT_SHARE * F.col("holding")).select("old", "new")
    picked = pairs.join(F.broadcast(sure), ["old", "new"]).orderBy(F.xxhash64("seen", "true"), "seen", "true").limit(limit)
    return [(r["seen"], r["true"]) for r in picked.select("seen", "true").collect()]


def misread_words(counts: DataFrame, editor: Editor) -> DataFrame:
    """(word, fixed) of the words that the editor turns into a word RATIO times as common.

    The editor proposes; what it proposes is joined with the counts of the whole corpus by a
    shuffle, where every word is one row, so no key is hot; the counts only refuse. The best
    proposal that they leave is the repair.
    """
    handed = counts.sparkSession.sparkContext.broadcast(editor)
    most, longest = counts.where(F.col("n") >= RATIO).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = handed.value
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            out = [(w, n, c, i) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(w) > 1 and not w.isdigit() for i, c in enumerate(e.candidates(w))]
            columns = [list(c) for c in zip(*out, strict=True)] if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["word", "n", "maybe", "rank"])

    # No word is RATIO times as common as one of the others, or nearly as long.
    maybe = counts.where((F.col("n") * RATIO <= most) & (F.length("word") <= longest + 2 * MIDDLE)).select("word", "n").repartition(F.col("word")).mapInArrow(tries, "word string, n bigint, maybe string, rank int")
    right = counts.where(F.col("n") >= RATIO).select(F.col("word").alias("maybe"), F.col("n").alias("times"))
    # Never broadcast: the planner can't see how many tries a word gives.
    return maybe.join(right.hint("merge"), "maybe").where(F.col("times") >= RATIO * F.col("n")).groupBy("word").agg(F.min_by("maybe", "rank").alias("fixed"))


def masked(line: str) -> str:
    """A furniture line without its page number, for comparison."""
    words = line.split()
    while words and (NUMBER.match(words[-1]) and re.search(r"[0-9]|^\W*[ivxlcdm]+\W*$", words[-1], re.I)):
        words.pop()
    while words and (NUMBER.match(words[0]) and re.search(r"[0-9]", words[0])):
        words.pop(0)
    return re.sub(r"[\W\d_]+", "", " ".join(words)).lower()


def _near(a: str, b: str) -> bool:
    """Equal but for a misread character or two."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 6:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 2


def furniture(pages: list[list[str]], title: str) -> list[dict[int, str]]:
    """For each page the lines that are running headers or page numbers.

    Only the first two and last two non-blank lines of a page are looked at: a number in any
    form alone on the first or last line; a line whose words come back at the edge of another
    page, or begin the record's title.
    """
    edges, numbers = [], []
    for lines in pages:
        full = [i for i, x in enumerate(lines) if x.strip()]
        out: dict[int, str] = {}
        order = list(dict.fromkeys([*full[:2], *full[-2:]]))
        for i in (full[:1] + full[-1:]) if len(full) > 1 else []:
            if NUMBER.match(lines[i].strip()) and SOLID.search(lines[i]) and len(lines[i].strip()) <= 24:
                out[i] = "page_number"
        left = [i for i in full if i not in out]
        edges.append([(i, masked(lines[i])) for i in dict.fromkeys([*left[:1], *left[-1:]]) if i in order and len(left) > 1])
        numbers.append(out)
    plain = re.sub(r"[\W\d_]+", "", title).lower()
    seen = Counter(m for page in edges for m in {m for _, m in page} if len(m) >= 3)
    for page, out, lines in zip(edges, numbers, pages, strict=True):
        for i, m in page:
            if len(m) < 3 or lines[i].strip()[-1] in ".;:!?" and m != plain:
                continue
            again = seen[m] >= HEADER_PAGES or (len(pages) > 2 and sum(n for x, n in seen.items() if _near(x, m)) >= HEADER_PAGES)
            if again or (plain and len(m.strip()) >= 6 and (plain.startswith(m) or (_near(plain[: len(m)], m)))):
                out[i] = "header"
    if any(numbers) and len(pages) > 1:
        for page, out, lines in zip(edges, numbers, pages, strict=True):
            full = sorted(len(x) for x in lines if x.strip())
            for i, m in page:
                x = lines[i].strip()
                # A first or last line far shorter than the others that ends no sentence is no line of a paragraph.
                if i not in out and len(m) >= 3 and len(full) >= 5 and len(x) < 0.7 * full[len(full) // 2] and x[-1] not in ".;:!?,\"»”" + HYPHENS and x[0] not in "#|>-*`•" and not x[0].islower():
                    out[i] = "header"
    return numbers


def line_faults(pages: DataFrame, known: DataFrame, plain: set[str], bad: DataFrame, editor: Editor, bad_count: int) -> DataFrame:
    """(k, seg_no, line_no, fault, word, fixed): the faults, and for chars the word and its repair.

    known: (word, n) of the right words, joined with the words that line ends divide; plain:
    words known to be right that need no look-up.

    The lines are read once, with whatever either verdict on a line end would make of them. A
    row's fault is ``end`` for a line end to be judged, and hangs on the verdicts named in
    ``yes`` (must be divided) or ``no`` (must not be), each a line's (seg_no, line_no).
    """
    sc = pages.sparkSession.sparkContext
    handed = sc.broadcast((plain, editor.w))
    place_kind = pa.struct([("s", pa.int32()), ("i", pa.int32())])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), place_kind, pa.list_(place_kind)]
    names = ["k", "seg_no", "line_no", "fault", "word", "kept", "sure", "free", "yes", "no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, weights = handed.value
        e = Editor()
        e.w = weights
        ask: dict[str, str | None] = {}  # token: its word if it must be judged

        def asked(token: str) -> str | None:
            word = ask.get(token, "?")
            if word == "?":
                word = core(token)
                word = None if len(word) < 2 or not any(c.isalpha() for c in word) or word in skip else word
                if len(ask) > 1 << 18:
                    ask.clear()
                ask[token] = word
            return word

        for batch in (whole.slice(at, 100) for whole in batches for at in range(0, whole.num_rows, 100)):
            rows = []
            for k, title, texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                split = [t.split("\n") for t in texts]
                marks = furniture(split, title)
                body = []
                for s, (lines, out) in enumerate(zip(split, marks, strict=True)):
                    for i, fault in out.items():
                        rows.append((k, s, i, fault, None, None, None, None, None, None))
                    body += [(s, i, x.rstrip()) for i, x in enumerate(lines) if x.strip() and i not in out]
                before = None  # the line before, if it may divide a word
                for at, (s, i, line) in enumerate(body):
                    tokens = line.split()
                    here, whole = None, ""
                    if line[-1] in HYPHENS and at + 1 < len(body) and len(line) > 1 and (line[-2].isalnum() or line[-2] in "!|"):
                        a, b = tokens[-1], body[at + 1][2].split()[0]
                        if b[:1].isalpha() or b[:1].isdigit() or b[:1] in "!|":
                            here, whole = {"s": s, "i": i}, core(a[:-1] + b)
                            left = core(a[:-1])
                            free = b[:1].islower() and e.joins(left, line[-1], core(b))
                            rows.append((k, s, i, "end", whole, core(a[:-1] + "-" + b), line[-1] in "¬­‐", free, here, None))
                            if whole:
                                rows.append((k, s, i, "chars", f"{len(left)} {whole}", None, None, None, here, None))
                                s2, i2, _ = body[at + 1]
                                rows.append((k, s2, i2, "chars", f"-{len(left)} {whole}", None, None, None, here, None))
                    for n, token in enumerate(tokens):
                        word = asked(token)
                        if word is not None:
                            no = [x for x in (before if n == 0 else None, here if n == len(tokens) - 1 else None) if x]
                            rows.append((k, s, i, "chars", word, None, None, None, None, no or None))
                    before = here if whole else None
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    lines = cut(pages.mapInArrow(run, "k bigint, seg_no int, line_no int, fault string, word string, kept string, sure boolean, free boolean, yes struct<s:int,i:int>, no array<struct<s:int,i:int>>"))
    ends = lines.where("fault = 'end'").select("k", "yes", "word", "kept", "sure", "free")
    ends = ends.join(known.select("word", F.col("n").alias("n_whole")), "word", "left").join(known.select(F.col("word").alias("kept"), F.col("n").alias("n_kept")), "kept", "left")
    hyphened = F.coalesce(F.col("n_kept") >= F.coalesce("n_whole", F.lit(0)), F.lit(False))  # at a hyphen the word has anyway
    divided = F.col("sure") | F.col("n_whole").isNotNull() | (F.col("n_kept").isNull() & F.col("free"))
    # Records repeated in the table agree on their line ends.
    divided = cut(ends.where(~hyphened & divided).select("k", "yes").distinct())
    certain = lines.where("fault not in ('end', 'chars')").select("k", "seg_no", "line_no", "fault")
    certain = certain.unionByName(divided.select("k", F.col("yes.s").alias("seg_no"), F.col("yes.i").alias("line_no"), F.lit("hyphen").alias("fault")))
    place = F.regexp_extract("word", r"^(-?)(\d+) ", 2).try_cast("int")
    asked = lines.where("fault = 'chars'").select("k", "seg_no", "line_no", "fault", "word", "yes", "no")
    asked = asked.withColumn("place", F.when(F.col("yes").isNotNull(), place)).withColumn("second", F.col("yes").isNotNull() & F.startswith("word", F.lit("-")))
    asked = asked.withColumn("w", F.when(F.col("yes").isNotNull(), F.regexp_replace("word", r"^-?\d+ ", "")).otherwise(F.col("word")))
    hint = F.broadcast if bad_count <= BROADCAST_WORDS else (lambda df: df)
    joined = asked.join(hint(bad.select(F.col("word").alias("bw"), "fixed")), F.col("w") == F.col("bw"))
    # In a divided word the fault belongs to the line that holds the first differing character.
    same = F.left("w", F.col("place")) == F.left("fixed", F.col("place"))
    joined = cut(joined.where(F.col("yes").isNull() | F.when(F.col("second"), same).otherwise(~same)).select("k", "seg_no", "line_no", "fault", F.col("w").alias("word"), "fixed", "yes", "no"))
    out = ["k", "seg_no", "line_no", "fault", "word", "fixed"]
    free = joined.where("yes is null and no is null").select(*out)
    whole = joined.where("yes is not null").join(divided, ["k", "yes"], "left_semi").select(*out)
    parts = joined.where("no is not null")
    for n in range(2):
        parts = parts.withColumn("yes", F.get("no", F.lit(n))).join(divided, ["k", "yes"], "left_anti")
    nothing = F.lit(None).cast("string")
    return certain.withColumns({"word": nothing, "fixed": nothing}).unionByName(free).unionByName(whole).unionByName(parts.select(*out))


def prepared(pages: DataFrame) -> tuple[DataFrame, set[str], DataFrame, Editor, int]:
    """Known words with their counts, those that need no look-up, misread words with their repairs, and the trained editor."""
    counts = cut(word_counts(pages))
    best = counts.where((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(r"^\p{L}{2,}$")).orderBy(F.desc("n"), "word").limit(TRAIN_WORDS).collect()
    editor = Editor().train([r["word"] for r in best], training_pairs(counts, {r["word"]: r["n"] for r in best}))
    bad = cut(misread_words(counts, editor))
    known = cut(counts.where(F.col("n") >= LEAST_COUNT).join(bad, "word", "left_anti"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    plain = {r["word"] for r in known.where(F.col("n") >= SHARE * total).select("word").collect()}  # at most 1 / SHARE rows
    return known, plain, bad, editor, bad.count()


def _paragraphs(pages: list[str], faults: list[dict]) -> Iterator[tuple[int, str]]:
    """(page of the first line, text) of each paragraph of a record, repaired by its faults.

    Furniture goes, divided words are joined, misread words replaced, lines joined by spaces. A
    blank line ends a paragraph; so does a page whose last line ends a sentence.
    """
    gone = {(f["seg_no"], f["line_no"]) for f in faults if f["fault"] in ("header", "page_number")}
    divided = {(f["seg_no"], f["line_no"]) for f in faults if f["fault"] == "hyphen"}
    fixes: dict[tuple[int, int], dict[str, str]] = defaultdict(dict)
    for f in faults:
        if f["word"] is not None:
            fixes[f["seg_no"], f["line_no"]][f["word"]] = f["fixed"]

    def repaired(token: str, known: dict[str, str]) -> str:
        word = core(token)
        fixed = known.get(word)
        if fixed is None:
            return token
        at = token.lower().find(word)
        if at < 0:
            return token
        old = token[at : at + len(word)]
        fixed = fixed.upper() if len(old) > 1 and old.isupper() else fixed[:1].upper() + fixed[1:] if old[:1].isupper() else fixed
        return token[:at] + fixed + token[at + len(word) :]

    tokens: list[str] = []
    first, carry, known = 0, "", {}  # carry: a word's part before a line end
    for s, page in enumerate(pages):
        for i, line in enumerate(page.split("\n")):
            if (s, i) in gone:
                continue
            here = line.split()
            if not here:
                if tokens and not carry and any((s, k) not in gone and x.strip() for k, x in enumerate(page.split("\n")[:i])):
                    yield first, " ".join(tokens)
                    tokens = []
                continue
            if not tokens and not carry:
                first = s
            if carry:
                here[0] = carry + here[0]
            own = fixes.get((s, i), {})
            known = {**known, **own} if carry else own
            carry = ""
            if (s, i) in divided:
                carry = here.pop()[:-1]
            tokens += [repaired(t, known) for t in here]
        if tokens and not carry and tokens[-1].rstrip("\"'»”’)]")[-1:] in tuple(".!?…:"):
            yield first, " ".join(tokens)
            tokens = []
    if carry:
        tokens.append(carry)
    if tokens:
        yield first, " ".join(tokens)


def scan_faults(df: DataFrame, key: str = "extraction_id", segments: str = "segments", title: str = "title") -> DataFrame:
    """(key, seg_no, line_no, fault): header, page_number, hyphen and chars, one row each.

    Furniture is told by its place on the page, misread words by the editor and the corpus's
    word counts, divided words by the editor and those counts. Records without segments, null
    page texts and null keys give no rows; a null title only drops the comparison with it;
    repeated rows count once; an empty table gives none.
    """
    pages = pages_of(df, key, segments, title)
    return line_faults(pages, *prepared(pages)).select(F.col("k").alias(key), "seg_no", "line_no", "fault").distinct()


def repaired_paragraphs(df: DataFrame, key: str = "extraction_id", segments: str = "segments", title: str = "title") -> DataFrame:
    """(key, para_no, seg_no, text): the continuous paragraphs of each record, in order; seg_no is where one begins.

    The faults of scan_faults are taken out: furniture is dropped, divided and misread words are
    repaired, lines are joined, also over the end of a page. Null rules as in scan_faults; of
    repeated rows of a key one is read. One record's faults and pages meet in one row.
    """
    pages = pages_of(df, key, segments, title)
    faults = line_faults(pages, *prepared(pages)).distinct().groupBy("k").agg(F.collect_list(F.struct("seg_no", "line_no", "fault", "word", "fixed")).alias("faults"))
    whole = pages.select("k", "pages").dropDuplicates(["k"]).join(faults, "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            rows = [(k, n, s, t) for k, p, f in zip(*[c.to_pylist() for c in batch.columns], strict=True) for n, (s, t) in enumerate(_paragraphs(p, f or []))]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=[key, "para_no", "seg_no", "text"])

    return whole.mapInArrow(run, f"{key} bigint, para_no int, seg_no int, text string")
