"""Problems 1, 5, 6, 7, 9 and 10."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import p01_residue, p05_main, p06_language, p07_scans, p09_leaks, p10_cut, queries

ARTICLE = "The harbour office measured the wooden bridge in early spring. Nobody knew why the clock tower needed a new coat of paint before the season."


def test_placeholders():
    for t in ("Dear {{ name }},", "x ${a.b} y", "{% x %}", "<%= x %>", "%city%", "#LINK#", "@@x@@", "__body__", "[[id]]", "XXX_id_XXX", "[insert date here]", "<your title>", "[object Object]", "null null", "it is undefined now", "{price}"):
        assert p01_residue.placeholders(t), t
    for t in ("write `{{ x }}`", 'say "{x}" here', "```\n{x}\n```", "50% of 20%", "# Heading", "[sic] and [1]", "set {1, 2}", "_it_ is", "", "null", "a #tag here"):
        assert not p01_residue.placeholders(t), t


def test_residue(spark):
    notice = "Our staff could not load the requested document because the storage node is resting today"
    rows = [
        (1, "T", ARTICLE), (2, "T", "Menu\n\n404 – Page not found. The address you requested does not exist on this server."), (3, "T", ARTICLE + "\n404 – Page not found. The address you requested does not exist on this server."), (4, "{{title}}", ARTICLE), (5, None, "Text goes here text goes here.\n" + ARTICLE), (6, "T", None), (7, "T", ""), (None, "T", "{{x}}"), (2, "T", "Menu\n\n404 – Page not found. The address you requested does not exist on this server."),
        (8, "Just a moment", "Please enable JavaScript to use this page and then load the very same address again in the browser window that you have open right now thank you"),
        (9, "T", "Please enable JavaScript to use this page and then load the very same address again in the browser window that you have open right now thank us"), (10, "T", notice), (11, "T", "Lorem ipsum dolor sit amet, donec felis augue nisl. " * 3000), (12, "T", ARTICLE + " " + "word " * 50_000),
    ]
    df = spark.createDataFrame([(*r, 0, "u") for r in rows], "extraction_id long, title string, text string, label int, unit string")
    got = {r.extraction_id: r.why for r in p01_residue.residue(df).collect()}
    assert got == {2: "notice", 4: "placeholder", 5: "filler", 8: "notice", 9: "notice", 11: "filler"}
    assert p01_residue.residue(df.limit(0)).count() == 0


def test_without_spreading_hardly_a_notice_is_found(spark, monkeypatch):
    """Rows come by the near-duplicate graph: with no pair alike, only what is trusted where it stands is left."""
    notice = "Our staff could not load the requested document because the storage node is resting today"
    rows = [(1, "Just a moment", notice), (2, "A", notice + "."), (3, "B", notice.replace("today", "tonight")), (4, "C", "Access denied. You do not have permission to view this resource."), (5, "D", ARTICLE)]
    df = spark.createDataFrame(rows, "extraction_id long, title string, text string")
    assert {r.extraction_id for r in p01_residue.residue(df).collect()} == {1, 2, 3, 4}
    monkeypatch.setattr(p01_residue, "alike", lambda pairs: pairs.select("u", "got").where("false"))
    assert {r.extraction_id for r in p01_residue.residue(df).collect()} == {1, 2}  # the copies of one text are one node


def test_labels_spread_only_to_near_duplicates(spark):
    base = "the archive of the northern valley keeps a list of all boats that were built there between the two floods and sold to the islands"
    near, far = base.replace("sold", "given"), base.replace("boats that were built there between", "houses")
    rows = [(1, 0, base, p01_residue.NOTICED), (2, 0, base + " today", 0), (3, 0, near, 0), (4, 0, far, 0), (5, 0, "something else", 0)]
    sims = p01_residue.simhash([r[2].split() for r in rows])
    df = spark.createDataFrame([(k, n, int(s), label, False, False, False, 0, u) for (k, n, u, label), s in zip(rows, sims, strict=True)], "extraction_id long, no int, sim long, label byte, prose boolean, alone boolean, again boolean, about long, unit string")
    got = {r.extraction_id for r in p01_residue.labelled_units(df, "extraction_id").collect()}
    assert {1} <= got <= {1, 2, 3}
    bits = lambda a, b: bin(int(a) ^ int(b)).count("1")
    assert bits(sims[0], sims[1]) < bits(sims[0], sims[4])


def test_labels_reach_all_that_brute_force_reaches(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, chain = [], [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(12):  # copies with words changed, left out and added, in all degrees
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))]
        texts.append((base, p01_residue.NOTICED))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            texts.append((copy, 0))
    texts.append((list(chain), p01_residue.FILLED))
    for i in range(30):  # each is like the one before, the last ones not at all like the first
        chain[i] = f"new{i}"
        texts.append((list(chain), 0))
    texts.append((chain * 3, 0))
    texts.append((chain[:5] * 40 + chain, 0))  # the same shingles, some of them many times
    grams = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for ws, _ in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want, front = set(), [i for i, (_, label) in enumerate(texts) if label]
    while front:
        want |= set(front)
        front = [j for j in range(len(texts)) if j not in want and any(alike(grams[i], grams[j]) for i in front)]
    sims = p01_residue.simhash([ws for ws, _ in texts])
    df = spark.createDataFrame([(i, 0, int(sims[i]), label, False, False, False, 0, " ".join(ws)) for i, (ws, label) in enumerate(texts)], "extraction_id long, no int, sim long, label byte, prose boolean, alone boolean, again boolean, about long, unit string")
    got = {r.extraction_id for r in p01_residue.labelled_units(df, "extraction_id").collect()}
    assert got == want and 80 < len(want) < len(texts)


def article(i):
    """Two sentences that no other page has."""
    rng = random.Random(i)
    return " ".join(" ".join(["The", *(f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(9))]) + "." for _ in range(2))


def test_main_body(spark):
    nav, foot = "Home | News | Contact", "All rights reserved."
    page = lambda i: "\n".join([nav, "", "We use cookies to improve your visit.", "Got it", "", article(i), "", "## Heading", "", "- first thing", "- second thing", "", article(100 + i), "Subscribe to our newsletter and never miss a story.", "Related articles", "* A title", "", "- Home", "- Contact", "", foot])
    rows = [(i, f"https://h{i % 2}.example/a/{i}", page(i)) for i in range(24)] + [(60, None, page(60)), (61, "https://h0.example/x", None), (62, "u", ""), (None, "u", "x"), (0, "https://h0.example/a/0", page(0))]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "extraction_id long, source_id string, text string, no int, host string")
    got = {}
    for r in p05_main.surrounding_lines(df).collect():
        got.setdefault(r.extraction_id, []).append(r.line_no)
    lines = page(3).split("\n")
    kept = [x for i, x in enumerate(lines) if x and i not in got[3]]
    assert kept == [article(3), "## Heading", "- first thing", "- second thing", article(103)]
    assert sorted(got[60]) == sorted(got[3]) and 61 not in got and all(len(v) == len(set(v)) for v in got.values())
    assert p05_main.surrounding_lines(df.limit(0)).count() == 0


def test_residue_proven_by_the_corpus(spark):
    notice, filler = "This little app works best with its motor turned on.", "Put some words about the thing into this box."
    rows = [(i, f"Title {i}", notice) for i in range(5)] + [(10 + i, f"Other {i}", f"{filler} {filler}\n{ARTICLE}") for i in range(4)] + [(20, "One", f"{filler}\n{ARTICLE}"), (21, "Two", ARTICLE)]
    rows += [(30 + i, "Same page", "The old mill stood empty for many years.") for i in range(5)] + [(40, "Twice", "It rained and rained. It rained and rained.")]
    df = spark.createDataFrame(rows, "extraction_id long, title string, text string")
    got = {r.extraction_id: r.why for r in p01_residue.residue(df).collect()}
    assert got == {**{i: "notice" for i in range(5)}, **{10 + i: "filler" for i in range(4)}, 20: "filler"}


def test_body_text_and_long_notices_without_known_words(spark):
    notice = "Dear visitor, the crumbs of this house are kept for thirty days in a jar beside the door, as every guest of the house has been told before."
    page = lambda i: "\n".join(["- Alpha", "- Beta", "", notice, "", article(i), "", "- first thing", f"- second thing {i}", "", article(100 + i), "", "Zork | Blip", "Foo inc 2020"])
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(40)] + [(90, "https://h.example/x", None), (91, "https://h.example/y", "")], "extraction_id long, source_id string, text string")
    got = {r.extraction_id: r.body for r in p05_main.main_body(df).collect()}
    assert got[7] == "\n".join([article(7), "", "- first thing", "- second thing 7", "", article(107)])
    assert 90 not in got and got[91] == "" and p05_main.main_body(df.limit(0)).count() == 0


def test_main_body_leaves_out_cases_proven_by_other_kinds(spark, tmp_path):
    notice = "This little app works best with its motor turned on."
    rows = [(i, kind, "success", f"Title {i}", f"{notice}\nHome", f"https://h.example/{i}") for i, kind in enumerate(("html", "docs", "text"))] + [(9, "html", "success", "Nine", f"{ARTICLE}\nHome", "https://h.example/9")]
    spark.createDataFrame(rows, "extraction_id long, kind string, status string, title string, text string, source_id string").write.parquet(str(tmp_path / "extractions.parquet"))
    assert {r.extraction_id for r in queries.p1_found(spark, str(tmp_path)).collect()} == {0, 1, 2}
    assert {tuple(r) for r in queries.p5_found(spark, str(tmp_path)).collect()} == {(9, 1)}


WORDS = {"en": "the house and river were near old town with many people", "de": "das haus und der fluss waren nahe bei einer alten stadt", "es": "la casa y el río estaban cerca del pueblo viejo", "ru": "дом и река были рядом со старым городом людей"}


def sentence(lang, rng, n=14):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)) + "."


def test_language_held_out(spark):
    rng = random.Random(5)
    model = p06_language.fit([(lang, sentence(lang, rng)) for lang in WORDS for _ in range(60)] + [("de", sentence("en", rng)) for _ in range(5)])
    texts = [(lang, sentence(lang, rng, 10)) for lang in WORDS for _ in range(50)]
    scores = model.scores([p06_language.WORD.findall(t) for _, t in texts])
    right = np.mean([p06_language.LANGUAGES[b] == lang for b, (lang, _) in zip(scores.argmax(1), texts, strict=True)])
    assert right >= 0.98
    unseen = model.scores([["housing", "townsfolk"], ["городской", "речной"]])
    assert [p06_language.LANGUAGES[b] for b in unseen.argmax(1)] == ["en", "ru"]
    rows = [(1, "EN", sentence("en", rng) + "\n\n" + sentence("de", rng) + "\n\n" + sentence("en", rng, 30)), (2, "n/a", sentence("es", rng)), (3, None, "12 34"), (4, "de", None), (5, "pt-BR", ""), (6, "de_DE", sentence("de", rng) * 3000), (None, "en", "the")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "extraction_id long, language string, text string, lang string, k int")
    got = {(r.extraction_id, r.para_no): (r.lang, r.stated) for r in p06_language.languages(df, model).collect()}
    assert got == {(1, -1): ("en", "en"), (1, 1): ("de", "en"), (2, -1): ("es", None), (6, -1): ("de", "de")}
    code = "".join(rng.choice("0123456789abcdef") for _ in range(4000))  # its single letters are no words
    coded = spark.createDataFrame([(7, "de", sentence("de", rng) + f"\n\n{code}\n\n" + sentence("de", rng))], "extraction_id long, language string, text string")
    assert {(r.para_no, r.lang) for r in p06_language.languages(coded, model).collect()} == {(-1, "de")}
    assert p06_language.languages(df.limit(0), model).count() == 0
    assert p06_language.identify(df.limit(0)).count() == 0


def test_code_spellings(spark):
    want = {"English": "en", "en-GB": "en", "fre": "fr", "Русский": "ru", "pt_BR": "pt", "und": None, " ": None, "it": None, "NL": "nl"}
    got = spark.createDataFrame([(k,) for k in want], "x string").select("x", p06_language.known_code(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in got} == want


def scans(rng, n=60):
    base = "the harbour office measured several wooden bridges beside the quarry because nobody remembered which keeper had painted them during winter".split()
    rows, want = [], set()
    for k in range(n):
        pages = []
        for p in range(3):
            lines = [f"The Old Report {p + 1}" if p % 2 else "The Old Report", ""]
            for _ in range(6):
                words = [rng.choice(base) for _ in range(8)]
                i = len(lines)
                if rng.random() < 0.15:
                    w = rng.randrange(8)
                    bad = words[w].replace("e", "c", 1) if "e" in words[w] else words[w]
                    if bad != words[w]:
                        words[w] = bad
                        want.add((k, p, i, "chars"))
                lines.append(" ".join(words))
            if p == 0:
                lines[-1] += " quar-"
                want.add((k, p, len(lines) - 1, "hyphen"))
            elif p == 1:
                lines[2] = "ry " + lines[2]
            lines.append(f"- {k + p} -")
            pages.append((0, 0, "\n".join(lines)))
            want |= {(k, p, 0, "header"), (k, p, len(lines) - 1, "page_number")}
        rows.append((k, "The Old Report", pages))
    return rows, want


def test_scans_held_out(spark):
    rows, want = scans(random.Random(11))
    rows += [(900, None, None), (901, "t", []), (902, "t", [(0, 0, None), (0, 0, "")]), (None, "t", [(0, 0, "x")]), rows[0]]
    df = spark.createDataFrame([(*r, "w", 0) for r in rows], "extraction_id long, title string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, word string, k int")
    got = {tuple(r) for r in p07_scans.scan_faults(df).collect()}
    assert len(got & want) / len(got) >= 0.95 and len(got & want) / len(want) >= 0.95
    assert p07_scans.scan_faults(df.limit(0)).count() == 0


def test_scans_do_not_depend_on_the_size_of_the_corpus(spark):
    letters = "abdfgijkpqxy"
    bulk = [" ".join(a + b + c + d + e + "q" for b in letters for c in letters for d in letters for e in letters) for a in letters]
    rows = [(k, "t", [(0, 0, "the harbour keeper measured it\nby the harbour wall of the quarry")]) for k in range(9)]
    rows += [(20, "t", [(0, 0, "the harbour keeper\nby the qua-\nrry wall")]), (21, "t", [(0, 0, "near the harhour wall\nof the kccper it is")]), (22, "t", [(0, 0, "near the harbour wall\nof the quarry 1t and kecper")])]
    rows += [(23, "t", [(0, 0, "it is mcasured\nby thc wall")])]  # one way of misreading, in three words
    kind = "extraction_id long, title string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    small = {tuple(r) for r in p07_scans.scan_faults(spark.createDataFrame(rows, kind)).collect()}
    assert {(20, 0, 1, "hyphen"), (22, 0, 1, "chars")} <= small
    rows += [(100 + i, "t", [(0, 0, t) for t in bulk]) for i in range(8)]  # two million other words
    large = {tuple(r) for r in p07_scans.scan_faults(spark.createDataFrame(rows, kind)).collect()}
    assert {r for r in large if r[0] < 100} == small


def misread(word, rng):
    """A copy with one place misread in one of four ways: replaced, divided and lost characters."""
    ways = [("e", "c"), ("o", "0"), ("n", "ri"), ("rr", "r")]
    choices = [(m.start(), t, s) for t, s in ways for m in re.finditer(t, word)]
    at, true, seen = rng.choice(choices) if choices else (0, "", "")
    return word[:at] + seen + word[at + len(true) :]


def test_editor_repairs_unseen_copies():
    rng = random.Random(2)
    words = "harbour office measured wooden bridge nobody remembered keeper painted winter several furnace lantern garden quarry narrow mirror berries current morning printing inside window corner carried arrival barrel borrow correct ferry furrow hurry marry merry sorry sparrow terrace territory tomorrow worry".split()
    copies = sorted({(c, w) for w in words for _ in range(12) if (c := misread(w, rng)) != w})
    held = copies[::4]
    e = p07_scans.Editor().train(words, [p for p in copies if p not in held])
    assert {x[:6] for x in e.heads} == {"replac", "insert"}  # a lost character is put in
    assert np.mean([w in e.candidates(c) for c, w in held]) >= 0.8 and e.joins("har", "-", "bour")
    assert "remembered" in e.candidates("rcmembercd") and "painted" not in e.candidates("painted")


def test_repaired_paragraphs(spark):
    rows, _ = scans(random.Random(11))
    page = ["The Old Report 1\n\nthe harbour office mcasured several wooden bri-\ndges beside the quarry because nobody\n- 4 -", "The Old Report\n\nremembered which keeper had painted them.\n\nThe harbour Officc\n- 5 -", "The Old Report 3\n\nmeasured wooden bridges during winter.\n- 6 -"]
    rows += [(500, "The Old Report", [(0, 0, p) for p in page]), (501, "t", None), (502, None, [(0, 0, None)]), (500, "The Old Report", [(0, 0, p) for p in page])]
    df = spark.createDataFrame([(*r, "w") for r in rows], "extraction_id long, title string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, text string")
    got = {(r.extraction_id, r.para_no): (r.seg_no, r.text) for r in p07_scans.repaired_paragraphs(df).collect()}
    assert got[500, 0] == (0, "the harbour office measured several wooden bridges beside the quarry because nobody remembered which keeper had painted them.")
    assert got[500, 1] == (1, "The harbour Office measured wooden bridges during winter.") and (500, 2) not in got and not any(k in (501, 502) for k, _ in got)
    assert not any("Old Report" in t or "-" in t for _, t in got.values())
    assert p07_scans.repaired_paragraphs(df.limit(0)).count() == 0


ITEM = "Once a forged seal had united Zelbelo its flooded observatory held merely 182 sheets of copper and 686 fewer than the masons melted down by moonlight"


def plain_overlap(doc, item):
    """Longest equal run of words."""
    d, i = p09_leaks.words(doc), p09_leaks.words(item)
    return max((n for a in range(len(d)) for b in range(len(i)) for n in [next((k for k in range(min(len(d) - a, len(i) - b)) if d[a + k] != i[b + k]), min(len(d) - a, len(i) - b))]), default=0)


def test_leaks(spark):
    w = ITEM.split()
    other = "The rope makers of Dorura sold 12 barrels of resin before the fair while an eclipse delayed the ferrymen near the crooked lighthouse again"
    docs = [
        (1, "I like it. " + ITEM + " Great."), (2, "x " + " ".join(w[:14]).upper().replace(" ", "\n")), (3, " ".join(w[:8]) + " and so on"), (4, " ".join([*w[:6], "WRONG", *w[7:16]])), (5, " ".join(w[:9]) + " something in between here " + " ".join(w[14:24])), (6, None), (7, ""),
        (8, "word " * 60_000 + ITEM.replace(" ", "&nbsp;")), (9, other[:60]), (None, ITEM), (1, "I like it. " + ITEM + " Great."),
    ]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, item int, h string")
    items = spark.createDataFrame([(1, "a", ITEM), (2, "a", other), (3, "a", None), (4, "a", "too short"), (1, "a", ITEM)], "item_no long, suite string, text string")
    got = {(r.doc_id, r.item_no) for r in p09_leaks.leaked(df, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (5, 1), (8, 1)}
    assert {d for d, t in docs[:5] if plain_overlap(t, ITEM) >= 12} <= {d for d, _ in got}
    assert p09_leaks.leaked(df.limit(0), items).count() == 0 and p09_leaks.leaked(df, items.limit(0)).count() == 0


def test_leaks_of_items_in_many_copies_and_with_wrong_words(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(60)]
    table = [(i, " ".join(ws)) for i, ws in enumerate(items)] + [(100 + i, " ".join(items[0])) for i in range(60)]  # half of all items are one text
    wrong = lambda ws, *places: ["x" if i in places else w for i, w in enumerate(ws)]
    docs = [(1, items[0][:12], True), (2, wrong(items[1][:12], 10), True), (3, wrong(items[2][:12], 5), True), (4, items[3][:11], False), (5, wrong(items[4][:12], 3, 8), False)]
    docs += [(6, wrong(items[5][:8], 6) + ["between"] * 5 + items[5][15:23], True), (7, items[6][15:23] + ["between"] * 5 + items[6][:8], False), (8, wrong(items[7][:16], 5, 9), True), (9, items[8][:6] + ["y"] * 4 + items[8][20:26], True)]
    df = spark.createDataFrame([(k, " ".join(["before", *ws, "after"])) for k, ws, _ in docs], "doc_id long, text string")
    got = {(r.doc_id, r.item_no) for r in p09_leaks.leaked(df, spark.createDataFrame(table, "item_no long, text string")).collect()}
    assert got == {(k, k - 1) for k, _, leak in docs if leak} | {(1, 100 + i) for i in range(60)}


def test_a_stretch_that_leaks_has_three_hits_or_more():
    rng = random.Random(6)
    for _ in range(3000):
        item = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(12, 40))]
        wrong = rng.sample(range(1, len(item) - 1), max(1, len(item) // p09_leaks.ERRORS))
        doc = ["x" if i in wrong else w for i, w in enumerate(item)]
        kept = [{int(h[i]) for i in p09_leaks.winnow(h)} for h in map(p09_leaks.gram_hashes, (item, doc))]
        assert len(kept[0] & kept[1]) >= 3


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50])
def test_winnowing_guarantee(n):
    h = np.random.default_rng(n).integers(0, 9, n)
    chosen = set(p09_leaks.winnow(h).tolist())
    assert all(chosen & set(range(i, i + p09_leaks.WINDOW)) for i in range(n - p09_leaks.WINDOW + 1)) and (n == 0 or chosen)


def test_prefixes_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abä") for _ in range(rng.randrange(1, 9)))
    known, tails = {word() for _ in range(300)}, {word() for _ in range(300)}
    frame = lambda x: spark.createDataFrame([(w,) for w in sorted(x)], "bare string").repartition(7)
    want = {(t, t in known, any(k != t and k.startswith(t) for k in known)) for t in tails}
    assert {tuple(r) for r in p10_cut.prefixes(frame(tails), frame(known)).collect()} == want
    for a, b in ((tails, set()), (set(), known), ({"zz"}, known), ({"0"}, known)):
        assert {tuple(r) for r in p10_cut.prefixes(frame(a), frame(b)).collect()} == {(t, t in b, any(k != t and k.startswith(t) for k in b)) for t in a}


def test_cut_texts(spark):
    whole = ["The colour is lovely and the lid is easy to clean.", "Delivery took 5 days because of the holidays.", "I would buy this kettle again without a second thought."]
    docs = [(i, " ".join(whole), "csv" if i % 2 else None, "Very happy") for i in range(20)]
    full = " ".join(whole)
    docs += [(100 + i, full[:70], "csv", None) for i in range(6)] + [
        (200, full[:-1], "csv", None), (201, "Delivery took 7 days because of the hol…", "app", None), (202, "Very happy", "app", None), (203, whole[0] + " &am", "app", None), (204, None, "app", None), (205, " ", "app", None), (206, whole[0] + " 😀", "app", None), (207, "Delivery took", None, None), (None, "x", "app", None),
        (201, "Delivery took 7 days because of the hol…", "app", None), (208, whole[0] + " ...", "app", None), (209, "word. " * 50_000, "app", None),
    ]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, source string, title string, k int, tail string")
    got = {r.doc_id for r in p10_cut.truncated(df).collect()}
    assert got == {100, 101, 102, 103, 104, 105, 201, 203, 207}
    rates = {r.source: (r.n_texts, r.n_cut) for r in p10_cut.cut_rates(df).collect()}
    assert rates["csv"] == (17, 6) and rates[None] == (11, 1) and rates["app"][1] == 2
    assert p10_cut.truncated(df.limit(0)).count() == 0
