"""Problems 2, 3, 4 and 8: runs, splitting, turns and encoding."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import p02_runs, p03_split, p04_turns, p08_encode

SEG = "extraction_id long, source_id string, seq int, start_ms long, end_ms long, text string, k string, s string, ptr int"


def segments(spark, rows):
    """With extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(e, "s", q, a, b, t, "k", "s", 1) for e, q, a, b, t in rows], SEG)


def plain_runs(rows):
    def norm(t):
        return re.sub(r"[\W_]+", "", re.sub(r"<[^<>]*>", "", t)).lower()

    def like(a, b):
        if a == b:
            return True
        if re.sub(r"\D", "", a) != re.sub(r"\D", "", b) or abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:])

    by = {}
    for e, q, _, _, t in rows:
        if e is not None and q is not None and t and t.strip():
            by.setdefault(e, {})[q] = norm(t)
    out = set()
    for e, seqs in by.items():
        run = []
        for q in [*sorted(seqs), None]:
            if q is not None and run and like(seqs[run[-1]], seqs[q]):
                run.append(q)
                continue
            if len(run) > 1:
                out.add((e, run[0], run[-1]))
            run = [q]
    return out


def test_runs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(p02_runs, "BLOCK", 8)
    rng = random.Random(3)
    texts = ["hello", "Hello!", "helo", "<i>hello</i>", "help", "7 hello", "8 hello", "♪", "[ ]", "", "  ", None, "other"]
    rows = [(e, q, q * 10, q * 10 + 5, rng.choice(texts)) for e in range(6) for q in range(60)] + [(None, 1, 0, 0, "hello"), (1, None, 0, 0, "hello")]
    rows += [(9, q, q, q, "same") for q in range(100)] + rows[:5]
    got = p02_runs.collapse_runs(segments(spark, rows)).collect()
    assert {(r.extraction_id, r.first_seq, r.last_seq) for r in got} == plain_runs(rows)
    long = next(r for r in got if r.extraction_id == 9)
    assert (long.n_events, long.start_ms, long.end_ms, long.duration_ms) == (100, 0, 99, 99)


def test_runs_of_nothing(spark):
    assert p02_runs.collapse_runs(segments(spark, [])).count() == 0
    assert p02_runs.collapse_runs(segments(spark, [(1, 0, None, None, "a" * 100_000), (1, 1, None, None, "a" * 100_000)])).first().duration_ms is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n#-.é", max_size=600), st.integers(30, 90))
def test_pieces_tile_the_text(text, limit):
    pieces = p03_split.split(text, limit, 10)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert c <= b <= c + 10 and d > b and b - a <= limit
    assert all(b - a <= limit for a, b in pieces)


def test_pieces_end_at_structure():
    text = "# A\n\n" + "word. " * 60 + "\n\n# B\n\n" + "- item\n" * 20
    cuts = [text[a:b] for a, b in p03_split.split(text, 300, 20)]
    assert any(c.endswith("\n\n") for c in cuts) and all(c[-1] in ". \n" for c in cuts)
    assert len(p03_split.split("x" * 10_000, 1000, 100)) == 12


def test_split_items(spark):
    df = spark.createDataFrame([(1, -1, "a b " * 500, 400, "x"), (2, 0, None, 10, "x"), (3, 0, "", 10, "x"), (4, 0, "short", 10, "x"), (None, 1, "y" * 20, 10, "x")], "extraction_id long, seg_no int, text string, size_limit int, piece string")
    got = p03_split.split_items(df, overlap=4).collect()
    assert {r.extraction_id for r in got} == {1, None} and max(len(r.piece) for r in got if r.extraction_id == 1) <= 400
    assert p03_split.split_items(df.limit(0)).count() == 0


def test_turns(spark):
    casts = spark.createDataFrame([(1, 1, 10, "host"), (1, 2, 20, "guest"), (1, 2, 20, "guest"), (2, 1, 10, None)], "extraction_id long, seat int, speaker_id long, credit string")
    speakers = spark.createDataFrame([(10, "Ann", "Bolton", "Dr."), (20, "Cid", "Dover", None), (30, None, None, None)], "speaker_id long, first_name string, last_name string, honorific string")
    rows = [
        (1, 0, 0, 9, "00:00 - before anyone"), (1, 1, 10, 19, "Ann Bolton:"), (1, 2, 20, 29, "[Music]"), (1, 3, 30, 39, "um, hello there. CID: hi"), (1, 4, 40, 49, "[Cid Dover] more (laughs)"), (1, 5, 50, 59, "Dr. Bolton – I- I see"), (1, 6, 60, 69, None),
        (1, 7, 70, 79, "GUEST: well <v Ann Bolton> yes"), (1, 7, 70, 79, "GUEST: well <v Ann Bolton> yes"), (1, 8, 80, 89, "Ann Boltn: still me"), (1, 9, 90, 99, "Speaker 2: bye"), (3, 0, 0, 1, "Ann Bolton: not listed"), (2, 0, 0, 5, "A. Bolton: alone"),
    ]
    got = p04_turns.speaker_turns(segments(spark, rows), casts, speakers).orderBy("extraction_id", "turn_no").collect()
    assert [(r.extraction_id, r.start_ms, r.speaker_id, r.text) for r in got] == [
        (1, 30, 10, "hello there."), (1, 30, 20, "hi more"), (1, 50, 10, "I see"), (1, 70, 20, "well"), (1, 70, 10, "yes still me"), (1, 90, 20, "bye"), (2, 0, 10, "alone"),
    ]
    assert p04_turns.speaker_turns(segments(spark, []), casts, speakers).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return p08_encode.Encoder(p08_encode.vocabulary_path())


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_encoding_round_trip_and_chunks(encoder, text, size):
    ids = encoder.encode(text)
    d = p08_encode.Decoder(p08_encode.vocabulary_path()) if not hasattr(test_encoding_round_trip_and_chunks, "d") else test_encoding_round_trip_and_chunks.d
    test_encoding_round_trip_and_chunks.d = d
    assert d.feed(ids) + d.finish() == text
    assert [i for part in encoder.stream(text[k : k + size] for k in range(0, len(text), size)) for i in part] == ids


def test_encoding_equals_the_library(spark, encoder):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(p08_encode.vocabulary_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    texts = ["Hello world, it's 2024!", "日本語 ñandú 😀👩‍🔧", "a" * 3000, " " * 500 + "x", "\n\n\t x", "=" * 700, "<|endoftext|>", "", None]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in p08_encode.encode_corpus(df).collect()}
    assert got == {i: (lib.encode(t, add_special_tokens=False).ids if t else []) for i, t in [*enumerate(texts), (None, "x")]}


def test_transducer_keeps_little(encoder):
    t = p08_encode.Transducer(encoder.m)
    out = t.feed(b"ab" * 3000)
    assert len(t.data) <= 3 * encoder.m.longest and out + t.finish() == [encoder.m.rank[x] for x in encoder.m.merge(b"ab" * 3000)]
