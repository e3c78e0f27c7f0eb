"""Speech transcripts into clean, ordered speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.runtime import blocked_last, cut

PLACES = 1 << 24  # more than the pieces of any cue, whose text would be tens of megabytes; positions stay below 2^63 for 2^38 cues

# Words that carry no content in speech, by language.
FILLERS = (
    "um, uh, uhm, er, erm, hm, hmm, mhm, you know, I mean, eh, este, o sea, pues, euh, ben, bah, du coup, hein, "
    "äh, ähm, öh, halt, sozusagen, né, tipo, ahn, hã, nou, zeg maar, э, ээ, эм, ну, как бы, это самое"
).split(", ")

CLOCK = r"(?:<\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?>|\[\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\]|\(\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\)|^\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?=\s+-|\s|$))(?:\s+-(?=\s))?"
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}_.'’&;]*"
LABEL = rf"<v(?:\.[\w.]+)? ([^<>]*)>|\[([^\[\]]*)\]|\(([^()]*)\)|((?:{WORD}-?,? ){{0,4}}{WORD})(?: ?:| [–—])(?=\s|$)"


def name_forms(casts: DataFrame, speakers: DataFrame) -> DataFrame:
    """For each extraction the ways to name its speakers: (extraction_id, strict, loose, names).

    A form that fits two speakers of one extraction names nobody and is left out, as are
    forms made from null names.
    """
    c = casts.select("extraction_id", "seat", "speaker_id", F.trim("credit").alias("role")).where("extraction_id is not null and speaker_id is not null").distinct()
    s = speakers.select("speaker_id", F.trim("first_name").alias("f"), F.trim("last_name").alias("l"), F.trim("honorific").alias("h")).distinct()
    both = c.join(s, "speaker_id", "left")
    col, low = F.col, lambda *parts: F.lower(F.concat(*parts))
    sp = F.lit(" ")
    seat = col("seat").cast("string")
    loose = [
        low(col("f"), sp, col("l")), low(col("l"), F.lit(", "), col("f")), low(col("l"), sp, col("f")), low("f"), low("l"),
        low(F.left("f", F.lit(1)), F.lit(". "), col("l")), low(col("f"), sp, F.left("l", F.lit(1)), F.lit(".")), low(col("h"), sp, col("l")), low(col("h"), sp, col("f"), sp, col("l")), low(col("h"), sp, col("f")),
    ]
    strict = [
        F.concat(F.left("f", F.lit(1)), F.left("l", F.lit(1))), F.concat(F.left("f", F.lit(1)), F.lit("."), F.left("l", F.lit(1)), F.lit(".")), F.upper("role"), F.initcap("role"),
        F.concat(F.lit("Speaker "), seat), F.concat(F.lit("SPEAKER "), seat), F.concat(F.lit("SPEAKER_"), F.lpad(seat, 2, "0")), F.concat(F.lit("SPK_"), F.lpad(seat, 2, "0")), F.concat(F.lit("S"), seat),
        F.concat(F.upper("role"), sp, seat), F.concat(F.initcap("role"), sp, seat),
    ]
    forms = F.concat(*[F.array(F.struct(x.alias("form"), F.lit(flag).alias("strict"))) for xs, flag in ((loose, False), (strict, True)) for x in xs])
    each = both.select("extraction_id", "speaker_id", F.explode(forms).alias("x")).select("extraction_id", "speaker_id", "x.*").where("form is not null and form <> ''")
    sure = each.groupBy("extraction_id", "form", "strict").agg(F.min("speaker_id").alias("speaker_id"), F.max("speaker_id").alias("other")).where("speaker_id = other")
    entry = F.struct("form", "speaker_id")
    name = F.struct("form", F.size(F.split("form", " ")).alias("n"), "speaker_id")
    return sure.groupBy("extraction_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("strict"), entry))).alias("strict"),
        F.map_from_entries(F.collect_list(F.when(~F.col("strict"), entry))).alias("loose"),
        F.collect_list(F.when(~F.col("strict") & (F.length("form") >= 4), name)).alias("names"),
    )


def _named(words: Column, strict: Column, loose: Column, names: Column) -> Column:
    """The longest form that the last of the words are, as (n, speaker_id), or null.

    Exact forms come first; else a name form of four letters or more with one letter wrong.
    """
    tails = {n: F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - (n - 1)), F.lit(n)), " ") for n in (4, 3, 2, 1)}
    exact = F.coalesce(*[F.when(sid.isNotNull(), F.struct(F.lit(n).alias("n"), sid.alias("speaker_id"))) for n, t in tails.items() for sid in (F.try_element_at(strict, t), F.try_element_at(loose, F.lower(t)))])
    low = F.array(*[F.lower(tails[n]) for n in (1, 2, 3, 4)])
    near = F.array_max(F.transform(F.filter(names, lambda f: (F.levenshtein(F.try_element_at(low, f["n"]), f["form"], 1) == 1)), lambda f: F.struct(f["n"].alias("n"), f["speaker_id"].alias("speaker_id"))))
    return F.coalesce(exact, near)


def clean_words(text: Column) -> Column:
    """Without clock times, sound notes, tags, fillers and false starts."""
    c = F.regexp_replace(text, CLOCK, " ")
    c = F.regexp_replace(c, r"<[^<>]*>|\(\([^()]*\)\)|\([^()]*\)|\[[^\[\]]*\]|\*[^*\n]{1,40}\*|[♪♫][^♪♫]*[♪♫]|[♪♫]|>>+|^\s*[-–—]\s|\s[-–—]\s*$", " ")
    c = F.regexp_replace(c, r"(?iu)(?<![\p{L}\p{N}'’])(?:" + "|".join(sorted(FILLERS, key=len, reverse=True)) + r")(?:,|\.\.\.|…|(?=\s|$))", " ")
    c = F.regexp_replace(c, r"(?iu)(?<![\p{L}\p{N}])([\p{L}\p{N}]+)- (?=\1(?![\p{L}\p{N}]))", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def speaker_turns(segments: DataFrame, casts: DataFrame, speakers: DataFrame) -> DataFrame:
    """Turns of the extractions listed in casts: (extraction_id, turn_no, start_ms, end_ms, speaker_id, text).

    Labels are matched against the forms of the extraction's own cast (one letter wrong is
    allowed in a name), speakers are filled forward, noise is removed, and consecutive pieces
    of one speaker become a turn, which starts at the cue of its first spoken word. Words
    before any label belong to nobody and are left out. Cues with null text, position or key
    are skipped; repeated deliveries count once; an empty table gives no rows. All fills run in
    blocks, so that one endless transcript does not end in one task.
    """
    forms = name_forms(casts, speakers)
    cues = segments.where("extraction_id is not null and seq is not null and text is not null").select("extraction_id", F.col("seq").cast("long").alias("seq"), "start_ms", "end_ms", "text")
    cues = cues.join(forms.select("extraction_id"), "extraction_id", "left_semi").dropDuplicates(["extraction_id", "seq"]).join(forms, "extraction_id")
    plain = F.regexp_replace(F.regexp_replace("text", r"[\x01-\x03]|&nbsp;|\(\([^()]*\)\)", " "), CLOCK, " ")
    marked = F.regexp_replace(plain, LABEL, "\x01$1$2$3$4\x02$0\x03")
    parts = F.transform(
        F.split(marked, "\x01"),
        lambda p: F.struct(
            F.when(F.instr(p, "\x02") > 0, F.trim(F.substring_index(p, "\x02", 1))).alias("label"),
            F.when(F.instr(p, "\x02") > 0, F.substring_index(F.substring_index(p, "\x03", 1), "\x02", -1)).otherwise("").alias("raw"),
            F.substring_index(p, "\x03", -1).alias("rest"),
        ),
    )
    pieces = cues.select("extraction_id", "seq", "start_ms", "end_ms", "strict", "loose", "names", F.posexplode(parts).alias("place", "p"))
    who = F.when(F.col("p.label").isNotNull(), _named(F.split("p.label", " "), F.col("strict"), F.col("loose"), F.col("names")))
    named = pieces.withColumn("who", who).select(
        "extraction_id", "start_ms", "end_ms", "seq", "place", F.col("who.speaker_id").alias("speaker"),
        F.when(F.col("who").isNotNull(), F.array_join(F.slice(F.split("p.label", " "), F.lit(1), F.greatest(F.lit(0), F.size(F.split("p.label", " ")) - F.col("who.n"))), " ")).otherwise("").alias("before"),
        F.when(F.col("who").isNotNull(), F.col("p.rest")).otherwise(F.concat("p.raw", "p.rest")).alias("words"),
    )
    # Words that the label pattern took along before the name still belong to the speaker before.
    two = F.array(
        F.struct(F.lit(0).alias("half"), F.lit(None).cast("long").alias("speaker"), F.col("before").alias("words")),
        F.struct(F.lit(1).alias("half"), F.col("speaker").cast("long").alias("speaker"), F.col("words")),
    )
    halves = named.select("extraction_id", "seq", "start_ms", "end_ms", "place", F.explode(two).alias("h")).select(
        "extraction_id", "start_ms", "end_ms", (F.col("seq") * PLACES * 2 + F.col("place") * 2 + F.col("h.half")).alias("at"), "h.speaker", clean_words(F.col("h.words")).alias("words")
    )
    halves = cut(halves.where("speaker is not null or words <> ''"))
    filled = blocked_last(halves, ["extraction_id"], "at", F.col("speaker"), "speaker_id", block=8192 * PLACES)
    spoken = cut(filled.where(F.col("speaker_id").isNotNull() & F.col("words").rlike(r"[\p{L}\p{N}]")).drop("speaker"))
    previous = blocked_last(spoken, ["extraction_id"], "at", F.col("speaker_id"), "previous", block=8192 * PLACES, include_self=False)
    begin = cut(previous.withColumn("begins", F.when(F.col("previous").isNull() | (F.col("previous") != F.col("speaker_id")), F.col("at"))).drop("previous"))
    islands = blocked_last(begin, ["extraction_id"], "at", F.col("begins"), "turn", block=8192 * PLACES)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]), " ")
    turns = islands.groupBy("extraction_id", "turn", "speaker_id").agg(F.min_by("start_ms", "at").alias("start_ms"), F.max_by("end_ms", "at").alias("end_ms"), said.alias("text"))
    return turns.select("extraction_id", F.col("turn").alias("turn_no"), "start_ms", "end_ms", "speaker_id", "text")
