"""The pN_ queries over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.runtime import table


def p1_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p01_residue import residue, usable

    return residue(usable(table(spark, sf_dir, "extractions")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_residue(spark, sf_dir).select("extraction_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p02_runs import collapse_runs

    return collapse_runs(table(spark, sf_dir, "segments")).select("extraction_id", "first_seq", "last_seq")


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p02_runs import collapse_runs

    return collapse_runs(table(spark, sf_dir, "segments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p03_split import oversized_items, split_items

    pieces = split_items(oversized_items(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "segments")))
    return pieces.where("piece_no = 1").select("extraction_id", "seg_no").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p03_split import split_extractions

    return split_extractions(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "segments"))


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p04_turns import speaker_turns

    return speaker_turns(table(spark, sf_dir, "segments"), table(spark, sf_dir, "casts"), table(spark, sf_dir, "speakers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_turns(spark, sf_dir).select("extraction_id", "start_ms", "speaker_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p01_residue import residue, usable
    from quillmesh.llm.p05_main import surrounding_lines

    extractions = table(spark, sf_dir, "extractions")
    pages = extractions.where("status = 'success' and kind = 'html'")
    left_out = residue(usable(extractions)).select("extraction_id")
    return surrounding_lines(pages).join(left_out, "extraction_id", "left_anti")


def p5_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p05_main import main_body

    return main_body(table(spark, sf_dir, "extractions").where("status = 'success' and kind = 'html'"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p06_language import identify

    texts = table(spark, sf_dir, "extractions").where("status = 'success'").select("extraction_id", "text", "language")
    return identify(texts).dropDuplicates(["extraction_id", "para_no"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p01_residue import residue, usable
    from quillmesh.llm.p06_language import identify

    extractions = table(spark, sf_dir, "extractions")
    found = identify(extractions.where("status = 'success'").select("extraction_id", "text", "language"))
    cases = found.where("para_no >= 0 or stated is null or stated <> lang").select("extraction_id", "para_no", "lang").distinct()
    return cases.join(residue(usable(extractions)).select("extraction_id"), "extraction_id", "left_anti")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p07_scans import scan_faults

    return scan_faults(table(spark, sf_dir, "extractions").where("status = 'success' and kind in ('pdf', 'image')"))


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p07_scans import repaired_paragraphs

    return repaired_paragraphs(table(spark, sf_dir, "extractions").where("status = 'success' and kind in ('pdf', 'image')"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p08_encode import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p09_leaks import leaked

    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_no")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p10_cut import truncated

    return truncated(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.llm.p10_cut import cut_rates

    return cut_rates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_residue": p1_residue,
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p5_found": p5_found,
    "p5_body": p5_body,
    "p6_found": p6_found,
    "p6_languages": p6_languages,
    "p7_found": p7_found,
    "p7_repaired": p7_repaired,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}

RUNS = r"""
    WITH once AS (SELECT extraction_id, seq, start_ms, end_ms, text FROM segments WHERE regexp_matches(text, '[^\s\x{00A0}\x{200B}\x{FEFF}]')
        QUALIFY row_number() OVER (PARTITION BY extraction_id, seq ORDER BY arrived_at) = 1),
    bare AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '</?[A-Za-z0-9][^<>]*>', '', 'g'), '&amp;(#?\w+;)', '&\1', 'g'),
        '(?i)&(lt|gt|quot|apos|nbsp|amp|hellip|[lr][sd]quo|[mn]dash|middot|copy|shy|#0*(3[2-9]|4[0-7]|160|82\d\d)|#x0*(2[0-9a-f]|a0|20[0-9a-f]{2}));', '', 'g'),
        '&([A-Za-z])(acute|grave|circ|uml|tilde|cedil|ring|slash);', '\1', 'g')), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS t FROM once),
    before AS (SELECT *, lag(t) OVER w AS p, row_number() OVER w AS n FROM bare WINDOW w AS (PARTITION BY extraction_id ORDER BY seq)),
    flagged AS (SELECT *, CASE WHEN n > 1 AND (t = p OR (abs(length(t) - length(p)) <= 1 AND levenshtein(t, p) <= 1 AND regexp_replace(t, '\P{N}+', '', 'g') = regexp_replace(p, '\P{N}+', '', 'g'))) THEN 0 ELSE 1 END AS new FROM before),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY extraction_id ORDER BY seq) AS run FROM flagged)
    SELECT extraction_id, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq{more} FROM runs GROUP BY extraction_id, run HAVING count(*) > 1"""

SQL: dict[str, str] = {
    "p2_found": RUNS.replace("{more}", ""),
    "p2_runs": RUNS.replace("{more}", ", arg_min(start_ms, seq) AS start_ms, arg_max(end_ms, seq) AS end_ms, count(*) AS n_events, arg_max(end_ms, seq) - arg_min(start_ms, seq) AS duration_ms"),
    "p3_found": """
        SELECT DISTINCT extraction_id, seg_no FROM (
            SELECT extraction_id, -1 AS seg_no, text, 4000 AS size_limit FROM extractions
            UNION ALL SELECT extraction_id, CAST(u.i - 1 AS INTEGER), segments[u.i].text, 1500
                FROM extractions, LATERAL (SELECT unnest(range(1, len(segments) + 1)) AS i) u
            UNION ALL SELECT extraction_id, seq, text, 1500 FROM segments)
        WHERE length(text) > size_limit""",
}
