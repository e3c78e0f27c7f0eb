"""Results as Markdown and JSON, failure stubs, the result cache and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import lines, trimmed, unlines

# The closed vocabulary of events.
STAGES = ("started", "detected", "fetching", "extracting", "cache_hit", "success", "failed")
TERMINAL = ("cache_hit", "success", "failed")


def markdown_body(text: Column, title: Column) -> Column:
    """'' if blank, as it is if it opens with a heading, else under the title."""
    body = trimmed(text)
    return F.when(body == "", "").when(body.rlike(r"^#{1,6}\s"), F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise(F.concat(F.lit("\n# "), title, F.lit("\n\n"), body, F.lit("\n")))


def whole_seconds(ms: Column) -> Column:
    return F.bround(ms / 1000, 0).cast("bigint")


def _scalar(v: Column) -> Column:
    """A string as YAML: as it is if it is plain words, else in double quotes, escaped as JSON does."""
    plain = v.rlike(r"^\p{L}(?:[\p{L}\p{N} _-]*[\p{L}\p{N}_-])?$") & ~F.lower(v).isin("true", "false", "null", "yes", "no", "on", "off")
    quoted = F.to_json(F.struct(v.alias("v")))
    return F.when(plain, v).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def _front(**fields: Column) -> Column:
    """Front matter in the order of the fields; nulls and empty strings are left out. Names ending in _ are taken as they are."""
    lines = [F.coalesce(F.when(v.cast("string") != "", F.concat(F.lit(f"{k.rstrip('_')}: "), v.cast("string") if k.endswith("_") else _scalar(v), F.lit("\n"))), F.lit("")) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n"))


def _named(df: DataFrame, *names: str) -> dict[str, Column]:
    """Columns by name; those that a frame doesn't have are null."""
    return {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in names}


def _as_json(v: Column) -> Column:
    """A struct or array in one line, or null."""
    whole = F.to_json(F.struct(v.alias("v")))
    return F.when(v.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def success_markdown(df: DataFrame) -> DataFrame:
    """(slug, md) of successes: front matter in a fixed key order, nulls left out, then the body."""
    c = _named(df, "source", "source_id", "title", "slug", "author", "posted", "kind", "language", "extracted_at")
    made = next((n for n in ("detail", "extractor") if n in df.columns), None)
    head = _front(
        source=c["source"], source_id=c["source_id"], title=c["title"], slug=c["slug"], author=c["author"], duration_seconds_=whole_seconds(F.col("duration_ms")), posted=c["posted"], kind=c["kind"],
        extractor_detail_=_as_json(F.col(made)) if made else F.lit(None).cast("string"), language=c["language"], extracted_at=c["extracted_at"], status=F.lit("success"),
    )
    return df.where("status = 'success'").select("slug", F.concat(head, markdown_body(F.col("text"), F.col("title"))).alias("md"))


def success_json(df: DataFrame) -> DataFrame:
    """(slug, json) of successes; metadata keeps its nulls."""
    meta = F.struct("source", "source_id", "title", "slug", "author", "duration_ms", "posted", "language")
    made = F.col("detail" if "detail" in df.columns else "extractor")
    return df.where("status = 'success'").select("slug", F.to_json(F.struct("status", "kind", made.alias("extractor_detail"), meta.alias("metadata"), "text", "segments", "extracted_at"), {"ignoreNullFields": "false"}).alias("json"))


def failure_stub(df: DataFrame) -> DataFrame:
    """(slug, md, json) of failures; extractor_attempted names the kind's way that was tried, none where no kind matched."""
    title, tried = F.nullif("title", F.lit("")), F.when(F.col("kind").isNull(), F.array().cast("array<string>")).otherwise(F.array("kind"))
    c = _named(df, "source", "source_id", "slug", "kind", "error", "extracted_at")
    head = _front(
        source=c["source"], source_id=c["source_id"], slug=c["slug"], kind=c["kind"], title=title, status=F.lit("failed"), exit_code_=F.col("exit_code"), extractor_attempted_=_as_json(tried), error=c["error"], attempted_at=c["extracted_at"],
    )
    body = F.lit("\n(no body - extraction failed; run again with force)\n")
    payload = F.struct("status", "kind", "source", "source_id", "slug", title.alias("title"), "exit_code", tried.alias("extractor_attempted"), "error", F.col("extracted_at").alias("attempted_at"))
    return df.where("status = 'failed'").select("slug", F.concat(head, body).alias("md"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"))


def front_matter(md: Column) -> Column:
    """The block between the opening rule and the next one, or null."""
    return F.nullif(F.regexp_extract(md, r"(?s)^---\n(.*?)\n---\n", 1), F.lit(""))


def uncached(sources: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Sources without an earlier success under their slug (or a suffixed form of it) and id."""
    if force:
        return sources
    return sources.join(_owned(results), (F.col("slug") == F.col("done_slug")) & (F.col("source_id") == F.col("done_id")), "left_anti")


def cached(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources with their earlier result's actual slug as hit_slug."""
    hit = sources.join(_owned(results), (F.col("slug") == F.col("done_slug")) & (F.col("source_id") == F.col("done_id")))
    return hit.groupBy(*sources.columns).agg(F.min("actual").alias("hit_slug"))


def _owned(results: DataFrame) -> DataFrame:
    """A result answers for its slug and for each of its forms without a trailing --suffix, so that the join is on equality."""
    parts = F.split("slug", "--")
    forms = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "--"))
    return results.where("status = 'success'").select(F.explode(forms).alias("done_slug"), F.col("source_id").alias("done_id"), F.col("slug").alias("actual"))


def checked_stage(event: Column) -> Column:
    return F.when(event.isin(*STAGES), event).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce(event, F.lit("null")))))


def event_rows(results: DataFrame) -> DataFrame:
    """Events of finished extractions: started, detected, then success or failed, with their order."""
    end = F.when(F.col("status") == "success", F.lit("success")).otherwise(F.lit("failed"))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), e.alias("event")) for i, e in enumerate((F.lit("started"), F.lit("detected"), end))])
    return results.select("source_id", "kind", "slug", "error", F.explode(rows).alias("e")).select("source_id", "kind", "slug", "e.step", "e.event", F.when(F.col("e.event") == "failed", F.col("error")).alias("error"))


def final_state(log: DataFrame, key: str = "source_id", event: str = "event", ts: str = "ts") -> DataFrame:
    """(key, final_event, n_events): the last terminal event of each key, or null while it runs; repeated deliveries count once."""
    once = log.select("log_id", key, event, ts).where(F.col(key).isNotNull()).dropDuplicates(["log_id"])
    last = F.max(F.when(F.col(event).isin(*TERMINAL), F.struct(F.col(ts).alias("t"), F.col("log_id").alias("i"), F.col(event).alias("e"))))
    return once.groupBy(key).agg(last["e"].alias("final_event"), F.count("*").alias("n_events"))


def quoted(x: Column) -> Column:
    return unlines(F.transform(lines(x), lambda s: F.when(s == "", ">").otherwise(F.concat(F.lit("> "), s))))
