"""Command line: python -m quillmesh.cli INPUT ... --out DIR."""

from __future__ import annotations

import argparse
import importlib.util
import json
import pathlib
import shutil
import sys

import quillmesh


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmesh", description="Extract sources to Markdown and JSON.")
    p.add_argument("input", nargs="*", help="URLs or paths")
    p.add_argument("--out", default="out", help="folder of the results")
    p.add_argument("--force", action="store_true", help="extract again what has a result")
    p.add_argument("--provider", help="use this provider")
    p.add_argument("--json-log", action="store_true", help="print events as JSON lines")
    p.add_argument("--print", dest="to_stdout", action="store_true", help="print the Markdown instead of writing files")
    p.add_argument("--verbose", "-v", action="store_true", help="say on stderr what became of each input")
    p.add_argument("--keep-intermediates", action="store_true", help="keep the whole result table in OUT/intermediate")
    p.add_argument("--notebook-tag", help="tag in the names of notebooks for videos")
    mode = p.add_mutually_exclusive_group()
    for flag in ("check", "probe", "list-providers", "version"):
        mode.add_argument(f"--{flag}", dest="mode", action="store_const", const=flag)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.mode == "version":
        print(quillmesh.__version__)
        return 0
    if args.mode == "check":
        found = {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas")} | {t: shutil.which(t) is not None for t in ("java", "pandoc", "pdftotext")}
        print(json.dumps(found, indent=2))
        return 0 if found["pyspark"] and found["java"] else 10
    from quillmesh.plans.pipeline import Engine

    engine = Engine()
    if args.mode == "list-providers":
        print("\n".join(p.kind for p in engine.registry.all()))
        return 0
    if not args.input:
        print("no input", file=sys.stderr)
        return 2
    from pyspark.sql import functions as F

    from quillmesh.operators import sinks
    from quillmesh.runtime import cut, session

    spark = session("quillmesh-cli")
    sources = spark.createDataFrame([(x,) for x in args.input], "raw string")
    if args.mode == "probe":
        for r in engine.detect(sources).select("raw", "kind", "slug").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return 0
    local = [x for x in args.input if "://" not in x and pathlib.Path(x).is_file()]
    if local:
        content = spark.read.format("binaryFile").load(local).select(F.regexp_replace("path", "^file:/*", "/").alias("p"), "content")
        sources = sources.join(content, F.col("p").endswith(F.regexp_replace("raw", r"^\./", "")), "left").select("raw", "content", F.when(F.lower("raw").rlike(r"\.(?:md|markdown|txt|text)$"), F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    out = pathlib.Path(args.out)
    done = None
    if not args.force and any(out.glob("*.md")):
        done = earlier(spark, str(out))
    named = results_of(engine, sources, done, args.provider, args.notebook_tag)
    if done is not None:
        hits = sinks.cached(engine.detect(sources.select("raw")).select(F.col("raw").alias("source_id"), "kind", "slug"), done)
        for r in hits.toLocalIterator():
            say(args, {"event": "cache_hit", "source_id": r["source_id"], "slug": r["hit_slug"]})
    named = cut(named)
    if args.json_log:
        for r in sinks.event_rows(named).orderBy("source_id", "step").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False), file=sys.stderr)
    made = sinks.success_markdown(named).join(sinks.success_json(named), "slug").unionByName(sinks.failure_stub(named))
    if args.to_stdout:
        for r in made.toLocalIterator():
            print(r["md"], end="")
    else:
        out.mkdir(parents=True, exist_ok=True)
        for r in made.toLocalIterator():  # one file of each kind for every input of the command line
            (out / f"{r['slug']}.md").write_text(r["md"], encoding="utf-8")
            (out / f"{r['slug']}.json").write_text(r["json"], encoding="utf-8")
            if args.verbose:
                print(f"wrote {out / r['slug']}.md", file=sys.stderr)
    if args.keep_intermediates:
        named.write.mode("overwrite").parquet(str(out / "intermediate"))
    return int(named.agg(F.max("exit_code")).first()[0] or 0)


def say(args: argparse.Namespace, event: dict) -> None:
    if args.json_log or args.verbose:
        print(json.dumps(event, ensure_ascii=False), file=sys.stderr)


def earlier(spark, out: str):
    """(source_id, slug, status) of the results in a folder, read from their front matter; malformed files count for nothing."""
    from pyspark.sql import functions as F

    from quillmesh.operators import sinks

    head = sinks.front_matter(F.col("value"))
    line = lambda k: F.regexp_extract(head, rf"(?m)^{k}: (.*)$", 1)
    plain = lambda v: F.when(v.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]).otherwise(v)
    slug = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.md$", 1)
    return spark.read.text(out, wholetext=True, pathGlobFilter="*.md").select(plain(line("source_id")).alias("source_id"), F.try_url_decode(slug).alias("slug"), line("status").alias("status"))


def results_of(engine, sources, done, provider: str | None, tag: str | None):
    """Results with what the files need; slugs that two inputs want are told apart. A source of no kind has the slug of its name."""
    from pyspark.sql import functions as F

    from quillmesh.operators import identity, textops

    day = F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    found = engine.run(sources, done, provider=provider).withColumns(
        {
            "source": F.col("raw"), "source_id": F.col("raw"), "posted": F.lit(None).cast("string"), "extracted_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
            "slug": F.coalesce(F.nullif("slug", F.lit("")), F.nullif(identity.slug(F.col("raw")), F.lit("")), F.lit("extraction-failed")),
            "notebook": F.when(F.col("kind") == "youtube", textops.notebook_name(F.coalesce(F.nullif("title", F.lit("")), F.col("slug")), F.col("slug"), day, tag=tag)),
        }
    )
    safe = found.withColumn("__id", identity.work_name(F.col("source_id")))
    return identity.disambiguated(safe, key="__id", order="raw").drop("slug", "__id").withColumnRenamed("final_slug", "slug")


if __name__ == "__main__":
    sys.exit(main())
