"""Scans: tables of sources, text files, binary files, archives, and notebooks of short links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import trimmed
from quillmesh.operators.files import extracted_file
from quillmesh.operators.textops import with_links


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(raw, text, status, exit_code, error) of whole text files; invalid UTF-8 is replaced, blank files fail with 30."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("raw"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    blank = trimmed(F.col("text")) == ""
    return files.select("raw", "text", F.when(blank, "failed").otherwise("success").alias("status"), F.when(blank, 30).otherwise(0).alias("exit_code"), F.when(blank, "empty file").alias("error"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(raw, ext, stem, file) of files with their extracted contents; each task reads its own files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    named = files.select(F.col("path").alias("raw"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content")
    return named.select("raw", "ext", "stem", extracted_file("content", "ext").alias("file"))


def short_links(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct short links of all texts, to be resolved once each."""
    return texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(https?://t\.co/\w+)"), F.lit(1)))).alias("link")).distinct()


def linked_texts(texts: DataFrame, lookup: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text) with the short links that a table (link, target) resolves; unknown ones stay.

    Each row's distinct links meet the table by a join, so the table may be of any size, and
    come back as one small map a row. The key must be unique.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(https?://t\.co/\w+)"), F.lit(1)))).alias("link")
    known = texts.select(key, found).join(lookup.select("link", "target"), "link").groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("link", "target")))).alias("__known"))
    return texts.join(known, key, "left").select(key, F.when(F.col("__known").isNull(), F.col(text)).otherwise(with_links(F.col(text), F.col("__known"))).alias(text))


def missing(sources: DataFrame, found: DataFrame) -> DataFrame:
    """Sources without a file: failed with exit code 10."""
    return sources.join(found.select("raw"), "raw", "left_anti").select("raw", F.lit("failed").alias("status"), F.lit(10).alias("exit_code"), F.lit("file not found").alias("error"))
