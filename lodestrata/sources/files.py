"""File trees as relations, read by Spark from any store it reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .globs import DEFAULT_EXCLUDES, matches


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), length, modified, content. Paths are filtered before contents are read; user excludes add to the defaults.

    Order by split(path, '/'), which is a walk's order: names within each directory.
    """
    base = root.rstrip("/") + "/"
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    cut = F.regexp_replace(F.lit(base), r"^[a-z]+:/+", "/")
    x = x.withColumn("path", F.substring(full, F.char_length(cut) + 1, F.char_length(full)))
    x = x.where(~matches(F.col("path"), *DEFAULT_EXCLUDES, *exclude))
    if include:
        x = x.where(matches(F.col("path"), *include))
    return x.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def text_files(files: DataFrame) -> DataFrame:
    """Files without a NUL among their first 512 bytes, as text."""
    head = F.hex(F.substring("content", 1, 512))
    return files.where(~F.coalesce(head.rlike("^(?:..)*00"), F.lit(False))).withColumn("content", F.col("content").cast("string"))


def generated(files: DataFrame) -> DataFrame:
    """Marks files that a tool wrote, by name or by their first line."""
    first = F.split("content", "\n", 2)[0]
    return files.withColumn("generated", F.col("path").endswith("_string.go") | F.coalesce(first.contains("Code generated"), F.lit(False)))
