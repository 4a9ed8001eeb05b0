"""Environment files, API descriptions and workspaces as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dotenv(lines: DataFrame) -> DataFrame:
    """lines(path, line, text): file, key, value; the last of a key counts; comments and lines without a key don't."""
    x = lines.withColumn("text", F.btrim("text", F.lit(" \t\r"))).where(~F.col("text").startswith("#") & (F.instr("text", "=") > 1))
    x = x.select(F.col("path").alias("file"), "line", F.trim(F.regexp_extract("text", r"^([^=]+)=", 1)).alias("key"), F.trim(F.regexp_replace("text", r"^[^=]+=", "")).alias("value"))
    return x.groupBy("file", "key").agg(F.max_by("value", "line").alias("value"))


def api_paths(lines: DataFrame) -> DataFrame:
    """lines(path, line, text) of API descriptions: file, route. In YAML only what stands under paths:; in JSON any key that begins with a slash."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("text").rlike(r"^[A-Za-z]"), F.regexp_extract("text", r"^([A-Za-z][\w-]*)\s*:", 1)), ignorenulls=True).over(w)
    x = lines.withColumn("top", top)
    yaml = F.when(F.col("top") == "paths", F.regexp_extract("text", r"^ {1,4}[\"']?(/[^\s:\"']*)[\"']?\s*:", 1))
    route = F.when(F.col("path").endswith(".json"), F.regexp_extract("text", r'"(/[^"]*)"\s*:\s*\{', 1)).otherwise(yaml)
    return x.select(F.col("path").alias("file"), route.alias("route")).where("route <> ''")


def workspaces(files: DataFrame) -> DataFrame:
    """files(path, content): kind, pattern of the members of the first kind of workspace found at the root."""
    # The files that declare workspaces, in the order in which they are tried.
    kinds = {"go.work": r"(?m)^\s*(?:use\s+)?(\.[^\s()]*)\s*$", "pnpm-workspace.yaml": r"(?m)^\s*-\s*[\"']?([^\"'\s]+)", "package.json": r'"workspaces"\s*:\s*(?:\{\s*"packages"\s*:\s*)?\[([^\]]*)\]', "lerna.json": r'"packages"\s*:\s*\[([^\]]*)\]', "Cargo.toml": r"(?s)\[workspace\].*?members\s*=\s*\[([^\]]*)\]"}
    ord_ = F.coalesce(*[F.when(F.col("path") == k, F.lit(i)) for i, k in enumerate(kinds)])
    found = F.coalesce(*[F.when(F.col("path") == k, F.regexp_extract_all("content", F.lit(p), F.lit(1))) for k, p in kinds.items()])
    x = files.withColumn("ord", ord_).where(F.col("ord").isNotNull()).withColumn("found", found).where(F.size("found") > 0)
    first = x.agg(F.min_by(F.struct("path", "found"), "ord").alias("f"))
    each = first.where(F.col("f").isNotNull()).select(F.col("f.path").alias("kind"), F.explode("f.found").alias("part"))
    return each.select("kind", F.explode(F.split("part", ",")).alias("p")).select("kind", F.regexp_replace(F.btrim("p", F.lit(" \t\r\n\"'")), r"^\./", "").alias("pattern")).where("pattern <> ''").distinct()
