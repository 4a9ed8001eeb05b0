"""Version history from the text that the version-control tool prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed_to(path: Column) -> Column:
    """Where a rename ends: 'a/{b => c}/d' is a/c/d, 'a => b' is b."""
    inner = F.regexp_replace(path, r"\{[^{}]*? => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(inner, r"^.* => ", ""), r"//+", "/")


def numstat(text: DataFrame) -> DataFrame:
    """text(repo, line, value): lines 'sha|author|time' each followed by 'added<TAB>deleted<TAB>path'. Gives a row for each touched file."""
    head = r"^([0-9a-f]{7,40})\|(.*)\|([^|]+)$"
    w = Window.partitionBy("repo").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("value").rlike(head), F.struct(F.regexp_extract("value", head, 1).alias("sha"), F.regexp_extract("value", head, 2).alias("author"), F.to_timestamp(F.regexp_extract("value", head, 3)).alias("ts")))
    x = text.withColumn("commit", F.last(here, ignorenulls=True).over(w))
    row = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    count = lambda k: F.regexp_extract("value", row, k).try_cast("long")  # noqa: E731  binary files have no counts
    return x.where(F.col("value").rlike(row) & F.col("commit").isNotNull()).select("repo", "commit.*", count(1).alias("added"), count(2).alias("deleted"), renamed_to(F.regexp_extract("value", row, 3)).alias("path"))


def blame(text: DataFrame) -> DataFrame:
    """text(path, line, value): porcelain output. Author and time are printed once for each commit and carried to its other lines."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = text.withColumn("h", F.last(F.when(F.col("value").rlike(head), F.struct(F.regexp_extract("value", head, 1).alias("sha"), F.regexp_extract("value", head, 2).cast("int").alias("n"))), ignorenulls=True).over(w))
    who = x.where(F.col("h").isNotNull()).groupBy("path", "h.sha").agg(F.max(F.regexp_extract("value", r"^author (.*)$", 1)).alias("author"), F.timestamp_seconds(F.max(F.regexp_extract("value", r"^author-time (\d+)$", 1).try_cast("long"))).alias("author_ts"))
    own = x.where(F.col("value").startswith("\t")).select("path", F.col("h.sha").alias("sha"), F.col("h.n").alias("line"))
    return own.join(who, ["path", "sha"]).select("path", "line", "author", "author_ts")


def last_touch(commits: DataFrame, paths: DataFrame) -> DataFrame:
    """commits(path, ts), paths(prefix): when a file or anything below a directory was last touched; prefixes are joined by equality."""
    from ..functions.expressions import ancestors

    up = commits.select("ts", F.explode(ancestors(F.col("path"), proper=False)).alias("prefix"))
    return paths.join(up.groupBy("prefix").agg(F.max("ts").alias("last")), "prefix", "left")


def release_tags(tags: DataFrame, top: int = 10) -> DataFrame:
    """tags(name, hash8, ts): the newest version tags."""
    return tags.where(F.col("name").rlike(r"^v?\d+\.\d+\.\d+")).orderBy(F.desc("ts"), "name").limit(top)
