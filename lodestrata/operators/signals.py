"""The shared path of all detectors: validate, deduplicate, cap, boost, filter."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import clean_path, priority, signal_id

_TEXTS = T.ArrayType(T.StringType())
SCHEMA = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("source", "kind", "file_path")],
        T.StructField("line", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("title", "description", "author")],
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", _TEXTS),
        T.StructField("closed_at", T.TimestampType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("blocks", _TEXTS),
        T.StructField("depends_on", _TEXTS),
        T.StructField("workspace", T.StringType()),
    ]
)
#: Kinds whose presence on a file raises its other signals, and by how much.
BOOSTS = {"churn": 0.05, "vulnerable-dependency": 0.10, "low-lottery-risk": 0.05}


def with_id(signals: DataFrame, into: str = "signal_id") -> DataFrame:
    return signals.withColumn(into, signal_id("source", "kind", "file_path", "line", "title"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rejects(signals: DataFrame) -> DataFrame:
    """Adds reasons, the rules that a signal breaks, as one string."""
    path = F.coalesce("file_path", F.lit(""))
    rules = {
        "title": F.trim(F.coalesce("title", F.lit(""))) == "",
        "source": F.trim(F.coalesce("source", F.lit(""))) == "",
        "absolute": path.startswith("/"),
        "traversal": ~path.startswith("/") & clean_path(path).startswith(".."),
        "confidence": F.coalesce(~F.col("confidence").between(0.0, 1.0), F.lit(True)),
    }
    return signals.withColumn("reasons", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in rules.items()]))


def valid(signals: DataFrame) -> DataFrame:
    return rejects(signals).where(F.col("reasons") == "").drop("reasons")


def deduplicated(signals: DataFrame, order: list[str], key: str = "signal_id") -> DataFrame:
    """Of equal ids the first row by order, with the greatest confidence of all; one partially aggregated group-by."""
    rest = [c for c in signals.columns if c not in (key, "confidence")]
    row = signals.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), F.max("confidence").alias("confidence"))
    return row.select(key, "r.*", "confidence")


def capped(signals: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The most important rows, by priority, then confidence, then order."""
    p = priority(F.col("confidence"), F.col("priority")) if "priority" in signals.columns else priority(F.col("confidence"))
    return signals.orderBy(p, F.col("confidence").desc(), *order).limit(most)


def boosted(signals: DataFrame, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """Raises signals that share a file with signals of other, weighty kinds; at most to 1.

    What is on a file is aggregated first and joined back, so a file with very many
    signals is not gathered. Signals without a file are left alone.
    """
    path = F.coalesce("file_path", F.lit(""))
    heavy = signals.where(F.col("kind").isin(*boosts) & (path != "")).groupBy(F.col("file_path").alias("__f")).agg(*[F.max(F.col("kind") == k).alias(f"__{i}") for i, k in enumerate(boosts)])
    add = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.col(f"__{i}"), F.lit(False)) & (F.col("kind") != k), v).otherwise(0.0) for i, (k, v) in enumerate(boosts.items())])
    x = signals.join(heavy, F.col("file_path") == F.col("__f"), "left")
    return x.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + add)).select(*signals.columns)


def at_least(signals: DataFrame, confidence: float) -> DataFrame:
    return signals.where(F.col("confidence") >= confidence)


def of_kinds(signals: DataFrame, kinds: str) -> DataFrame:
    """kinds: a list with commas; blanks and case don't matter."""
    return signals.where(F.col("kind").isin(*[k.strip().lower() for k in kinds.split(",") if k.strip()]))


def in_workspace(signals: DataFrame, name: str, prefix: str) -> DataFrame:
    return signals.withColumn("workspace", F.lit(name)).withColumn("file_path", F.when(F.coalesce("file_path", F.lit("")) == "", F.col("file_path")).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.col("file_path"))))


def overridden(signals: DataFrame, rules: list[tuple[str, int]]) -> DataFrame:
    """rules: (glob, priority); the first that matches the path wins."""
    from ..sources.globs import matches

    chain = F.lit(None).cast("int")
    for glob, p in reversed(rules):
        chain = F.when(matches(F.col("file_path"), glob), p).otherwise(chain)
    return signals.withColumn("priority", F.coalesce(chain, F.col("priority")))


def kind_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
