"""Extensions for streams of signals: what is new, and weekly activity. The batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_only(stream: DataFrame, key: str = "signal_id", at: str = "timestamp", late: str = "1 day") -> DataFrame:
    """The first signal of each id within the watermark; state is dropped once it has passed."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def weekly(stream: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Touches and their week, closed when the watermark has passed it."""
    # weeks begin on Monday: the epoch was a Thursday
    return stream.withWatermark(at, late).groupBy(F.window(at, "7 days", "7 days", "4 days").alias("week")).agg(F.count(F.lit(1)).alias("commits")).select(F.col("week.start").alias("week"), "commits")


def write_new(stream: DataFrame, known: str, out: str, checkpoint: str, key: str = "signal_id"):
    """Appends signals that the table known doesn't hold, batch by batch; an anti-join, so a batch that is repeated adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        seen = spark.read.parquet(known).select(key)
        new = df.dropDuplicates([key]).join(seen, key, "left_anti")
        new.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
