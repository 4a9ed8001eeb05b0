"""What the operators ask of the cluster: shared intermediate tables and small DataFrame helpers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one of our own, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: its result is complete, nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, *, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them again. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lodestrata_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._lodestrata_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle at every size, for sides that grow with the data."""
    return left.join(right.hint("merge"), on, how)


def looked_up(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle at every size that does not sort the left side's rows, for long ones; right has short rows, one a key."""
    return left.join(right.hint("shuffle_hash"), on, how)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for columns of any names, dots among them; run sees the names of df."""
    names = df.columns

    def renamed(batches):
        import pyarrow as pa

        return run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(renamed, schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def key_of(column: str | Column) -> Column:
    """A string key that keeps null apart from every value."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))
