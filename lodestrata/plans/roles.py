"""Maps the driver's tables to the roles that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clocks are parameters, never the machine's; these suit the tables.
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: documents as files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))


def lines(files_: DataFrame) -> DataFrame:
    """path, line (from 1), text; the empty line after a last line feed is none."""
    x = files_.select("path", F.posexplode(F.split(F.regexp_replace("content", r"\n$", ""), "\n")).alias("pos", "text"))
    return x.select("path", (F.col("pos") + 1).cast("int").alias("line"), "text")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, author, ts: events as file touches."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat_ws("/", "event_type", (F.col("event_id") % 50).cast("string")).alias("path"), F.col("user_id").cast("string").alias("author"), "ts")


def ownership_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dir, author, ts: line items as blamed lines, shipping dates as commits."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").cast("string").alias("dir"), F.col("l_suppkey").cast("string").alias("author"), F.col("l_shipdate").alias("ts"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, last: a customer's last order."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.max("o_orderdate").alias("last"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1).alias("path"), "html")


def nation_edges(spark: SparkSession, sf_dir: str, least: int = 200) -> DataFrame:
    """src, dst: supplier's and customer's nation, joined by at least so many line items per 60 000."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    n = x.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = li.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total)).where(F.col("n") * 60000 >= least * F.col("total")).select("src", "dst")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a Python file for each part, which imports two others by its key and defines a function and a class."""
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("app.m"), (x % 7).cast("string"), F.lit(".f"), x.cast("string"))
    call = F.when(k % 3 == 0, F.concat(F.lit("run_"), (k + 1).cast("string"))).otherwise("helper")
    content = F.concat(F.lit("import "), name(k + 1), F.lit("\nfrom "), name(k * 3), F.lit(".thing import x\nimport os\ndef run_"), k.cast("string"), F.lit("(a):\n    if a and b:\n        return 1\n    for i in a:\n        pass\n    return "), call, F.lit("(a)\n\nclass Kind"), k.cast("string"), F.lit(":\n    pass\n"))
    # a part is a few bytes and its file hundreds: keys are dealt out before files are made of them, in a number of parts that isn't merged again
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    keys = table(spark, sf_dir, "part").select("p_partkey").repartition(many, "p_partkey")
    return keys.select(k.alias("part"), F.concat(F.replace(name(k), F.lit("."), F.lit("/")), F.lit(".py")).alias("path"), content.alias("content"))


def touched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, author, ts: events as touches of documents."""
    k = F.col("event_id") % 50
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("src"), (k % 20).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md")).alias("path"), F.col("user_id").cast("string").alias("author"), "ts")
