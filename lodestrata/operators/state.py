"""What changes between runs: snapshots, differences, history, baselines, backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import normal_title


def new_signals(now: DataFrame, before: DataFrame, key: str = "signal_id") -> DataFrame:
    return now.join(before.select(key), key, "left_anti")


def differences(now: DataFrame, before: DataFrame, key: str = "signal_id") -> DataFrame:
    """Rows of either side alone, with change added or removed."""
    a = now.join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    r = before.join(now.select(key), key, "left_anti").withColumn("change", F.lit("removed"))
    return a.unionByName(r)


def moved(changes: DataFrame) -> DataFrame:
    """Removed and added rows of the same kind and title, matched one to one in order, if the place differs."""
    w = Window.partitionBy("kind", "title").orderBy("file_path", "line", "source")
    side = lambda c: changes.where(F.col("change") == c).withColumn("rn", F.row_number().over(w))
    a = side("added").select("kind", "title", "rn", F.col("file_path").alias("to_path"), F.col("line").alias("to_line"))
    r = side("removed").select("kind", "title", "rn", F.col("file_path").alias("from_path"), F.col("line").alias("from_line"))
    return r.join(a, ["kind", "title", "rn"]).where("from_path <> to_path or from_line <> to_line").drop("rn")


def resolved(removed: DataFrame, files: DataFrame) -> DataFrame:
    """Removed markers as closed signals; says so where the file is gone."""
    here = files.select(F.col("path").alias("file_path")).distinct().withColumn("here", F.lit(True))
    x = removed.where(F.col("source") == "todos").join(here, "file_path", "left")
    return x.select("source", "kind", "file_path", "line", "title", F.when(F.col("here").isNull(), "resolved: file deleted").otherwise("resolved").alias("description"), F.lit(0.3).alias("confidence"))


def unsuppressed(signals: DataFrame, baseline: DataFrame, now: str, key: str = "signal_id") -> DataFrame:
    """Without those that an unexpired entry of baseline(signal_id, reason, suppressed_at, expires_at) names; the last entry of an id counts."""
    return signals.join(active(baseline, now).select(key), key, "left_anti")


def active(baseline: DataFrame, now: str) -> DataFrame:
    last = baseline.groupBy("signal_id").agg(F.max_by(F.struct("reason", "expires_at"), "suppressed_at").alias("e")).select("signal_id", "e.*")
    return last.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp")))


def baseline_status(baseline: DataFrame, now: str) -> DataFrame:
    gone = F.col("expires_at") < F.lit(now).cast("timestamp")
    return baseline.groupBy("reason").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(gone, F.lit(False))).alias("expired"), F.min("suppressed_at").alias("oldest"), F.max("suppressed_at").alias("newest"))


def listed(baseline: DataFrame, now: str, reason: str | None = None, *, expired_only: bool = False) -> DataFrame:
    """The suppressions of one reason, or of any; with expired_only those that ran out."""
    x = baseline if reason is None else baseline.where(F.col("reason") == reason)
    return x.where(F.col("expires_at") < F.lit(now).cast("timestamp")) if expired_only else x


def beyond_backlog(signals: DataFrame, backlog: DataFrame) -> DataFrame:
    """Not in backlog(id, title) by id, by the hash in ids that begin with str-, nor by title."""
    ids = backlog.select(F.regexp_replace("id", "^str-", "").alias("signal_id")).distinct()
    titles = backlog.select(normal_title(F.col("title")).alias("t")).distinct()
    x = signals.join(ids, "signal_id", "left_anti").withColumn("t", normal_title(F.col("title")))
    return x.join(titles, "t", "left_anti").drop("t")


def trend(old: Column, new: Column) -> Column:
    """improving, stable or degrading, with a dead band of a tenth; the base is the old value, or the new one if that is 0."""
    base = F.when(old == 0, new).otherwise(old).cast("double")
    delta = (new - old).cast("double")
    return F.when((base == 0) | (F.abs(delta) / base < 0.1), "stable").when(delta > 0, "degrading").otherwise("improving")


def trends(history: DataFrame, last: int = 5) -> DataFrame:
    """history(at, key, n): each key's first and last value within the last entries."""
    entries = history.select("at").distinct()
    recent = entries.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("at")))).where(F.col("rn") <= last)
    ends = recent.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("points"))
    x = history.join(F.broadcast(ends)).where((F.col("at") == F.col("first")) | (F.col("at") == F.col("last")))
    g = x.where("points >= 2").groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("at") == F.col("first"), F.col("n"))), F.lit(0)).alias("old"), F.coalesce(F.sum(F.when(F.col("at") == F.col("last"), F.col("n"))), F.lit(0)).alias("new"))
    return g.withColumn("delta", F.col("new") - F.col("old")).withColumn("direction", trend(F.col("old"), F.col("new")))


def fingerprints(now: DataFrame, before: DataFrame, key: str = "signal_id") -> DataFrame:
    """new, unchanged or absent for each fingerprint of either run."""
    a, b = now.select(key).distinct().withColumn("a", F.lit(1)), before.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "absent").otherwise("unchanged").alias("state"))


def with_dependencies(signals: DataFrame, dependencies: DataFrame) -> DataFrame:
    """signals(signal_id, …), dependencies(from_id, to_id, type): fills blocks and depends_on from edges of type blocks between known signals."""
    ids = signals.select("signal_id").distinct()
    e = dependencies.where("type = 'blocks' and from_id <> to_id").select("from_id", "to_id").distinct()
    e = e.join(ids.select(F.col("signal_id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("signal_id").alias("to_id")), "to_id", "left_semi")
    out = e.groupBy(F.col("from_id").alias("signal_id")).agg(F.array_sort(F.collect_set("to_id")).alias("blocks"))
    into = e.groupBy(F.col("to_id").alias("signal_id")).agg(F.array_sort(F.collect_set("from_id")).alias("depends_on"))
    rest = [c for c in signals.columns if c not in ("blocks", "depends_on")]
    return signals.select(*rest).join(out, "signal_id", "left").join(into, "signal_id", "left")


def delta_text(changes: DataFrame, moves: DataFrame) -> list[str]:
    """changes(signal_id, file_path, line, title, change), moves(kind, title, from_path, …): the lines of a report, added, removed and moved. For reading: the driver holds it."""
    mark = {"added": "+", "removed": "-"}
    out = [f"{mark[r['change']]} {r['title']} ({r['file_path']}:{r['line']})" for r in changes.orderBy("change", "file_path", "line").toLocalIterator()]
    return out + [f"~ {r['title']} ({r['from_path']}:{r['from_line']} -> {r['to_path']}:{r['to_line']})" for r in moves.orderBy("title", "from_path", "from_line").toLocalIterator()]


def write_state(signals: DataFrame, path: str, version: str) -> None:
    """A new version of the state beside the old ones; readers take the last."""
    signals.write.parquet(f"{path.rstrip('/')}/version={version}")


def read_state(spark, path: str, version: str | None = None) -> DataFrame | None:
    """The state of a version, else of the last; None where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("version="))
    found = [n for n in found if version is None or n == f"version={version}"]
    return spark.read.parquet(f"{path.rstrip('/')}/{found[-1]}") if found else None


def read_backlog(spark, path: str) -> DataFrame:
    """A backlog of JSON lines; a bad line is an error."""
    return spark.read.schema("id string, title string, description string, status string, priority int, issue_type string, labels array<string>").option("mode", "FAILFAST").json(path)


def read_sarif(spark, path: str) -> DataFrame:
    """rule, level, text, file_path, line, signal_id of the results of a SARIF document."""
    location = "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    result = f"struct<ruleId:string,level:string,message:struct<text:string>,locations:{location},partialFingerprints:map<string,string>>"
    x = spark.read.schema(f"runs array<struct<results:array<{result}>>>").option("multiLine", True).json(path)
    r = x.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    return r.select(F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.message.text").alias("text"), at["artifactLocation"]["uri"].alias("file_path"), at["region"]["startLine"].alias("line"), F.get(F.map_values("r.partialFingerprints"), F.lit(0)).alias("signal_id"))
