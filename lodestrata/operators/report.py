"""Report sections: queries over signals and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import priority, report_module


def module_summary(signals: DataFrame, top: int | None = 20) -> DataFrame:
    """module, total, p1 to p4, health, top_kinds."""
    x = signals.withColumn("module", report_module(F.col("file_path"))).withColumn("p", priority(F.col("confidence")))
    g = x.groupBy("module").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("p") == k).alias(f"p{k}") for k in (1, 2, 3, 4)])
    g = g.withColumn("health", 4 * F.col("p1") + 3 * F.col("p2") + 2 * F.col("p3") + F.col("p4"))
    k = x.groupBy("module", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("rn", F.row_number().over(Window.partitionBy("module").orderBy(F.desc("n"), "kind"))).where("rn <= 3")
    kinds = k.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "kind"))), lambda s: s["kind"]), ",").alias("top_kinds"))
    out = g.join(kinds, "module")
    return out.orderBy(F.desc("health"), "module").limit(top) if top else out


def hotspots(complexity: DataFrame, churn: DataFrame, least_score: float = 6.0, least_churn: int = 5, top: int = 15) -> DataFrame:
    x = complexity.join(churn.select("path", "changes"), "path").where((F.col("score") >= least_score) & (F.col("changes") >= least_churn))
    return x.select("path", "name", "score", "changes", F.round(F.log2(F.col("changes") + 1) * F.col("score"), 6).alias("heat")).orderBy(F.desc("heat"), "path", "name").limit(top)


def churn_section(churn: DataFrame, top: int = 20) -> DataFrame:
    level = F.when(F.col("changes") >= 20, "unstable").when(F.col("changes") >= 10, "moderate").otherwise("stable")
    return churn.select("path", "changes", "authors", level.alias("stability")).orderBy(F.desc("changes"), "path").limit(top)


# Age bands in days.
AGES = (("< 1 week", 0, 7), ("1-4 weeks", 7, 28), ("1-3 months", 28, 90), ("3-12 months", 90, 365), ("> 1 year", 365, 10**6))


def age_buckets(rows: DataFrame, now: str) -> DataFrame:
    """rows(ts): all five bands, empty ones too, and how many have no time."""
    spark = rows.sparkSession
    days = F.when(F.col("ts").isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0))
    band = F.lit("unknown")
    for name, lo, _ in AGES:
        band = F.when(F.col("days") >= lo, name).otherwise(band)
    got = rows.withColumn("days", days).groupBy(F.when(F.col("days").isNull(), "unknown").otherwise(band).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(i, n) for i, n in enumerate([a[0] for a in AGES] + ["unknown"])], "ord int, bucket string")
    return F.broadcast(every).join(got, "bucket", "left").select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def recommendations(metrics: DataFrame) -> DataFrame:
    """metrics(rule, value): messages of the rules whose value is above 0, most severe first."""
    # The severity of each rule.
    severity = {"lottery-risk": 1, "hotspots": 1, "churn": 2, "coverage": 2, "complexity": 2, "todos": 3}
    level = F.coalesce(*[F.when(F.col("rule") == k, v) for k, v in severity.items()], F.lit(3))
    return metrics.where("value > 0").select(level.alias("severity"), "rule", "value", F.concat_ws(" ", F.lit("Look into"), F.col("value").cast("string"), F.col("rule")).alias("message"))


def weekly(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"))


def top_authors(commits: DataFrame, top: int = 10) -> DataFrame:
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "author").limit(top)


def conventions(backlog: DataFrame) -> DataFrame:
    """The prefix most ids have, the first of equals."""
    g = backlog.select(F.regexp_extract("id", r"^([A-Za-z]+)-", 1).alias("prefix")).where("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "prefix").limit(1)


def priority_histogram(signals: DataFrame) -> DataFrame:
    return signals.groupBy("source", priority(F.col("confidence")).cast("long").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def hygiene_section(signals: DataFrame) -> DataFrame:
    """issue, n: the four kinds of untidiness, also those that do not occur, and their total."""
    names = {"large-binary": "Large binaries", "merge-conflict-marker": "Merge conflict markers", "committed-secret": "Committed secrets", "mixed-line-endings": "Mixed line endings"}
    one = signals.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in names.items()], F.count_if(F.col("kind").isin(*names)).alias("Total"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(f"`{n}`").alias("n")) for n in (*names.values(), "Total")])).alias("x")).select("x.issue", "x.n")


def complexity_section(functions: DataFrame, most: int = 20) -> DataFrame:
    """The functions of the greatest score."""
    return functions.orderBy(F.desc("score"), "path", "start").limit(most)


def debt_by_kind(signals: DataFrame, examples: int = 5) -> DataFrame:
    """kind, n, examples: how many signals of each kind and the first few, as title and place."""
    place = F.concat("file_path", F.when(F.coalesce("line", F.lit(0)) > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    w = Window.partitionBy("kind").orderBy("file_path", "line", "title")
    x = signals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples).withColumn("example", F.concat("title", F.lit(" ("), place, F.lit(")")))
    few = x.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("e"))
    n = signals.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return n.join(few, "kind").select("kind", "n", F.array_join(F.transform("e", lambda e: e["example"]), "; ").alias("examples"))


def modules_affected(changed: DataFrame) -> DataFrame:
    """changed(number, path): number, context: the modules that a change touches, with their numbers of files."""
    from ..functions.expressions import owner_module

    n = changed.groupBy("number", owner_module(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("n"))
    part = F.concat("module", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " file)").otherwise(" files)"))
    g = n.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("module", part.alias("part")))).alias("parts"))
    return g.select("number", F.concat(F.lit("Modules affected: "), F.array_join(F.transform("parts", lambda p: p["part"]), ", ")).alias("context"))


def priority_check(signals: DataFrame) -> DataFrame:
    """assigned, p1, distinct, warning: whether priorities look suspicious (more than half the first, or all the same)."""
    g = signals.agg(F.count("priority").alias("assigned"), F.count_if(F.col("priority") == 1).alias("p1"), F.countDistinct("priority").alias("distinct"))
    warning = F.when(F.col("assigned") == 0, "").otherwise(F.concat_ws(", ", F.when(2 * F.col("p1") > F.col("assigned"), "more than half P1"), F.when(F.col("distinct") == 1, "all the same")))
    return g.withColumn("warning", warning)


def merged_clusters(signals: DataFrame) -> DataFrame:
    """signals(cluster, confidence, tags): cluster, n, the greatest confidence, the union of the tags."""
    g = signals.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    return g


def owners_section(owners: DataFrame, most: int = 3) -> DataFrame:
    """owners(dir, author, share): dir and its first contributors with their shares in percent."""
    w = Window.partitionBy("dir").orderBy(F.desc("share"), "author")
    x = owners.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    label = F.concat("author", F.lit(" "), F.round(100 * F.col("share")).cast("int").cast("string"), F.lit("%"))
    g = x.groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("top"))
    return g.select("dir", F.array_join(F.transform("top", lambda t: t["label"]), ", ").alias("contributors"))


def hotspot_count(complexity: DataFrame, churn: DataFrame, least_score: float = 6.0, least_churn: int = 5) -> DataFrame:
    """n: complex functions in files that change often."""
    often = churn.where(F.col("changes") >= least_churn).select("path").distinct()
    return complexity.where(F.col("score") >= least_score).join(often, "path", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def tagged_weeks(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """commits(sha, ts), tags(name, sha, ts): week, commits, tagged (commits that bear a tag), tags of the week."""
    week = F.date_trunc("week", F.col("ts")).alias("week")
    bears = tags.select(F.substring("sha", 1, 8).alias("short")).distinct().withColumn("hit", F.lit(1))
    c = commits.select(week, F.substring("sha", 1, 8).alias("short")).join(bears, "short", "left").groupBy("week").agg(F.count(F.lit(1)).alias("commits"), F.count("hit").alias("tagged"))
    t = tags.select(week, "name").groupBy("week").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return c.join(t, "week", "left").select("week", "commits", "tagged", F.coalesce("tags", F.lit("")).alias("tags"))
