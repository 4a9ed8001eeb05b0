"""Graphs as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pruned(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges between nodes that have both, edges in and edges out: others are on no cycle."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    for _ in range(rounds):
        e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    return e


def closure(edges: DataFrame) -> DataFrame:
    """Pairs joined by a path, by squaring until nothing is added; as many steps as the logarithm of the longest path."""
    from ..plans.tables import written

    now = written(pruned(edges))
    n = now.count()
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        now = written(now.union(step).distinct())
        m = now.count()
        if m == n:
            return now
        n = m


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: cycle (its smallest node), size, members, confidence."""
    r = closure(edges)
    both = r.join(r.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    lead = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("cycle")).select(F.col("src").alias("node"), "cycle")
    g = lead.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_set("node")), lambda x: x.cast("string")), ",").alias("members")).where("size >= 2")
    return g.withColumn("confidence", F.when(F.col("size") == 2, 0.80).when(F.col("size") == 3, 0.75).otherwise(0.70))


def components(links: DataFrame) -> DataFrame:
    """links(a, b): (id, component), the smallest id that can be reached; labels spread and jump until they rest."""
    from ..plans.tables import written

    changed = F.sum(F.xxhash64("id", "component").cast("decimal(20,0)"))
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        spread = label.join(near, "id").select("id", F.least("component", "c").alias("component"))
        jump = spread.join(spread.select(F.col("id").alias("component"), F.col("component").alias("c2")), "component").select("id", F.least("component", "c2").alias("component"))
        # labels only fall, so a sum of hashes over the rows tells whether any did
        before, label = label, written(jump)
        if before.agg(changed).first() == label.agg(changed).first():
            return label


def acyclic(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Drops the least confident edge, the first of equals, until no cycle is left; for the few edges that a model infers."""
    kept = list(edges)
    while kept:
        degree, out = {}, {}
        for a, b, _ in kept:
            degree[b] = degree.get(b, 0) + 1
            degree.setdefault(a, 0)
            out.setdefault(a, []).append(b)
        ready, seen = [n for n, d in degree.items() if not d], 0
        while ready:
            n = ready.pop()
            seen += 1
            for m in out.get(n, ()):
                degree[m] -= 1
                if not degree[m]:
                    ready.append(m)
        if seen == len(degree):
            break
        kept.remove(min(kept, key=lambda e: e[2]))
    return kept
