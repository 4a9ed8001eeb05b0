"""Exact verification of candidate buckets, and distributed union-find over the links.

Candidates come as rows (sig, id): ids with a signature in common may be similar.
Every bucket is first compared with its smallest id, as equi-joins of single pairs.
Where union-find over those links leaves the other members of a bucket in one
component, nothing is left to learn from it. All other buckets are gathered into
families, the components of buckets with a member in common, so that ids which meet in
many buckets are compared once; a bucket of a family of more than ``FAMILY`` ids is
taken alone instead. Their members are compared in blocks of bounded size, each pair of
blocks on its own, which gives a spanning set of links. No list of all pairs
is made, and no link that joins two components is missed.

A signature's smallest id, number of ids and hashes of them come from a window where it
is not hot. Hot ones, of more than about one in ``HEAVY`` rows, are found beforehand in
the rows of one in ``SHARE`` ids; they are fewer than ``HEAVY`` and broadcast to their
rows, and partial aggregates make them a row a task. What is found hot moves work only,
no result depends on it. Joins of sides that grow with the data are shuffles at every
size. Tables that nothing reads any more are deleted at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import discard, met, partitions, written

#: Members of a bucket that one task of the block comparison takes from each side.
BLOCK_ROWS = 1024
#: Ids of a family that is compared as a whole.
FAMILY = 4096
#: Rows of a block that are compared pair by pair.
PAIRWISE = 16
#: Links that one task's union-find takes.
ONE_TASK = 1 << 19


#: Signatures of a larger share of all rows than one in so many are hot; they are looked for in the rows of one in SHARE ids.
HEAVY, SHARE = 2048, 64


def met_signatures(rows: DataFrame, some: DataFrame | None = None, **more: Column) -> DataFrame:
    """rows(sig, id, ...): those whose signature has two ids at least, with n, leader (the smallest id) and more aggregates. some: the rows of one in SHARE ids, where they are at hand."""
    if some is None:
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SHARE)) == 0)
    seen = written(some.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = written(seen.where(F.col("n") > max(16.0, total / HEAVY)).select("sig"))
    discard(seen)
    every = {"n": F.count(F.lit(1)), "leader": F.min("id"), "last": F.max("id"), **more}
    w = Window.partitionBy("sig")
    met = lambda df: df.where("leader < last").drop("last")
    if hot.isEmpty():
        discard(hot)
        return met(rows.select("*", *[c.over(w).alias(n) for n, c in every.items()]))
    hot = F.broadcast(hot)  # fewer than HEAVY rows
    cold = rows.join(hot, "sig", "left_anti").select("*", *[c.over(w).alias(n) for n, c in every.items()])
    groups = rows.join(hot, "sig", "left_semi").groupBy("sig").agg(*[c.alias(n) for n, c in every.items()])
    return met(cold.unionByName(rows.join(F.broadcast(groups), "sig")))


def _joined(batches):
    """Union-find over all links: each id but the smallest of its component, and that one."""
    import pyarrow as pa

    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not links:
        return
    ids, at = np.unique(np.concatenate([x for pair in zip(*links, strict=True) for x in pair]), return_inverse=True)
    u, v = np.split(at, 2)
    parent = np.arange(len(ids))
    while len(u):
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        u, v = parent[u], parent[v]
        u, v = u[u != v], v[u != v]
    moved = parent != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[parent[moved]])], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """links(a, b long): (id, component) for each id with a link; component is the smallest id reachable.

    Up to ``ONE_TASK`` links are joined by one task. More alternate large-star and small-star
    steps until nothing changes; a hub's links are joined with its minimum, which adaptive
    execution splits, never gathered.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= ONE_TASK:
        few = written(edges.coalesce(1).mapInArrow(_joined, "id long, component long"))
        discard(edges)
        return few
    known = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        before, edges = edges, written(small)
        discard(before)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == known:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        known = state


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Number of elements that both have."""
    both = np.concatenate((x, y))
    both.sort()
    return np.count_nonzero(both[1:] == both[:-1])


def verified(pairs: DataFrame, elements: Callable, percent: int) -> DataFrame:
    """pairs(a, b, x, y): those whose items x and y have a Jaccard similarity of so many percent at least, as (a, b)."""

    def once(ids, items):  # equal ids have equal items
        _, first, which = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        own = elements(items.take(first))
        return [own[k] for k in which.tolist()]

    def run(batches):
        import pyarrow as pa

        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                left, right = once(b.column(0), b.column(2)), once(b.column(1), b.column(3))
                # no larger intersection than the smaller set
                inter = np.array([shared(x, y) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0 for x, y in zip(left, right, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - inter
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(100 * inter >= percent * union))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(rows: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """rows: (id, component, sorted distinct elements). Links between components, as many as join them."""
    n = len(rows)
    if n < 2 or all(r[1] == rows[0][1] for r in rows):
        return []
    parent = {r[1]: r[1] for r in rows}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if n <= PAIRWISE:
        out = []
        for k, (y, d, right) in enumerate(rows):
            for x, c, left in rows[:k]:
                p, q, both = root(c), root(d), len(left) + len(right)
                # no larger intersection than the smaller set
                if p != q and (100 + percent) * min(len(left), len(right)) >= percent * both and (100 + percent) * shared(left, right) >= percent * both:
                    parent[p] = q
                    out.append((x, y))
        return out
    comp = np.array([r[1] for r in rows])
    sizes = np.array([len(r[2]) for r in rows], np.int64)
    items = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(n), sizes)
    _, at, times = np.unique(items, return_inverse=True, return_counts=True)
    several = times[at] > 1  # an element of one row alone is in no intersection
    owner, at = owner[several], at[several]
    inter = np.zeros((n, n), np.float32)
    if len(at):
        _, at = np.unique(at, return_inverse=True)
        width = 2048
        for lo in range(0, int(at.max()) + 1, width):
            part = (at >= lo) & (at < lo + width)
            m = np.zeros((n, width), np.float32)
            m[owner[part], at[part] - lo] = 1
            inter += m @ m.T
    # 100 inter >= percent (a + b - inter); sums of counts are exact as doubles
    ok = (100 + percent) * inter.astype(float) >= percent * (sizes[:, None] + sizes[None, :]).astype(float)
    i, j = np.nonzero(np.triu(ok & (comp[:, None] != comp[None, :]), 1))
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(int(comp[x])), root(int(comp[y]))
        if p != q:
            parent[p] = q
            out.append((rows[x][0], rows[y][0]))
    return out


def bucket_links(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], elements: Callable, percent: int, extra: DataFrame | None = None, some: DataFrame | None = None) -> DataFrame:
    """buckets(sig, id long) -> links(a, b) whose components are those of all similar pairs within buckets.

    Without a column tag rows may come twice. With it, the signatures of one id and tag are a group of which similar ids
    share more than tag div 2; that many of the group's most frequent ones are left out.
    fetch: from ids(id) to (id, items); elements: from an Arrow column of items to arrays of
    distinct elements. extra: links known beforehand. some: the buckets' rows of one in SHARE ids.
    """
    if "tag" in buckets.columns:
        common = met_signatures(buckets, some)
        order = Window.partitionBy("id", "tag").orderBy(F.col("n").desc(), "sig")
        some = None
        buckets = written(common.withColumn("nth", F.row_number().over(order)).where("nth > tag div 2").select("sig", "id"))
    # buckets of the same ids are one: hashes of the ids stand for the bucket from here on
    grouped = met_signatures(buckets, some, h1=F.bit_xor(F.xxhash64("id")), h2=F.try_sum(F.shiftright(F.xxhash64("id", F.lit(7)), 24)))
    multi = written(grouped.select(F.xxhash64("n", "h1", "h2").alias("sig"), "id", "leader").distinct())
    star = written(multi.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    sets = written(fetch(star.select(F.explode(F.array("a", "b")).alias("id")).distinct()), codec="lz4")
    left, right = (sets.select(F.col("id").alias(c), F.col("items").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    known = verified(met(met(star, left, "a"), right, "b"), elements, percent)
    if extra is not None:
        known = known.union(extra.select("a", "b"))
    known = written(known)
    comp = components(known)

    placed = multi.where("id <> leader").join(comp, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = written(met(placed, open_.select("sig"), "sig").select("sig", "id", "component"))
    discard(multi, star)
    heads = rest.groupBy("sig").agg(F.min("id").alias("a"))
    family = components(rest.join(heads, "sig").select("a", F.col("id").alias("b")).distinct()).withColumnRenamed("component", "family")
    large = family.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= FAMILY)
    family = written(family.join(large, "family").select("id", "family", "large"))
    # the head of a family is not among the ids that have links
    every = family.union(family.groupBy(F.col("family").alias("id")).agg(F.min("family").alias("family"), F.max("large").alias("large")))
    grouped = rest.join(every, "id").withColumn("g", F.when(F.col("large"), F.struct(F.lit(1).alias("alone"), F.col("sig").alias("key"))).otherwise(F.struct(F.lit(0).alias("alone"), F.col("family").alias("key"))))
    grouped = written(grouped.select("g.alone", "g.key", "id", "component").distinct())
    parts = grouped.groupBy("alone", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    rows = grouped.join(parts, ["alone", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = met(rows.select("alone", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component"), sets, "id")

    keys = ["alone", "key", "i", "j"]

    def compare(batches):
        import pyarrow as pa

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        now, data = None, []
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b, found = big.slice(lo, 1000), []
                names = zip(*[b.column(k).to_pylist() for k in range(4)], strict=True)
                for name, x, c, e in zip(names, b.column(4).to_pylist(), b.column(5).to_pylist(), elements(b.column(6)), strict=True):
                    if name != now:
                        found += block_links(data, percent)
                        now, data = name, []
                    data.append((x, c, e))
                yield table(found)
        yield table(block_links(data, percent))

    # few bytes, much work: a number of partitions is kept as it is
    rows = rows.select(*keys, "id", "component", "items").repartition(partitions(buckets.sparkSession), *keys).sortWithinPartitions(*keys)
    more = written(rows.mapInArrow(compare, "a long, b long"))
    discard(rest, family, grouped, sets)
    return known.union(more)
