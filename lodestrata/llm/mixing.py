"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Each source's documents, in an order shuffled by a hash, form one stream of words that
is cut into blocks of ``block`` words. Slot i of the schedule is the point frac(i g),
g the golden ratio's fraction; the cumulative targets say which source's interval it
falls in. The slots of a source are ranked, and slot r takes the stream's block r; past
the stream's end it begins again. Slots beyond a source's target are dropped, those
it lacks come at the end, and its last block is cut, so a source gives its target
rounded to whole words.

The mix is that schedule: ``taken`` says for each document the first slot that takes of
it, and ``mixture`` gives the documents in the order of their first slots, so sources
are interleaved at every scale as the points are.

Nothing is ranked or summed in one place: positions in a stream are sums within ranges
of the hash, added to the sums of the ranges before; slots are ranked within runs of
``RUN`` slots in the same way; a hot source is as many ranges and runs as it needs.
Texts are shuffled once to meet their takes and once into the order of the slots.

Targets: sources by code point, null last, have the weights 3, 1, 2, repeating, of
``share`` times all words; no target exceeds ``repeat`` times its source's words, and
what is over goes to the others by weight.

Defined results: null texts have no words and are never taken; a null source is a
source of its own; rows that are equal in id, source and text are told apart by number;
without any words all targets are 0; empty tables give empty results. Columns may have
any names, they are left alone. A text that ``mixture`` takes in part has its words
joined by single blanks; one that is taken whole is unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import fresh_name, key_of, partitions, written

WEIGHTS = (3, 1, 2)
SHARE, REPEAT = 1.5, 2
BLOCK = 64
GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio); slots are split into two numbers so that products keep their precision.
GOLDEN_HIGH = 0.607787409740350972
RUN = 1 << 16
GRID = 1024
WORD = r"[^\x20\x09-\x0D]+"
FIRST = Window.unboundedPreceding


def sized(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """id, source, size, key of source, shuffle hash, text hash, number among equal rows."""
    whole = F.col(f"`{text}`")
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(whole, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(whole).alias("text_hash"))
    nth = F.row_number().over(Window.partitionBy("id", "source", "text_hash").orderBy("size"))
    # rows without an id are spread by their texts and numbers
    told = F.coalesce(F.col("id").cast("string"), F.concat_ws(":", F.lit("null"), F.col("text_hash").cast("string"), F.col("nth").cast("string")))
    return own.withColumn("nth", nth).withColumn("key", key_of("source")).withColumn("hash", F.md5(F.concat(F.lit("mix:"), told)))


def targets(rows: DataFrame) -> DataFrame:
    """One row a source: key, source_size, target, whole (the target in words), and its interval lo, hi of 0 to 1."""
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = ranked.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0.0)).withColumn("cap", REPEAT * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy((F.col("cap") / F.nullif("weight", F.lit(0.0))).asc_nulls_last(), "rank")
    total = F.sum("source_size").over(every) * SHARE
    left = (total - F.coalesce(F.sum("cap").over(order.rowsBetween(FIRST, -1)), F.lit(0.0))) / F.nullif(F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    level = caps.withColumn("level", left).withColumn("place", F.row_number().over(order)).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    stop = F.min(F.when(F.col("fits") & (F.col("weight") > 0), F.col("place"))).over(every)
    level = level.withColumn("stop", stop).withColumn("final", F.max(F.when(F.col("place") == F.col("stop"), F.col("level"))).over(every))
    target = F.when(F.col("weight") == 0, F.lit(0.0)).when(F.col("place") < F.col("stop"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    out = level.select("key", "rank", "source_size", target.alias("target")).withColumn("whole", F.floor(F.col("target") + 0.5).cast("long"))
    up = Window.orderBy("rank")
    all_words = F.nullif(F.sum("whole").over(every), F.lit(0)).cast("double")
    lo, hi = F.coalesce(F.sum("whole").over(up.rowsBetween(FIRST, -1)), F.lit(0)), F.sum("whole").over(up)
    return written(out.withColumn("lo", lo / all_words).withColumn("hi", hi / all_words))


def positions(rows: DataFrame) -> DataFrame:
    """Adds start: the words of the source's stream before the document."""
    n = rows.count()
    digits = 0
    while n > 20_000 * 16**digits:
        digits += 1
    ranged = rows.withColumn("range", F.substring("hash", 1, digits) if digits else F.lit(""))
    sums = ranged.groupBy("key", "range").agg(F.sum("size").alias("s"))
    before = sums.select("key", "range", F.coalesce(F.sum("s").over(Window.partitionBy("key").orderBy("range").rowsBetween(FIRST, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "range").orderBy("hash", "id", "text_hash", "nth").rowsBetween(FIRST, 0)
    return ranged.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(before, ["key", "range"]).withColumn("start", F.col("before") + F.col("inside")).drop("range", "inside", "before")


def golden_point(i: Column) -> Column:
    x = F.floor(i / 1048576) * F.lit(GOLDEN_HIGH) + (i % 1048576) * F.lit(GOLDEN)
    return x - F.floor(x)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a slot that is used: slot, key, nth (its rank in the source), first and last + 1 word of the stream."""
    spark = sources.sparkSession
    words = sources.agg(F.sum("whole")).first()[0] or 0
    n = -(-words // block)
    grid = sources.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))))
    points = spark.range(n).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * GRID))
    hit = points.join(grid.select("cell", "key", "lo", "hi"), "cell").where("lo <= u and u < hi").select("slot", "key", F.floor(F.col("slot") / RUN).alias("run"))
    runs = hit.groupBy("key", "run").agg(F.count(F.lit(1)).alias("c"))
    before = runs.select("key", "run", F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("run").rowsBetween(FIRST, -1)), F.lit(0)).alias("before"))
    ranked = hit.withColumn("in_run", F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")) - 1).join(before, ["key", "run"]).select("slot", "key", (F.col("before") + F.col("in_run")).alias("nth"))
    have = runs.groupBy("key").agg(F.sum("c").alias("have"))
    need = F.ceil(F.col("whole") / block)
    late = sources.join(have, "key", "left").select("key", "rank", need.alias("need"), F.coalesce("have", F.lit(0)).alias("have")).where("have < need")
    late = late.select((F.lit(n) + F.col("rank")).alias("slot"), "key", F.explode(F.sequence("have", F.col("need") - 1)).alias("nth"))
    every = ranked.union(late).join(sources.select("key", "whole"), "key")
    return every.withColumn("first", F.col("nth") * block).withColumn("last", F.least(F.col("first") + block, "whole")).where("first < last").drop("whole")


def pieces(rows: DataFrame, sources: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Which words of which document each slot takes: slot, nth, key, start (of the document), epoch, from_word, words."""
    own = rows.where("size > 0").join(sources.select("key", "source_size", "whole"), "key").where("whole > 0")
    epochs = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))).withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), "whole")).where("a < b")
    cut = epochs.withColumn("nth", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))).select("key", "nth", "start", "epoch", "a", "b")
    lo, hi = F.greatest("a", "first"), F.least("b", "last")
    return cut.join(slots, ["key", "nth"]).select("slot", "nth", "key", "start", "epoch", (lo - F.col("a")).alias("from_word"), (hi - lo).alias("words"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their positions, sources with their targets, pieces)."""
    rows = written(positions(written(sized(docs, id, text, source))))
    sources = targets(rows)
    return rows, sources, written(pieces(rows, sources, schedule(sources, block), block))


def taken(docs: DataFrame, **names) -> DataFrame:
    """One row a document: id, size, source_size, target, taken, first_slot (the first that takes of it; null if none does)."""
    rows, sources, cut = mixed(docs, **names)
    sums = cut.groupBy("key", "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")).withColumn("some", F.lit(True))
    out = rows.withColumn("some", F.col("size") > 0).join(sums, ["key", "start", "some"], "left").join(sources.select("key", "source_size", "target"), "key")
    return out.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixture(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", *, slot: str | None = None) -> DataFrame:
    """The documents of the mix with their columns, once for each time they are taken, in the order of their first slots; with ``slot``, a column of that name has the slot."""
    rows, _, cut = mixed(docs, id=id, text=text, source=source)
    takes = cut.groupBy("key", "start", "epoch").agg(F.min("from_word").alias("from_word"), F.sum("words").alias("words"), F.min("slot").alias("slot"))
    k, other, n, take = (fresh_name(docs, x) for x in ("__key", "__other", "__nth", "__take"))
    # two hashes of id, source and text tell rows apart; only the first deals them, so texts are shuffled once
    same = lambda *parts: (F.xxhash64(*parts), F.xxhash64(F.lit(31), *parts))
    first, second = same("id", "source", "text_hash")
    takes = takes.join(rows.where("size > 0"), ["key", "start"]).select(first.alias(f"{k}t"), second.alias(f"{other}t"), F.col("nth").alias(f"{n}t"), F.struct("size", "from_word", "words", "slot").alias(take))
    first, second = same(F.col(f"`{id}`"), F.col(f"`{source}`"), F.xxhash64(F.col(f"`{text}`")))
    told = docs.withColumn(k, first).withColumn(other, second).repartition(k)
    told = told.withColumn(n, F.row_number().over(Window.partitionBy(k, other).orderBy(F.lit(1))))
    equal = lambda a, b: F.col(a).bitwiseXOR(F.col(b)) == 0
    both = told.join(takes.hint("merge"), (F.col(k) == F.col(f"{k}t")) & equal(other, f"{other}t") & equal(n, f"{n}t"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0)), (F.col(f"{take}.from_word") + 1).cast("int"), F.col(f"{take}.words").cast("int")), " ")
    new = F.when(F.col(f"{take}.words") == F.col(f"{take}.size"), F.col(f"`{text}`")).otherwise(part)
    at = fresh_name(docs, "__slot")
    out = both.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.col(f"{take}.slot").alias(at))
    spark = docs.sparkSession
    many = partitions(spark)
    last = (cut.agg(F.max("slot")).first()[0] or 0) + 1
    # slots are numbers without gaps, so equal ranges of them are equal shares of the mix
    out = out.repartitionById(many, F.least(F.floor(F.col(at) * many / last), F.lit(many - 1)).cast("int")).sortWithinPartitions(at)
    return out.withColumnRenamed(at, slot) if slot else out.drop(at)
