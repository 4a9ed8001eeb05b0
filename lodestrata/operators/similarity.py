"""Titles alike: Jaccard pairs by shared words, and leaders' groups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import STOP_WORDS, jaccard, title_words


def similar_titles(titles: DataFrame, least: float = 0.5) -> DataFrame:
    """titles(id, title): pairs a < b whose words' Jaccard similarity reaches the limit.

    Pairs meet by their rarest words only: of n words the first n - ceil(least n) + 1, in
    the order of how many titles hold them, always have one in common with a similar title.
    """
    x = titles.select("id", title_words(F.col("title")).alias("words"))
    often = x.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("id").orderBy("often", "w")
    size = F.size("words")
    w = x.select("id", "words", F.explode("words").alias("w")).join(often, "w").withColumn("nth", F.row_number().over(order))
    w = w.where(F.col("nth") <= size - F.ceil(F.lit(least) * size - 1e-9) + 1)
    a, b = (w.select(F.col("id").alias(c), F.col("words").alias(f"{c}_words"), "w") for c in ("a", "b"))
    pairs = a.join(b, "w").where("a < b").select("a", "b", "a_words", "b_words").dropDuplicates(["a", "b"])
    return pairs.withColumn("similarity", F.round(jaccard(F.col("a_words"), F.col("b_words")), 6)).where(F.col("similarity") >= least).select("a", "b", "similarity")


def leader_groups(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """rows(part, ord, title), perhaps dir: each row joins the first leader of its part that is alike or in the same directory (not the top one), or leads.

    Order decides, so a part is one task; its work grows with the rows times the leaders.
    """
    columns = ["part", "ord", "title", "dir"] if "dir" in rows.columns else ["part", "ord", "title"]

    def words(t: str) -> frozenset[str]:
        return frozenset(w for w in re.split(r"[\W_]+", (t or "").lower()) if len(w.encode()) >= 2 and w not in STOP_WORDS)

    def assign(f):
        f = f.sort_values("ord")
        leaders: list[tuple[int, str, frozenset[str]]] = []
        out = []
        for o, t, d in zip(f["ord"], f["title"], f["dir"] if "dir" in f else [None] * len(f), strict=True):
            w, d = words(t), d if d and d != "." else None
            hit = next((k for k, e, v in leaders if (d is not None and e == d) or ((w or v) and len(w & v) / len(w | v) >= least)), None)
            if hit is None:
                leaders.append((o, d, w))
                hit = o
            out.append(hit)
        return f.assign(leader=out)[["part", "ord", "leader"]]

    return rows.select(*columns).groupBy("part").applyInPandas(assign, "part string, ord long, leader long")


def closest(values: DataFrame, allowed: list[str], most: int = 3) -> DataFrame:
    """values(value): the allowed value at the least edit distance, the first of equals, if near enough."""
    best = F.array_min(F.array(*[F.struct(F.levenshtein(F.lower("value"), F.lit(a)).alias("distance"), F.lit(a).alias("suggestion")) for a in allowed]))
    x = values.select("value", best.alias("b"))
    return x.select("value", F.col("b.distance").cast("long").alias("distance"), F.when(F.col("b.distance") <= most, F.col("b.suggestion")).alias("suggestion"))
