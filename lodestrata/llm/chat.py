"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees by their parents. Self-joins double, step by step, how far up each
message sees, together with the number and the score of the messages passed; after as
many steps as the logarithm of the greatest depth every message knows the score of its
path to the root. Leaves are ranked by the mean score of their paths, and for the chosen
ones the same tables, applied in turn, list all messages of the path. Each path becomes
one conversation: a template marks turns, and control strings inside texts are escaped
so that they can be read back.

Escaping doubles every backslash and puts one after the first character of each control
string; unescaping removes it again.

Defined results: null text and role are empty; a null tree is a tree of its own; a
message whose parent is null, itself or unknown is a root; replies to an id that occurs
more than once go to the first such message (by parent, role, text and score); repeated
rows are messages of their own; messages below a cycle have no root and are on no path;
a null score counts 0; equal scores are ranked by the leaf's place. Empty tables give
empty results. Columns of other names are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import key_of, written


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    between: str = "\n"
    #: Strings of this and other chat templates that no text may spell out.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned_role: str = "assistant"

    def escape(self, c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for s in self.control:
            c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
        return c

    @staticmethod
    def unescape(c: Column) -> Column:
        return F.regexp_replace(c, r"\\(\\?)", "$1")


def message_tree(messages: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """t (key of the tree), tree, node (place in the tree), up (the parent's place), role, text, score."""
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    own = messages.select(key_of(tree).alias("t"), F.col(tree).alias("tree"), F.col(message).alias("m"), F.col(parent).alias("p"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), points.alias("score"))
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.col("m").asc_nulls_last(), "p", "role", "text", "score")).cast("long")
    nodes = written(own.withColumn("node", place))
    first = nodes.where("m is not null").groupBy(F.col("t").alias("ft"), F.col("m").alias("fm")).agg(F.min("node").alias("up"))
    above = nodes.join(first, (F.col("t") == F.col("ft")) & (F.col("p") == F.col("fm")), "left")
    return written(above.select("t", "tree", "node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("up"), "role", "text", "score"))


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (t, node, up) of the 1st, 2nd, 4th, ... ancestors, and (t, node, n, total) of the path to the root."""
    levels: list[DataFrame] = []
    now = written(nodes.select("t", "node", "up", F.lit(1).cast("long").alias("n"), F.col("score").alias("total")))
    deepest = now.agg(F.max("node")).first()[0] or 0
    while (1 << len(levels)) <= deepest and now.where("up is not null").limit(1).count():
        levels.append(now.where("up is not null").select("t", "node", "up"))
        far = now.select(F.col("t").alias("t2"), F.col("node").alias("at"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        # only messages that don't see the root yet are joined; the others are done
        both = now.where("up is not null").join(far, (F.col("t") == F.col("t2")) & (F.col("up") == F.col("at")))
        seen = both.select("t", "node", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"))
        now = written(now.where("up is null").union(seen))
    return levels, now.where("up is null").select("t", "node", "n", "total")


def branches(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """The best paths of each tree: t, leaf, rank, branch_score, node, depth (0 at the root)."""
    levels, paths = ancestors(nodes)
    inner = nodes.where("up is not null").select("t", F.col("up").alias("node")).distinct()
    order = Window.partitionBy("t").orderBy(F.col("branch_score").desc(), "leaf")
    leaves = paths.join(inner, ["t", "node"], "left_anti").select("t", F.col("node").alias("leaf"), "n", (F.col("total") / F.col("n")).alias("branch_score")).withColumn("rank", F.row_number().over(order))
    if top is not None:
        leaves = leaves.where(F.col("rank") <= top)
    on = written(leaves.select("t", "leaf", "rank", "branch_score", F.col("leaf").alias("node"), (F.col("n") - 1).alias("depth")))
    for k, level in enumerate(levels):
        up = on.join(level, ["t", "node"]).select("t", "leaf", "rank", "branch_score", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        on = written(on.union(up))
    return on


def formatted(messages: DataFrame, tree: str, message: str, parent: str, role: str = "role", text: str = "text", score: str | None = None, top: int | None = 1, template: Template = Template()) -> DataFrame:
    """One row a chosen branch: tree, rank, branch_score, formatted, and mask, the places (start, length in code points) of learned texts."""
    nodes = message_tree(messages, tree, message, parent, role, text, score)
    x = template
    turns = branches(nodes, top).join(nodes.select("t", "node", "tree", "role", "text"), ["t", "node"])
    head = F.concat(F.lit(x.start), x.escape(F.col("role")), F.lit(x.middle))
    turns = turns.withColumn("head", head).withColumn("body", x.escape(F.col("text"))).withColumn("shown", F.concat("head", "body", F.lit(x.end + x.between)))
    before = F.coalesce(F.sum(F.char_length("shown")).over(Window.partitionBy("t", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("role") == x.learned_role, F.struct((before + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    turns = turns.withColumn("span", span)
    rows = turns.groupBy("t", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list(F.struct("depth", "shown", "span"))).alias("turns"))
    return rows.select("tree", "rank", "branch_score", F.array_join(F.transform("turns", lambda v: v["shown"]), "").alias("formatted"), F.filter(F.transform("turns", lambda v: v["span"]), lambda v: v.isNotNull()).alias("mask"))


def read_back(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds what the formatted text and its mask say: n_turns, turns (role, text), loss_text."""
    x = template
    parts = F.split(F.col("formatted"), "\\Q" + x.end + x.between + "\\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    halves = F.transform(parts, lambda v: F.split(v, "\\Q" + x.middle + "\\E", 2))
    told = F.transform(halves, lambda v: F.struct(x.unescape(F.substring(v[0], F.lit(len(x.start) + 1), F.char_length(v[0]))).alias("role"), x.unescape(v[1]).alias("text")))
    learned = F.transform("mask", lambda m: x.unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return rows.withColumn("turns", told).withColumn("n_turns", F.size("turns").cast("long")).withColumn("loss_text", F.array_join(learned, ""))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), each one a chain of replies: the digest columns of the formatted texts."""
    own = conversations.select("conv_id", "turn", "role", "text")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    chain = own.withColumn("place", place).withColumn("before", F.when(F.col("place") > 1, F.col("place") - 1))
    rows = read_back(formatted(chain, "conv_id", "place", "before"))
    told = F.array_join(F.transform("turns", lambda v: F.concat(v["role"], F.lit("\n"), v["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
