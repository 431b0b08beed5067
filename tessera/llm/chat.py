"""Chat formatting of reply trees, with DataFrame functions only.

Iterative self-joins double the reach of every node's pointer to its ancestor, so a path of depth d is enumerated
in log2(d) joins.  Branches are ranked by the score summed from root to leaf, and each chosen path becomes one conversation.
Every join is on a node key, one row a node on one side, so a crowded conversation does not skew it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import durable

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What starts like a control string of this or a common template, with any number of escapes after its first character.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"


def escape(text: Column) -> Column:
    """A backslash after the first character of what could be read as a control string; unescape() takes it back."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def chain(turns: DataFrame) -> DataFrame:
    """Reply trees of linear conversations (conv_id, turn, role, text): nodes (conv_id, node, parent, role, text, score).

    Turns follow by turn, then role and text; null turns come first.  Each has the one before as parent.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(path, conv_id, leaf, node, place): the nodes of the `best` highest-scored root-to-leaf paths of each conversation.

    nodes: conv_id, node (unique in its conversation), parent (null or absent from the conversation: a root), score.
    A path's score is the sum of its nodes' (null: 0); ties go to the smaller leaf.  place counts from the root, from 0.
    Nodes on a cycle have no root and are left out.
    """

    def key(node: str) -> Column:  # 128 bits: no two of any number of nodes that can be stored will share it
        names = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0")), F.col(node)
        return F.struct(F.xxhash64(*names).alias("x"), F.xxhash64(F.lit(1), *names).alias("y"))

    base = nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    mine = base.select(key("node").alias("h"), "conv_id", "node", "score", key("parent").alias("up"), F.col("parent").isNull().alias("top"))
    known = mine.select(F.col("h").alias("up"), F.lit(True).alias("there"))
    mine = mine.join(known, "up", "left").withColumn("up", F.when(~F.col("top") & F.col("there"), F.col("up"))).drop("top", "there")
    # up: the ancestor `reach` steps above, null once past the root; total and depth: over the steps so far.
    tree = durable(mine.select("h", "conv_id", "node", "up", F.col("score").alias("total"), F.lit(1).alias("depth")), "tree")
    jumps = [tree.select("h", "up")]
    reach = 1
    limit = tree.count()
    while reach <= limit and not tree.where("up is not null").limit(1).isEmpty():
        above = tree.select(F.col("h").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        tree = tree.join(above.hint("merge"), "up", "left").select("h", "conv_id", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        tree = durable(tree, "tree")
        jumps.append(tree.select("h", "up"))
        reach *= 2
    rooted = tree.where("up is null")
    inner = jumps[0].where("up is not null").select(F.col("up").alias("h")).distinct()
    leaves = rooted.join(inner, "h", "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= best)
    path = chosen.select(F.col("h").alias("path"), F.col("h").alias("at"), F.col("depth").alias("place"))
    # Unfold: with the ancestors at distances below 2^i known, one join adds those at 2^i to 2^(i+1) - 1.
    for i, jump in enumerate(jumps[:-1]):
        more = path.join(jump.where("up is not null").withColumnRenamed("h", "at"), "at").select("path", F.col("up").alias("at"), (F.col("place") - (1 << i)).alias("place"))
        path = durable(path.unionByName(more), "paths")
    names = chosen.select(F.col("h").alias("path"), "conv_id", F.col("node").alias("leaf"))
    own = jumps[0].join(mine.select("h", "node"), "h").select(F.col("h").alias("at"), "node")
    return path.join(own, "at").join(names, "path").select("path", "conv_id", "leaf", "node", (F.col("place") - 1).alias("place"))


def formatted(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, loss_mask): one conversation for each chosen path.

    loss_mask: array<struct<start, length>> of code points in formatted, from 0: the assistant turns' texts, in order.
    Null roles and texts are empty.  A null conv_id is a conversation of its own.
    """
    p = paths(nodes, best)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    said = nodes.select("conv_id", "node", role.alias("role"), text.alias("text")).withColumnsRenamed({"conv_id": "c", "node": "n"})
    rows = p.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    turn = F.struct("place", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    g = rows.groupBy("path", "conv_id", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE))))
    g = g.withColumn("formatted", whole)
    size = F.transform("turns", lambda t: F.struct(F.char_length(t["head"]).alias("head"), F.char_length(t["body"]).alias("body"), t["loss"].alias("loss")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(acc: Column, t: Column) -> Column:
        span = F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))
        mask = F.when(t["loss"], F.concat(acc["mask"], span)).otherwise(acc["mask"])
        return F.struct((acc["at"] + t["head"] + t["body"] + F.lit(len(CLOSE))).alias("at"), mask.alias("mask"))

    return g.select("conv_id", "leaf", "formatted", F.aggregate(size, zero, step)["mask"].alias("loss_mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Turns and loss text as the formatted string and its mask hold them: adds turns array<struct<role, text>> and loss_text."""
    parts = F.slice(F.split("formatted", _quoted(OPEN), -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        return F.struct(
            unescape(F.substring_index(part, MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(part, CLOSE, 1), MIDDLE, -1)).alias("text"),
        )

    loss = F.concat_ws("", F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))))
    return conversations.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", loss)


def _quoted(text: str) -> str:
    return reduce(lambda s, c: s.replace(c, "\\" + c), "|<>", text)
