"""Prefix tries over conversations, as level-order bitvectors (LOUDS) in shards.

Plan.  (1) Turns are range-sorted by conversation and turn and numbered across partitions, so that a long conversation is spread over tasks.  (2) A prefix's
key is the exclusive or of 128-bit hashes of (place, role, text): it runs along the turns, is carried from partition to partition, and gives a
node its parent's key without a join.  (3) A map-side-combined groupBy makes one row for each distinct prefix.  (4) Nodes under which more than SHARD turns
lie are heavy; they are the upper levels.  Every other node lies in a subtree of at most SHARD turns below a heavy one; whole subtrees are dealt to shards,
where numpy builds one level-order bitvector with label arrays and rolls up in reverse breadth-first order.  (5) The heavy levels take over the
totals of the subtrees below them, and are summed along the trie by pointer doubling, in rounds that follow the logarithm of their depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.minhash import _grouped
from tessera.llm.store import durable

#: Turns below a node, itself included, from which it counts as an upper level.
SHARD = 1024
#: conv_ids that one sorted piece of a node's list spans.
SPAN = 4096


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, role, text) of turns (conv_id, turn, role, text, ...): pos from 1 in the order of turn (null first), role, text.

    A null role or text becomes empty; rows without a conv_id are left out; repeated rows stay.  part: the task that sorted the row; a conversation of any length is cut over several.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    at = F.monotonically_increasing_id()
    rows = durable(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text", at.alias("at")), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a conversation has tasks
    runs = runs.select("conv_id", "part", (F.lit(1) - F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", "part", (F.col("at") + F.col("shift")).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, part, depth, role hashes and lengths) of the rebuilt conversations; conversations without a turn have one row of depth 0.

    Conversation c takes the first h turns of c - c % group (all, if it has fewer; none, if it is absent), then its own turns after its first h; h is crc32(decimal c) % most.
    """
    label = [F.xxhash64(F.lit(1), "role", "text").alias("l1"), F.xxhash64("role", F.lit(2), "text").alias("l2"), F.char_length("text").cast("long").alias("chars")]
    rows = durable(numbered(turns).select("conv_id", "part", "pos", *label), "labels")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("m", F.lit(0))))
    convs = durable(convs.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    # A conversation's turns in one task share one row of its facts, so none is dealt to a single task for its length.
    facts = rows.select("conv_id", "part").distinct().join(convs.select("conv_id", "h", "m", "size"), "conv_id")
    own = rows.join(facts, ["conv_id", "part"]).where("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "l1", "l2", "chars", "size")
    first = rows.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").select("base", "pos", "l1", "l2", "chars")
    taken = convs.where("m > 0").select("conv_id", "base", "m", "size").join(first, "base").where("pos <= m")  # at most group * most rows for a base
    taken = taken.select("conv_id", F.lit(-1).cast("long").alias("part"), F.col("pos").alias("depth"), "l1", "l2", "chars", "size")
    none = convs.where("size = 0").select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("l1", "l2", "chars")], "size")
    return own.unionByName(taken).unionByName(none)


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (conv_id, part, depth, l1, l2, chars, size) with the keys (k1, k2) of their prefixes and (p1, p2) of their parents'; depth 0 has keys 0."""
    at = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(3), "depth", "l1", "l2")).otherwise(0), F.when(F.col("depth") > 0, F.xxhash64("l2", "depth", F.lit(4), "l1")).otherwise(0)]
    rows = rows.select("conv_id", "part", "depth", "chars", "size", at[0].alias("a1"), at[1].alias("a2"))
    run = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = durable(rows.withColumns({"x1": F.bit_xor("a1").over(run), "x2": F.bit_xor("a2").over(run)}), "runs")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "part").agg(F.bit_xor("a1").alias("c1"), F.bit_xor("a2").alias("c2"))
    carry = carry.select("conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(c) for c in ("c1", "c2")])
    keyed = rows.join(carry, ["conv_id", "part"]).withColumns({"k1": F.col("x1").bitwiseXOR(F.col("c1")), "k2": F.col("x2").bitwiseXOR(F.col("c2"))})
    return keyed.select("conv_id", "depth", "chars", "size", "k1", "k2", F.col("k1").bitwiseXOR(F.col("a1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("a2")).alias("p2"))


class Louds:
    """A forest in level order: one bit 1 for each child, then a 0, node by node; the roots are the children of a node that is not stored.

    The i-th 1 is node i, and the zeros before it count the nodes whose children came before: so parents and children come from the bitvector alone.
    """

    def __init__(self, depth: np.ndarray, key: np.ndarray, parent: np.ndarray):
        """key, parent: structured 128-bit keys; nodes whose parent is no key are roots.  order: the given rows in level order."""
        by = np.argsort(key)
        spot = np.minimum(np.searchsorted(key[by], parent), len(key) - 1)
        up = np.where(key[by][spot] == parent, by[spot], -1)
        # Level by level: a level's nodes stand in the order of their parents.
        place = np.full(len(key) + 1, -1, np.int64)
        level = np.zeros(len(key), np.int64)
        now, at, order, depth_of = np.flatnonzero(up < 0), 0, [], 0
        kids = np.argsort(up, kind="stable")
        begin = np.searchsorted(up[kids], np.arange(len(key)))
        count = np.searchsorted(up[kids], np.arange(len(key)), side="right") - begin
        while len(now):
            order.append(now)
            place[now] = at + np.arange(len(now))
            level[now] = depth_of
            at, depth_of = at + len(now), depth_of + 1
            n = count[now]
            now = kids[np.repeat(begin[now] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.first = np.append(0, np.cumsum([len(x) for x in order])).astype(np.int64)
        degree = np.append((up < 0).sum(), count[self.order])
        bits = np.ones(int(degree.sum()) + len(degree), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        self.bits, self.n = np.packbits(bits, bitorder="little"), len(bits)

    def parents(self) -> np.ndarray:
        """Each node's parent in level order; -1 for roots."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.n, bitorder="little"))
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        """Each node's number of children."""
        zeros = np.flatnonzero(~np.unpackbits(self.bits, count=self.n, bitorder="little").astype(bool))
        return np.diff(zeros) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values in level order, level by level from the last."""
        out, up = values.copy(), self.parents()
        for a, b in zip(self.first[-2:0:-1].tolist(), self.first[:1:-1].tolist(), strict=True):
            np.add.at(out, up[a:b], out[a:b])
        return out


_NODE = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, top boolean"


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), [("a", np.int64), ("b", np.int64)])
    out["a"], out["b"] = a, b
    return out


def _light(nodes: DataFrame) -> DataFrame:
    """Nodes (shard, k1, k2, p1, p2, conv_id, depth, n_convs, chars) of whole subtrees, rolled up in their shards; top: roots, whose parent is elsewhere."""

    def run(stream):
        for t in _grouped(stream, 0):
            k1, k2, p1, p2, conv, depth, convs, chars = (t.column(c).to_numpy() for c in ("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "chars"))
            trie = Louds(depth, _keys(k1, k2), _keys(p1, p2))
            o, up, degree = trie.order, trie.parents(), trie.degrees()
            leaves, saved = trie.rolled_up((degree == 0).astype(np.int64)), trie.rolled_up((convs[o] - 1) * chars[o])
            above = pa.array(np.where(up < 0, 0, conv[o][up]), mask=up < 0)
            columns = [k1[o], k2[o], p1[o], p2[o], conv[o], depth[o], convs[o], degree, leaves, saved]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), above, pa.array(up < 0)], names=[x.split()[0] for x in _NODE.split(", ")])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, _NODE)


def nodes(rows: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations of rebuilt(): (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id: the least member; parent_conv_id: its parent's, null for the root (depth 0, all conversations); n_convs: members; n_leaves: nodes without children in the subtree;
    saved_tokens: summed over the subtree, (n_convs - 1) times the code points of a node's last text; ends_sha256: hash of the comma-joined ids, ascending, of the members that end there.
    An empty table has no conversation and no row.
    """
    spark = rows.sparkSession
    keyed = durable(prefixes(rows), "prefixes")
    turns = keyed.where("depth > 0")
    below = F.sum(F.col("size") - F.col("depth") + 1).alias("below")
    node = turns.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), below)
    node = durable(node, "nodes")
    zero = F.lit(0).cast("long")
    everyone = keyed.where("depth = 0 or depth = 1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = everyone.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    heavy = node.where(F.col("below") > SHARD)
    heavy = durable(heavy.select(root.columns).unionByName(root), "heavy")

    # The depth at which a conversation leaves the heavy levels, and there the root of its light subtree.
    deepest = turns.join(heavy.where("depth > 0").select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("left_at"))
    light = node.where(F.col("below") <= SHARD)
    least = light.select("conv_id").distinct()  # a light node is found through its least member
    entry = keyed.where("depth > 0").select("conv_id", "depth", F.xxhash64("k1", "k2").alias("under")).join(least, "conv_id", "left_semi")
    entry = entry.join(deepest, "conv_id", "left").where(F.col("depth") == F.coalesce("left_at", zero) + 1).select("conv_id", "under")
    done = durable(_light(light.join(entry, "conv_id").select(F.col("under").alias("shard"), "k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "chars")), "light")

    tops = done.where("top").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_leaves", "saved_tokens", F.lit(1).cast("long").alias("children"))
    tops = tops.unionByName(heavy.where("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(1).cast("long").alias("children")))
    tops = tops.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "children")])
    upper = heavy.join(tops, ["k1", "k2"], "left")
    children = F.coalesce("children", zero)
    upper = upper.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.coalesce("n_leaves", zero)).alias("n_leaves"), (F.coalesce("saved_tokens", zero) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    upper = _summed(durable(upper, "upper"))

    names = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    out = ["k1", "k2", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    loose = done.where("top").select("p1", "p2", *out).unionByName(upper.where("depth > 0").select("p1", "p2", *out))
    found = loose.join(names, ["p1", "p2"]).select(*out, F.col("above").alias("parent_conv_id"))
    found = found.unionByName(done.where("not top").select(*out, "parent_conv_id")).unionByName(upper.where("depth = 0").select(*out, F.lit(None).cast("long").alias("parent_conv_id")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.join(_ends(keyed), ["k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", *out[4:], F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _summed(upper: DataFrame) -> DataFrame:
    """upper with n_leaves and saved_tokens summed over the heavy descendants: after k rounds, over those less than 2 to the k below."""
    facts = upper.select("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "n_children")
    now = upper.select("k1", "k2", F.when(F.col("depth") > 0, F.col("p1")).alias("u1"), F.when(F.col("depth") > 0, F.col("p2")).alias("u2"), "n_leaves", "saved_tokens")
    while True:
        asks = now.where("u1 is not null")
        more = asks.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        if more.isEmpty():
            break
        further = now.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"))
        now = now.join(more, ["k1", "k2"], "left").join(further, ["u1", "u2"], "left")
        total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_leaves", "l"), ("saved_tokens", "s"))]
        now = durable(now.select("k1", "k2", F.col("w1").alias("u1"), F.col("w2").alias("u2"), *total), "sums")
    return facts.join(now.select("k1", "k2", "n_leaves", "saved_tokens"), ["k1", "k2"])


def _ends(keyed: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the ids of the conversations that end at a node, hashed in order; a list is sorted in pieces of SPAN ids and streamed, never held."""
    ends = keyed.where("depth = size").select("k1", "k2", "conv_id", F.floor(F.col("conv_id") / SPAN).alias("piece"))
    ends = ends.groupBy("k1", "k2", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(stream):
        key, digest = None, None
        for batch in stream:
            a, b, h = [], [], []
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k1, k2) != key:
                    if digest is not None:
                        for column, x in zip((a, b, h), (*key, digest.hexdigest()), strict=True):
                            column.append(x)
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(h, pa.string())], names=["k1", "k2", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "piece").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")
