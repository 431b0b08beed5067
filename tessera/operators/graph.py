"""Graph operators: edges are (src, dst) frames; frontiers are joined, visited nodes anti-joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import stored


def undirected(edges: DataFrame) -> DataFrame:
    """Edges both ways, not made distinct: what walks them is."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hop): the least number of steps, in either direction, from the start nodes, up to depth."""
    both = undirected(edges)
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(both, front.node == both.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        front = stored(front, "frontier") if hop < depth else front  # or each later hop would walk all earlier ones anew
        seen = seen.unionByName(front)
    return seen


def simple_paths(edges: DataFrame, start: DataFrame, target: DataFrame, most_hops: int) -> DataFrame:
    """(path array, hops): all paths without a repeated node from start to target nodes, forward, of at most most_hops."""
    e = edges.select("src", "dst").distinct()
    goal = target.select(F.col("node").alias("last")).distinct()
    paths = start.select(F.array("node").alias("path"), F.col("node").alias("last")).distinct()
    found = None
    for hops in range(1, most_hops + 1):
        paths = paths.join(e, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        hit = paths.join(goal, "last", "left_semi").select("path", F.lit(hops).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
    return found


def overlaps(members: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, weight, share): pairs of groups with common members; share = weight / the smaller group.  Joined on the member."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    size = m.groupBy("g").agg(F.count("*").alias("n"))
    pairs = m.select(F.col("g").alias("a"), "m").join(m.select(F.col("g").alias("b"), "m"), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    pairs = pairs.join(size.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", "weight", F.round(F.col("weight") / F.least("na", "nb"), 4).alias("share"))


def contradictions(relations: DataFrame, subject: str, object_: str, support: str, oppose: str, share: float = 0.25) -> DataFrame:
    """Pairs where both sides have at least `share` of the weight; balance is the smaller side."""
    total = F.sum(F.col(support) + F.col(oppose))
    g = relations.groupBy(subject, object_).agg(F.sum(support).alias("support"), F.sum(oppose).alias("oppose"), total.alias("total"))
    return g.where((F.col("total") > 0) & (F.col("support") >= share * F.col("total")) & (F.col("oppose") >= share * F.col("total"))).withColumn("balance", F.least("support", "oppose"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of edges (src, dst), however long the way is.

    Rounds of contraction: every node points to its neighbour of the least hash, and edges are drawn anew between what was pointed to.
    Chains shrink by a constant factor a round, so the rounds follow the logarithm of the nodes; round tables are stored.
    """
    left = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    every = stored(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct(), "nodes")
    owner = every.select("node", F.col("node").alias("top"))
    left = stored(left.where("a < b"), "edges")
    while not left.isEmpty():
        either = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = either.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), "b")).alias("m"))
        hop = stored(best.select(F.col("a").alias("x"), F.when(F.col("m.h") < F.xxhash64("a"), F.col("m.b")).otherwise(F.col("a")).alias("y")), "hops")
        owner = owner.join(hop, owner.top == hop.x, "left").select("node", F.coalesce("y", "top").alias("top"))
        owner = stored(owner, "owners")
        left = left.join(hop, left.a == hop.x).select("b", F.col("y").alias("p")).join(hop, F.col("b") == hop.x).select("p", F.col("y").alias("q"))
        left = stored(left.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct(), "edges")
    least = owner.groupBy("top").agg(F.min("node").alias("component"))
    return owner.join(least, "top").select("node", "component")
