"""Density clusters: of bounded groups in numpy, and of all points of a plane by Boruvka rounds over grid cells; projections and absorption of noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

#: Small cells along a cell; growth of the cells from one search to the next; points of a cell at the first search at most.
FINE, GROWTH, CROWD = 8, 4, 256


def hdbscan_leaf(x: np.ndarray, min_size: int, min_samples: int = 1) -> np.ndarray:
    """Labels (-1: noise) of the leaves of the condensed cluster tree; time follows n^2, memory n."""
    n = len(x)
    if n < min_size:
        return np.full(n, -1)

    def away(i: int) -> np.ndarray:
        return np.sqrt(((x - x[i]) ** 2).sum(axis=1))

    core = np.array([np.partition(away(i), k)[k] for i in range(n)]) if (k := min(min_samples, n - 1)) else np.zeros(n)

    def row(i: int) -> np.ndarray:
        """Mutual reachability of i: one row at a time, never a matrix."""
        return np.maximum(away(i), np.maximum(core, core[i]))

    # Minimum spanning tree (Prim), then single linkage from its sorted edges.
    best, near, edges = row(0), np.zeros(n, int), []
    best[0] = np.inf
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[j], int(near[j]), j))
        inside[j] = True
        d = row(j)
        closer = ~inside & (d < best)
        best[closer], near[closer] = d[closer], j
    node, members, children = list(range(n)), {i: [i] for i in range(n)}, {}

    def root(i: int) -> int:
        while node[i] != i:
            node[i] = node[node[i]]
            i = node[i]
        return i

    for _, i, j in sorted(edges):
        a, b, new = root(i), root(j), len(node)
        node.append(new)
        node[a] = node[b] = new
        members[new], children[new] = members[a] + members[b], (a, b)
    labels, leaf = np.full(n, -1), 0
    stack = [len(node) - 1]
    while stack:
        top = at = stack.pop()
        while at in children:  # follow the one side that is large enough; a true split makes two clusters
            big = [c for c in children[at] if len(members[c]) >= min_size]
            if len(big) == 2:
                stack += big
                break
            if not big:
                at = None
                break
            at = big[0]
        if at is None or at not in children:
            if top != len(node) - 1 or len(members[top]) >= min_size:
                labels[members[top]] = leaf
                leaf += 1
    return labels


def clustered(rows: DataFrame, group: str, key: str, vector: str, min_size: int = 3) -> DataFrame:
    """(group, key, cluster) by density inside each group on unit vectors; noise is a cluster of its own (its key); cluster is the least key.

    A group is what one frame or candidate list holds: the tree needs all of it in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector]).astype(float)
        label = hdbscan_leaf(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), min_size)
        keys = pdf[key].to_numpy()
        return pd.DataFrame({group: pdf[group], key: keys, "cluster": [k if v < 0 else keys[label == v].min() for k, v in zip(keys, label, strict=True)]})

    t = dict(rows.dtypes)
    return rows.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {t[group]}, {key} {t[key]}, cluster {t[key]}")


def plane(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y): the first two principal components, fitted and applied by Spark ML."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("p"))
    return p.select(key, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def kth(rows: DataFrame, column: str, k: int) -> float:
    """The k-th least value (from 0) of a column without nulls: sorted over tasks, of which only the sizes are collected."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranked = stored(rows.select(column).repartitionByRange(n, column).sortWithinPartitions(column).select(column, at.alias("at")), "ranked")
    sizes = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    for r in sizes:
        if k < r["n"]:
            return ranked.where(F.col("at") == (r["part"] << 33) + k).first()[column]
        k -= r["n"]
    raise ValueError("fewer values than that")


def absorbed(points: DataFrame, key: str, cluster: str, x: str = "x", y: str = "y", reach: float = 2.0, share: float = 0.9) -> DataFrame:
    """(key, cluster): noise (a null cluster) joins the nearest centroid (ties: the least cluster) within `reach` times the distance that `share` of all members keep to theirs.

    The distances of all clusters' members are pooled: of n sorted ones it is that at place floor(n * share), the last at most.
    Centroids (a row per cluster) meet only the noise of the same or an adjacent square, as wide as that reach, so the join has keys.
    """
    own = points.where(F.col(cluster).isNotNull())
    mid = stored(own.groupBy(cluster).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y")), "centroids")
    gap = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
    gaps = own.join(mid, cluster).select(gap.alias("gap"))
    many = own.count()
    if not many:
        return points.select(key, cluster)
    limit = reach * kth(gaps, "gap", min(int(many * share), many - 1))
    wide = max(limit, 1e-12)
    square = lambda c: F.floor(F.col(c) / wide)
    mid = mid.withColumnRenamed(cluster, "_to").withColumn("_i", square("_x")).withColumn("_j", square("_y"))
    noise = points.where(F.col(cluster).isNull()).withColumn("_i", F.explode(F.array(*[square(x) + k for k in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[square(y) + k for k in (-1, 0, 1)])))
    met = noise.join(mid, ["_i", "_j"]).withColumn("_gap", gap).where(F.col("_gap") <= limit)
    best = met.groupBy(key).agg(F.min_by("_to", F.struct("_gap", "_to")).alias("_to"))
    return points.join(best, key, "left").select(key, F.coalesce(cluster, "_to").alias(cluster))


def _apart(a: str, b: str) -> tuple[Column, Column]:
    """Least and greatest distance of two boxes."""
    c = lambda side, name: F.col(f"{side}.{name}")
    least, most = [], []
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        least.append(F.greatest(c(a, lo) - c(b, hi), c(b, lo) - c(a, hi), F.lit(0.0)))
        most.append(F.greatest(c(a, hi) - c(b, lo), c(b, hi) - c(a, lo)))
    return F.sqrt(least[0] * least[0] + least[1] * least[1]), F.sqrt(most[0] * most[0] + most[1] * most[1])


def _nearest_other(state: DataFrame, asks: DataFrame, width: float, widest: float) -> DataFrame:
    """(comp, w, to): the shortest way from each asking component of state (spot, x, y, comp) to another one; ties: the least pair of spots.

    Searched in cells of `width`, then of GROWTH times that, and so on, until an asking component has found a spot within a cell's width or the cells hold all.
    In a search each component of a small cell is one box.  Boxes of adjacent cells bound the way from below and above; only spots of those boxes that the
    bounds leave are compared.  Spots within the last width are one component by then, so a small cell holds few boxes, however crowded it is.
    """
    found, left = None, stored(asks.select("comp"), "asking")
    while True:
        small = width / FINE
        spots = state.select("spot", "x", "y", "comp", F.floor(F.col("x") / small).alias("i"), F.floor(F.col("y") / small).alias("j"))
        boxes = spots.groupBy("i", "j", "comp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        boxes = stored(boxes.withColumns({"ci": F.floor(F.col("i") / FINE), "cj": F.floor(F.col("j") / FINE)}), "boxes")
        own = boxes.join(left, "comp").withColumn("ci", F.explode(F.array(*[F.col("ci") + d for d in (-1, 0, 1)]))).withColumn("cj", F.explode(F.array(*[F.col("cj") + d for d in (-1, 0, 1)])))
        least, most = _apart("p", "q")
        met = own.alias("p").join(boxes.alias("q"), ["ci", "cj"]).where(F.col("p.comp") != F.col("q.comp")).where(least <= width)
        met = stored(met.select(*[F.col(f"p.{c}") for c in ("i", "j", "comp")], *[F.col(f"q.{c}").alias(f"{c}2") for c in ("i", "j", "comp")], least.alias("least"), most.alias("most")), "met")
        bound = met.groupBy("comp").agg(F.least(F.min("most"), F.lit(width)).alias("bound"))
        met = met.join(bound, "comp").where(F.col("least") <= F.col("bound")).select("i", "j", "comp", "i2", "j2", "comp2")
        pairs = met.join(spots.withColumnRenamed("spot", "a"), ["i", "j", "comp"])
        other = spots.select(F.col("spot").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(f"{c}2") for c in ("i", "j", "comp")])
        pairs = pairs.join(other, ["i2", "j2", "comp2"])
        gap = F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")))
        best = pairs.select("comp", gap.alias("w"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("comp2").alias("to")).where(F.col("w") <= width)
        hit = stored(best.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "to")).alias("b")).select("comp", "b.w", "b.to"), "ways")
        found = hit if found is None else found.unionByName(hit)
        left = stored(left.join(hit, "comp", "left_anti"), "asking")
        if width > widest or left.isEmpty():
            return found
        width *= GROWTH


def leaves(points: DataFrame, key: str, x: str = "x", y: str = "y", min_size: int = 2) -> DataFrame:
    """(key, cluster): the leaves of the condensed single-linkage tree of all points of a plane; cluster is a leaf's least key, null for noise.

    A component of the minimum spanning tree, grown by its edges from the shortest, is small below min_size.  Two that are not small make a true split where they
    meet; a leaf is what such a component holds when it first meets another (or at the end, if it never does).  No tree is collected.  In Boruvka rounds each component finds its
    shortest way to another one.  It takes the way if it is still small then, that is, if its first min_size points meet later, and each of its points notes the longest way it has come
    by.  When none takes its way any more, a component keeps as a leaf the points that had come before its shortest way to another.  Rounds follow log2(min_size).

    Equal points are one spot; points with a null or non-finite place are noise.  Ways of equal length are taken in the order of their keys.  Fewer points than min_size: all noise.
    """
    place = points.select(F.col(key).alias("spot"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fine = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    place = stored(place, "places")
    spots = place.where(F.coalesce(fine, F.lit(False))).groupBy("x", "y").agg(F.min("spot").alias("spot"), F.count("*").alias("n"))
    spots = stored(spots, "spots")
    facts = spots.agg(F.count("*"), F.sum("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    none = place.select(F.col("spot").alias(key), F.lit(None).cast(dict(points.dtypes)[key]).alias("cluster"))
    if not facts[0] or facts[1] < min_size:
        return none
    widest = max(facts[3] - facts[2], facts[5] - facts[4], 1e-300)
    width = widest * (16 / facts[0]) ** 0.5
    for _ in range(200):  # cells get smaller until none is crowded
        crowd = spots.groupBy(F.floor(F.col("x") / width), F.floor(F.col("y") / width)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if crowd <= CROWD or width < widest * 1e-12:
            break
        width /= GROWTH

    # late: the longest way by which a spot came to its component; at that time it met the component's first spots.
    state = stored(spots.select("spot", "x", "y", "n", F.col("spot").alias("comp"), F.lit(0.0).alias("late")), "state")
    order = Window.partitionBy("comp").orderBy("late", "spot")

    def since(state: DataFrame) -> DataFrame:
        """When a component's first min_size points have met; later ones belong to it from when they come."""
        first = state.select("comp", "late", "spot", "n").withColumn("place", F.row_number().over(order)).where(F.col("place") <= min_size)
        return first.withColumn("sum", F.sum("n").over(order)).where(F.col("sum") >= min_size).groupBy("comp").agg(F.min("late").alias("since"))

    known = stored(_nearest_other(state, state.select("comp"), width, widest), "ways")
    while True:
        ways = known.join(since(state), "comp", "left").where(F.col("since").isNull() | (F.col("since") > F.col("w"))).select("comp", "w", "to")
        ways = stored(ways, "taken")
        if ways.isEmpty():
            break
        # Ways lead along ever shorter ones to a component that takes none, or to two that take each other's.
        back = ways.select(F.col("comp").alias("to"), F.col("to").alias("back"))
        hops = ways.join(back, "to", "left").select("comp", "w", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("top"))
        hops = stored(hops, "hops")
        while True:
            on = hops.select(F.col("comp").alias("top"), F.col("top").alias("next"))
            step = stored(hops.join(on, "top", "left").select("comp", "w", F.coalesce("next", "top").alias("top"), (F.col("next") != F.col("top")).alias("moved")), "hops")
            hops = step.select("comp", "w", "top")
            if step.where("moved").isEmpty():
                break
        joined = state.join(hops, "comp", "left").withColumn("comp", F.coalesce("top", "comp"))
        state = stored(joined.select("spot", "x", "y", "n", "comp", F.greatest("late", F.coalesce("w", F.lit(0.0))).alias("late")), "state")

        new = stored(hops.select(F.col("top").alias("comp")).distinct(), "new")
        gone = hops.select("comp").unionByName(new)
        known = stored(known.join(gone, "comp", "left_anti").unionByName(_nearest_other(state, new, width, widest)), "ways")

    state = stored(state.join(since(state), "comp").select("spot", "x", "y", "comp", F.greatest("late", "since").alias("entry")), "state")
    until = known.select("comp", F.col("w").alias("until"))
    kept = state.join(until, "comp", "left").where(F.col("until").isNull() | (F.col("entry") < F.col("until")))
    kept = stored(kept.select("comp", "x", "y"), "leaves")
    named = place.join(kept, ["x", "y"]).select("spot", "comp")
    named = named.join(named.groupBy("comp").agg(F.min("spot").alias("cluster")), "comp").select("spot", "cluster")
    return place.join(named, "spot", "left").select(F.col("spot").alias(key), "cluster")
