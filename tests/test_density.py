"""Clusters of a plane, linkage, near vectors and the layout, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, density, layout, near

DATA = "/root/testdata/sf0.01"


def frame(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double").repartition(4)


def plain_leaves(x, min_size):
    label = density.hdbscan_leaf(x, min_size)
    return {i: None if v < 0 else int(np.flatnonzero(label == v)[0]) for i, v in enumerate(label)}


@pytest.mark.parametrize("min_size", [2, 5])
def test_leaves_of_a_plane(spark, min_size):
    """2000 points in crowded and thin regions, all together: what the sequential tree gives."""
    rng = np.random.default_rng(min_size)
    mid = rng.uniform(-50, 50, (12, 2))
    x = np.concatenate([c + rng.standard_normal((150, 2)) * s for c, s in zip(mid, np.geomspace(0.001, 6, 12), strict=True)] + [rng.uniform(-200, 200, (200, 2))])
    got = {r.id: r.cluster for r in density.leaves(frame(spark, x), "id", min_size=min_size).collect()}
    assert got == plain_leaves(x, min_size)


def test_leaves_edge_cases(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 5.0, 0.0), (4, 5.5, 0.0), (5, None, 1.0), (6, float("nan"), 1.0), (7, 90.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("spot", F.lit("clash"))
    assert {r.id: r.cluster for r in density.leaves(df, "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: None, 6: None, 7: None}
    assert {r.cluster for r in density.leaves(df.where("id < 3"), "id").collect()} == {1}
    assert {r.cluster for r in density.leaves(df.where("id = 3"), "id").collect()} == {None}
    assert density.leaves(df.limit(0), "id").count() == 0


def test_absorbed_by_a_pooled_distance(spark):
    """Many members sit close to their centroids, a few far: the limit is twice one place of all distances together."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((40, 2)) * 0.1, [20, 0] + rng.standard_normal((10, 2)), [[0.5, 0.5], [20, 3], [10, 0], [0, 2.0]]])
    cluster = [0] * 40 + [40] * 10 + [None] * 4
    df = spark.createDataFrame([(i, float(a), float(b), c) for i, ((a, b), c) in enumerate(zip(x, cluster, strict=True))], "id long, x double, y double, cluster long")
    mids = {c: x[[k for k, v in enumerate(cluster) if v == c]].mean(axis=0) for c in (0, 40)}
    gaps = sorted(np.hypot(*(x[i] - mids[c])) for i, c in enumerate(cluster) if c is not None)
    limit = 2 * gaps[min(int(len(gaps) * 0.9), len(gaps) - 1)]
    want = {}
    for i, c in enumerate(cluster):
        best = min((float(np.hypot(*(x[i] - m))), k) for k, m in mids.items())
        want[i] = c if c is not None else best[1] if best[0] <= limit else None
    assert {r.id: r.cluster for r in density.absorbed(df, "id", "cluster").collect()} == want and want[52] is None and want[50] == 0
    assert density.absorbed(df.where("cluster is null"), "id", "cluster").where("cluster is not null").count() == 0


def vectors_of(spark, path=DATA):
    e = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    return e, np.array([r.vec_id for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_found(spark):
    e, ids, x = vectors_of(spark, "/root/testdata/sf0.1")
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in near.nearest(e, "vec_id", "embedding", 10).collect():
        got.setdefault(r.src, {})[r.dst] = r.similarity
    want = np.argsort(-s, axis=1)[:, :10]
    hits = [len({int(ids[j]) for j in want[i]} & set(got[int(k)])) for i, k in enumerate(ids)]
    assert np.mean(hits) / 10 >= 0.6 and all(len(v) == 10 for v in got.values())
    assert all(abs(v - s[np.searchsorted(ids, k), np.searchsorted(ids, d)]) < 1e-8 for k, of in list(got.items())[:50] for d, v in of.items())


def neighbours_kept(x, places, k=10):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    d = ((places[:, None] - places[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    a, b = np.argsort(-s, axis=1)[:, :k], np.argsort(d, axis=1)[:, :k]
    return np.mean([len(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) / k


def test_layout_keeps_neighbours(spark, monkeypatch):
    """More of the nearest rows stay near than on the principal components, also in several blocks; the same rows give the same places."""
    e, ids, x = vectors_of(spark)
    flat = np.array([(r.x, r.y) for r in density.plane(e, "vec_id", "embedding").orderBy("vec_id").collect()])
    first = [tuple(r) for r in layout.plane(e, "vec_id", "embedding").orderBy("vec_id").collect()]
    again = [tuple(r) for r in layout.plane(e.repartition(7), "vec_id", "embedding").orderBy("vec_id").collect()]
    assert np.allclose(first, again, atol=1e-6)
    kept = neighbours_kept(x, np.array(first)[:, 1:])
    assert kept > 1.5 * neighbours_kept(x, flat), (kept, neighbours_kept(x, flat))
    monkeypatch.setattr(layout, "BLOCK", 150)
    parts = np.array([tuple(r)[1:] for r in layout.plane(e, "vec_id", "embedding").orderBy("vec_id").collect()])
    assert neighbours_kept(x, parts) > 1.2 * neighbours_kept(x, flat)


@pytest.mark.parametrize("side", [40, 1024])
def test_variants_by_components(spark, monkeypatch, side):
    """Complete linkage of whole frames, though only a component of rows within the cut is ever in a task."""
    e, ids, x = vectors_of(spark)
    e = e.withColumn("label", F.col("label") % 2)
    label = np.array([r.label for r in e.orderBy("vec_id").collect()])
    within = cluster.within
    monkeypatch.setattr(cluster, "within", lambda *a: within(*a, side=side))
    for cut in (0.42, 0.75):
        want = {}
        for f in (0, 1):
            own = np.flatnonzero(label == f)
            for k, v in zip(own, cluster.complete_linkage(x[own], cut), strict=True):
                want[int(ids[k])] = int(ids[own[v]])
        got = {r.vec_id: r.variant for r in cluster.variants(e, "label", "vec_id", "embedding", cut).collect()}
        same = {v: min(k for k, u in want.items() if u == v) for v in set(want.values())}
        assert got == {k: same[v] for k, v in want.items()}


def test_variant_summaries(spark):
    import datetime as dt

    day = lambda d: dt.date(2024, 1, d)
    q = spark.createDataFrame([("f", 1, [1.0, 0.0], day(3)), ("f", 2, [0.9, 0.1], day(1)), ("f", 3, [0.0, 1.0], None), ("g", 1, None, day(2))], "frame string, k long, v array<double>, ts date")
    got = {(r.frame, r.variant): (r.quotes, r.first_seen, r.last_seen, r.centroid) for r in cluster.variant_summaries(q, cluster.variants(q, "frame", "k", "v"), "frame", "k", "v", "ts").collect()}
    assert got == {("f", 1): (2, day(1), day(3), [0.95, 0.05]), ("f", 3): (1, None, None, [0.0, 1.0]), ("g", 1): (1, day(2), day(2), None)}
