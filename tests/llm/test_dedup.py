import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, minhash
from tessera.llm.components import connected_components

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"f1": F.lit(1), "block": F.lit("x")}).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}


def variants(n, size, edits, seed):
    """n copies of one text, each with a few words changed: a chain of overlapping neighbourhoods."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        t = list(base)
        for k in rng.sample(range(size), rng.randrange(edits)):
            t[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_minhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert near(spark, rows) == brute(rows)


def test_minhash_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "É two", "é two", long, long + " x", "a b c d e", "A b\x0bc d e", "a b c d e f"]
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute(rows)
    assert near(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (None, 2, None, True)]


@pytest.mark.parametrize("block", [128, 4])
def test_minhash_of_documents_with_several_texts(spark, monkeypatch, block):
    """Different texts of one doc_id are told apart and both link; what they link with is reachable through the document."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ANCHORS", 1)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y")], "doc_id long, text string")
    assert sorted(tuple(r)[::2] for r in minhash.near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    rows = [(5, a), (5, b), (9, a + " x"), (4, b + " y"), (7, c), (7, c), (8, c + " z"), (6, "alone in the whole wide world")] + [(20, f"{c} {i}") for i in range(30)] + [(21, f"{a} q{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 4), (9, 4), (4, 4), (21, 4), (7, 7), (8, 7), (20, 7), (6, 6)}


def test_minhash_crowded_group(spark, monkeypatch):
    """Groups larger than a block: none of the links between blocks, outliers included, may be lost."""
    monkeypatch.setattr(minhash, "BLOCK", 24)
    monkeypatch.setattr(minhash, "ANCHORS", 6)
    texts = variants(150, 120, 9, 1) + variants(40, 60, 8, 2) + variants(3, 60, 2, 3)
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute(rows)


def test_minhash_family_below_the_threshold(spark, monkeypatch):
    """5000 documents of one template, all pairs near 0.6, with a few true copies among them: the rows that meet stay few, and no link is lost."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(79)]
    texts = [" ".join(base + [f"u{rng.randrange(10**9)}" for _ in range(25)]) for _ in range(5000)]
    texts += [texts[i] + " end" for i in range(0, 5000, 500)]
    met = []
    probed = minhash._probed
    monkeypatch.setattr(minhash, "_probed", lambda *a: met.append(probed(*a)) or met[-1])
    got = near(spark, list(enumerate(texts)))
    assert {i: c for i, (_, c) in got.items() if i != c} == {5000 + k: 500 * k for k in range(10)}
    assert len(met) == 1 and met[0].count() < 10_000


@pytest.mark.parametrize("less", [1e9, 0.0])
def test_minhash_many_minor_classes(spark, monkeypatch, less):
    """The rarest shingles propose every pair that brute force links, whatever the sizes."""
    monkeypatch.setattr(minhash, "BLOCK", 24)
    monkeypatch.setattr(minhash, "ANCHORS", 2)
    monkeypatch.setattr(minhash, "SPREAD", 0)
    monkeypatch.setattr(minhash, "LESS", less)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(70)]
    texts = []
    for _ in range(150):
        t = base + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 40))]
        texts += [" ".join(t)] + [" ".join(t + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(25))])] * rng.randrange(2)
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute(rows)


def test_minhash_shared_passage(spark, monkeypatch):
    """Short near copies that are mostly a passage which many unlike long documents carry too: all their buckets are crowded."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "ANCHORS", 0)
    monkeypatch.setattr(minhash, "SIDE", 8, raising=False)
    rng, texts = random.Random(6), []
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(4):
        passage = words(64)
        texts += [" ".join(passage + words(n)) for n in [90] * 400 + [10, 10]]
    rows = list(enumerate(texts))
    want = {}
    for at in range(0, len(rows), 402):
        want |= brute(rows[at : at + 402])
    assert near(spark, rows) == want


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(0)
    for true in (0.75, 0.9, 0.97):
        got = []
        for _ in range(30):
            u = rng.integers(0, 2**63, 1200, dtype=np.uint64)
            k = int(1000 * (1 - true) / (1 + true))
            d = minhash.odd_sketch(minhash.minhash(u[:1000])) ^ minhash.odd_sketch(minhash.minhash(u[k : 1000 + k]))
            got.append(float(minhash.estimate(int(np.bitwise_count(d).sum()))))
        assert abs(np.mean(got) - true) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (7, 7), (None, 4)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors_brute(rows, threshold=0.98):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, *_ in rows}
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[:a]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                s, t = sorted((find(i), find(j)))
                root[t] = s
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [1024, 32])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    rows += [(10_000 + i, (base + 0.1 * rng.standard_normal(64)).astype(np.float32).tolist(), 3) for i in range(120)]
    rows += [(20_000, None, 3), (20_001, [0.0] * 64, 3), (20_002, [float("nan")] * 64, 3), (20_003, [None] * 64, 3), (20_004, base.tolist(), None), (20_005, [], 3), (20_006, [1.0, 2.0], 3), (20_007, [2.0, 4.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1)).repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    want = vectors_brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_recall_and_copies(spark):
    """12 000 vectors of few labels, with chains of near copies and many equal ones, against brute force by matrix product."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((9000, 48))
    near = x[:2000] + 0.13 * rng.standard_normal((2000, 48))  # around the threshold
    x = np.concatenate([x, near, np.tile(x[5], (1000, 1))]).astype(np.float32)
    label = np.concatenate([np.arange(9000) % 2, np.arange(2000) % 2, np.full(1000, 1)])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df.repartition(7)).collect()}
    links, reached = np.zeros(len(x), int), {}
    for c in (0, 1):
        at = np.flatnonzero(label == c)
        u = x[at].astype(float) / np.linalg.norm(x[at].astype(float), axis=1, keepdims=True)
        hit = u @ u.T >= 0.98
        links[at] = hit.sum(axis=1) - 1
        reached |= {int(at[i]): set(at[hit[i]].tolist()) for i in range(len(at))}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() > 0.999 * links.sum() and links.sum() > 1_000_000
    assert all(got[i].component_id == 5 for i in reached[5])


def test_near_vectors_repeated_and_lost_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (None, [1.0, 0.0], 1), (4, [1e300, 0.0], 1), (5, [1e-300, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embeddings.near_vectors(df).collect()))
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False), (5, 0, 5, True)]
