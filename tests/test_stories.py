"""Story clusters against plain, sequential versions."""

import datetime as dt
import difflib
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import cluster, density, graph, stories

T0 = dt.datetime(2024, 1, 1)


def test_ratio_and_simhash(spark):
    pairs = [("council votes on the budget", "council votes on budget"), ("", "x"), (None, "x"), ("abc", "abc")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(stories.title_ratio("a", "b").alias("s")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    body = "The quick brown fox jumped over seven lazy dogs while rain kept falling on the town"
    df = spark.createDataFrame([(body,), (body + " today",), (None,), ("of the",)], "t string")
    a, b, none, empty = (r.h for r in df.select(stories.simhash("t").alias("h")).collect())
    assert none is None and empty is None and a and bin((a ^ b) % 2**64).count("1") < 25


def test_duplicate_pairs(spark):
    title = "County board approves new bridge over the river"
    long_ = "x" * 600
    rows = [(1, title + " - The Daily", "stub"), (2, title, long_), (3, "Update: " + title, long_), (4, "Short title", "stub"), (5, "Short title", long_)]
    rows += [(6, "Pneumonoultramicroscopicsilicovolcano", "s"), (7, "pneumonoultramicroscopicsilicovolcano", long_), (8, None, "s"), (9, title, None), (10, title, "old stub")]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {r.stub_id: (r.canonical_id, round(r.similarity, 3)) for r in stories.duplicate_pairs(df, F.col("id") != 10).collect()}
    assert got == {1: (2, 1.0), 6: (7, 1.0)}


def test_duplicate_pairs_against_brute_force(spark):
    """A prefix is found anywhere in a title: inside a word, behind other words; every stub against every article."""
    rng = random.Random(7)
    words = ["plan", "harbour", "bridge", "wonderfulness", "council", "town", "vote", "for", "the", "new", "budget", "-", "Ünïon"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9)))
    rows = [(1, "wonderfulness plan for the town council", "s"), (2, "Unwonderfulness plan for the town council", "b" * 600)]
    for i in range(3, 160):
        t = rng.choice(rows)[1] if rng.random() < 0.6 else title()
        t = rng.choice(["", "", "Un", "Update: ", "A "]) + (t or "") + rng.choice(["", "", " x", " - The Daily"])
        rows.append((i, rng.choice([t, t, t, None]), rng.choice(["s", "b" * 600, "b" * 300, None])))
    df = spark.createDataFrame(rows, "id long, title string, body string").repartition(4)
    norm = {r.id: (r.norm, r.low) for r in df.select("id", text.publisher_stripped(F.col("title")).alias("norm"), F.lower("title").alias("low")).collect()}
    want = {}
    for i, t, b in rows:
        if t is None or b is None or len(b) >= 200 or len(norm[i][0]) < 20:
            continue
        near = [(-difflib.SequenceMatcher(None, norm[i][0], norm[j][0]).ratio(), j) for j, u, c in rows if u is not None and c is not None and len(c) >= 500 and norm[i][0][:30] in norm[j][1]]
        near = [x for x in near if -x[0] >= 0.9]
        if near:
            want[i] = min(near)[1]
    assert {r.stub_id: r.canonical_id for r in stories.duplicate_pairs(df, F.lit(True)).collect()} == want and want[1] == 2 and len(want) > 2


def test_links_and_assignment(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    body = " ".join(word() for _ in range(120))
    rows = [
        (1, "http://a.example/s?utm_source=x", "Mayor opens the new harbour bridge", body, T0),
        (2, "http://www.a.example/s", "Something else entirely here", "b", T0 + dt.timedelta(days=1)),  # the same url
        (3, "http://b.example/1", "Mayor opens the new harbour bridge - B News", "c", T0 + dt.timedelta(days=2)),  # the same title
        (4, "http://c.example/1", "Mayor opens the new harbour bridge today", body + " more", T0 + dt.timedelta(days=3)),  # title and body
        (5, "http://d.example/1", "Ward 8 results for the harbour bridge", "e", T0),
        (6, "http://e.example/1", "Ward 3 results for the harbour bridge", "e", T0),  # the numbers contradict
        (7, "http://f.example/1", "Mayor opens the new harbour bridge", "g", T0 + dt.timedelta(days=90)),  # too late
    ]
    df = spark.createDataFrame(rows, "id long, url string, title string, body string, ts timestamp")
    got = {(r.early, r.late) for r in stories.links(df).collect()}
    assert {(1, 2), (1, 3), (1, 4)} <= got and not any(7 in p or p == (5, 6) for p in got)
    of = {r.id: r.story for r in stories.assigned(df, stories.links(df)).collect()}
    assert of == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7}
    assert {(r.old, r.new) for r in stories.merges(df).collect()} == {(2, 1), (4, 1)}
    out = df.withColumn("outlet", F.col("url")).withColumn("authority", F.when(F.col("id") == 3, 9))
    s = {r.story: r for r in stories.summaries(out, stories.assigned(df, stories.links(df))).collect()}
    assert (s[1].articles, s[1].outlets, s[1].representative, s[1].last_seen) == (4, 4, 3, T0 + dt.timedelta(days=3))


def test_assignment_against_a_sequential_version(spark):
    rng = random.Random(7)
    for n, m in ((60, 90), (40, 400), (50, 49)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} if m > n else {(i, i + 1) for i in range(m)}
        want, founders = {}, set()
        for i in range(n):
            mine = [a for a, b in pairs if b == i and a in founders]
            want[i] = max(mine) if mine else i
            if not mine:
                founders.add(i)
        items = spark.createDataFrame([(i, T0 + dt.timedelta(hours=i)) for i in range(n)], "id long, ts timestamp")
        got = {r.id: r.story for r in stories.assigned(items, spark.createDataFrame(list(pairs), "early long, late long")).collect()}
        assert got == want


def test_merge_mapping(spark):
    mapping = stories.followed(spark.createDataFrame([(i + 1, i) for i in range(1, 9)], "old long, new long"))
    assert {(r.old, r.new) for r in mapping.collect()} == {(i, 1) for i in range(2, 10)}
    m = spark.createDataFrame([("f", 1, 0.5, 3, 4), ("f", 2, 0.7, 1, 2), ("g", 2, 0.1, 9, 9)], "frame string, story long, confidence double, first_seen long, last_seen long")
    assert {tuple(r) for r in stories.merged_matches(m, mapping).collect()} == {("f", 1, 0.7, 1, 4), ("g", 1, 0.1, 9, 9)}
    r = lambda *v: spark.range(1).select(stories.retrigger(*[F.lit(x).cast("int") for x in v]).alias("r")).first().r
    assert [r(3, 4, 40, 1, 1), r(3, 4, None, None, 5), r(14, 15, 1, 5, 5), r(20, 21, None, 5, 4)] == ["resurrection", "authority_promotion", "size_milestone_15", None]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(400)] + [("x", "x"), ("y", "z")], "src string, dst string")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {f"n{i:04}": "n0000" for i in range(401)} | {"x": "x", "y": "y", "z": "y"}


def test_linkage_without_a_matrix():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.3 * rng.standard_normal((12, 8)) for c in rng.standard_normal((6, 8))])
    assert (cluster.complete_linkage(x, 0.42) == cluster.chained_linkage(x, 0.42)).all()


def test_noise_is_absorbed(spark):
    rows = [(i, "a", 0.1 * i, 0.0) for i in range(5)] + [(10, "b", 9.0, 9.0), (11, "b", 9.5, 9.0), (20, None, 0.5, 0.0), (21, None, 4.0, 4.0), (22, None, 9.3, 9.1)]
    df = spark.createDataFrame(rows, "id long, c string, x double, y double")
    got = {r.id: r.c for r in density.absorbed(df, "id", "c").collect()}
    assert (got[20], got[21], got[22]) == ("a", None, "b")


def test_greedy_clusters(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 0.0])]
    got = {r.k: r.cluster for r in stories.greedy_clusters(spark.createDataFrame(rows, "g long, k long, v array<double>"), "g", "k", "v", 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_texts_without_words_do_not_pair(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "Привет мир 日本"), (5, "primary election"), (6, "one two three"), (7, "one two three")], "k long, t string")
    assert {(r.a, r.b, r.distance) for r in stories.simhash_pairs(df.select("k", stories.simhash("t").alias("h")), "k", "h").collect()} == {(6, 7, 0)}


def test_simhash_pairs(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(10) for h in hashes[:6]]  # k bits away; 0: copies
    signed = [h - 2**64 if h >= 2**63 else h for h in hashes]
    got = {(r.a, r.b, r.distance) for r in stories.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "k long, h long"), "k", "h").collect()}
    first = {h: hashes.index(h) for h in hashes}
    want = {(first[h], i, 0) for i, h in enumerate(hashes) if first[h] != i}
    names = sorted(first.values())
    want |= {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in names for b in names if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 6}
    assert got == want
