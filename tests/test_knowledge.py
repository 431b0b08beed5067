"""Names, claims and density clusters on small, hand-made inputs."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import claims, cluster, density
from tests.test_operators import one


def test_names(spark):
    assert one(spark, names.without_honorifics(F.col("n")), n="Rep. Dr. Jane Doe Jr., MD") == "Jane Doe"
    same = lambda a, b: one(spark, names.same_person(F.col("a"), F.col("b"), {"bob": "robert"}), a=a, b=b)
    assert same("Sen. Bob Casey Jr.", "Robert Casey Jr.") and not same("Bob Casey Jr.", "Bob Casey") and same("Bob Casey MD", "Robert Casey") and not same("Bob Casey", "Bob Cary")
    assert one(spark, names.district_forms(F.col("c")), c="PA-08")[:4] == ["PA-08", "PA-8", "PA08", "PA 8"]
    assert "11th district" in one(spark, names.district_forms(F.col("c")), c="NY-11")
    assert str(one(spark, names.general_election(F.col("y").cast("int")), y=2026)) == "2026-11-03"
    assert str(one(spark, names.nth_weekday(F.lit(2026), F.lit(5), "Tue", 3), y=1)) == "2026-05-19"
    assert one(spark, names.byline(F.col("t")), t="Title\nBy Jane Q. Doe\nbody") == "Jane Q. Doe" and one(spark, names.byline(F.col("t")), t="nothing") is None
    s = lambda t: one(spark, names.issue_strength(F.col("t"), ["tax", "city hall"], {"tax"}), t=t)
    assert s("City Hall\nbody") == 45 and s("x\ntax") == 0 and s("tax tax") == 0 and s("x\ncity hall and tax, city hall") == 52


def test_claims(spark):
    rels = spark.createDataFrame([("a", "p", "b", 1, i) for i in range(60)] + [("a", "q", "b", 1, 1)], "s string, p string, o string, at long, article long")
    r = {x.p: x for x in claims.relations(rels).collect()}
    assert r["p"].weight == 60 and len(r["p"].evidence) == 50 and r["p"].evidence[0].article == 59
    left = claims.without_articles(claims.relations(rels), spark.createDataFrame([(1,)], "article long")).collect()
    assert [(x.p, x.weight) for x in left if x.p == "q"] == []
    assert one(spark, claims.claim_status(F.lit("retracted"), F.array(F.lit("supports"))), x=1) == "retracted"
    assert tuple(one(spark, claims.verbatim_offset(F.col("a"), F.col("b")), a="Cat", b="the cat")) == (4, 7)
    assert one(spark, claims.verbatim_offset(F.col("a"), F.col("b")), a="dog", b="the cat") is None


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (20, 3)) for c in ([0, 0, 1], [0, 1, 0])])
    label = density.hdbscan_leaf(x, 15)
    assert {frozenset(label[:20][label[:20] >= 0]), frozenset(label[20:][label[20:] >= 0])} == {frozenset({0}), frozenset({1})}
    assert (density.hdbscan_leaf(x[:2], 3) == -1).all()
    label = cluster.complete_linkage(x, 0.42)
    assert len(set(label[:20])) == 1 and len(set(label[20:])) == 1 and label[0] != label[20]


def test_title_pairs(spark):
    rows = [(1, "Big fire at the old mill in town - AP"), (2, "Big fire at the old mill in town | Reuters"), (3, "District 8 results are in tonight"), (4, "District 3 results are in tonight")]
    got = cluster.title_pairs(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.65).collect()
    assert [(r.a, r.b, r.similarity) for r in got] == [(1, 2, 1.0)]
    v = cluster.canonical_verdict
    assert one(spark, v(F.col("a"), F.col("b"), F.col("r")), a=70, b=2000, r=0.95) == "new_is_duplicate"
    assert one(spark, v(F.col("a"), F.col("b"), F.col("r")), a=70, b=2000, r=0.5) == "no_match"
