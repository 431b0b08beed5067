"""What is to be done once."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import claims, stories, textindex
from tessera.sources import feeds


def test_a_span_is_looked_for_once(spark):
    df = spark.createDataFrame([("a  b", "x a b")], "s string, t string")
    place = df.select(claims.verbatim_offset(F.col("s"), F.col("t")).alias("at"))
    assert tuple(place.first().at) == (2, 5) and place._jdf.queryExecution().analyzed().toString().count("regexp_substr") == 1


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    def never(self, *_):
        raise AssertionError("shuffled")

    df = spark.createDataFrame([(1, "the bridge, the"), (2, None), (3, "Bridge")], "doc long, text string").repartition(2)
    monkeypatch.setattr(DataFrame, "repartition", never)
    textindex.build(df, "doc", "text", str(tmp_path))
    got = {(r.term, r.doc): (r.length, r.positions) for r in textindex.read(spark, str(tmp_path), ["the", "bridge"]).collect()}
    assert got == {("the", 1): (3, [0, 2]), ("bridge", 1): (3, [1]), ("bridge", 3): (1, [0])}


def test_known_items_of_one_title(spark):
    """Known rows that all bear one title: items meet that title once, not each row."""
    raw = spark.range(5).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("C").alias("committee"), F.concat(F.lit("u"), "id").alias("url"))).alias("value"))
    known = spark.range(1000).select(F.concat(F.lit("u"), F.col("id") * 2).alias("url"), F.lit("-").alias("title"))
    out = feeds.filings(raw, known)
    assert sorted(r.url for r in out.collect()) == ["u1", "u3"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3 and "Aggregate" in plan[plan.rindex("Join LeftAnti") :]


def test_stretches_of_a_long_title():
    """A title's stretches are few and those of any prefix in it are among them."""
    rng = random.Random(3)
    title = "".join(rng.choice("abcdefgh ü\U0001d4d0") for _ in range(60_000))
    held = set(stories._least_hashes(title).tolist())
    assert len(held) < 15_000 and not len(stories._least_hashes(title[:19]))
    for at in range(0, 59_000, 997):
        for size in (20, 25, 30):
            assert set(stories._least_hashes(title[at : at + size]).tolist()) <= held
