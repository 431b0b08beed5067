"""Selection, alert state and overlap on small, hand-made inputs."""

from pyspark.sql import functions as F

from tessera.operators import selection


def test_featured(spark):
    rows = [{"id": i, "owner": "a" if i < 6 else "b", "stage": i % 3, "pinned": i == 9} for i in range(10)]
    # 9 is pinned (owner b, stage 0); 4 and 5 exceed owner a's four, 6 exceeds stage 0's three; back-fill takes the first left out.
    assert [r["id"] for r in selection.featured(rows, most=8)] == [9, 0, 1, 2, 3, 7, 8, 4]
    asleep = [{**r, "live": r["id"] not in (0, 9)} for r in rows]
    assert [r["id"] for r in selection.featured(asleep, most=3)] == [9, 1, 2]
    many = [{"id": i, "owner": i % 2, "stage": i % 7, "pinned": i % 500 == 499, "live": i % 3 > 0} for i in range(2000)]
    df = spark.createDataFrame([tuple(r.values()) for r in many], "id long, owner long, stage long, pinned boolean, live boolean").repartition(5)
    few = [r.asDict() for r in selection.reachable(df, [F.col("id")]).collect()]
    assert len(few) < 400 and selection.featured(few) == selection.featured(many)


def test_episodes(spark):
    state = spark.createDataFrame([("open", 1, None), ("closed", 1, 2), ("quiet", 1, None)], "k string, detected_at long, resolved_at long")
    signal = spark.createDataFrame([("open", False, True), ("closed", True, False), ("new", True, False), ("none", False, False)], "k string, firing boolean, recovered boolean")
    out = {r.k: (r.detected_at, r.resolved_at) for r in selection.episodes(state, signal, "k", F.lit(9).cast("long")).collect()}
    assert out == {"open": (1, 9), "closed": (9, None), "quiet": (1, None), "new": (9, None)}
