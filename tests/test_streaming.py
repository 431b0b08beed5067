"""The firehose job: replays, keywords that change while it runs, posts that come twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import job

POST = "uri string, did string, text string, created_at timestamp"
T = dt.datetime(2024, 3, 1, 12)


@pytest.fixture
def world(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"

    def post(*rows):
        spark.createDataFrame(rows, POST).coalesce(1).write.mode("append").parquet(at("in"))

    def words(*rows):
        spark.createDataFrame(rows, "keyword string, active boolean, changed_at timestamp").coalesce(1).write.mode("append").parquet(at("words"))

    def run():
        job.started(spark.readStream.schema(POST).parquet(at("in")), at("words"), at("out"), at("checkpoint")).awaitTermination()

    def rows():
        return sorted((r.uri, r.keyword, r.batch) for r in job.written(spark, at("out")).collect())

    return post, words, run, rows, at


def test_keywords_change_and_posts_repeat(spark, world):
    post, words, run, rows, at = world
    words(("Budget", True, T), ("  ", True, T))
    post(("u1", "d", "the BUDGET vote", T), ("u2", "d", "a bridge", T), ("u1", "d", "the budget vote", T + dt.timedelta(hours=1)), ("u3", "d", None, None))
    run()
    assert rows() == [("u1", "budget", 0)]
    words(("bridge", True, T), ("budget", False, T + dt.timedelta(days=1)))  # between two batches of one stream
    post(("u2", "d", "a bridge", T), ("u4", "d", "budget", T), ("u1", "d", "the bridge budget", T))
    run()
    assert rows() == [("u1", "budget", 0), ("u2", "bridge", 1)]
    words(("budget", True, T + dt.timedelta(days=2)))
    post(("u2", "d", "a bridge", T + dt.timedelta(minutes=5)), ("u5", "d", "bridge and budget", None))
    run()
    assert rows() == [("u1", "budget", 0), ("u2", "bridge", 1), ("u5", "bridge", 2)]


def test_a_batch_that_is_run_again(spark, world):
    post, words, run, rows, at = world
    words(("a", True, T), ("b", True, T))
    first = spark.createDataFrame([("u1", "d", "a", T), ("u2", "d", "b", T + dt.timedelta(days=3)), ("u1", "d", "a", T)], POST)
    other = spark.createDataFrame([("u2", "e", "b", T + dt.timedelta(days=3)), ("u3", "e", "b", T)], POST)
    for number, batch in ((0, first), (1, other), (0, first), (1, other), (1, other)):
        job.upsert(batch, number, at("words"), at("out"))
    assert rows() == [("u1", "a", 0), ("u2", "b", 0), ("u3", "b", 1)]
    words(("b", False, T + dt.timedelta(days=1)))  # the replay follows the table as it is now, and leaves nothing of before
    job.upsert(first, 0, at("words"), at("out"))
    assert rows() == [("u1", "a", 0), ("u3", "b", 1)]
    job.upsert(first.limit(0), 7, at("words"), at("out"))
    assert len(rows()) == 2


def test_too_many_keywords(spark, world, monkeypatch):
    post, words, run, rows, at = world
    monkeypatch.setattr(job, "MOST", 2)
    words(("a", True, T), ("b", True, T), ("c", False, T), ("C", True, T))
    assert job.active(spark, at("words")) == ["a", "b"]  # of two changes at one time the one that ends it counts
    words(("d", True, T))
    with pytest.raises(ValueError):
        job.active(spark, at("words"))


def test_suspect_samples_in_every_order_of_arrival(spark, tmp_path):
    """The standing flags are those of the batch rules over all samples, whatever order they come in within the watermark."""
    import random

    from tessera.operators import upkeep
    from tessera.streaming import suspects

    rng = random.Random(1)
    rows = [(f"s{s}", T + dt.timedelta(minutes=m), float(rng.choice([40, 45, 70, 10])), float(rng.choice([55, 60, 30]))) for s in range(3) for m in range(0, 240, 10)]
    late = [r for r in rows if rng.random() < 0.3]
    batches = [[] for _ in range(6)]
    for r in rows:  # a sample comes with its hour or one batch later
        batches[int((r[1] - T).total_seconds() // 3600) + (r in late)].append(r)
    schema = "source string, at timestamp, own double, other double"
    source, told = f"file://{tmp_path}/in", f"file://{tmp_path}/told"

    def append(batch, number):
        batch.write.mode("overwrite").parquet(f"{told}/{number}")

    for b in batches:
        rng.shuffle(b)
        spark.createDataFrame(b or [("s0", T, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = suspects.flagged(spark.readStream.schema(schema).parquet(source), "3 hours")
        stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {tuple(r) for r in suspects.latest(spark.read.schema(suspects.OUT).parquet(f"{told}/*")).select("source", "at", "suspect").collect()}
    every = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in upkeep.samples(every.limit(0), every).select("source", "at", "suspect").collect()}
    assert got == want and any(r[2] for r in want)
