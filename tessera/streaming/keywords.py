"""The firehose: decode events, keep those with a keyword, drop repeats within a watermark, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOKED_AT = 4000


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first of the words, in sorted order, within the first 4000 characters; null without one."""
    t = F.lower(F.substring(text, 1, LOOKED_AT))
    return F.get(F.filter(F.array(*[F.lit(w.lower()) for w in sorted(set(words))]), lambda w: F.contains(t, w)), F.lit(0))


def matched(posts: DataFrame, text: str, words: list[str]) -> DataFrame:
    return posts.withColumn("keyword", first_keyword(F.col(text), words)).where("keyword is not null")


def deduplicated(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Streaming dedup on key; ts must be a timestamp (timestamp_ntz is cast)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def decoded(raw: DataFrame, value: str = "value") -> DataFrame:
    """(uri, did, text, created_at) of the create events of posts in JSON lines; others are dropped."""
    schema = "did string, commit struct<operation string, collection string, rkey string, record struct<text string, createdAt string>>"
    e = raw.select(F.from_json(value, schema).alias("e")).select("e.did", "e.commit.*")
    e = e.where((F.col("operation") == "create") & (F.col("collection") == "app.bsky.feed.post") & F.col("did").isNotNull() & F.col("rkey").isNotNull() & (F.length("record.text") > 0))
    return e.select(F.concat_ws("/", F.lit("at:/"), "did", "collection", "rkey").alias("uri"), "did", F.col("record.text").alias("text"), F.try_to_timestamp("record.createdAt").alias("created_at"))
