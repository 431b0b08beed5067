"""The firehose as a job: micro-batches are matched against a keyword table that may change while the stream runs, and written so that a replay changes nothing.

Target: Parquet under `<target>/day=<created day>/batch=<batch id>`.  A batch replaces its own folders whole, and drops posts that another batch of their day has written,
so a batch that is run again (after a lost driver, from the checkpoint) leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.storage import remove
from tessera.streaming.keywords import LOOKED_AT

#: Keywords that may be active at a time: they are words that people enter, and travel with the plan.
MOST = 10_000


def active(spark: SparkSession, keywords: str) -> list[str]:
    """The keywords in force: of each word of the table (keyword, active, changed_at) the last change counts (ties: not active); more than MOST are refused."""
    t = spark.read.schema("keyword string, active boolean, changed_at timestamp").parquet(keywords)
    word = F.lower(F.trim("keyword"))
    last = t.where(F.length(word) > 0).groupBy(word.alias("keyword")).agg(F.max(F.struct("changed_at", (~F.col("active")).alias("off"))).alias("last"))
    rows = last.where("not last.off").select("keyword").orderBy("keyword").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} active keywords")
    return [r.keyword for r in rows]


def matched(posts: DataFrame, words: list[str]) -> DataFrame:
    """posts (uri, did, text, created_at) with the first of the sorted words in the first characters of the text; posts without one are dropped."""
    seen = F.lower(F.substring("text", 1, LOOKED_AT))
    found = F.get(F.filter(F.lit(words).cast("array<string>"), lambda w: F.contains(seen, w)), F.lit(0))
    return posts.withColumn("keyword", found).where("keyword is not null")


def upsert(batch: DataFrame, number: int, keywords: str, target: str) -> None:
    """Write one micro-batch of posts (uri, did, text, created_at), each uri once: the earliest row, and none that another batch wrote.  Posts without a time belong to no day and share one folder."""
    spark = batch.sparkSession
    day = F.coalesce(F.to_date("created_at"), F.lit("1970-01-01").cast("date"))
    rows = matched(batch, active(spark, keywords)).withColumn("day", day)
    facts = F.struct(F.col("created_at").alias("at"), "text", "did", "keyword")
    rows = rows.groupBy("day", "uri").agg(F.min(facts).alias("f")).select("day", "uri", "f.did", "f.text", F.col("f.at").alias("created_at"), "f.keyword")
    rows = rows.withColumn("batch", F.lit(number).cast("long"))
    days = [r.day for r in rows.select("day").distinct().collect()]  # the days of one micro-batch
    known = written(spark, target).where(F.col("day").isin(days) & (F.col("batch") != number)).select("day", "uri") if days else None
    new = rows.join(known, ["day", "uri"], "left_anti") if known is not None else rows
    staged = f"{target}/_staged-{number}"
    new.write.mode("overwrite").parquet(staged)
    new = spark.read.schema(new.schema).parquet(staged)  # what is replaced below is no longer read
    old = [r.day for r in written(spark, target).where(F.col("batch") == number).select("day").distinct().collect()]
    for d in old:  # a replay after a change of keywords may write fewer days
        remove(spark, f"{target}/day={d}/batch={number}")
    new.write.mode("append").partitionBy("day", "batch").parquet(target)
    remove(spark, staged)


SCHEMA = "uri string, did string, text string, created_at timestamp, keyword string, day date, batch long"


def written(spark: SparkSession, target: str) -> DataFrame:
    """The target's rows; none where nothing has been written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(target)


def started(posts: DataFrame, keywords: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A running query over streaming posts; trigger: as for writeStream.trigger, by default what there is now.  Keywords are read anew for every batch."""
    writer = posts.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: upsert(batch, number, keywords, target)).start()


def schema_of(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema
