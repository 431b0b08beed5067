"""Readers with fixed schemas; rejects are rows, not errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the pipe-separated candidate master (fixed values).
CANDIDATE_MASTER = ["CAND_ID", "CAND_NAME", "CAND_PTY_AFFILIATION", "CAND_ELECTION_YR", "CAND_OFFICE_ST", "CAND_OFFICE", "CAND_OFFICE_DISTRICT", "CAND_ICI", "CAND_STATUS", "CAND_PCC", "CAND_ST1", "CAND_ST2", "CAND_CITY", "CAND_ST", "CAND_ZIP"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_master(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated, # comments and the optional header skipped."""
    schema = ", ".join(f"{c} string" for c in CANDIDATE_MASTER)
    return spark.read.csv(path, sep="|", comment="#", schema=schema).where(F.col("CAND_ID") != "CAND_ID")


def race_rows(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(races, candidates) of federal offices: race_key is year-state-office-district; one row a race."""
    c = candidates.where(F.col("CAND_OFFICE").isin("H", "S", "P") & F.col("CAND_STATUS").isin("C", "N"))
    key = F.concat_ws("-", "CAND_ELECTION_YR", "CAND_OFFICE_ST", "CAND_OFFICE", F.when(F.col("CAND_OFFICE") == "H", F.lpad("CAND_OFFICE_DISTRICT", 2, "0")))
    c = c.withColumn("race_key", key)
    return c.select("race_key", "CAND_ELECTION_YR", "CAND_OFFICE_ST", "CAND_OFFICE", "CAND_OFFICE_DISTRICT").dropDuplicates(["race_key"]), c


def tagged_csv(spark: SparkSession, path: str, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV whose `type` column names one of the kinds; rejects carry a reason."""
    names = "type name url notes category source_type office district party location election_date key_priorities".split()
    schema = ", ".join(f"{c} string" for c in [*names, "_bad"])
    return tagged(spark.read.csv(path, header=True, schema=schema, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE"), kinds)


def tagged(rows: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of rows (type, name, _bad: the text that did not parse, ...); rejects carry a reason."""
    reason = F.when(F.col("_bad").isNotNull(), "malformed").when(F.col("type").isNull() | ~F.lower(F.trim("type")).isin(kinds), "unknown type").when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason", "_bad"), rows.where("reason is not null")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, published."""
    x = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    when = F.regexp_replace("pubDate", "^[A-Za-z]{3}, *", "")
    return x.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.coalesce(*[F.try_to_timestamp(when, F.lit(f"d MMM yyyy HH:mm:ss {z}")) for z in ("z", "xx")]).alias("published"))


def geojson_box(spark: SparkSession, path: str) -> DataFrame:
    """One row: the bounding box of all polygon rings of a GeoJSON file."""
    g = spark.read.json(path, multiLine=True, schema="features array<struct<geometry: struct<coordinates: array<array<array<double>>>>>>")
    p = g.select(F.explode("features").alias("f")).select(F.explode("f.geometry.coordinates").alias("ring")).select(F.explode("ring").alias("p"))
    return p.agg(F.min(F.col("p")[0]).alias("west"), F.min(F.col("p")[1]).alias("south"), F.max(F.col("p")[0]).alias("east"), F.max(F.col("p")[1]).alias("north"))
