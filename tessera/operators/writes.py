"""Upserts, insert-ignore, deletes and audits as rewrites: Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], most: list[str] = (), least: list[str] = (), latest: list[str] = ()) -> DataFrame:
    """old and new as one row a key: the larger, the smaller, or the new side's (if not null) value of the columns named."""
    cols = [*keys, *most, *least, *latest]
    both = old.select(*cols, F.lit(0).alias("_seq")).unionByName(new.select(*cols, F.lit(1).alias("_seq")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in latest]
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in most], *[F.min(c).alias(c) for c in least], *last)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old plus the first new row (by order) of every key that old lacks."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(first.join(old, keys, "left_anti").select(*old.columns))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def table_digest(rows: DataFrame) -> DataFrame:
    """(rows, digest): independent of order, for comparing copies of a table."""
    return rows.select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sum("h").alias("digest"))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, before, after) of every value that differs, nulls included."""
    j = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns]).join(new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns]), key)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("before"), F.col(f"n_{c}").alias("after")) for c in columns])
    return j.select(key, F.explode(pairs).alias("p")).where(~F.col("p.before").eqNullSafe(F.col("p.after"))).select(key, "p.*")
