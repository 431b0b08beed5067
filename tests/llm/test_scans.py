"""A scan that is planned anew may be split otherwise; results must not follow the place of a row in it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i % 37, f"text number {i % 37} of a few {i % 5} words and {i % 37} more", "en", "ab"[i % 37 % 2]) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/docs")
    yield spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.unset(SPLIT)
    spark.conf.unset(OPEN)


def split(spark, many):
    spark.conf.set(SPLIT, "1k" if many else "64m")
    spark.conf.set(OPEN, "1k" if many else "1")


def test_mixing_stage(spark, docs):
    split(spark, False)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    want = sorted(mixed.collect(), key=str)
    split(spark, True)
    assert len(want) > 0 and sorted(mixed.where(F.lit(True)).collect(), key=str) == want
