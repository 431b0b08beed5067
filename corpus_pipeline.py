"""A corpus pipeline: language ID, near-dedup, PII, mixing, packing.  Each stage's result is stored as Parquet and read back."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mixing, packing, pii, store
from tessera.llm.queries import vocabulary


#: Tables that the last stage wrote on its way; its result is stored before the next stage begins.
_tables: list[str] = []


def _stage(work):
    """A stage that first deletes what the stage before it wrote on its way."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.release(spark, _tables)
        with store.scope() as tables:
            out = work(spark, docs, sf_dir)
        _tables.extend(tables)
        return out

    return stage


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs stored with a number for each row, so that every later reading gives a row the same one; and that column's name."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return store.durable(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; their columns stay as they are.  A null text, or one without a letter, has none."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("own")
    found = langid.identify(docs.select("doc_id", "lang", "text", others)).where(~F.col("rejected"))
    return found.select(*[F.col("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])


@_stage
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null last), and of equal doc_ids the first row.

    Rows are compared as such, so different texts of one doc_id stay, and its copies go.  Texts without words are no copies and stay.
    """
    numbered, row = _numbered(docs)
    groups = minhash.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = groups.join(numbered.select(row, F.col("doc_id").alias("named")), row).groupBy("component_id")
    first = first.agg(F.min(F.struct(F.col("named").isNull().alias("unnamed"), "named", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


@_stage
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for what is personal; n_chars follows the text, null with it."""
    out = pii.pseudonymise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; documents with nothing to take are left out."""
    numbered, row = _numbered(docs)
    copies = mixing.mix(numbered.select(row, "doc_id", "source", "text"), row=F.col(row)).where("copies > 0")
    copies = copies.select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return numbered.join(copies.select(row), row).select(*docs.columns)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, one sequence each; a null text is its end id alone."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Models, hashes and a tokenizer are beyond SQL; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; only its table stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{store.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            store.remove(spark, f"{at}/{i - 1}")
    store.release(spark, _tables)
    return docs
