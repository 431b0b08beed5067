"""Ranked text search without an index: phrase first, any token if nothing has the phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase_or_any(docs: DataFrame, doc: str, text: str, query: str, limit: int) -> DataFrame:
    """(doc, hits, phrase): documents with the phrase, else those with any of its words; most hits first, then doc."""
    low = F.lower(text)
    words = [w for w in query.lower().split() if w]
    hits: Column = sum((F.regexp_count(low, F.lit(rf"\b{w}\b")) for w in words), F.lit(0))
    rows = docs.select(doc, hits.alias("hits"), low.contains(query.lower()).alias("phrase")).where("hits > 0 or phrase")
    some = rows.agg(F.coalesce(F.max("phrase"), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(some)).where("phrase or not _any").orderBy(F.desc("hits"), doc).limit(limit).select(doc, F.col("hits").cast("long").alias("hits"), "phrase")


def contains_escaped(column: Column, term: str) -> Column:
    """Case-insensitive substring; the term's % and _ are ordinary characters."""
    return F.lower(column).contains(term.lower())
