"""What operators leave behind while a longer job goes on: stored tables, and jobs that the driver keeps in mind."""

import os
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, store
from tessera.llm.components import connected_components


def left(paths: list[str]) -> list[str]:
    return [os.path.basename(p).split("-")[0] for p in paths if os.path.exists(p.removeprefix("file://"))]


def test_rounds_of_components_are_released(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with store.scope() as tables:
        got = connected_components(chain)
    assert sorted(left(tables)) == ["edges", "labels"]
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(301)}
    store.release(spark, tables)
    with store.scope() as tables:
        assert connected_components(chain.limit(0)).count() == 0
    store.release(spark, tables)


def test_near_duplicates_keep_what_they_are_read_from(spark):
    words = "one two three four five six seven eight nine ten eleven twelve "
    rows = [(i, words * 4 + ("" if i < 150 else f"end{i % 7}")) for i in range(300)] + [(300, "a text that is like none of them at all"), (301, None)]
    with store.scope() as tables:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(left(tables)) == ["components", "signatures"]
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, 0) for i in range(300)} | {(300, 300), (301, 301)}
    store.release(spark, tables)


def test_scopes_end_in_order(spark):
    with store.scope() as outer:
        with store.scope() as inner:  # as empty as the one around it
            pass
        store.durable(spark.range(1), "one")
    assert (len(outer), inner) == (1, [])
    store.release(spark, outer)


def test_a_sample_takes_few_jobs(spark):
    """The shuffle's partitions are not a job each."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = spark.createDataFrame([(i, f"text number {i} of its language", f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("sample", "sample")
        got = langid.sample(docs, "text", "lang", "doc_id", F.lit(True), 5)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sample")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == {"l0", "l1", "l2"} and all(1 <= len(v) <= 5 for v in got.values())
    assert 0 < len(jobs) < 20


def held() -> float:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_release_gives_freed_memory_back(spark):
    """Pieces freed between others that stay are not the driver's for good."""
    texts = [str(i) * 400 for i in range(60_000)]
    some = texts[::2000]
    full = held()
    del texts
    store.release(spark, [])
    assert full - held() > 70 and len(some) == 30


def test_a_model_copies_no_symbol_for_each_place_of_an_ngram():
    """Top-order n-grams are read from the texts where they stand: beside hashes and their sort nothing is as long as the texts."""
    rng = np.random.default_rng(5)
    code = [langid.symbols(" ".join(map("".join, rng.choice(list("abcdef"), (n, 4))))) for n in rng.integers(1, 900, 40)]
    texts = {"a": code[:20], "b": code[20:]}
    model = langid.Model.of(texts)
    grams = [c[i : i + langid.ORDER] for c in code for i in range(len(c) - langid.ORDER + 1)]
    _, first = np.unique(np.concatenate([langid.gram_hashes(c, langid.ORDER) for c in code]), return_index=True)
    assert (model.full == model._grams(np.array(grams)[first]).astype(np.float32)).all()
    many = {k: v * 100 for k, v in texts.items()}
    tracemalloc.start()
    try:
        model.top(many)
        assert tracemalloc.get_traced_memory()[1] < 45 * 100 * sum(map(len, code))
    finally:
        tracemalloc.stop()
