"""The pipeline against a plain version of each stage, on the smallest tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii, store
from tessera.llm.queries import vocabulary
from tests.llm.test_dedup import brute
from tests.llm.test_text_ops import plain_shares

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i for i, (_, c) in brute([(i, r.text) for i, r in rows.items()]).items() if i == c}
    stage = dict(corpus_pipeline.STAGES)
    assert stage["language ID"](spark, docs, DATA).count() == len(rows)  # all are prose
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(out.doc_id) <= kept
    clean = pii.pseudonymise(docs.where(docs.doc_id.isin(list(kept)))).toPandas().set_index("doc_id")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in clean.text.items()}
    by = Counter()
    for i in kept:
        by[rows[i].source] += size[i]
    want = plain_shares(dict(by))
    t = Tokenizer.from_file(vocabulary())
    ids = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in clean.text.items()}
    taken, most = Counter(), Counter()
    for i, g in out.groupby("doc_id"):
        copies, rest = divmod(int(g.length.sum()), ids[i])
        assert rest == 0 and copies in (1, 2) and (g.doc_tokens == ids[i]).all()
        taken[rows[i].source] += copies * size[i]
    for i in kept:
        most[rows[i].source] = max(most[rows[i].source], size[i])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in by)
    assert out.sequence_id.is_unique and (out.offset == 0).all()


def test_stages_on_hard_rows(spark):
    """Nulls, empty and repeated rows, different texts of one doc_id, clashing columns, empty tables: every stage, on its own."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from the old house "
    rows = [(1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (1, "another text of the same number that is quite unlike the first one", "en", "b", 2), (2, None, "en", "a", None), (3, "", None, None, 0)]
    rows += [(None, prose, None, "b", 5), (None, "a line of its own with enough words in it to be told", "en", "b", 5), (4, "12 34", "en", "b", 5), (5, prose * 3000, "en", "a", 9), (6, "x@y.org " + prose, "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("clash") for c in ("_row", "score", "rejected", "copies", "size", "n_pii", "component_id", "taken")})
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DATA)
        got[name] = out.collect()
        assert out.columns == (df.columns if "packing" not in name else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        assert stage(spark, df.limit(0), DATA).count() == 0
    store.release(spark, corpus_pipeline._tables)
    named = lambda name: sorted((r.doc_id or 0, (r.text or "")[:9]) for r in got[name])
    assert named("language ID") == sorted((i or 0, t[:9]) for i, t, *_ in rows if t and re.search("[a-z]", t))
    assert named("MinHash near-dedup") == sorted([(1, prose[:9]), (1, "another t"), (2, ""), (3, ""), (0, "a line of"), (4, "12 34")])
    assert len(got["PII"]) == len(rows) and {r.n_chars for r in got["PII"] if r.doc_id == 3} == {0} and not any("y.org" in (r.text or "") for r in got["PII"])
    assert {r.doc_id for r in got["mixing sources"]} <= {1, None, 4, 5, 6} and all(r.text for r in got["mixing sources"])
    assert sum(r.start == 0 for r in got["packing"]) == len(rows)
