import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, quality, queries, urls


def brute_perplexity(trusted, texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney over characters, written plainly."""

    def symbols(t):
        return quality.PAD * (order - 1) + "".join("0" if c.isdigit() else " " if c in "\t\n\x0b\x0c\r" else c for c in t)

    counts = {order: Counter(s[i : i + order] for s in map(symbols, trusted) for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, contexts = {}, {}
    for k, c in counts.items():
        n = [max(sum(v == i for v in c.values()), 0) for i in range(6)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        discounts[k] = [0] + [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / max(n[i], 1))) for i in (1, 2, 3)]
        by = defaultdict(list)
        for g, v in c.items():
            by[g[:-1]].append(v)
        contexts[k] = by

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        k, lower = len(g), p(g[1:])
        seen = contexts[k].get(g[:-1])
        if not seen:
            return lower
        d, n = discounts[k], counts[k][g]
        w = sum(d[min(v, 3)] for v in seen) / sum(seen)
        return max(n - d[min(n, 3)], 0) / sum(seen) + w * lower

    out = []
    for s in map(symbols, texts):
        logs = [math.log(p(s[i : i + order])) for i in range(len(s) - order + 1)]
        out.append(math.exp(-sum(logs) / len(logs)))
    return out


@pytest.mark.parametrize("shard", [quality.SHARD, 30])
def test_perplexity_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(quality, "SHARD", shard)
    trusted = ["the cat sat on the mat in 2024", "the dog sat on the cat\nand the mat", "a cat and a dog and the end"]
    texts = [*trusted, "the cat and the dog sat", "zzzz qqqq 99", "é", "x" * 3000]
    rows = [(i, t, "en", i < len(trusted)) for i, t in enumerate(texts)] + [(90, None, "en", False), (91, "", "en", True), (92, "abc", "fr", False), (93, "abc", None, None), (94, "y", None, True), (0, "the mat", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").withColumn("row", F.lit("clash"))
    got = {(r.doc_id, r.symbols): r for r in quality.perplexities(df, df.where("good")).collect()}
    want = brute_perplexity(trusted, texts)
    for i, (t, p) in enumerate(zip(texts, want, strict=True)):
        assert got[i, len(t)].perplexity == pytest.approx(p, rel=1e-9)
    assert len(got) == len(rows) and got[0, 7].perplexity is not None
    assert got[90, 0].perplexity is None and got[91, 0].perplexity is None and got[92, 3].perplexity is None and got[93, 3].perplexity is not None
    assert quality.perplexities(df.limit(0), df.limit(0)).count() == 0


def test_quality_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op9_quality_classifier(spark, d).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert len(out) == 1000 and out.kept[good].mean() > 0.98
    noise = spark.createDataFrame([(1, "qx7 zzk!! 93 vvw kkq jx qqz wx" * 20, "en")], "doc_id long, text string, lang string")
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id > 1").select("doc_id", "text", "lang")
    judged = quality.classify(docs.unionByName(noise), spark.read.parquet(f"{d}/labels.parquet").where("doc_id > 1"))
    assert not judged.where("doc_id = 1").first().kept


def test_quality_against_a_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas().set_index("doc_id").sort_index()
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    trusted = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).where("good")
    held = {r.doc_id: r.h for r in trusted.select("doc_id", (F.pmod(F.xxhash64(F.lit(quality.HELD), "doc_id"), F.lit(quality.HELD)) == 0).alias("h")).collect()}
    for lang in {v[1] for v in texts.values()}:
        own = [i for i, v in sorted(texts.items()) if v[1] == lang]
        ppl = dict(zip(own, brute_perplexity([texts[i][0] for i in own if held.get(i) is False], [texts[i][0] for i in own]), strict=True))
        assert np.allclose(got.perplexity[own], [ppl[i] for i in own], rtol=1e-9)
        measured = sorted(ppl[i] for i in own if held.get(i))
        if not measured:  # no limit is known
            assert got.kept[own].all() and got.threshold[own].isna().all()
            continue
        limit = quality.MARGIN * measured[math.ceil(quality.QUANTILE * len(measured)) - 1]
        for i in own:
            assert got.threshold[i] == pytest.approx(limit * (1 + 8 / len(texts[i][0]) ** 0.5)) and got.kept[i] == (ppl[i] <= got.threshold[i])


def test_quality_edge_cases(spark):
    docs = [(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, None, "en"), (3, "", None), (None, "abc", "en"), (4, "abc", None), (5, "é" * 300_000, "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"total": F.lit("clash"), "good": F.lit(1)})
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = sorted(((r.doc_id or 0, r.kept) for r in quality.classify(df, known).collect()))
        assert got == [(0, True), (1, True), (1, True), (2, False), (3, False), (4, True), (5, True)]
    assert quality.classify(df.limit(0), labels).count() == 0


def test_neighbours_recall_and_edges(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    junk = spark.createDataFrame([(9000, None), (9020, [0.0] * 64), (9040, [float("inf")] * 64), (9060, [None] * 64), (9080, [1.0])], "vec_id long, embedding array<float>")
    got = ann.neighbours(e.select("vec_id", "embedding").unionByName(junk).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == set(ids[ids % 20 == 0].tolist())
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g.score) <= 0).all()
        assert np.allclose(g.score, [s[ids == v][0] for v in g.vec_id], atol=1e-12)
        hits += len(set(ids[order]) & set(g.vec_id))
    assert hits / len(got) > 0.95
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20)]
    assert ann.neighbours(few.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_and_null_ids(spark):
    """Every row but the query's own is a candidate, also where its vec_id repeats; rows without a vec_id take no part."""
    rows = [(1, [0.9, 0.1]), (1, [0.8, 0.3]), (2, [0.5, 0.0]), (0, [1.0, 0.0]), (None, [7.0, 0.0]), (0, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == sorted([(0, 1, 0, 2.0), (0, 2, 1, 0.9), (0, 3, 1, 0.8), (0, 4, 2, 0.5), (0, 1, 0, 2.0), (0, 2, 1, 1.8), (0, 3, 1, 1.6), (0, 4, 2, 1.0)])


def test_neighbours_are_exact(spark):
    """A group of 1000 copies: the 20 smallest vec_ids; near copies within the quantisation error: the true order."""
    rng = np.random.default_rng(2)
    a, b, noise = rng.standard_normal(16), rng.standard_normal(16), rng.standard_normal((900, 16))
    x = np.concatenate([np.tile(a, (1000, 1)), b + 1e-4 * noise, rng.standard_normal((1500, 16))]).astype(np.float32)
    ids = np.random.default_rng(3).permutation(len(x)).astype(np.int64)
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    asked = [int(ids[0]), int(ids[1000]), int(ids[2000])]
    got = {}
    for r in ann.neighbours(e.repartition(3), F.col("vec_id").isin(asked)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = x.astype(np.float64)
    for q in asked:
        s = sum(x[:, j] * x[ids == q][0][j] for j in range(16))
        assert got[q] == [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]


def test_neighbours_in_cells(spark, monkeypatch):
    """Clustered vectors in many cells: the result is that of brute force in double precision, and far cells are not searched."""
    monkeypatch.setattr(ann, "CODES", 100)
    rng = np.random.default_rng(6)
    mid = 10 * rng.standard_normal((30, 12))
    x = np.concatenate([c + 0.3 * rng.standard_normal((100, 12)) for c in mid] + [rng.standard_normal((50, 12))])
    ids = rng.permutation(len(x)).astype(np.int64)
    e = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(e.repartition(3), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == (ids % 20 == 0).sum()
    for q, found in got.items():
        s = sum(x[:, j] * x[ids == q][0][j] for j in range(12))
        best = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert found == [(int(ids[k]), s[k]) for k in best]


def test_many_url_rules(spark, monkeypatch):
    hosts = ["a.net", "b.a.net", "xa.net", "", "net", "c.d.org"]
    rows = spark.createDataFrame([(h, p) for h in hosts for p in ("", "/", "/en/x", "/en")], "host string, path string")
    rules = {"net/": "block", "a.net/en/": "allow", "org/": "block", "d.org/en": "allow", "b.a.net/": "allow"}
    which, verdict = urls.rule(F.col("host"), F.col("path"), rules)
    want = sorted(map(tuple, rows.select("host", "path", which, verdict).collect()), key=str)
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in urls.rule_table(rows, rules).collect()), key=str) == want


def test_url_rules_and_reputation(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://EXAMPLE.net/en/1?q#f": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://www.example.com/de/2": ("www.example.com", "/de/2", "example.com/de/", "block"),
        "http://notexample.com/de/2": ("notexample.com", "/de/2", None, "allow"),
        "ftp://x.org/fr/?a": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://ÀB.com?x://y": ("Àb.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    bad = [(1000 + i, f"http://bad.spam.example/{i}") for i in range(40)] + [(2000 + i, f"http://good.fine.example/{i}") for i in range(400)]
    pages = spark.createDataFrame([*enumerate(cases), *bad], "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(i, True) for i, _ in bad[:30]] + [(i, False) for i, _ in bad[40:400]] + [(5, None), (5, False)], "page_id long, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, outcomes, queries.RULES).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, i
    assert {got[i].verdict for i, _ in bad[:40]} == {"block"} and {got[i].verdict for i, _ in bad[40:]} == {"allow"}
    assert urls.judge(pages.limit(0), outcomes.limit(0), queries.RULES).count() == 0
