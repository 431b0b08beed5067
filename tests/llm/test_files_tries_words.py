"""Operators 11 to 13 against brute force, on hard rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, spelling, tokens, trie
from tessera.llm.mph import MinimalHash, fingerprint

DATA = "/root/testdata/sf0.001"


# ---- op11: token files


def plain_tokens(rows):
    """(doc_id, start, n_tokens, crc) by the library itself, for distinct doc_ids."""
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(queries.words()), 0, []
    for doc, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_against_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_token_files(spark, DATA).collect()) == plain_tokens(rows)


HARD = [None, "", " \t\n", "A", "don't It'S ''S x'll", "<|endoftext|> a <|startoftext|>", "Ünïcödé İstanbul ẞß ΣΑΣ", "é é", "日本語 テスト", "1234 ½²", "a\x00b\x1c c d　e\x85f", "😀!!--__", "x" * 5000, "y " * 200_000, "¡Hola! ¿Qué?"]


def test_token_files_on_hard_texts(spark):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choice("aB1 .,'\téİǅ<|>s") for _ in range(60)) for _ in range(300)]
    rows = list(enumerate(texts, -5))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "file": F.lit(None).cast("int")}).repartition(5)
    written = tokens.write(df, queries.words(), shards=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in written.read().collect())
    assert got == plain_tokens(rows)
    asked = spark.createDataFrame([(0, 0), (7, 0), (7, 1), (10**9, 0), (None, 0)], "doc_id long, nth long")
    assert sorted((r.doc_id, r.nth) for r in written.read(asked).collect()) == [(0, 0), (7, 0)]


def test_token_files_of_repeated_and_null_ids(spark):
    rows = [(1, f"w{i}") for i in range(40)] + [(1, "same")] * 30 + [(None, "n"), (None, "n"), (0, "first"), (2, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written = tokens.write(df, queries.words(), shards=6)
    got = written.read().orderBy("start").collect()
    assert [r.doc_id for r in got] == [0, *[1] * 70, 2, None, None]
    assert sorted(r.nth for r in got if r.doc_id == 1) == list(range(70)) and sorted(r.nth for r in got if r.doc_id is None) == [0, 1]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert Counter(r.ids for r in got if r.doc_id == 1).most_common(1)[0][1] == 30
    empty = tokens.write(df.limit(0), queries.words())
    assert empty.read().count() == 0 and empty.shards.count() == 0


def test_long_texts_are_looked_up_in_stretches(monkeypatch):
    enc = tokens.WordEncoder(queries.words())
    text = " ".join(f"Word{i % 997}\n{i % 10}!?" for i in range(400_000))
    tracemalloc.start()
    (ids,) = enc.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 < 50 * len(text) and ids.tolist() == enc.plain([text])[0].tolist()
    monkeypatch.setattr(tokens, "LOOKED_UP", 7)
    rng = random.Random(4)
    texts = ["x" * 50, " " * 50, "\n", ""] + ["".join(rng.choice("aB1 .,'\t\réİ<|>s") for _ in range(rng.randrange(90))) for _ in range(300)]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_later_stages_of_token_files_hold_no_encoder(spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(200)], "doc_id long, text string")
    written = tokens.write(df, queries.words(), shards=4)
    assert len(written.index.inputFiles()) == 1 and written.index.count() == 4 == written.index.select("file").distinct().count()
    tokens.encoder(queries.words())
    tokens.drop_encoders()
    assert not tokens._encoders


def test_minimal_hash():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 2, 1000, 50_000):
        h = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        hashed, end = MinimalHash.load(b"12345678" + MinimalHash.build(*h).dump(), 8)
        assert np.array_equal(np.sort(hashed.find(*h)), np.arange(n))
        other = rng.integers(0, 2**63, (2, 1000), dtype=np.uint64)
        at = hashed.find(*other)
        prints = np.zeros(n, np.uint32)
        prints[hashed.find(*h)] = fingerprint(*h)
        assert ((at >= -1) & (at < max(n, 1))).all() and not (prints[at[at >= 0]] == fingerprint(*other)[at >= 0]).any()
    with pytest.raises(ValueError):
        MinimalHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


# ---- op12: prefix tries


def plain_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    seqs = {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(x)] for c, x in by.items()}
    made = {c: seqs.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + x[h:] for c, x in seqs.items()}
    members = defaultdict(list)
    for c, x in sorted(made.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * (len(k[-1][1]) if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "depth": F.lit(None).cast("int")}).repartition(3)
    return sorted((tuple(r) for r in trie.nodes(trie.rebuilt(df)).collect()), key=str)


def test_trie_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_prefix_trie(spark, DATA).collect()), key=str) == plain_trie(rows)


@pytest.mark.parametrize("shard", [1, 7, 1024])
def test_trie_of_hard_conversations(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "SPAN", 10)
    rng = random.Random(shard)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü😀", None, ""])) for c in rng.sample(range(0, 450), 120) for t in range(rng.randrange(1, 9))]
    rows += [(c, None, None, None) for c in (2, 5, 5, 101)] + [(700, t, "user", "long" * (t % 3)) for t in range(300)] + [(800 + i, t, "user", "copy") for i in range(60) for t in range(4)]
    rows += [(None, 0, "user", "lost"), (1005, 0, "u", "base absent"), (901, 3, "b", "a"), (901, 3, "a", "b"), (901, 3, "a", "b"), (950, 0, "ab", "c"), (951, 0, "a", "bc")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 0, "user", "x")]) == []


def test_louds_parents_and_sums():
    key = np.array([(i, 0) for i in (5, 3, 9, 1, 7, 8)], [("a", np.int64), ("b", np.int64)])
    up = np.array([(i, 0) for i in (0, 5, 5, 3, 0, 3)], [("a", np.int64), ("b", np.int64)])
    t = trie.Louds(np.zeros(6), key, up)
    assert [key[i][0] for i in t.order] == [5, 7, 3, 9, 1, 8]
    assert t.parents().tolist() == [-1, -1, 0, 0, 2, 2] and t.degrees().tolist() == [2, 0, 2, 0, 0, 0]
    assert t.rolled_up(np.ones(6, np.int64)).tolist() == [5, 1, 3, 1, 1, 1]


# ---- op13: spelling variants


def plain_words(docs, slips=97):
    out = Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    vocabulary = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in vocabulary.items():
        those = sorted((x for x in vocabulary if abs(len(x) - len(w)) < 2 and x != w and near(x, w)), key=lambda x: (-vocabulary[x], x))
        form[w] = those[0] if those and vocabulary[those[0]] >= 2 * n else None
        out[w] = (n, len(those))
    rows = []
    for w, (n, k) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, k, vocabulary[form[w]] if form[w] else None))
    return sorted(rows)


def variants_of(spark, docs, slips=97):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")}).repartition(3)
    return sorted(tuple(r) for r in spelling.variants(spelling.words(df, slips)).collect())


def test_variants_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_spelling_variants(spark, DATA).collect()) == plain_variants(plain_words(docs))


def test_variants_of_hard_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    monkeypatch.setattr(spelling, "KEYS", 64)
    rng = random.Random(4)
    base = ["hello", "helllo", "hallo", "hallos", "aaaaa", "aaaaaa", "aaaaab", "étéété", "ÉTÉÉTÉ", "×÷×÷×÷", "abcde", "abcdé", "zabcde", "x" * 300, "x" * 299 + "y"]
    words = base + ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    text = [rng.choice([" ", "-", "\n", "1"]).join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in rng.choices(words, k=rng.randrange(80))) for _ in range(120)]
    docs = [*enumerate(text), (None, "hello hello"), (None, None), (5, ""), (6, "ŒuvreŒ 日本"), (7, "hallo hallo"), (7, "hallo hallo")]
    for slips in (97, 3):
        assert variants_of(spark, docs, slips) == plain_variants(plain_words(docs, slips))
    assert variants_of(spark, []) == []


def test_chains_of_forms(spark):
    chain = [("abcde", 400), ("abcdf", 200), ("abcgf", 100), ("abhgf", 50), ("aihgf", 25), ("jihgf", 12), ("jihgk", 6), ("jihlk", 3)]
    counts = spark.createDataFrame([*chain, (None, 9)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(counts).collect()}
    assert got == {w: (chain[i - 1][0] if i else None, "abcde") for i, (w, _) in enumerate(chain)}
