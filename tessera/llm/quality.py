"""Quality by an interpolated modified Kneser-Ney character n-gram model of trusted text, one per language.

Counts cover all trusted documents and stay distributed: tables of n-grams keyed by language, sharded by hash and joined.  The
distinct n-grams of all documents are joined with the count tables of all orders; the probabilities come back to the documents in shards of
bounded size, one language at a time, so a perplexity needs neither an n-gram occurrence nor a text to be shuffled.
Thresholds are quantiles of the perplexity, in each language, of trusted documents that the model has not seen.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import durable, small_batches

ORDER = 5
#: Trusted documents of a language beyond this quantile of perplexity, times MARGIN, set its limit.
QUANTILE, MARGIN = 0.99, 1.25
#: One trusted document of so many, by hash, is kept from the model and sets the limits.
HELD = 5
#: Trusted document ids that are broadcast; more are joined by a shuffle of the texts.
BROADCAST = 1_000_000
#: n-grams that a broadcast shard holds (about 100 MB on the driver), and that a task remembers having told; leading bits for look-up.
SHARD, TOLD, LEAD = 2_000_000, 1_000_000, 17
PIECE = 1 << 18
#: Symbols that a model is taken to choose from at order 0.
SYMBOLS = 1 << 12
PAD = "\x02"
#: Stands for a null language.
NO_LANG = "\x01"


def _symbols(text: str) -> np.ndarray:
    """Code points, digits as one and white space as one, with ORDER - 1 pads before."""
    code = np.frombuffer((PAD * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[(code >= 48) & (code <= 57)] = 48
    code[(code >= 9) & (code <= 13)] = 32
    code[(code >= 0xD800) & (code < 0xE000)] = 0xFFFD
    return code


_FACTOR = np.random.Generator(np.random.PCG64(21)).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(code: np.ndarray) -> np.ndarray:
    h = np.zeros(max(len(code) - ORDER + 1, 0), np.uint64)
    for j in range(ORDER):
        h += code[j : j + len(h)].astype(np.uint64) * _FACTOR[j]
    return h ^ (h >> np.uint64(29))


def _windows(texts: list[str]):
    """(symbols, keys, starts) of pieces of the joined texts: hashes of all ORDER-grams that lie in one text, and where they start."""
    codes = [_symbols(t) for t in texts]
    whole = np.concatenate(codes)
    inner = np.ones(len(whole), bool)
    ends = np.cumsum([len(c) for c in codes])
    for j in range(1, ORDER):
        inner[ends - j] = False  # a text has ORDER - 1 pads at least
    for a in range(0, len(whole) - ORDER + 1, PIECE):
        part = whole[a : a + PIECE + ORDER - 1]
        at = np.flatnonzero(inner[a : a + len(part) - ORDER + 1])
        yield part, _keys(part)[at], at


def _joined(batch: pa.RecordBatch, text: int) -> dict:
    by: dict = {}
    for k, t in zip(batch.column(0).to_pylist(), batch.column(text).to_pylist(), strict=True):
        if t:
            by.setdefault(k, []).append(t)
    return by


def counts(trusted: DataFrame) -> DataFrame:
    """(lang, gram, n): ORDER-grams of trusted (lang, text), summed per batch before they are shuffled."""

    def run(batches):
        for batch in batches:
            for lang, texts in _joined(batch, 1).items():
                for part, keys, at in _windows(texts):
                    _, first, n = np.unique(keys, return_index=True, return_counts=True)
                    grams = [part[i : i + ORDER].tobytes().decode("utf-32-le") for i in at[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    rows = trusted.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Count tables by order: (lang, gram, n) and (lang, context, total, n1, n2, n3), and discounts (lang, d1, d2, d3)."""

    def __init__(self, top: DataFrame):
        self.grams, self.contexts, self.discounts = {ORDER: durable(top, "grams")}, {}, {}
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many distinct characters stand before
            wider = self.grams[k + 1].select("lang", F.substring("gram", 2, k).alias("gram"))
            self.grams[k] = durable(wider.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
        for k, g in self.grams.items():
            kinds = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)] + [F.count_if(F.col("n") >= 3).alias("n3")]
            context = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
            self.contexts[k] = durable(g.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), *kinds), "contexts")
            c = g.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"c{i}") for i in range(1, 5)])
            y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
            d = [F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"c{i + 1}") / F.greatest(F.col(f"c{i}"), F.lit(1.0)))).alias(f"d{i}") for i in (1, 2, 3)]
            self.discounts[k] = c.select("lang", *d)

    def scored(self, grams: DataFrame) -> DataFrame:
        """(lang, gram, logp) of distinct (lang, gram): the log-probability of the last character after the others."""
        rows = grams.withColumn("p", F.lit(1.0 / SYMBOLS))
        for k in range(1, ORDER + 1):
            suffix = F.substring("gram", ORDER - k + 1, k)
            own = self.grams[k].select("lang", F.col("gram").alias("_g"), "n")
            ctx = self.contexts[k].join(F.broadcast(self.discounts[k]), "lang")  # a row per language
            ctx = ctx.select("lang", F.col("context").alias("_c"), "total", *[f"d{i}" for i in (1, 2, 3)], ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("w"))
            rows = rows.withColumn("_g", suffix).withColumn("_c", F.substring("_g", 1, k - 1) if k > 1 else F.lit(""))
            rows = rows.join(own, ["lang", "_g"], "left").join(ctx, ["lang", "_c"], "left")
            d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
            seen = F.coalesce(F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total"), F.lit(0.0))
            rows = rows.withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen + F.col("w") * F.col("p"))).select("lang", "gram", "p")
        return rows.select("lang", "gram", F.log("p").alias("logp"))


def _distinct(batches):
    """Distinct (lang, gram) of a task's texts; what has been told is remembered, up to TOLD grams."""
    told = Sorted(np.zeros(0, np.uint64))
    for batch in batches:
        for lang, texts in _joined(batch, 1).items():
            salt = _salt(lang)
            for part, keys, at in _windows(texts):
                keys ^= salt
                lost = ~told.find(keys)[1]
                new, first = np.unique(keys[lost], return_index=True)
                if not len(new):
                    continue
                grams = [part[i : i + ORDER].tobytes().decode("utf-32-le") for i in at[lost][first].tolist()]
                told = Sorted(new if len(told.keys) > TOLD else np.sort(np.concatenate([told.keys[:-1], new])))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string())], names=["lang", "gram"])


class Sorted:
    """A sorted array of 64-bit keys, entered by their leading bits; its last element is a guard."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.begin = np.searchsorted(self.keys, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the key is there)."""
        at = self.begin[(h >> np.uint64(64 - LEAD)).astype(np.int64)]
        on = np.flatnonzero(self.keys[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < h[on]]
        return at, self.keys[at] == h


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Shard:
    """Sorted keys and log-probabilities of at most SHARD n-grams, entered by their leading bits."""

    def __init__(self, t: pa.Table):
        code = np.frombuffer("".join(t.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        h = np.zeros(len(code), np.uint64)
        for j in range(ORDER):
            h += code[:, j].astype(np.uint64) * _FACTOR[j]
        h ^= h >> np.uint64(29)
        langs = t.column("lang").combine_chunks().dictionary_encode()
        if len(langs):
            h ^= np.array([_salt(v) for v in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
        order = np.argsort(h)
        self.table = Sorted(h[order])
        self.logp = np.append(t.column("logp").to_numpy()[order], 0.0)

    def total(self, h: np.ndarray) -> np.ndarray:
        """Log-probabilities of keys; 0 for those of other shards."""
        at, there = self.table.find(h)
        return np.where(there, self.logp[at], 0.0)


def _passes(sizes: dict[str, int], most: int) -> list[tuple[list[str], int, int]]:
    """(languages, parts, part): a language of more than `most` n-grams is cut into parts, small ones stand together."""
    out, rest, held = [], [], 0
    for lang, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if n > most:
            parts = -(-n // most)
            out += [([lang], parts, i) for i in range(parts)]
            continue
        if rest and held + n > most:
            out.append((rest, 1, 0))
            rest, held = [], 0
        rest, held = [*rest, lang], held + n
    return [*out, (rest, 1, 0)] if rest else out


def _scoring(known):
    """A task that adds up, per row of (lang, text, t1, t2, doc_id), the log-probabilities of the n-grams in the broadcast table."""

    def run(batches):
        table = known.value
        for batch in batches:
            codes = [_symbols(t or "") for t in batch.column(1).to_pylist()]
            salts = np.array([_salt(v) for v in batch.column(0).to_pylist()], np.uint64)
            size = np.array([len(c) for c in codes], np.int64)
            total = np.zeros(len(codes))
            ends = np.cumsum(size)
            # Rows in groups of about PIECE symbols, and a longer text in pieces.
            r = 0
            while r < len(codes):
                e = max(r + 1, int(np.searchsorted(ends, (ends[r - 1] if r else 0) + PIECE, "right")))
                whole = codes[r] if e == r + 1 else np.concatenate(codes[r:e])
                owners = np.repeat(np.arange(r, e), size[r:e])
                for a in range(0, max(len(whole) - ORDER + 1, 0), PIECE):
                    part, owner = whole[a : a + PIECE + ORDER - 1], owners[a : a + PIECE + ORDER - 1]
                    inside = owner[: len(part) - ORDER + 1] == owner[ORDER - 1 :]
                    who = owner[: len(inside)][inside]
                    total += np.bincount(who, table.total(_keys(part)[inside] ^ salts[who]), minlength=len(codes))
                r = e
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), batch.column(2), batch.column(3), pa.array(size - ORDER + 1, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "lang", "t1", "t2", "symbols", "total"])

    return run


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, symbols, perplexity) for every row of docs (doc_id, text, lang), by the model of trusted (text, lang).

    perplexity: per character, null for a null or empty text and where the language has no trusted text.  A null lang is a language of its own, shown as null.
    Texts are never shuffled.  The priced n-grams of a language are cut by hash into shards of about SHARD (small languages share one), and each
    is broadcast in turn, so a broadcast has a bound; a pass reads the texts of its languages alone and adds up what the shard knows.  Where a language
    has several shards, its rows are named by doc_id and two hashes of the text, which do not depend on how the table is read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    base = docs.select(lang, text, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("doc_id").cast("long").alias("doc_id"))
    model = Model(counts(trusted.select(lang, text)))
    asked = base.select("lang", "text").mapInArrow(_distinct, "lang string, gram string").distinct()
    priced = durable(model.scored(asked), "priced")
    sizes = {r["lang"]: r["n"] for r in priced.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    schema = "doc_id long, lang string, t1 long, t2 long, symbols long, total double"
    found = []
    for langs, parts, part in _passes(sizes, SHARD):
        own = F.col("lang").isin(langs)
        table = priced.where(own & (F.pmod(F.xxhash64("gram"), F.lit(parts)) == part))
        known = spark.sparkContext.broadcast(Shard(table.toArrow()))
        one = base.where(own).mapInArrow(_scoring(known), schema).withColumn("parts", F.lit(parts))
        found.append(durable(one, "sums"))
        known.destroy()
    empty = base.where(~F.col("lang").isin(list(sizes))) if sizes else base  # no symbol in any text of the language
    out = empty.select("doc_id", "lang", F.lit(0).cast("long").alias("symbols"), F.lit(0.0).alias("total"))
    for one in found:
        out = out.unionByName(one.where("parts = 1").select("doc_id", "lang", "symbols", "total"))
    if several := [x.where("parts > 1") for x in found]:
        rows = reduce(DataFrame.unionByName, several).groupBy("doc_id", "lang", "t1", "t2", "symbols", "parts").agg(F.sum("total").alias("total"), F.count("*").alias("n"))
        # Equal rows were added together: each pass gave a row for every one of them.
        same = (F.col("n") / F.col("parts")).cast("int")
        rows = rows.withColumn("total", F.col("total") / same).withColumn("again", F.explode(F.sequence(F.lit(1), same)))
        out = out.unionByName(rows.select("doc_id", "lang", "symbols", "total"))
    seen = F.broadcast(model.contexts[1].select("lang", F.lit(True).alias("known")))  # a row per language
    out = out.join(seen, "lang", "left")
    ppl = F.when((F.col("symbols") > 0) & F.col("known"), F.exp(-F.col("total") / F.col("symbols")))
    return out.select("doc_id", F.when(F.col("lang") != NO_LANG, F.col("lang")).alias("lang"), "symbols", ppl.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, symbols, perplexity, threshold, kept) for every row of docs.

    labels: doc_id, quality, toxic; trusted are documents with quality 1 and not toxic in every label they have.  All but every HELDth of them
    by hash train the model, and these set the threshold: kept is a perplexity of at most margin times their quantile in the language, higher for short texts, which vary more.
    Where a language has no threshold, or a text no perplexity, it is kept, except that null and empty texts are not.  Repeated rows get a
    row each, a null doc_id is never trusted, an empty table gives an empty result, and without labels everything with text is kept.  Other columns are ignored.
    """
    good = labels.groupBy("doc_id").agg((F.min(F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("good"))
    held = F.pmod(F.xxhash64(F.lit(HELD), "doc_id"), F.lit(HELD)) == 0
    good = durable(good.where("good and doc_id is not null").select("doc_id", held.alias("held")), "trusted")
    ids = good.where("not held").select("doc_id")
    trusted = docs.select("doc_id", "text", "lang").join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_semi")
    scored = durable(perplexities(docs.select("doc_id", "text", "lang"), trusted), "perplexity")
    measured = scored.where("perplexity is not null").join(good.where("held").select("doc_id"), "doc_id", "left_semi")
    cut = measured.groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("limit"))
    out = scored.join(F.broadcast(cut.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")), "left")  # a row per language
    limit = F.col("limit") * (1 + 8 / F.sqrt(F.greatest(F.col("symbols"), F.lit(1))))
    kept = (F.col("symbols") > 0) & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "symbols", "perplexity", limit.alias("threshold"), kept.alias("kept"))
