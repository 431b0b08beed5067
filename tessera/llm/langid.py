"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

The model is fitted on a bounded sample of labelled rows (FIT_DOCS per language, a documented parameter, each text whole),
chosen by hash; prediction covers every whole text.  Up to ABREAST languages share one sorted array of n-gram hashes per
order, with a column of probabilities (or of back-off weights) per language, so one binary search serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.store import durable, release, scope, small_batches, trim
from tessera.llm.textual import _odd, mix

ORDER = 5
#: Fitted documents per language, and characters that may be fitted per language; of these every fourth document calibrates.
FIT_DOCS, FIT_CHARS = 400, 4_000_000
#: Characters fitted of all languages together: many languages share them equally.
FIT_TOTAL = 16_000_000
#: Languages whose models share one array; more languages have several.
ABREAST = 16
#: Characters scored at a time.
PIECE = 1 << 18
#: Unseen n-grams whose scores a worker keeps; then it starts afresh.
KEPT = 500_000
#: Leading bits of a hash by which a sorted array is entered.
LEAD = 17
#: Bits by which the limit of rejection is raised for a text of one symbol; it falls with the square root of the length.
SHORT = 8.0
UNKNOWN = "und"

_MULT = _odd(31, ORDER + 1)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter (any Unicode category L); made once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of anything else is one space; ORDER - 1 spaces before, one after."""
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 32)
    keep = code != 32
    keep[1:] |= code[:-1] != 32
    keep[0] = False
    return np.append(np.full(ORDER - 1, 32, np.uint32), code[keep])


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams; element i ends at i + n - 1."""
    if len(code) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(code) - n + 1, np.uint64)
    wide = code.astype(np.uint64)
    for j in range(n):  # the last character has the first factor, so a suffix keeps its factors
        h += wide[n - 1 - j : len(wide) - j] * _MULT[j]
    return mix(h + np.uint64(n))


def _counts(parts: list[np.ndarray], n: int):
    """Distinct n-grams of several texts: hash, count, hash of the context, of the suffix and of the suffix's context."""
    keys, contexts, suffixes = [], [], []
    for c in parts:
        k = gram_hashes(c, n)
        keys.append(k)
        contexts.append(gram_hashes(c[:-1], n - 1) if n > 1 else np.zeros(len(k), np.uint64))
        suffixes.append(gram_hashes(c[1:], n - 1) if n > 1 else np.zeros(len(k), np.uint64))
    key, first, count = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
    return key, count, np.concatenate(contexts)[first], np.concatenate(suffixes)[first]


def kneser_ney(parts: list[np.ndarray], order: int = ORDER):
    """Interpolated Kneser-Ney model of symbol sequences, lowest order first.

    Per order: sorted hashes and probabilities of the seen n-grams (lower orders: of continuation counts), and
    sorted hashes and interpolation weights of their contexts.  The lowest order is interpolated with the uniform
    distribution over the seen symbols and one unseen.
    """
    parts = [c for c in parts if len(c) >= order]
    orders = []
    for n in range(1, order + 1):
        key, count, context, suffix = _counts(parts, n)
        if n < order:
            _, _, _, ends = _counts(parts, n + 1)  # one row per distinct (n+1)-gram: its suffix is continued once
            seen, times = np.unique(ends, return_counts=True)
            at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            count = np.where(seen[at] == key, times[at], 1)
        n1, n2 = int((count == 1).sum()), int((count == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        ctx, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(where, count)
        weight = discount * kinds / total
        if n == 1:
            lower = np.full(len(key), 1.0 / (len(key) + 1))
        else:
            low = orders[-1]
            lower = low[1][np.searchsorted(low[0], suffix)]
        orders.append((key, np.maximum(count - discount, 0) / total[where] + weight[where] * lower, ctx, weight))
    return orders


@dataclass
class Model:
    """Models of several languages side by side: per order sorted hashes, and float32 columns by language."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None
    full: np.ndarray | None = None
    known: tuple | None = None
    kept: int = KEPT

    @classmethod
    def of(cls, texts: dict[str, list[np.ndarray]]) -> Model:
        m = cls(sorted(texts))
        single = [kneser_ney(texts[lang]) for lang in m.languages]
        m.floor = np.array([np.log(s[0][3][0] / (len(s[0][0]) + 1)) for s in single], np.float32)
        for n in range(ORDER):
            keys = np.unique(np.concatenate([s[n][0] for s in single]))
            contexts = np.unique(np.concatenate([s[n][2] for s in single]))
            logp = np.full((len(keys), len(single)), np.nan, np.float32)
            weights = np.zeros((len(contexts), len(single)), np.float32)
            for i, s in enumerate(single):
                logp[np.searchsorted(keys, s[n][0]), i] = np.log(s[n][1])
                weights[np.searchsorted(contexts, s[n][2]), i] = np.log(s[n][3])
            m.keys.append(keys)
            m.logp.append(logp)
            m.contexts.append(contexts)
            m.weights.append(weights)
        m.top(texts)
        return m

    def score(self, code: np.ndarray) -> np.ndarray:
        """Log-probability (nats) of each symbol from the ORDER-th on, per language.  What no language has seen is kept."""
        h = gram_hashes(code, ORDER)
        if self.known is None or len(self.known[0]) > len(self.full) + self.kept:
            self._keep(self.keys[-1], self.full)
        at = self._find(h)
        lost = np.flatnonzero(self.known[0][at] != h)
        if len(lost):
            new, first = np.unique(h[lost], return_index=True)
            rows = self._grams(code[lost[first][:, None] + np.arange(ORDER)]).astype(np.float32)
            place = np.searchsorted(self.known[0], new)
            self._keep(np.insert(self.known[0], place, new), np.insert(self.known[1], place, rows, axis=0))
            at = self._find(h)
        return self.known[1][at]

    def _keep(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Sorted hashes, their rows, and where each value of the leading bits begins among them."""
        begin = np.searchsorted(keys, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD))
        self.known = (keys, rows, np.minimum(begin, len(keys) - 1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The first place in the sorted hashes that is not below h (or the last place)."""
        keys, _, begin = self.known
        at = begin[(h >> np.uint64(64 - LEAD)).astype(np.int64)]
        on = np.flatnonzero(keys[at] < h)
        while len(on):
            at[on] += 1
            on = on[at[on] < len(keys)]
            on = on[keys[at[on]] < h[on]]
        return np.minimum(at, len(keys) - 1)

    def top(self, texts: dict[str, list[np.ndarray]]) -> None:
        """Complete the log-probabilities of every seen top-order n-gram in every language."""
        joined = [c for v in texts.values() for c in v]
        _, first = np.unique(np.concatenate([gram_hashes(c, ORDER) for c in joined]), return_index=True)
        ends = np.cumsum([len(c) - ORDER + 1 for c in joined])
        at = first + (ORDER - 1) * np.searchsorted(ends, first, "right")  # of the n-gram's first symbol among all texts' symbols
        self.full = self._grams(np.concatenate(joined)[at[:, None] + np.arange(ORDER)]).astype(np.float32)

    def _grams(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each row after the others, per language."""
        n = grams.shape[1]
        wide = grams.astype(np.uint64)
        result = np.tile(self.floor, (len(grams), 1))
        for k in range(1, n + 1):
            h = np.zeros(len(grams), np.uint64)
            c = np.zeros(len(grams), np.uint64)
            for j in range(k):
                h += wide[:, n - 1 - j] * _MULT[j]
                if j:
                    c += wide[:, n - 1 - j] * _MULT[j - 1]
            h, c = mix(h + np.uint64(k)), mix(c + np.uint64(k - 1)) if k > 1 else np.zeros(len(grams), np.uint64)
            if k > 1:
                at = np.minimum(np.searchsorted(self.contexts[k - 1], c), len(self.contexts[k - 1]) - 1)
                result += np.where((self.contexts[k - 1][at] == c)[:, None], self.weights[k - 1][at], 0)
            at = np.minimum(np.searchsorted(self.keys[k - 1], h), len(self.keys[k - 1]) - 1)
            own = np.where((self.keys[k - 1][at] == h)[:, None], self.logp[k - 1][at], np.nan)
            result = np.where(np.isnan(own), result, own)
        return result

    def entropies(self, codes: list[np.ndarray]) -> np.ndarray:
        """Mean negative log-probability per symbol (bits), a row for each text as symbols() gives it."""
        out = np.zeros((len(codes), len(self.languages)))
        if not codes:
            return out
        size = np.array([len(c) for c in codes])
        whole, at = np.concatenate(codes), np.append(0, np.cumsum(size))
        inner = np.ones(len(whole), bool)  # the first ORDER - 1 symbols of a text are only history
        for j in range(ORDER - 1):
            inner[np.minimum(at[:-1] + j, len(whole) - 1)] = False
        for a in range(0, len(whole) - ORDER + 1, PIECE):
            part = self.score(whole[a : a + PIECE + ORDER - 1])
            part[~inner[a + ORDER - 1 : a + ORDER - 1 + len(part)]] = 0
            lo, hi = a + ORDER - 1, a + ORDER - 1 + len(part)
            first = int(np.searchsorted(at, lo, "right")) - 1
            last = int(np.searchsorted(at[:-1], hi))
            cuts = np.maximum(at[first:last], lo)
            out[first:last] -= np.add.reduceat(part, cuts - lo, axis=0, dtype=np.float64)
        return out / (np.maximum(size - ORDER + 1, 1) * np.log(2))[:, None]


@dataclass
class Models:
    """Models of any number of languages, ABREAST at a time, with what was calibrated over all of them."""

    groups: list[Model]
    sharpness: float = 1.0
    limits: np.ndarray | None = None

    @classmethod
    def of(cls, texts: dict[str, list[np.ndarray]]) -> Models:
        names = sorted(texts)
        groups = [Model.of({k: texts[k] for k in names[i : i + ABREAST]}) for i in range(0, len(names), ABREAST)]
        for m in groups:
            m.kept = KEPT // len(groups)
        return cls(groups)

    @property
    def languages(self) -> list[str]:
        return [k for m in self.groups for k in m.languages]

    def entropies(self, codes: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([m.entropies(codes) for m in self.groups], axis=1)


def fit(texts: dict[str, list[np.ndarray]]) -> Models | None:
    """Three quarters of the texts make the models; the last quarter calibrates score and rejection; null: nothing to learn."""
    texts = {k: [c for c in v if len(c) >= ORDER] for k, v in texts.items()}
    texts = {k: v for k, v in texts.items() if v}
    if not texts:
        return None
    train = {k: [c for i, c in enumerate(v) if i % 4 != 3 or len(v) < 8] for k, v in texts.items()}
    model = Models.of(train)
    entropy, truth = [], []
    for i, k in enumerate(model.languages):
        held = [c for j, c in enumerate(texts[k]) if j % 4 == 3 or len(texts[k]) < 8]
        entropy.append(model.entropies(held))
        truth.append(np.full(len(held), i))
    entropy, truth = np.concatenate(entropy), np.concatenate(truth)
    grid = [0.5, 1, 2, 4, 8, 16, 32]
    loss = [-np.log(np.maximum(posterior(entropy, s)[np.arange(len(truth)), truth], 1e-12)).mean() for s in grid]
    model.sharpness = grid[int(np.argmin(loss))]
    limits = []
    for i in range(len(model.languages)):
        own = np.sort(entropy[truth == i, i])
        middle, top = own[len(own) // 2], own[min(len(own) - 1, int(0.999 * len(own)))]
        limits.append(max(top + (top - middle), 1.5 * middle))
    model.limits = np.array(limits)
    return model


def posterior(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    z = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
    return z / z.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, text: str, lang: str, key: str, where: Column, per_language: int = FIT_DOCS) -> dict[str, list[str]]:
    """At most per_language labelled texts a language, by the hash of key, until its share of characters is reached: the last one is taken whole.

    So a language has at least one text, however long its texts are.  A share by hash of the rows is sorted in Spark, a language a
    window of about 1.2 * per_language rows; what comes to the driver is bounded by FIT_TOTAL and one text a language.
    """
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.col(key).cast("string").alias("k"))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))
    with scope() as spent:
        counts = durable(counts.select("l", "n"), "languages")
    languages = counts.count()
    if not languages:
        release(docs.sparkSession, spent)
        return {}
    chars = min(FIT_CHARS, max(1, FIT_TOTAL // languages))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(17), "k", "t"), 11) / F.lit(2.0**53)
    picked = rows.withColumn("u", unit).join(counts, "l").where(F.col("u") < 1.2 * per_language / F.col("n")).select("l", "t", "u", F.length("t").alias("c"))
    along = Window.partitionBy("l").orderBy("u", "t")
    picked = picked.withColumn("i", F.row_number().over(along)).withColumn("before", F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    with scope() as more:  # stored, as an iterator over a shuffle is a job for each of its partitions, with or without rows
        picked = durable(picked.where((F.col("i") <= per_language) & (F.col("before") < chars)).select("l", "i", "t"), "fitted")
    out: dict[str, list[str]] = {}
    for r in sorted(picked.toLocalIterator(), key=lambda r: r["i"]):
        out.setdefault(r["l"], []).append(r["t"])
    release(docs.sparkSession, spent + more)
    return out


def identify(docs: DataFrame, train: Column | None = None, per_language: int = FIT_DOCS) -> DataFrame:
    """docs with lang_pred string, score double, entropy double and rejected boolean added (all rows, all columns kept).

    train: which rows may be learned from (needs doc_id, text, lang; default all).  lang_pred is the language of least
    cross-entropy per symbol (ties: the first by name), "und" with score 0 and rejected for a null text, one without a letter, or where nothing could be learned.
    score: that language's posterior at a calibrated sharpness.  rejected: the entropy exceeds the calibrated
    limit of its language, a margin above all but 0.1 % of held-back labelled documents, wider for short texts.  Existing columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    names = ["lang_pred", "score", "entropy", "rejected"]
    docs = docs.drop(*names)
    texts = sample(docs, "text", "lang", "doc_id", F.lit(True) if train is None else train, per_language)
    model = fit({k: [symbols(t) for t in v] for k, v in texts.items()})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_TOTAL
    del texts, model  # the broadcast has a file of its own
    trim()
    at = docs.columns.index("text")
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        m = shared.value
        for batch in batches:
            codes = [symbols(t.as_py() or "") for t in batch.column(at)]
            some = [i for i, c in enumerate(codes) if m is not None and (c != 32).any()]
            lang, score, entropy, rejected = [UNKNOWN] * len(codes), [0.0] * len(codes), [None] * len(codes), [True] * len(codes)
            if some:
                e = m.entropies([codes[i] for i in some])
                best = np.argmin(e, axis=1)
                p = posterior(e, m.sharpness)[np.arange(len(some)), best]
                for i, k, row, q in zip(some, best.tolist(), e.tolist(), p.tolist(), strict=True):
                    lang[i], score[i], entropy[i], rejected[i] = m.languages[k], q, row[k], row[k] > m.limits[k] + SHORT / (len(codes[i]) - ORDER + 1) ** 0.5
            new = [pa.array(c, k) for c, k in zip((lang, score, entropy, rejected), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for n, k in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(n, k)
    return docs.mapInArrow(run, schema)
