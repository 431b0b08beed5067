"""Story clusters, variants, triage: duplicate rules, linkage and selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import graph, near
from tessera.storage import stored


def near_duplicate(sim: Column, same_source: Column, ts_a: Column, ts_b: Column, days: int = 7) -> Column:
    """Title similarity from 0.92, or from 0.72 with the same source and times within `days` (a missing time is close)."""
    seconds = F.abs(F.unix_timestamp(ts_a.cast("timestamp")) - F.unix_timestamp(ts_b.cast("timestamp")))
    close = F.coalesce(seconds <= days * 86400, F.lit(True))
    return (sim >= 0.92) | ((sim >= 0.72) & F.coalesce(same_source, F.lit(False)) & close)


#: Longs of a set's bitmap; rows of a set that stand in one array.
BITMAP, CHUNK = 4, 256
#: Against products such as 0.65 * n a little over the whole number that they stand for.
EPS = 1e-9


def set_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): pairs a < b of different sets (i long, w array without repeats) with Jaccard similarity >= least, each pair once.

    Prefix filter: of such a pair the larger set's rarest (1 - least) of tokens, and one, hold one of the rarest 1 - 2 least / (1 + least), and one, of the smaller's.  Sets meet on
    these where their sizes allow the similarity (cut into classes: a set asks its own and the one below), where as many tokens may still follow on both sides, and where bitmaps of
    the tokens' parities do not differ in more bits than the sets may in tokens.  What is left is counted.
    """
    x = sets.where("size(w) > 0").select("i", F.explode("w").alias("w"))
    words = stored(x.groupBy("w").agg(F.count("*").alias("df")), "words")
    # Tokens as numbers in order of rarity: places in a sorted table.
    words = stored(words.sort("df", "w").select("w", "df", F.monotonically_increasing_id().alias("r")), "words")
    bit = F.pmod(F.xxhash64(F.lit(11), "r"), F.lit(64 * BITMAP)).cast("int")
    numbered = x.join(words, "w").select("i", "r", (F.col("df") > 1).alias("shared"), bit.alias("bit"))
    maps = [F.bit_xor(F.when(F.floor(F.col("bit") / 64) == m, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"m{m}") for m in range(BITMAP)]
    step = -math.log(least) * 1.0001
    known = numbered.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("r", "shared"))).alias("s"), F.count("*").cast("int").alias("n"), *maps).withColumn("c", F.floor(F.log("n") / step))
    known = stored(known, "sets")
    bits = [f"m{m}" for m in range(BITMAP)]
    lead = known.select("i", "n", "c", *bits, F.posexplode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - EPS) + 1).cast("int"))).alias("at", "z"))
    lead = lead.where("z.shared").select("i", "n", "c", *bits, "at", "z.r")
    found = lead.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * (2 * least / (1 + least)) - EPS) + 1)
    asks = lead.withColumn("c", F.explode(F.array(F.col("c"), F.col("c") - 1)))
    both = F.col("p.n") + F.col("q.n")
    smaller = (F.col("q.n") < F.col("p.n")) | ((F.col("q.n") == F.col("p.n")) & (F.col("q.i") < F.col("p.i")))
    sizes = F.col("q.n") >= F.col("p.n") * least - EPS
    follow = F.least(F.col("p.n") - F.col("p.at"), F.col("q.n") - F.col("q.at")) >= both * (least / (1 + least)) - EPS
    apart = sum((F.bit_count(F.col(f"p.{m}").bitwiseXOR(F.col(f"q.{m}"))) for m in bits), F.lit(0)) <= both * ((1 - least) / (1 + least)) + EPS
    met = asks.alias("p").join(found.alias("q"), (F.col("p.r") == F.col("q.r")) & (F.col("p.c") == F.col("q.c")) & smaller & sizes & follow & apart)
    pairs = met.select(F.least("p.i", "q.i").alias("a"), F.greatest("p.i", "q.i").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(known.select(F.col("i").alias(side), F.col("s.r").alias(f"s{side}")), side)
    sim = text.jaccard(F.col("sa"), F.col("sb"))
    return pairs.where(sim >= least).select("a", "b", F.round(sim, 4).alias("similarity"))


def distinct_sets(rows: DataFrame, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the number i of their token set, (i, w) of each set once).  Rows without tokens go."""
    # Stored with rows that then go: a filter before would make the tokens twice.
    t = stored(rows.withColumn("_d", F.md5(F.to_json(F.array_sort(tokens)))), "tokens").where(F.size(tokens) > 0)
    sets = stored(t.groupBy("_d").agg(F.first(tokens).alias("w")).withColumn("i", F.monotonically_increasing_id()), "sets")
    return t.join(sets.select("_d", "i"), "_d").drop("_d"), sets.select("i", "w")


def token_pairs(rows: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs of rows whose token sets (arrays without repeats) have Jaccard similarity >= least.

    Different sets are compared by set_pairs, each once; their rows then become pairs, array by array of CHUNK rows, so that a set of many rows is spread over tasks
    and nothing but the result follows the square of the copies.
    """
    members, sets = distinct_sets(rows.select(F.col(key).alias("k"), F.col(tokens).alias("w")), "w")
    members = stored(members.select("k", "i"), "members")
    size = members.groupBy("i").agg(F.ceil(F.count("*") / CHUNK).alias("many"), F.count("*").alias("rows"))
    chunk = F.pmod(F.xxhash64(F.lit(3), "k"), F.col("many")).cast("int")
    chunks = stored(members.join(size, "i").groupBy("i", chunk.alias("chunk")).agg(F.collect_list("k").alias("ks")), "chunks")
    alone = size.where("rows > 1").select(F.col("i").alias("a"), F.col("i").alias("b"), F.lit(1.0).alias("similarity"))
    pairs = set_pairs(sets, least).unionByName(alone)
    for side in "ab":
        pairs = pairs.join(chunks.select(F.col("i").alias(side), F.col("chunk").alias(f"c{side}"), F.col("ks").alias(f"k{side}")), side)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.where("a < b or ca <= cb").repartition(n, "a", "b", "ca", "cb")
    every = dealt.withColumn("ka", F.explode("ka")).withColumn("kb", F.explode("kb")).where("a < b or ca < cb or ka < kb")
    return every.where("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")


def title_pairs(items: DataFrame, key: str, title: str, least: float) -> DataFrame:
    """(a, b, similarity) of titles with token similarity >= least, numbers not contradicting."""
    pairs = token_pairs(items.select(F.col(key), text.title_tokens(F.col(title)).alias("w")), key, "w", least)
    numbers = items.select(F.col(key).alias("k"), text.title_numbers(F.col(title)).alias("n"))
    for side in "ab":
        pairs = pairs.join(numbers.select(F.col("k").alias(side), F.col("n").alias(f"n{side}")), side)
    return pairs.where(~text.numbers_mismatch(F.col("na"), F.col("nb"))).select("a", "b", "similarity")


def representative(items: DataFrame, cluster: str, authority: Column, length: Column, ts: str, key: str) -> DataFrame:
    """The representative of each cluster: most authority (1 where unknown), longest body, earliest, least key."""
    order = [F.desc(F.coalesce(authority, F.lit(1))), F.desc_nulls_last(length), F.asc_nulls_last(ts), F.col(key)]
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where("_r = 1").drop("_r")


def promotable(rows: DataFrame, label: str, article: str, outlet: str, name: str) -> DataFrame:
    """Labels with at least 3 rows, 3 articles and 2 outlets, with their modal name (ties: the longest, then by name)."""
    g = rows.groupBy(label).agg(F.count("*").alias("rows"), F.countDistinct(article).alias("articles"), F.countDistinct(outlet).alias("outlets"))
    names = rows.groupBy(label, name).agg(F.count("*").alias("_n"))
    modal = names.groupBy(label).agg(F.max_by(name, F.struct("_n", F.length(name), name)).alias("modal_name"))
    return g.where("rows >= 3 and articles >= 3 and outlets >= 2").join(modal, label)


def complete_linkage(vectors: np.ndarray, cut: float) -> np.ndarray:
    """Labels of complete-linkage clusters in cosine distance, merged while the farthest pair is within cut; O(n^2) memory."""
    n = len(vectors)
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dist = 1 - x @ x.T
    np.fill_diagonal(dist, np.inf)
    label = np.arange(n)
    while n > 1:
        i, j = divmod(int(np.argmin(dist)), len(dist))
        if dist[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        dist[i] = dist[:, i] = np.maximum(dist[i], dist[j])
        dist[i, i] = np.inf
        dist[j] = dist[:, j] = np.inf
        label[label == label[j]] = label[i]
    return label


def chained_linkage(vectors: np.ndarray, cut: float) -> np.ndarray:
    """What complete_linkage gives, by nearest-neighbour chains: distances are made anew from the vectors, so memory follows n, not n^2."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    members = {i: np.array([i]) for i in range(len(x))}
    done, chain = [], []
    while members or chain:
        if not chain:
            chain = [min(members)]
        a = chain[-1]
        others = np.concatenate([m for k, m in members.items() if k != a]) if len(members) > 1 else np.zeros(0, int)
        if not len(others):
            done.append(members.pop(a))
            chain.pop()
            continue
        far = (1 - x[members[a]] @ x[others].T).max(axis=0)
        starts = np.cumsum([0, *[len(m) for k, m in members.items() if k != a]])[:-1]
        width = np.maximum.reduceat(far, starts)
        names = [k for k in members if k != a]
        b = names[int(np.argmin(width))]
        if width.min() > cut:  # nothing merges with a any more
            done.append(members.pop(a))
            chain = [c for c in chain if c in members]
        elif len(chain) > 1 and np.isclose(width[names.index(chain[-2])], width.min(), atol=0):
            b = chain[-2]
            members[min(a, b)] = np.concatenate([members.pop(a), members.pop(b)])
            chain = chain[:-2]
        else:
            chain.append(b)
    label = np.zeros(len(x), int)
    for m in done:
        label[m] = m.min()
    return label


def within(rows: DataFrame, frame: str, key: str, vector: str, cut: float, side: int = 1024) -> DataFrame:
    """(frame, a, b): links that join all rows of a frame whose cosine distance is within cut, a spanning forest of each block instead of all pairs.

    A frame's rows are dealt to parts of about `side`; each pair of parts is a block that one task compares, so a frame of any size is spread over tasks.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    parts = rows.groupBy(frame).agg(F.ceil(F.count("*") / side).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(F.lit(3), key), F.col("parts")).cast("int")
    dealt = rows.select(frame, key, F.col(vector).cast("array<double>").alias("v")).join(parts, frame).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64(frame, F.least("own", "other"), F.greatest("own", "other"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(block.alias("block"), F.col(frame).alias("frame"), F.col(key).alias("k"), "v").repartition(n, "block").sortWithinPartitions("block", "k")

    def linked(stream):
        for t in near.whole(stream):
            x = near.matrix(t.column("v"))
            todo, a, b = np.arange(len(x)), [], []
            while len(todo):
                queue, todo = [int(todo[0])], todo[1:]
                while queue and len(todo):
                    i = queue.pop()
                    hit = 1 - x[todo] @ x[i] <= cut + 1e-9
                    a += [i] * int(hit.sum())
                    b += todo[hit].tolist()
                    queue += todo[hit].tolist()
                    todo = todo[~hit]
            k = t.column("k").combine_chunks()
            f = t.column("frame").combine_chunks()
            yield pa.RecordBatch.from_arrays([f.take(pa.array(a, pa.int64())), k.take(pa.array(a, pa.int64())), k.take(pa.array(b, pa.int64()))], names=["frame", "a", "b"])

    return dealt.mapInArrow(linked, f"frame {kinds[frame]}, a {kinds[key]}, b {kinds[key]}").withColumnRenamed("frame", frame)


def variants(quotes: DataFrame, frame: str, key: str, vector: str, cut: float = 0.42, matrix: int = 2000) -> DataFrame:
    """(frame, key, variant): complete linkage inside each frame; variant is its least key.

    Rows further apart than cut never share a cluster, so the components of the graph of rows within cut are linked each by itself: a task holds a
    component, not a frame.  Up to `matrix` rows of one are linked by their distance matrix, more by chains without one.  A row without a vector is a variant of its own.
    """
    kinds = dict(quotes.dtypes)
    rows = stored(quotes.select(frame, key, vector), "quotes")
    links = within(rows.where(F.col(vector).isNotNull()), frame, key, vector, cut)
    node = lambda k: F.struct(F.col(frame).alias("f"), F.col(k).alias("k"))
    of = graph.components(links.select(node("a").alias("src"), node("b").alias("dst"))).select("node.*", F.col("component.k").alias("component"))
    of = of.select(F.col("f").alias(frame), F.col("k").alias(key), "component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vector]).astype(float)
        label = complete_linkage(x, cut) if len(x) <= matrix else chained_linkage(x, cut)
        keys = pdf[key].to_numpy()
        return pd.DataFrame({frame: pdf[frame], key: keys, "variant": [keys[label == v].min() for v in label]})

    joined = rows.join(of, [frame, key])
    many = joined.groupBy(frame, "component").applyInPandas(run, f"{frame} {kinds[frame]}, {key} {kinds[key]}, variant {kinds[key]}")
    alone = rows.join(of, [frame, key], "left_anti").select(frame, key, F.col(key).alias("variant"))
    return many.unionByName(alone)


def variant_summaries(quotes: DataFrame, of: DataFrame, frame: str, key: str, vector: str, ts: str) -> DataFrame:
    """(frame, variant, quotes, first_seen, last_seen, centroid) of variants (frame, key, variant): the mean of the members' vectors, and the span of their times."""
    rows = quotes.join(of, [frame, key])
    facts = rows.groupBy(frame, "variant").agg(F.count("*").alias("quotes"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    means = rows.select(frame, "variant", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(frame, "variant", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy(frame, "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return facts.join(means, [frame, "variant"], "left")


def triage(merge: Column, uncertain: Column, noise: Column, promote: Column) -> Column:
    """The decision cascade over supplied scores."""
    return F.when(merge >= 0.85, "merge").when(uncertain >= 0.5, "uncertain").when(noise, "noise").when(promote >= 0.9, "promote").otherwise("review")


def canonical_verdict(new_length: Column, old_length: Column, ratio: Column) -> Column:
    """Which of two items of one title is the duplicate: stubs are under 200 characters, bodies at least 500."""
    match = ratio >= 0.90
    return F.when(~F.coalesce(match, F.lit(False)), "no_match").when((new_length < 200) & (old_length >= 500), "new_is_duplicate").when((old_length < 200) & (new_length >= 500), "existing_is_duplicate").otherwise("neither")


def fingerprint(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(ids).cast("array<string>"), ","), 256)
