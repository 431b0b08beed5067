"""What depends on order, settled in order: whoever can ever meet forms a component, and a task takes whole components, article by article."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.storage import stored

#: Articles that a task is given at once, components whole.
BATCH = 20_000
#: Microseconds of a day.
DAY = 86_400_000_000


def node(kind: str, c: str | Column) -> Column:
    """A name for a title, an address or a story in the graph of what can meet; null for null."""
    return F.concat(F.lit(kind), F.md5(c if isinstance(c, Column) else F.col(c).cast("string")))


def components(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component) over edges of rows (node, more: array of nodes that it stands for too) and pairs (a, b)."""
    also = rows.select(F.col("node").alias("src"), F.explode(F.filter("more", lambda m: m.isNotNull())).alias("dst")).where("src is not null").distinct()
    return graph.components(also.unionByName(pairs.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"))))


def placed(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (node, more, ...) with their component and how many rows it has, and pairs (a, b, similarity) with theirs; both stored."""
    of = stored(components(rows, pairs), "components")
    r = rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("more")
    r = stored(r, "placed")
    sizes = r.where("component is not null").groupBy("component").agg(F.count("*").alias("members"))
    p = pairs.join(of.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    return r.join(sizes, "component", "left"), stored(p, "placed")


def run(rows: DataFrame, pairs: DataFrame, settle, schema: str) -> DataFrame:
    """settle(rows, neighbours) for batches of whole components of rows and pairs; neighbours: node -> [(node, similarity)]."""
    batches = max(1, rows.count() // BATCH)
    batch = F.pmod(F.xxhash64("component"), F.lit(batches)).alias("batch")

    def held(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for a, b, s in zip(right["a"], right["b"], right["similarity"], strict=True):
            near[a].append((b, s))
        return settle(left, near)

    left = rows.withColumn("batch", batch).groupBy("batch")
    return left.cogroup(pairs.withColumn("batch", batch).groupBy("batch")).applyInPandas(held, schema)


def _bits(a: int, b: int) -> int:
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def joined(rows: pd.DataFrame, near: dict, days: int, close_days: int) -> pd.DataFrame:
    """(id, story): articles in order of n; rows: id, n, fresh, story, node, url, words, hash (None: none), arrived, ts (NaN: none), seen in microseconds, authority, length."""
    best, last, by_title, by_url, out = {}, {}, defaultdict(dict), defaultdict(dict), []
    rows = rows.sort_values("n")
    columns = [rows[c].tolist() for c in ("id", "n", "fresh", "story", "node", "url", "words", "hash", "hashed", "arrived", "ts", "seen", "authority", "length")]
    for id_, n, fresh, story, title, url, words, hash_, hashed, arrived, ts, seen, authority, length in zip(*columns, strict=True):
        if fresh:
            found = None

            def better(s, found=None, arrived=arrived):
                return (last[s], s) if found is None or last[s] > found[0] or (last[s] == found[0] and s < found[1]) else found

            asked = [(by_title, b, sim) for b, sim in near.get(title, ())] if title is not None else []
            for index, key, sim in [*asked, *([(by_url, url, 1.0)] if url is not None else [])]:
                for s, (_, h, hd, t) in list(index.get(key, {}).items()):
                    if last[s] < arrived - days * DAY:  # it stays so: arrivals only grow
                        del index[key][s]
                    elif sim >= 0.92 or (words >= 50 and hashed and hd and _bits(hash_, h) <= 6 and not abs(ts - t) > close_days * DAY):
                        found = better(s, found)
            story = found[1] if found else id_
            out.append((id_, story))
        rank = (authority, length, -seen, -n)
        if story not in best or rank > best[story][0]:
            if story in best:
                by_title[best[story][1]].pop(story, None)
                by_url[best[story][2]].pop(story, None)
            best[story] = (rank, title if title and title[0] == "t" else None, url)
            told = (n, hash_, hashed, ts)
            if best[story][1] is not None:
                by_title[title][story] = told
            if url is not None:
                by_url[url][story] = told
        last[story] = max(last.get(story, seen), seen)
    return pd.DataFrame(out, columns=["id", "story"])


class Founders:
    """Founders of one title: of those alike in hash and length the last one stands for all, as it came nearest to whoever follows."""

    def __init__(self):
        self.at, self.many, self.last = {}, 0, None
        self.hash, self.words, self.when = np.zeros(8, np.int64), np.zeros(8, np.int64), np.zeros(8, np.int64)
        self.hashed, self.who = np.zeros(8, bool), []

    def add(self, hash_: int, hashed: bool, words: int, when: int, who: tuple) -> None:
        i = self.at.setdefault((hash_, hashed, words), self.many)
        if i == self.many:
            self.many += 1
            self.who.append(who)
            if i == len(self.hash):
                for c in ("hash", "words", "when", "hashed"):
                    setattr(self, c, np.concatenate([getattr(self, c), np.zeros_like(getattr(self, c))]))
        self.hash[i], self.words[i], self.when[i], self.hashed[i], self.who[i] = hash_, words, when, hashed, who
        self.last = (when, who)


def founded(rows: pd.DataFrame, near: dict, days: int, close_days: int, strict: bool) -> pd.DataFrame:
    """(id, story): by time, an article joins the latest founder that it links with or is one; rows: id, node, url, first (of its url), words, hash, hashed, ts in microseconds."""
    titles, founders, out = defaultdict(Founders), {}, []
    rows = rows.sort_values(["ts", "id"])
    columns = [rows[c].tolist() for c in ("id", "node", "first", "words", "hash", "hashed", "ts")]
    for id_, title, first, words, hash_, hashed, ts in zip(*columns, strict=True):
        when, found = ts // 1_000_000, None  # whole seconds
        if first is not None and first != id_ and first in founders and when - founders[first][0] // 1_000_000 <= days * 86400:
            found = founders[first]
        named = title is not None and title[0] == "t"
        for other, sim in near.get(title, ()) if named else ():
            f = titles.get(other)
            if f is None or (strict and words < 50):
                continue
            if sim >= 0.92 and not strict:
                who = f.last[1] if when - f.last[0] <= days * 86400 else None
            else:
                m, apart = slice(0, f.many), when - f.when[: f.many]
                bits = np.where(f.hashed[m] & hashed, np.bitwise_count((f.hash[m] ^ np.int64(hash_)).view(np.uint64)), 65)
                good = (bits <= 6) & (apart <= close_days * 86400) & (words >= 50)
                if strict:
                    level = np.maximum(f.words[m], words) <= 10 * np.maximum(np.minimum(f.words[m], words), 1)
                    good = (good | ((sim >= 0.92) & (bits <= 8))) & level
                good &= apart <= days * 86400
                hits = np.flatnonzero(good)
                who = max((f.who[i] for i in hits.tolist()), default=None) if len(hits) < 64 else max(f.who[i] for i in hits[f.when[hits] == f.when[hits].max()].tolist())
            if who is not None and (found is None or who > found):
                found = who
        if found is None:
            founders[id_] = (ts, id_)
            if named:
                titles[title].add(hash_, hashed, words, when, (ts, id_))
        out.append((id_, found[1] if found else id_))
    return pd.DataFrame(out, columns=["id", "story"])
