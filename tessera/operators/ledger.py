"""Writes that keep dependants straight, verified copies, matching with supplied verdicts, series and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names as people
from tessera.functions import vectors


def activities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Opponents' activities one a (opponent, story, fingerprint): the text that came first, the latest time.

    old, new: opponent, story, claim, attack, promise, at.  The fingerprint ignores case and white space.
    """
    both = old.unionByName(new)
    plain = [F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))) for c in ("claim", "attack", "promise")]
    both = both.withColumn("fingerprint", F.sha1(F.concat_ws("|", *plain)))
    return both.groupBy("opponent", "story", "fingerprint").agg(F.min_by(F.struct("claim", "attack", "promise"), F.struct("at", "claim")).alias("t"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).select("opponent", "story", "fingerprint", "t.*", "first_seen", "last_seen")


def without_items(items: DataFrame, stories: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, stories) after some items (id) go: a story whose representative went points to the best of the others, one without items goes too.

    items: id, story, authority, ts; stories: story, representative.
    """
    left = items.join(gone.select("id"), "id", "left_anti")
    best = left.groupBy("story").agg(F.min_by("id", F.struct((-F.coalesce("authority", F.lit(1))).alias("a"), "ts", "id")).alias("_best"))
    lost = gone.select(F.col("id").alias("representative"), F.lit(True).alias("_lost"))
    kept = stories.join(best, "story").join(lost, "representative", "left")
    return left, kept.select("story", F.when(F.col("_lost"), F.col("_best")).otherwise(F.col("representative")).alias("representative"))


def row_digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest): sha256 of each row's values as text, nulls told from empty ones."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return rows.select(key, F.sha2(F.concat_ws("\x1f", *[value(c) for c in columns]), 256).alias("digest"))


def copy_differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem) of a copy: missing, extra or different rows."""
    j = row_digests(old, key, columns).withColumnRenamed("digest", "a").join(row_digests(new, key, columns).withColumnRenamed("digest", "b"), key, "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("different").alias("problem"))


def shortlists(articles: DataFrame, frames: DataFrame, floor: float = 0.30) -> DataFrame:
    """(article, frame, score): frames (frame, centroid, threshold) from their threshold, floor at least; all frames, without a score, for an article without a vector.

    Frames are a campaign's, a few to a few hundred rows; Spark broadcasts them only if they are small.
    """
    s = vectors.cosine(F.col("vector"), F.col("centroid"))
    met = articles.crossJoin(frames).withColumn("score", F.when(F.col("vector").isNotNull(), s))
    return met.where(F.col("vector").isNull() | (F.col("score") >= F.greatest(F.coalesce("threshold", F.lit(floor)), F.lit(floor)))).select("article", "frame", "score")


def matched(shortlist: DataFrame, verdicts: DataFrame, bodies: DataFrame, least: int = 40) -> DataFrame:
    """Matches (article, frame, confidence, snippet) that a supplied verdict makes of a shortlist: confident enough, kept by the verifier (null: kept), and quoting the article.

    verdicts: article, frame, confidence, snippet, keep; bodies: article, body.  What was not shortlisted does not match.
    """
    from tessera.functions.extract import quote_found

    v = verdicts.join(shortlist.select("article", "frame"), ["article", "frame"], "left_semi").join(bodies, "article")
    return v.where((F.col("confidence") >= least) & F.coalesce("keep", F.lit(True)) & quote_found(F.col("snippet"), F.col("body"))).select("article", "frame", "confidence", "snippet")


def rematch_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(frame, kept, added, dropped): what a clean rematch would change; old and new: article, frame."""
    j = old.select("article", "frame").distinct().withColumn("a", F.lit(1)).join(new.select("article", "frame").distinct().withColumn("b", F.lit(1)), ["article", "frame"], "full")
    return j.groupBy("frame").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("dropped"))


def canonical(names: DataFrame, name: str, entities: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """names with entity_id and way: by name, alias, a form of a district, the name without titles, or the full form of a first name; ties: most mentions, then least id.

    entities: id, name, aliases array, district, mention_count.
    """
    full = F.create_map(*[F.lit(x) for kv in nicknames.items() for x in kv])

    def formal(c: Column) -> Column:  # the first name in full
        parts = F.split(F.lower(people.without_honorifics(c)), r"\s+", 2)
        return F.concat_ws(" ", F.coalesce(F.try_element_at(full, parts[0]), parts[0]), F.get(parts, F.lit(1)))

    one = lambda c, way: entities.select("id", "mention_count", F.lower(c).alias("k"), F.lit(way).alias("way"))
    listed = lambda c, way: entities.select("id", "mention_count", F.explode(c).alias("a")).select("id", "mention_count", F.lower("a").alias("k"), F.lit(way).alias("way"))
    keys = reduce(DataFrame.unionByName, [one(F.col("name"), 0), listed(F.col("aliases"), 1), listed(people.district_forms(F.col("district")), 2), one(people.without_honorifics(F.col("name")), 3), one(formal(F.col("name")), 4)])
    best = keys.where("k is not null and k <> ''").groupBy("k", "way").agg(F.min_by("id", F.struct((-F.col("mention_count")).alias("m"), "id")).alias("entity_id"))
    asked = names.select(F.col(name).alias("_name")).distinct()
    t = F.trim("_name")
    tries = [(F.lower(t), 0), (F.lower(t), 1), (F.lower(t), 2), (F.lower(people.without_honorifics(t)), 3), (formal(t), 4)]
    tried = asked.select("_name", F.explode(F.array(*[F.struct(k.alias("k"), F.lit(w).alias("way")) for k, w in tries])).alias("t")).select("_name", "t.*")
    found = tried.join(best, ["k", "way"]).groupBy("_name").agg(F.min_by(F.struct("entity_id", "way"), "way").alias("f"))
    return names.join(found, names[name] == F.col("_name"), "left").select(*[names[c] for c in names.columns], "f.entity_id", "f.way")


def event_study(events: DataFrame, samples: DataFrame, hours: int = 48) -> DataFrame:
    """events (event, key, at) with the value nearest to the time (within 18 hours), that nearest to `hours` later (within 24), and their difference."""
    from tessera.operators.series import nearest_as_of

    before = nearest_as_of(events.withColumn("t", F.col("at")), samples, "key", "t", "ts", "value", "18 HOURS", 18 * 3600).withColumnRenamed("nearest_value", "before")
    after = nearest_as_of(before.withColumn("t", F.col("at") + F.expr(f"INTERVAL {hours} HOURS")), samples, "key", "t", "ts", "value", "24 HOURS", 24 * 3600).withColumnRenamed("nearest_value", "after")
    return after.withColumn("delta", F.col("after") - F.col("before")).drop("t")


def as_ranked(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """rows of the given ids in their order (a search's result, a page of it)."""
    order = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(ids)], f"{key} {dict(rows.dtypes)[key]}, _rank int")
    return rows.join(order, key).orderBy("_rank").withColumn("rank", F.col("_rank") + 1).drop("_rank")


def series_of(rows: DataFrame, key: str, at: str, value: str, hidden: Column | None = None) -> DataFrame:
    """(key, points): each key's values in order of time, without those that are hidden."""
    rows = rows if hidden is None else rows.where(~F.coalesce(hidden, F.lit(False)))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value")))).alias("points"))


def notifications(kinds: dict[str, DataFrame], dismissed: DataFrame, most: int) -> DataFrame:
    """(kind, id, at): notices of several kinds (id, at) that were not dismissed (kind, id), newest first."""
    every = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("kind"), F.col("id").cast("string").alias("id"), "at") for k, d in kinds.items()])
    return every.join(dismissed, ["kind", "id"], "left_anti").orderBy(F.desc("at"), "kind", "id").limit(most)


def moved_frames(pulse: DataFrame, most: int = 6) -> DataFrame:
    """Of a pulse (key, this_week, last_week) what moved most: frames silent in both weeks are left out."""
    d = F.col("this_week") - F.col("last_week")
    return pulse.where("this_week + last_week > 0").withColumn("delta", d).orderBy(F.desc(F.abs("delta")), pulse.columns[0]).limit(most)


def claim_audit(claims: DataFrame, checks: dict[str, Column], by: str) -> DataFrame:
    """Per value of `by`: rows and how many fail each check."""
    return claims.groupBy(by).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def keyword_frequencies(docs: DataFrame, text: str, words: list[str]) -> DataFrame:
    """(word, docs, hits) over a corpus, in one pass over the texts."""
    low = F.lower(text)
    hit = lambda w: F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){w}(?![a-z0-9])"))
    one = docs.agg(*[a for i, w in enumerate(words) for a in (F.count_if(hit(w) > 0).alias(f"d{i}"), F.coalesce(F.sum(hit(w)), F.lit(0)).alias(f"h{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"d{i}").alias("docs"), F.col(f"h{i}").cast("long").alias("hits")) for i, w in enumerate(words)])).alias("r")).select("r.*")


def snapshot_text(rows: DataFrame, key: str, line: Column, order: list[Column], most: int) -> DataFrame:
    """(key, text): the first `most` lines of each key, one under the other."""
    w = Window.partitionBy(key).orderBy(*order)
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(key, "_r", line.alias("_l"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_l"))), lambda x: x["_l"]), "\n").alias("text"))


def filled(rows: DataFrame, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the column set where it was null, how many by value): a backfill and its report."""
    out = rows.withColumn("_was", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column), value))
    report = out.where("_was").groupBy(column).agg(F.count("*").alias("filled"))
    return out.drop("_was"), report


def sampled_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], share: int = 10) -> DataFrame:
    """changed() over every `share`-th key by hash: a deep look where a whole one costs too much; the sample is the feature."""
    from tessera.operators.writes import changed

    some = F.pmod(F.xxhash64(F.lit(share), key), F.lit(share)) == 0
    return changed(old.where(some), new.where(some), key, columns)


def backfilled(items: DataFrame, links: DataFrame, default: Column) -> DataFrame:
    """One match a (frame, story) out of items (item, story, confidence, ts) and their frames (item, frame): what INSERT .. SELECT .. GROUP BY fills a table with."""
    j = items.join(links, "item").withColumn("story", F.coalesce("story", default))
    return j.groupBy("frame", "story").agg(F.max("confidence").alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
