"""Entities' result sets, audits, calibration and what keeps tables straight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import blocks


def network(entities: DataFrame, relations: DataFrame, retracted: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities (id, type, mentions) with `least` mentions or of type event; relations (s, p, o, weight) between them that no claim (s, p, o) retracts."""
    nodes = entities.where((F.col("mentions") >= least) | (F.col("type") == "event"))
    seen = lambda c: nodes.select(F.col("id").alias(c))
    edges = relations.join(seen("s"), "s", "left_semi").join(seen("o"), "o", "left_semi").join(retracted, ["s", "p", "o"], "left_anti")
    return nodes, edges.select("s", "p", "o", "weight")


def profile(mentions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(entity, this, before, delta, articles): distinct articles of the last `days` days and of as many before.  mentions: entity, article, ts."""
    a, b = as_of - F.expr(f"INTERVAL {days} DAYS"), as_of - F.expr(f"INTERVAL {2 * days} DAYS")
    t = F.col("ts")
    g = mentions.groupBy("entity").agg(F.countDistinct(F.when(t >= a, F.col("article"))).alias("this"), F.countDistinct(F.when((t >= b) & (t < a), F.col("article"))).alias("before"), F.countDistinct("article").alias("articles"))
    return g.withColumn("delta", F.col("this") - F.col("before"))


def briefing_entities(mentions: DataFrame, aliases: DataFrame, always: list, as_of: Column, days: int = 7, top: int = 4) -> DataFrame:
    """Entities for a briefing: those of `always`, and the `top` others by articles that also mention one of these, with that share of all of theirs.

    mentions: entity, article, ts; aliases: entity, canonical (entities without one are their own).  Articles count once an entity.
    """
    m = mentions.join(aliases, "entity", "left").select(F.coalesce("canonical", "entity").alias("entity"), "article", "ts").distinct()
    race = m.where(F.col("entity").isin(always)).select("article").distinct().withColumn("race", F.lit(True))
    m = m.join(race, "article", "left")
    start = as_of - F.expr(f"INTERVAL {days} DAYS")
    g = m.where(F.col("ts") >= start).groupBy("entity").agg(F.countDistinct("article").alias("raw"), F.countDistinct(F.when(F.col("race"), F.col("article"))).alias("gated"))
    own = F.col("entity").isin(always)
    mine = g.where(own).select("entity", F.col("raw").alias("mentions"), F.lit(None).cast("double").alias("share"))
    rest = g.where(~own & (F.col("gated") > 0)).orderBy(F.desc("gated"), "entity").limit(top)
    return mine.unionByName(rest.select("entity", F.col("gated").alias("mentions"), (F.col("gated") / F.col("raw")).alias("share")))


def overnight(claims: DataFrame, allowed: DataFrame, labels: dict[str, int], as_of: Column, hours: int = 48, limit: int = 5, shortest: int = 30) -> DataFrame:
    """The `limit` claims of the last `hours` that name an allowed entity, by label, reliability (50 where unknown) and age; equal quotes once.

    claims: claim, quote, label, entity, reliability, ts (a row for each entity named).
    """
    from tessera.operators.review import briefing_score

    rank = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in labels.items()])
    near = claims.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.char_length("quote") >= shortest) & rank.isNotNull()).join(allowed, "entity", "left_semi")
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    s = near.withColumn("score", F.round(briefing_score(rank, F.coalesce("reliability", F.lit(50)), age, hours), 6))
    one = s.groupBy(F.lower("quote").alias("q")).agg(F.min_by(F.struct("claim", "score"), F.struct((-F.col("score")).alias("s"), "claim")).alias("c")).select("c.*")
    return one.orderBy(F.desc("score"), "claim").limit(limit)


def drift(evidence: DataFrame, current: str) -> DataFrame:
    """(version, entries, relations, stale): what each extractor version supports.  evidence: relation, article, version."""
    v = F.coalesce("version", F.lit("none"))
    return evidence.groupBy(v.alias("version")).agg(F.count("*").alias("entries"), F.countDistinct("relation").alias("relations")).withColumn("stale", F.col("version") != current)


def stale_articles(evidence: DataFrame, weights: DataFrame, current: str, limit: int) -> DataFrame:
    """Articles by the weight of the relations they support of which nothing is of the current version.  weights: relation, weight."""
    fresh = evidence.where(F.col("version") == current).select("relation").distinct()
    stale = evidence.join(fresh, "relation", "left_anti").select("relation", "article").distinct().join(weights, "relation")
    return stale.groupBy("article").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "article").limit(limit)


def productivity(posts: DataFrame, handles: DataFrame, least: int, relevant: Column) -> DataFrame:
    """Handles with `least` posts or more and no relevant one: posts meet handles on the parts of their urls, not all on all."""
    parts = posts.select(F.explode(F.array_distinct(F.split(F.lower("url"), "/"))).alias("handle"), relevant.alias("ok"))
    g = parts.join(handles.select(F.lower("handle").alias("handle")).distinct(), "handle").groupBy("handle").agg(F.count("*").alias("posts"), F.count_if("ok").alias("relevant"))
    return g.where((F.col("posts") >= least) & (F.col("relevant") == 0))


def samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots (source, at, own, other) after new ones: one a source and time, the old one's stays; suspect where both sides do not add up to 80-120 or where a row jumps from both its neighbours by over 15 in opposite directions."""
    both = old.select("source", "at", "own", "other", F.lit(0).alias("_s")).unionByName(new.select("source", "at", "own", "other", F.lit(1).alias("_s")))
    one = both.groupBy("source", "at").agg(F.min_by(F.struct("own", "other"), "_s").alias("v")).select("source", "at", "v.*")
    w = Window.partitionBy("source").orderBy("at")
    up, down = F.col("own") - F.lag("own").over(w), F.lead("own").over(w) - F.col("own")
    jump = F.coalesce(((up > 15) & (down < -15)) | ((up < -15) & (down > 15)), F.lit(False))
    odd = F.coalesce(~(F.col("own") + F.col("other")).between(80, 120), F.lit(False))
    return one.withColumn("suspect", odd | jump)


def pair_dataset(items: DataFrame, group: str, key: str, vector: str, negatives: int, parts: int = 64) -> DataFrame:
    """(a, b, same, distance): all pairs within a group, and about `negatives` pairs of different groups drawn by hash.

    For negatives every row meets the rows of one bucket of its own hash, not all rows.
    """
    x = items.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    l, r = x.toDF("ga", "a", "va"), x.toDF("gb", "b", "vb")  # noqa: E741
    same = blocks.pairs(items, group, key, vector, "distance", of=lambda s: 1 - s)
    bucket = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(parts))
    other = l.join(r, (bucket("a") == bucket("b")) & (F.col("ga") != F.col("gb")) & (F.col("a") < F.col("b")))
    other = other.orderBy(F.xxhash64(F.lit(7), "a", "b"), "a", "b").limit(negatives)
    distance = F.round(1 - vectors.cosine(F.col("va"), F.col("vb")), 4)
    other = other.select("a", "b", F.lit(False).alias("same"), distance.alias("distance"))
    return same.withColumn("same", F.lit(True)).unionByName(other).select("a", "b", "same", "distance")


def wire_purity(members: DataFrame, cluster: str, body: str) -> DataFrame:
    """(cluster, size, share): how much of a cluster is its most frequent body."""
    n = members.groupBy(cluster, F.xxhash64(body).alias("_b")).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.sum("n").alias("size"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


def rule_groups(entities: DataFrame, key: Column) -> DataFrame:
    """Groups of entities (id, mentions) that a rule's key makes one: key, target (most mentions, then least id) and members, of two at least."""
    g = entities.withColumn("_key", key).where("_key is not null").groupBy("_key").agg(F.count("*").alias("n"), F.min_by("id", F.struct((-F.col("mentions")).alias("m"), "id")).alias("target"), F.array_sort(F.collect_list("id")).alias("members"))
    return g.where("n > 1").select(F.col("_key").alias("key"), "target", "members")


def similar_entities(entities: DataFrame, key: str, kind: str, vector: str, least: float) -> DataFrame:
    """(a, b, similarity) of entities of one kind from `least` cosine."""
    return blocks.pairs(entities, kind, key, vector, "similarity", least=least)


def partisan_guard(rels: DataFrame, parties: DataFrame, friendly: list[str]) -> DataFrame:
    """Relations whose predicate is friendly between entities of different parties: to be looked at.  parties: id, party."""
    p = lambda c: parties.select(F.col("id").alias(c), F.col("party").alias(f"party_{c}"))
    return rels.where(F.col("p").isin(friendly)).join(p("s"), "s").join(p("o"), "o").where("party_s <> party_o")


def reference_audit(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, id_: str, keep: int = 5) -> DataFrame:
    """One row: rows of child whose key is null, rows without a parent, and the least `keep` of these."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    some = lost.orderBy(id_).limit(keep).agg(F.array_sort(F.collect_list(id_)).alias("samples"))
    n = lost.agg(F.count("*").alias("orphans"))
    return child.agg(F.count_if(F.col(child_key).isNull()).alias("nulls")).join(n).join(some)  # one row each


def claim_view(claims: DataFrame, supports: DataFrame, keep: int = 20) -> DataFrame:
    """claims (claim, s, p, o, status) with their supports (claim, article, stance, ts): newest `keep` of each stance, articles only."""
    w = Window.partitionBy("claim", "stance").orderBy(F.desc("ts"), "article")
    top = supports.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("stance") == k, F.struct("r", "article")))), lambda x: x["article"]).alias(k)
    return claims.join(top.groupBy("claim").agg(of("supports"), of("refutes")), "claim", "left")


def with_status(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """claims after (claim, status) changes, the last of which by at counts: retracted or active again."""
    last = changes.groupBy("claim").agg(F.max_by("status", "at").alias("_new"))
    return claims.join(last, "claim", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def resolved_merge(rows: DataFrame, cluster: Column, frame: Column) -> DataFrame:
    """rows with frame set where the cluster is the merged one and none was set before; others as they are."""
    return rows.withColumn("frame", F.when(cluster & F.col("frame").isNull(), frame).otherwise(F.col("frame")))


def nearest_past(decisions: DataFrame, probes: DataFrame, key: str, vector: str, group: str, top: int = 4) -> DataFrame:
    """(probe, key, rank): the `top` past decisions of the probe's group by cosine (ties: the least key).  probes: probe, group, vector."""
    s = blocks.nearest(decisions, probes, group, key, "probe", vector, top).withColumnRenamed("key", key)
    w = Window.partitionBy("probe").orderBy(F.desc("similarity"), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("probe", key, "rank")


def candidate_urls(results: DataFrame, blocked: list[str], affinity: Column, most: int) -> DataFrame:
    """The `most` best results (url) of hosts not blocked, one a host: by affinity, then url."""
    from tessera.functions.text import domain

    rows = results.withColumn("host", domain(F.col("url"))).where(F.col("host").isNotNull() & ~F.col("host").isin(blocked)).withColumn("affinity", affinity)
    best = rows.groupBy("host").agg(F.min_by(F.struct("url", "affinity"), F.struct((-F.col("affinity")).alias("a"), "url")).alias("r")).select("host", "r.*")
    return best.orderBy(F.desc("affinity"), "url").limit(most)


def handle_score(handle: Column, tokens: list[str], snippet: Column, appearances: Column) -> Column:
    """Points of an account: parts of the name in the handle (30 each) and in what is said of it (10 each), and how often it came up (5 each, 25 at most)."""
    low, said = F.lower(handle), F.lower(F.coalesce(snippet, F.lit("")))
    points = sum((F.when(low.contains(t), 30).otherwise(0) + F.when(said.contains(t), 10).otherwise(0) for t in tokens), F.lit(0))
    return points + F.least(appearances * 5, F.lit(25))


def applied_pack(pack: DataFrame, feeds: DataFrame, reminders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new feeds, new reminders) of a pack (kind, name, url): items with a url become feeds unless the url is known, others reminders unless the name is."""
    is_feed = F.coalesce((F.col("kind") == "feed") & F.col("url").isNotNull(), F.lit(False))
    new = pack.where(is_feed).dropDuplicates(["url"]).join(feeds.select("url"), "url", "left_anti").select("name", "url")
    return new, pack.where(~is_feed).dropDuplicates(["name"]).join(reminders.select("name"), "name", "left_anti").select("name")


def capability_diff(versions: DataFrame, old: str, new: str) -> DataFrame:
    """(change, capability): what the set of `new` has more (added) or less (removed) than that of `old`.  versions: version, capabilities."""
    of = lambda v: versions.where(F.col("version") == v).select(F.explode("capabilities").alias("capability"))
    return of(new).exceptAll(of(old)).select(F.lit("added").alias("change"), "capability").unionByName(of(old).exceptAll(of(new)).select(F.lit("removed").alias("change"), "capability"))


def stub_recovery(items: DataFrame, pages: DataFrame, least: int) -> DataFrame:
    """items (id, url, body) with bodies shorter than `least` replaced by the longer text of their page (url, text), and whether they were."""
    t = pages.groupBy("url").agg(F.max_by("text", F.struct(F.char_length("text"), "text")).alias("_t"))
    out = items.join(t, "url", "left")
    better = (F.char_length(F.coalesce("body", F.lit(""))) < least) & (F.char_length("_t") > F.char_length(F.coalesce("body", F.lit(""))))
    better = F.coalesce(better, F.lit(False))
    return out.select("id", F.when(better, F.col("_t")).otherwise(F.col("body")).alias("body"), better.alias("recovered"))


def link_candidates(pages: DataFrame, own: Column, title: str, least: float = 0.3) -> DataFrame:
    """(page, link, similarity): links in a page (page, html, title) to hosts where `own` (an expression over link) holds, ranked by how alike the anchor's text is to the title."""
    from tessera.functions.text import jaccard, strip_html, title_tokens

    a = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>"), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>(.*?)</a>"), F.lit(1))
    rows = pages.select("page", title, F.explode(F.arrays_zip(a.alias("link"), texts.alias("text"))).alias("z")).select("page", title, F.col("z.link").alias("link"), strip_html(F.col("z.text")).alias("anchor"))
    s = jaccard(title_tokens(F.col("anchor")), title_tokens(F.col(title)))
    best = rows.where(own).withColumn("similarity", F.round(s, 4)).where(F.col("similarity") >= least)
    return best.groupBy("page", "link").agg(F.max("similarity").alias("similarity"))
