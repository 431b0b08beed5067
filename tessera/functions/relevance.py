"""How much an item matters to a race: additive rules, verdict scores and their repair, urgency.  Signals come in as columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of each signal, usually and in races with little coverage.
POINTS = {"candidate": (35, 35), "opponent": (35, 35), "district": (30, 30), "office": (20, 30), "local": (15, 25), "election": (20, 20), "priority_issue": (20, 20), "known_issue": (10, 10), "keyword": (20, 20), "record": (20, 20), "statement": (30, 35), "sparse_source": (0, 15)}
NOISE_PENALTY, CONNECTED = 50, 60
#: What a verdict starts from.
VERDICTS = {"irrelevant": 0, "loosely_related": 20, "relevant": 50, "critical": 75}
URGENCIES = ["low", "medium", "high", "critical"]
#: Terms of the topics that are noise, of elections, records, attacks and claims, and what is left out by default.
SPORTS = ["phillies", "eagles", "flyers", "76ers", "mlb", "nba", "nfl", "nhl", "coach", "manager", "playoffs", "game", "season"]
ENTERTAINMENT = ["movie", "concert", "celebrity", "actor", "music", "festival", "streaming"]
WEATHER = ["weather", "forecast", "rain", "snow", "storm", "temperature", "heat wave"]
FOOD = ["restaurant", "dining", "chef", "menu", "food", "bar", "brewery"]
CRIME = ["arrest", "shooting", "robbery", "burglary", "assault", "police blotter"]
EXCLUDED = ["sports", "phillies", "eagles", "flyers", "76ers", "mlb", "nba", "nfl", "nhl", "playoffs", "game", "manager", "coach", "celebrity", "restaurant", "recipe", "weather", "lottery"]
ELECTION = ["campaign", "candidate", "election", "vote", "voter", "ballot", "poll", "endorsement", "debate", "primary", "general election", "yard sign"]
RECORDS = ["filing", "finance", "campaign finance", "donation", "pac", "committee", "ballot", "election", "ethics", "public record"]
ATTACKS = ["false", "lied", "lying", "misleading", "failed", "failure", "attack", "accused", "reckless", "dangerous", "corrupt", "flip-flop"]
CLAIMS = ["says", "said", "claims", "claimed", "announced", "stated", "pledged", "promised"]
TOPICS = {"sports": SPORTS, "entertainment": ENTERTAINMENT, "weather": WEATHER, "food": FOOD, "generic_crime": CRIME}
NAME_TITLES = ["jr", "sr", "mr", "ms", "dr", "rep", "sen", "hon", "ii", "iii"]
STATEMENT_TYPES, SPARSE_TYPES, RECORD_TYPE, NEWS_TYPE = ["opponent_statement", "campaign_note"], ["public_record", "social"], "public_record", "news"


def _n(flag: Column, points: Column | float) -> Column:
    return F.when(flag, points).otherwise(0)


def _any(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


@dataclass(frozen=True)
class Race:
    """What a campaign says of itself: names, places and words; empty where it says nothing."""

    candidate: str = ""
    opponents: tuple[str, ...] = ()
    district: tuple[str, ...] = ()
    location: str = ""
    office: tuple[str, ...] = ()
    geography: tuple[str, ...] = ()
    priorities: tuple[str, ...] = ()
    issues: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    sparse: bool = False


def surname(name: str) -> list[str]:
    """The word of a name that stands for it in a text: the last of over two letters, before the comma if there is one, titles left out."""
    parts = [re.sub("[^a-z]", "", w) for w in name.split(",")[0].lower().split()]
    return [w for w in parts if len(w) > 2 and w not in NAME_TITLES][-1:]


def said(text: Column, terms: Iterable[str], shortest: int = 1) -> Column:
    """Whether any of the terms stands in a lower-case text with no letter, digit or underscore of any script beside it; terms of fewer characters than `shortest` never do."""
    clean = sorted({re.sub(r"\s+", " ", t).strip().lower() for t in terms} - {""})
    clean = ["".join(c if c.isalnum() or c in " _" else "\\" + c for c in t) for t in clean if len(t) >= shortest]
    return text.rlike(r"(?<![\pL\pN_])(?:" + "|".join(clean) + r")(?![\pL\pN_])") if clean else F.lit(False)


def _issue_terms(name: str) -> list[str]:
    """An issue's name as a phrase, and its words of four characters and more."""
    return [*([name] if len(name.strip()) >= 3 else []), *(t for t in re.split("[^a-z0-9]+", name.lower()) if len(t) >= 4)]


def text_relevance(items: DataFrame, title: Column, body: Column, summary: Column, kind: Column, name: Column, url: Column, quality: Column, race: Race) -> DataFrame:
    """items with a column `relevance`: race_relevance() with every signal read from the text, and a list of reasons.

    The text is title, body, summary, kind, name and url of the source together, in lower case, white space collapsed; nulls are empty.  Names count by surname()
    as a whole word; phrases of under three characters never do.  kind tells statements, public records and news; quality "poor" is that of a bad extraction.
    Text and signals are columns of their own, so that each term table searches a text once however often the rules ask.
    """
    kept, own = [c for c in items.columns if c != "relevance"], _own(items, "_said_")
    t = F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, body, summary, kind, name, url)]), r"\s+", " ")))
    items = items.select("*", t.alias(own + "text"), F.coalesce(kind, F.lit("")).alias(own + "kind"), F.coalesce(quality == "poor", F.lit(False)).alias(own + "poor"))
    t, kind = F.col(own + "text"), F.col(own + "kind")
    phrase = lambda terms: said(t, terms, 3)
    read = {
        "candidate": said(t, surname(race.candidate)),
        "opponent": said(t, [w for o in race.opponents for w in surname(o)]),
        "district": phrase((*race.district, race.location)),
        "office": phrase(race.office),
        "near": phrase((race.location, *race.geography)),
        "election": said(t, ELECTION),
        "priority_issue": phrase(race.priorities),
        "known_issue": said(t, [w for i in race.issues for w in _issue_terms(i)]),
        "keyword": phrase(race.keywords),
        "record": (kind == RECORD_TYPE) & said(t, RECORDS),
        "excluded": said(t, (*EXCLUDED, *race.excluded)),
        "claims": said(t, CLAIMS),
        "attacks": said(t, ATTACKS),
        **{k: said(t, terms) for k, terms in TOPICS.items()},
    }
    items = items.select("*", *[c.alias(own + k) for k, c in read.items()])
    r = {k: F.col(own + k) for k in read}
    s = {
        **{k: r[k] for k in ("candidate", "opponent", "district", "office")},
        "local": r["district"] | r["near"],
        **{k: r[k] for k in ("election", "priority_issue", "known_issue", "keyword", "record")},
        "statement": kind.isin(STATEMENT_TYPES),
        "sparse_source": kind.isin(SPARSE_TYPES),
    }
    items = race_relevance(items, s, {k: r[k] for k in TOPICS}, r["excluded"], r["claims"], r["attacks"], kind == NEWS_TYPE, F.col(own + "poor"), race.sparse, kind == RECORD_TYPE)
    reasons = F.filter(F.array(*[F.when(flag, F.lit(k)) for k, flag in s.items() if k != "sparse_source" or race.sparse]), lambda x: x.isNotNull())
    return items.select(*[F.col(f"`{c}`") for c in kept], F.col("relevance").withField("reasons", reasons).alias("relevance"))


def relevance_label(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("irrelevant")


def content_category(topics: dict[str, Column], connected: Column, priority_issue: Column) -> Column:
    """The first of topics (sports and entertainment first, then weather, food, generic_crime) that holds; a connection to the race overrides it."""
    out = F.when(_any(*[topics[k] for k in ("sports", "entertainment") if k in topics]) & connected, "campaign")
    for k, flag in topics.items():
        out = out.when(flag & (F.lit(True) if k in ("sports", "entertainment") else ~connected & ~priority_issue), k)
    return out.when(priority_issue, "priority_issue").when(connected, "campaign").otherwise("irrelevant")


def _own(items: DataFrame, name: str) -> str:
    """A prefix that begins no column of items."""
    while any(c.lower().startswith(name) for c in items.columns):
        name += "_"
    return name


def race_relevance(items: DataFrame, s: dict[str, Column], topics: dict[str, Column], excluded: Column, claims: Column, attacks: Column, news: Column, poor: Column, sparse: bool = False, public: Column | None = None) -> DataFrame:
    """items with a column `relevance`: a struct of score, label, action, action_score, category, geo and archived.

    s: the signals of POINTS; news, poor: a news item and one whose text was badly extracted; sparse: the race has little coverage; public: a
    public record, which with a word of elections needs no connection (default: one that s says is).  Each rule is a column that later ones
    read, so that plans grow with the number of rules, not with their depth.
    """
    own = _own(items, "_race_")
    c = lambda name: F.col(own + name)
    rule = lambda out, **rules: out.withColumns({own + k: v for k, v in rules.items()})
    public = s["record"] if public is None else public
    connected = _any(s["candidate"], s["opponent"], s["district"], s["office"], s["local"], s["keyword"], s["statement"])
    out = rule(items, named=_any(s["candidate"], s["opponent"], s["district"]), connected=connected, open=F.coalesce(public, F.lit(False)) & F.coalesce(s["election"], F.lit(False)))
    out = rule(out, category=content_category(topics, c("connected"), s["priority_issue"]))
    total = sum((_n(F.coalesce(s[k], F.lit(False)), F.lit(p[sparse])) for k, p in POINTS.items() if k in s), F.lit(0))
    out = rule(out, total=F.when(c("named"), F.greatest(total, F.lit(CONNECTED))).otherwise(total))
    total = c("total") - _n(c("category").isin(*topics) if topics else F.lit(False), NOISE_PENALTY) - _n(excluded & ~c("named"), NOISE_PENALTY)
    total = F.least(total, F.when(~c("connected") & ~c("open"), F.lit(40 if sparse else 30)), F.when(s["priority_issue"] & ~c("connected"), F.lit(30)))
    out = rule(out, score=F.greatest(F.lit(0), F.least(F.lit(100), total)), weak=poor & news, answer=(s["candidate"] | s["opponent"]) & (claims | attacks))
    score, action = c("score"), c("action")
    out = rule(out, action=F.when((score >= 60) & c("answer"), "respond").when(score >= 60, "review").when(score >= (30 if sparse else 40), "monitor").otherwise("ignore"))
    points = F.when(action == "respond", F.least(F.lit(100), score + 15)).when(action == "review", score).when(action == "monitor", F.least(score, F.lit(59))).otherwise(F.least(score, F.lit(39)))
    tame = c("weak") & (action == "respond")
    out = rule(out, points=F.when(tame, F.least(points, F.lit(69))).otherwise(points), act=F.when(tame, "review").otherwise(action), final=F.when(c("weak"), F.least(score, F.lit(70))).otherwise(score))
    out = rule(out, label=relevance_label(c("final")))
    archived = (c("label") == "irrelevant") | (c("act") == "ignore") | (c("category") == "irrelevant")
    if sparse:
        archived = archived & ~((c("final") >= 30) & (c("category") != "irrelevant"))
    geo = F.when(s["district"], "district").when(s["local"], "local").otherwise("none")
    found = F.struct(c("final").cast("int").alias("score"), c("label").alias("label"), c("act").alias("action"), c("points").cast("int").alias("action_score"), c("category").alias("category"), geo.alias("geo"), archived.alias("archived"))
    return out.select(*[F.col(f"`{x}`") for x in items.columns if x != "relevance"], found.alias("relevance"))


def verdict_score(verdict: Column, title_names: Column, body_names: Column, high_claims: Column, medium_claims: Column, credible: Column, signal: Column) -> Column:
    """0-100 from a verdict, names in title and body, claims and the source; without a signal of the race, 40 at most for the upper verdicts."""
    base = reduce(lambda out, kv: out.when(verdict == kv[0], kv[1]), VERDICTS.items(), F.when(F.lit(False), 0)).otherwise(0)
    total = base + F.least(F.lit(20), title_names * 12) + F.least(F.lit(8), body_names * 4) + F.least(F.lit(10), high_claims * 3 + medium_claims) + _n(credible, 3)
    total = F.when(verdict.isin("relevant", "critical") & ~signal, F.least(total, F.lit(40))).otherwise(total)
    return F.when(verdict == "irrelevant", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))


def consistent(verdict: Column, action: Column, attention: Column, reason: Column) -> Column:
    """A struct of action, attention and reason that do not contradict the verdict."""
    off = verdict == "irrelevant"
    said = F.trim(F.coalesce(reason, F.lit(""))) != ""
    keep = attention & said & ~off
    new = F.when(off, "ignore").when((verdict == "critical") & (action == "ignore"), "respond").otherwise(action)
    return F.struct(new.alias("action"), F.coalesce(keep, F.lit(False)).alias("attention"), F.when(keep | (~off & ~attention), reason).alias("reason"))


def sentiment(value: Column) -> Column:
    return F.when(value == "favors_candidate", "positive").when(value == "favors_opponent", "negative").otherwise("neutral")


def urgency_rank(label: Column) -> Column:
    """0 to 3 for low to critical, so that the most urgent label of a group is its largest; null for others."""
    return F.when(F.array_position(F.array(*[F.lit(u) for u in URGENCIES]), label) > 0, F.array_position(F.array(*[F.lit(u) for u in URGENCIES]), label) - 1)


#: Points by owner and stage of a narrative.
STAGE_POINTS = {("opponent", "spreading"): 60, ("opponent", "mainstream"): 50, ("opponent", "emerging"): 30, ("candidate", "fading"): 45, ("candidate", "dormant"): 30}


def frame_urgency(owner: Column, stage: Column, trend: Column, outlets: Column, outlets_before: Column, active_days: Column) -> Column:
    """A struct of points (0-100) and level."""
    points = sum((_n((owner == o) & (stage == s), p) for (o, s), p in STAGE_POINTS.items()), F.lit(0))
    points = points + _n(trend == "up", 20) - _n(trend == "down", 10) + _n(outlets > 5, 15) + _n(outlets > 10, 10)
    points = points + _n((outlets_before == 0) & (outlets > 0), 15) + _n(active_days >= 5, 10)
    points = F.greatest(F.lit(0), F.least(F.lit(100), points))
    return F.struct(points.cast("int").alias("points"), F.when(points >= 80, "critical").when(points >= 60, "high").when(points >= 35, "medium").otherwise("low").alias("level"))


def interest_velocity(rows, term: str, day: str, interest: str, now: Column):
    """(term, this_week, prior_weeks, velocity): mean interest of 7 days over that of days 8 to 28, which counts as 1 at least."""
    age = F.datediff(now.cast("date"), F.col(day))
    g = rows.groupBy(term).agg(F.avg(F.when(age.between(0, 7), F.col(interest))).alias("a"), F.avg(F.when(age.between(8, 28), F.col(interest))).alias("b"))
    a, b = (F.coalesce(c, F.lit(0.0)) for c in ("a", "b"))
    return g.select(term, a.alias("this_week"), b.alias("prior_weeks"), (a / F.greatest(b, F.lit(1.0))).alias("velocity"))
