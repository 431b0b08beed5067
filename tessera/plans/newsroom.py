"""Scoring, ownership and extraction rules on the driver tables, each with its SQL where SQL can say it.

Signals that a campaign's configuration would give are read off ids; texts are those of documents and pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import extract, names, ownership, relevance, scores, text
from tessera.operators import review
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


def _every(n: int, key: str = "doc_id"):
    return F.col(key) % n == 0


@query("""
with s as (select doc_id as i, i % 5 = 0 or i % 7 = 0 or i % 11 = 0 as named, i % 4 = 0 as pi, i % 8 = 0 as sp, i % 10 = 0 as we from documents),
c as (select *, named or i % 13 = 0 or i % 3 = 1 or i % 17 = 0 or i % 23 = 0 as con from s),
k as (select *, case when sp and con then 'campaign' when sp then 'sports' when we and not con and not pi then 'weather' when pi then 'priority_issue' when con then 'campaign' else 'irrelevant' end as category,
  (case when i % 5 = 0 then 35 else 0 end + case when i % 7 = 0 then 35 else 0 end + case when i % 11 = 0 then 30 else 0 end + case when i % 13 = 0 then 20 else 0 end + case when i % 3 = 1 then 15 else 0 end + case when i % 3 = 0 then 20 else 0 end
   + case when pi then 20 else 0 end + case when i % 6 = 0 then 10 else 0 end + case when i % 17 = 0 then 20 else 0 end + case when i % 19 = 0 then 20 else 0 end + case when i % 23 = 0 then 30 else 0 end) as t from c),
u as (select *, case when named then greatest(t, 60) else t end - case when category in ('sports', 'weather') then 50 else 0 end - case when i % 12 = 0 and not named then 50 else 0 end as t2 from k),
v as (select *, case when not con and not (i % 19 = 0 and i % 3 = 0) then least(t2, 30) else t2 end as t3 from u),
w as (select *, greatest(0, least(100, case when pi and not con then least(t3, 30) else t3 end)) as score, (i % 5 = 0 or i % 7 = 0) and (i % 14 = 0 or i % 15 = 0) as answer, i % 9 = 0 and i % 2 = 0 as weak from v),
x as (select *, case when score >= 60 and answer then 'respond' when score >= 60 then 'review' when score >= 40 then 'monitor' else 'ignore' end as a from w),
y as (select *, case a when 'respond' then least(100, score + 15) when 'review' then score when 'monitor' then least(score, 59) else least(score, 39) end as p from x),
z as (select i as doc_id, case when weak then least(score, 70) else score end as score, case when weak and a = 'respond' then 'review' else a end as action, case when weak and a = 'respond' then least(p, 69) else p end as action_score, category, case when i % 11 = 0 then 'district' when i % 3 = 1 then 'local' else 'none' end as geo from y)
select doc_id, cast(score as int) as score, case when score >= 80 then 'critical' when score >= 60 then 'high' when score >= 40 then 'medium' when score >= 20 then 'low' else 'irrelevant' end as label, action, cast(action_score as int) as action_score, category, geo, score < 20 or action = 'ignore' or category = 'irrelevant' as archived from z""")
def race_relevance(spark, d):
    s = dict(candidate=_every(5), opponent=_every(7), district=_every(11), office=_every(13), local=F.col("doc_id") % 3 == 1, election=_every(3), priority_issue=_every(4), known_issue=_every(6), keyword=_every(17), record=_every(19), statement=_every(23))
    docs = relevance.race_relevance(_docs(spark, d), s, {"sports": _every(8), "weather": _every(10)}, _every(12), _every(14), _every(15), _every(2), _every(9))
    return docs.select("doc_id", "relevance.*")


#: A race whose names and words stand in the driver's documents.
RACE = relevance.Race(candidate="LICENSE, ANN", opponents=("Dr. Bob Version Jr.", "X Jr"), district=("commons", "zz"), location="apache", office=("the end",), geography=("und der", "de la"), priorities=("haben",), issues=("Nicht wie", "ab"), keywords=("http", "les"), excluded=("por", "que"))

_SAID = "regexp_matches(t, '(^|[^\\pL\\pN_])(?:{})([^\\pL\\pN_]|$)')"
_NOISE = {"sports": "phillies|eagles|flyers|76ers|mlb|nba|nfl|nhl|coach|manager|playoffs|game|season", "entertainment": "movie|concert|celebrity|actor|music|festival|streaming", "weather": "weather|forecast|rain|snow|storm|temperature|heat wave", "food": "restaurant|dining|chef|menu|food|bar|brewery", "crime": "arrest|shooting|robbery|burglary|assault|police blotter"}


@query(f"""
with d as (select *, case lang when 'en' then 'news' when 'de' then 'public_record' when 'fr' then 'social' else 'campaign_note' end as kind from documents),
x as (select doc_id, kind, kind = 'news' and n_chars < 200 as weak, lower(trim(regexp_replace(coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(text, '') || '  ' || kind || ' ' || coalesce(source, '') || ' ', '[ \t\n\x0b\f\r]+', ' ', 'g'))) as t from d),
s as (select doc_id, kind, weak, {_SAID.format("license")} as cand, {_SAID.format("version")} as opp, {_SAID.format("commons|apache")} as dist, {_SAID.format("the end")} as office, {_SAID.format("und der|de la")} as geo,
  {_SAID.format("campaign|candidate|election|vote|voter|ballot|poll|endorsement|debate|primary|general election|yard sign")} as elect, {_SAID.format("haben")} as prio, {_SAID.format("nicht wie|nicht")} as issue, {_SAID.format("http|les")} as kw,
  kind = 'public_record' as rec, {_SAID.format("filing|finance|campaign finance|donation|pac|committee|ballot|election|ethics|public record")} as recterm, kind = 'campaign_note' as stm,
  {_SAID.format("sports|recipe|lottery|phillies|eagles|flyers|76ers|mlb|nba|nfl|nhl|playoffs|game|manager|coach|celebrity|restaurant|weather|por|que")} as excl, {_SAID.format("says|said|claims|claimed|announced|stated|pledged|promised|false|lied|lying|misleading|failed|failure|attack|accused|reckless|dangerous|corrupt|flip-flop")} as answer,
  {_SAID.format(_NOISE["sports"])} as sp, {_SAID.format(_NOISE["entertainment"])} as en, {_SAID.format(_NOISE["weather"])} as we, {_SAID.format(_NOISE["food"])} as fo, {_SAID.format(_NOISE["crime"])} as cr from x),
c as (select *, cand or opp or dist as named, dist or geo as loc, cand or opp or dist or office or geo or kw or stm as con from s),
k as (select *, case when sp or en then case when con then 'campaign' when sp then 'sports' else 'entertainment' end when we and not con and not prio then 'weather' when fo and not con and not prio then 'food' when cr and not con and not prio then 'generic_crime'
  when prio then 'priority_issue' when con then 'campaign' else 'irrelevant' end as category,
  cand::int * 35 + opp::int * 35 + dist::int * 30 + office::int * 20 + loc::int * 15 + elect::int * 20 + prio::int * 20 + issue::int * 10 + kw::int * 20 + (rec and recterm)::int * 20 + stm::int * 30 as p from c),
u as (select *, case when named then greatest(p, 60) else p end - case when category in ('sports', 'entertainment', 'weather', 'food', 'generic_crime') then 50 else 0 end - case when excl and not named then 50 else 0 end as p2 from k),
v as (select *, case when not con and not (rec and elect) then least(p2, 30) else p2 end as p3 from u),
w as (select *, greatest(0, least(100, case when prio and not con then least(p3, 30) else p3 end)) as score from v),
a as (select *, case when score >= 60 and (cand or opp) and answer then 'respond' when score >= 60 then 'review' when score >= 40 then 'monitor' else 'ignore' end as act from w),
z as (select *, case act when 'respond' then least(100, score + 15) when 'review' then score when 'monitor' then least(score, 59) else least(score, 39) end as pts from a),
f as (select doc_id, case when weak then least(score, 70) else score end as score, case when weak and act = 'respond' then 'review' else act end as action, case when weak and act = 'respond' then least(pts, 69) else pts end as action_score, category, case when dist then 'district' when loc then 'local' else 'none' end as geo,
  array_to_string(list_filter([case when cand then 'candidate' end, case when opp then 'opponent' end, case when dist then 'district' end, case when office then 'office' end, case when loc then 'local' end, case when elect then 'election' end, case when prio then 'priority_issue' end, case when issue then 'known_issue' end, case when kw then 'keyword' end, case when rec and recterm then 'record' end, case when stm then 'statement' end], lambda r: r is not null), ',') as reasons from z)
select doc_id, cast(score as int) as score, case when score >= 80 then 'critical' when score >= 60 then 'high' when score >= 40 then 'medium' when score >= 20 then 'low' else 'irrelevant' end as label, action, cast(action_score as int) as action_score, category, geo, score < 20 or action = 'ignore' or category = 'irrelevant' as archived, reasons from f""")
def text_relevance(spark, d):
    """Every signal read from title, text and source with term tables; kinds of sources follow the language, short news count as badly extracted."""
    kind = F.when(F.col("lang") == "en", "news").when(F.col("lang") == "de", "public_record").when(F.col("lang") == "fr", "social").otherwise("campaign_note")
    none = F.lit(None).cast("string")
    docs = relevance.text_relevance(_docs(spark, d), F.substring_index("text", "\n", 1), F.col("text"), none, kind, F.col("source"), none, F.when(F.col("n_chars") < 200, "poor"), RACE)
    return docs.select("doc_id", "relevance.*").withColumn("reasons", F.array_join("reasons", ","))


@query("""
with v as (select event_id, case event_id % 5 when 0 then 'irrelevant' when 1 then 'loosely_related' when 2 then 'critical' else 'relevant' end as verdict, case event_id % 3 when 0 then 'ignore' when 1 then 'monitor' else 'respond' end as act,
  event_id % 2 = 0 as att, case when event_id % 4 = 0 then 'why' when event_id % 4 = 2 then ' ' end as why, event_id % 7 as n, user_id % 3 as h, event_id % 11 = 0 as signal from events),
t as (select *, case verdict when 'loosely_related' then 20 when 'relevant' then 50 when 'critical' then 75 else 0 end + least(20, (n % 3) * 12) + least(8, n * 4) + least(10, h * 3 + n % 2) + case when h = 0 then 3 else 0 end as t from v)
select event_id, cast(case when verdict = 'irrelevant' then 0 else greatest(0, least(100, case when verdict in ('relevant', 'critical') and not signal then least(t, 40) else t end)) end as int) as score,
  case when verdict = 'irrelevant' then 'ignore' when verdict = 'critical' and act = 'ignore' then 'respond' else act end as action, coalesce(att and trim(coalesce(why, '')) <> '' and verdict <> 'irrelevant', false) as attention,
  coalesce(case when (att and trim(coalesce(why, '')) <> '' and verdict <> 'irrelevant') or (verdict <> 'irrelevant' and not att) then why end, '-') as reason,
  case n when 0 then 'positive' when 1 then 'negative' else 'neutral' end as sentiment from t""")
def verdict_scores(spark, d):
    i, n, h = F.col("event_id"), F.col("event_id") % 7, F.col("user_id") % 3
    verdict = F.when(i % 5 == 0, "irrelevant").when(i % 5 == 1, "loosely_related").when(i % 5 == 2, "critical").otherwise("relevant")
    action = F.when(i % 3 == 0, "ignore").when(i % 3 == 1, "monitor").otherwise("respond")
    score = relevance.verdict_score(verdict, n % 3, n, h, n % 2, h == 0, i % 11 == 0)
    fixed = relevance.consistent(verdict, action, i % 2 == 0, F.when(i % 4 == 0, "why").when(i % 4 == 2, " "))
    tone = relevance.sentiment(F.when(n == 0, "favors_candidate").when(n == 1, "favors_opponent"))
    out = table(spark, d, "events").select("event_id", score.cast("int").alias("score"), fixed.alias("f"), tone.alias("sentiment"))
    return out.select("event_id", "score", "f.action", "f.attention", F.coalesce("f.reason", F.lit("-")).alias("reason"), "sentiment")


@query("""
with f as (select user_id, count(*) as n, user_id % 2 as o, user_id % 5 as s, user_id % 3 as t from events group by 1),
p as (select user_id, greatest(0, least(100, case when o = 0 then case s when 0 then 60 when 1 then 50 when 2 then 30 else 0 end else case s when 3 then 45 when 4 then 30 else 0 end end + case t when 0 then 20 when 1 then -10 else 0 end
  + case when n % 13 > 5 then 15 else 0 end + case when n % 13 > 10 then 10 else 0 end + case when n % 4 = 0 and n % 13 > 0 then 15 else 0 end + case when n % 8 >= 5 then 10 else 0 end)) as points from f)
select user_id, cast(points as int) as points, case when points >= 80 then 'critical' when points >= 60 then 'high' when points >= 35 then 'medium' else 'low' end as level from p""")
def frame_urgency(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    pick = lambda k, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("user_id") % k + 1).cast("int"))
    u = relevance.frame_urgency(pick(2, "opponent", "candidate"), pick(5, "spreading", "mainstream", "emerging", "fading", "dormant"), pick(3, "up", "down", "flat"), F.col("n") % 13, F.col("n") % 4, F.col("n") % 8)
    return g.select("user_id", u.alias("u")).select("user_id", "u.*")


@query("select event_type, cast(max(case user_id % 9 when 0 then 3 when 1 then 2 when 2 then 1 when 3 then 0 end) as int) as urgency from events where event_id % 4 > 0 group by 1")
def issue_urgency(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ["critical", "high", "medium", "low"] + ["none"] * 5]), (F.col("user_id") % 9 + 1).cast("int"))
    return table(spark, d, "events").where("event_id % 4 > 0").groupBy("event_type").agg(F.max(relevance.urgency_rank(label)).cast("int").alias("urgency"))


@query("""
with n as (select date_trunc('day', max(ts)) as n from events), g as (select event_type, coalesce(avg(case when date_diff('day', cast(ts as date), cast(n as date)) between 0 and 7 then value end), 0) as a, coalesce(avg(case when date_diff('day', cast(ts as date), cast(n as date)) between 8 and 28 then value end), 0) as b from events, n group by 1)
select event_type, round(a, 4) as this_week, round(b, 4) as prior_weeks, round(a / greatest(b, 1), 4) as velocity from g""")
def interest_velocity(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max(F.to_date("ts"))).first()[0])
    out = relevance.interest_velocity(e.withColumn("day", F.to_date("ts")), "event_type", "day", "value", now)
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("this_week", "prior_weeks", "velocity")])


_KIND = "case doc_id % 6 when 0 then 'campaign_note' when 1 then 'opponent_statement' when 2 then 'news' when 3 then 'social' when 4 then 'manual' else 'web' end"
_WORD = r"'(?i)(^|[^A-Za-z0-9])({})($|[^A-Za-z0-9])'"


def _kind():
    return F.element_at(F.array(*[F.lit(x) for x in ("campaign_note", "opponent_statement", "news", "social", "manual", "web")]), (F.col("doc_id") % 6 + 1).cast("int"))


@query(f"""
with s as (select doc_id, {_KIND} as kind, lower(source) as meta, lower(split_part(text, chr(10), 1) || ' ' || source || ' ' || text) as f from documents where source is not null and text is not null),
r as (select *, contains(meta, 'forum') as mine, contains(meta, 'wiki') as theirs, regexp_matches(f, {_WORD.format('license')}) as party, regexp_matches(f, {_WORD.format('commons')}) as grp, contains(meta, 'campaign') or contains(meta, 'official') or contains(meta, 'elect') or contains(meta, 'press release') as cl from s),
x as (select doc_id, case when kind = 'campaign_note' then case when mine or contains(f, 'forum') then 1 when theirs or contains(f, 'wiki') then 2 else 3 end
  when kind = 'opponent_statement' and not party and not grp then case when theirs then 4 else 2 end when party then 5 when grp then 6 when mine and cl then 7 when theirs and cl then 2
  when kind in ('social', 'news') and (contains(meta, 'campaign') or contains(meta, 'statement') or contains(meta, 'press release')) then 8 when contains(f, 'version') or kind = 'manual' then 9 else 10 end as r from r)
select doc_id, case r when 1 then 'candidate_statement' when 2 then 'opponent_statement' when 3 then 'community/manual' when 4 then 'opponent_statement' when 5 then 'party_committee_statement' when 6 then 'outside_group_statement' when 7 then 'candidate_statement' when 8 then 'media' when 9 then 'community/manual' else 'unclear' end as owner,
  case when r in (1, 4, 5, 6) then 'high' when r in (3, 10) then 'low' else 'medium' end as confidence from x""")
def source_owners(spark, d):
    docs = _docs(spark, d).where("source is not null and text is not null")
    o = ownership.source_owner(_kind(), F.substring_index("text", "\n", 1), F.col("source"), F.lit(None).cast("string"), F.col("text"), "forum", ["wiki"], ["license"], ["commons"], ["version"])
    return docs.select("doc_id", o.alias("o")).select("doc_id", "o.*")


@query(r"""
with s as (select doc_id, doc_id % 4 as o, source, lower(text) as t, doc_id % 3 = 0 as room from documents where text is not null and source is not null),
r as (select *, regexp_matches(t, '\b(?:the)\b\s+(?:said|says|stated|argued|announced|promised|told)\b|\b(?:said|says|stated|argued|announced|promised|told)\s+(?:the)\b') as mine, regexp_matches(t, '\b(?:die|der)\b\s+(?:said|says|stated|argued|announced|promised|told)\b|\b(?:said|says|stated|argued|announced|promised|told)\s+(?:die|der)\b') as theirs,
  case when not room and o = 0 then 'pro_candidate' when not room and o = 1 then 'pro_opponent' end as own, case lower(source) when 'web' then 'pro_candidate' when 'books' then 'pro_opponent' end as leaning from s)
select doc_id, coalesce(own, leaning, case when mine and not theirs then 'pro_candidate' when theirs and not mine then 'pro_opponent' end, 'neutral') as perspective,
  case when own is not null then 'existing' when leaning is not null then 'outlet' when mine <> theirs then 'attribution' else 'fallback' end as method from r""")
def perspectives(spark, d):
    docs = _docs(spark, d).where("text is not null and source is not null")
    owner = F.element_at(F.array(*[F.lit(x) for x in ("candidate_statement", "opponent_statement", "media", "unclear")]), (F.col("doc_id") % 4 + 1).cast("int"))
    p = ownership.perspective(owner, F.col("source"), {"web": "pro_candidate", "books": "pro_opponent"}, F.col("text"), ["the"], ["die", "der"], _every(3))
    return docs.select("doc_id", p.alias("p")).select("doc_id", "p.*")


@query("select user_id, coalesce(posture, '-') as posture, coalesce(urgency, '-') as urgency from (select distinct user_id, case user_id % 7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(ownership.LENS)) + " end as signal, case user_id % 4 when 0 then 'candidate' when 1 then 'opponent' when 2 then 'media' end as owner from events) left join (values " + ", ".join(f"('{s}', '{o}', '{p}', '{u}')" for s, cells in ownership.LENS.items() for o, (p, u) in zip(("candidate", "opponent", "media"), cells, strict=True)) + ") l(signal, owner, posture, urgency) using (signal, owner)")
def strategic_lens(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    signal = F.element_at(F.array(*[F.lit(s) for s in [*ownership.LENS, None]]), (F.col("user_id") % 7 + 1).cast("int"))
    owner = F.element_at(F.array(*[F.lit(s) for s in ["candidate", "opponent", "media", None]]), (F.col("user_id") % 4 + 1).cast("int"))
    return ownership.strategic_lens(u.withColumn("signal", signal).withColumn("owner", owner)).select("user_id", F.coalesce("posture", F.lit("-")).alias("posture"), F.coalesce("urgency", F.lit("-")).alias("urgency"))


@query(f"""
select doc_id, case when kind = 'opponent_statement' or regexp_matches(name, {_WORD.format('forum')}) then 'campaign_source' when kind = 'social' or regexp_matches(name, {_WORD.format('web|reddit')}) then 'social_media' when ot = 'local_news' or (ot in ('regional_news', 'broadcast') and st = 'pa') then 'local_news'
  when ot in ('regional_news', 'broadcast', 'national', 'blog') then 'national_news' when regexp_matches(name, {_WORD.format('news')}) then 'local_news' when trim(name) <> '' then 'national_news' else 'other' end as category
from (select doc_id, {_KIND} as kind, coalesce(source, '') as name, case doc_id % 7 when 0 then 'local_news' when 1 then 'regional_news' when 2 then 'broadcast' when 3 then 'national' when 4 then 'blog' else '' end as ot, case when doc_id % 2 = 0 then 'pa' else 'ny' end as st from documents)""")
def source_categories(spark, d):
    outlet = F.element_at(F.array(*[F.lit(x) for x in ("local_news", "regional_news", "broadcast", "national", "blog", "", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    c = ownership.source_category(_kind(), F.coalesce("source", F.lit("")), outlet, F.when(_every(2), "pa").otherwise("ny"), "PA", ["forum"], ["web", "reddit"], ["news"])
    return _docs(spark, d).select("doc_id", c.alias("category"))


_RULES = [("harm", r"\bvoted to (?:cut|repeal)\b", "attack"), ("vote", r"\bvoted?s?\b", "vote"), ("says", r"\b(?:said|says)\b", "statement")]


@query(r"""
select item_id, coalesce(case when attack then 'attack' when vote then 'vote' when says then 'statement' when label = 'defense' and not defended then null else label end, '-') as label,
  case when attack then 'positive:harm' when vote then 'positive:vote' when says then case when label = 'statement' then 'confirmed:says' else 'positive:says' end when label = 'defense' and not defended then 'sanity_downgrade_from:defense' else 'kept' end as rule
from (select item_id, regexp_matches(text, '(?i)\bvoted to (?:cut|repeal)\b') as attack, regexp_matches(text, '(?i)\bvoted?s?\b') as vote, regexp_matches(text, '(?i)\b(?:said|says)\b') as says, regexp_matches(text, '(?i)\bdefend') as defended,
  case item_id % 3 when 0 then 'statement' when 1 then 'defense' end as label from benchmark where trim(text) <> '')""")
def label_corrections(spark, d):
    b = table(spark, d, "benchmark").where("trim(text) <> ''")
    label = F.when(F.col("item_id") % 3 == 0, "statement").when(F.col("item_id") % 3 == 1, "defense")
    c = ownership.corrected_label(F.col("text"), label, _RULES, {"defense": r"\bdefend"})
    return b.select("item_id", c.alias("c")).select("item_id", F.coalesce("c.label", F.lit("-")).alias("label"), "c.rule")


@query()
def owner_corrections(spark, d):
    """Attacks are found by patterns that look ahead, which SQL lacks; tests compare with examples."""
    verbs, nouns, phrases = ["cuts", "broke"], ["record", "scandal"], ["voted to cut"]
    hit = [ownership.attacks(F.col("text"), n, verbs, nouns, phrases) for n in ("Jane Roe", "Doe, John")]
    owner = F.element_at(F.array(*[F.lit(x) for x in ("candidate", "opponent", "media")]), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", ownership.corrected_owner(owner, *hit).alias("owner"))


@query(r"""
with s as (select conv_id, turn, trim(unnest(string_split_regex(text, '[.!?]+'))) as s from conversations), l as (select *, lower(s) as l from s where s <> ''),
k as (select *, strpos(l, 'the') as o, strpos(l, 'and') as c from l)
select conv_id, turn, s as sentence, contains(l, 'not') as attack, contains(l, 'is') as claim, contains(l, 'will') as promise, c > 0 as verify, coalesce(case when contains(l, 'time') or contains(l, 'year') then 'history' when contains(l, 'word') then 'language' end, '-') as theme
from k where o > 0 and (c = 0 or c > o) and (contains(l, 'not') or contains(l, 'is') or contains(l, 'will'))""")
def opponent_sentences(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"[.!?]+")).alias("sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    k = ownership.sentence_kinds(F.col("sentence"), "the", "and", ["not"], ["is"], ["will"])
    t = F.coalesce(ownership.theme(F.col("sentence"), {"history": ["time", "year"], "language": ["word"]}), F.lit("-"))
    return s.select("conv_id", "turn", "sentence", k.alias("k"), t.alias("theme")).where("k is not null").select("conv_id", "turn", "sentence", "k.*", "theme")


@query(r"""
with p as (select page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d+$', ''), '^www\.', '') as h, case when page_id % 4 = 0 then 99 end as o from pages),
t as (select h, min(o) as o from (select domain as h, i as o from (values ('example.com', 1), ('example.org', 2), ('example.net', 2)) v(domain, i)) group by 1)
select page_id, coalesce(p.o, t.o, case when page_id % 3 = 0 then 1 when page_id % 3 = 1 then 2 end, -1) as outlet from p left join t using (h)""")
def outlet_links(spark, d):
    outlets = spark.createDataFrame([(1, "The Daily Tribune", ["example.com"]), (2, "Harbour Herald", ["example.org", "example.net"])], "outlet int, name string, domains array<string>")
    name = F.when(F.col("page_id") % 3 == 0, "Google News: The Daily Tribune").when(F.col("page_id") % 3 == 1, "Google News: Harbour Times")
    items = table(spark, d, "pages").select("page_id", "url", name.alias("name"), F.when(F.col("page_id") % 4 == 0, 99).alias("outlet"))
    return ownership.linked_outlets(items, outlets).select("page_id", F.coalesce("outlet", F.lit(-1)).alias("outlet"))


_BOILER = ["subscribe", "cookie", "all rights reserved"]


@query()
def page_extracts(spark, d):
    """Paragraphs, quality and date of every page; tests compare with a plain version."""
    p = table(spark, d, "pages").withColumn("title", extract.clean_title(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    p = p.withColumn("parts", extract.paragraphs(F.col("html"), F.col("title"), _BOILER)).withColumn("text", F.array_join("parts", "\n"))
    q = extract.extraction_quality(F.col("text"), F.col("title"), F.col("html"), F.size("parts"), _BOILER)
    return p.select("page_id", "title", F.md5("text").alias("digest"), F.size("parts").alias("paragraphs"), q.alias("q"), extract.html_date(F.col("html")).alias("published")).select("page_id", "title", "digest", "paragraphs", "q.*", "published")


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(split_part(text, chr(10), 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), chr(0), ''), '\s+', ' ', 'g'), '[\x{1F000}-\x{1FFFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{2300}-\x{23FF}\x{200D}\x{FE0F}\x{20E3}]+', '', 'g'), '\s+', ' ', 'g')) as title from documents where text is not null""")
def clean_titles(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", extract.clean_title(F.substring_index("text", "\n", 1)).alias("title"))


@query(r"""
with p as (select page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) as h, lower(coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')) as p from pages)
select page_id, h = 'example.org' or ends_with(h, '.example.org') or contains(p, '/scorecard') or ((h = 'example.net' or ends_with(h, '.example.net')) and not (""" + " or ".join(f"contains(p, '{x}')" for x in extract.POST_PATHS) + """)) as landing from p""")
def landing_pages(spark, d):
    host, path = (F.coalesce(F.regexp_extract("url", r, 1), F.lit("")) for r in (r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"))
    return table(spark, d, "pages").select("page_id", extract.landing_page(F.lower(host), path, ["example.org"], ["example.net"]).alias("landing"))


@query(r"""
select doc_id, contains(t, '<') or contains(t, '[...]') or (contains(t, ' —') and (contains(t, '(AP)') or contains(t, 'the '))) as raw, trim(t) <> '' and (rtrim(lower(trim(t)), '.') in ('n/a', 'no content') or (length(lower(trim(t))) >= 40 and (contains(lower(trim(t)), 'cannot') or contains(lower(trim(t)), 'license')))) as refusal
from (select doc_id, coalesce(text, '') as t from documents)""")
def summary_filters(spark, d):
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", extract.raw_summary(t, ["(AP)", "the "]).alias("raw"), extract.refusal(t, ["cannot", "license"], ["N/A".lower(), "no content."]).alias("refusal"))


@query(r"""
with n as (select c.conv_id, c.turn, trim(regexp_replace(lower(c.text), '[^\p{L}\p{N}]+', ' ', 'g')) as t, lag(trim(regexp_replace(lower(c.text), '[^\p{L}\p{N}]+', ' ', 'g'))) over (partition by conv_id order by turn) as before, lower(trim(substr(c.text, 1, 8))) as f from conversations c)
select conv_id, turn, coalesce(before <> '' and contains(t, split_part(before, ' ', 1)) and split_part(before, ' ', 1) <> '', false) as quoted, coalesce(case f when 'and' then 'and' when 'the' then 'the' end, case when f <> '' and (contains(f, 'and') or contains('and', f)) then 'and' when f <> '' and (contains(f, 'the') or contains('the', f)) then 'the' end, '-') as frame from n""")
def quote_checks(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    norm = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    c = c.withColumn("word", F.substring_index(F.lag(norm).over(Window.partitionBy("conv_id").orderBy("turn")), " ", 1))
    return c.select("conv_id", "turn", extract.quote_found(F.col("word"), F.col("text")).alias("quoted"), F.coalesce(extract.named_frame(F.substring("text", 1, 8), ["and", "the"]), F.lit("-")).alias("frame"))


@query(r"""select item_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\bthese\b', 'the others', 'gi'), '\band\b', 'plus', 'gi'), '\s+', ' ', 'g'))) as digest from benchmark""")
def anonymised_texts(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(extract.anonymised(F.col("text"), {"and": "plus", "these": "the others"})).alias("digest"))


@query(r"""select event_id, cast(json_extract(regexp_replace(replace(props, '}', ',}'), ',(\s*[}\]])', '\1', 'g'), '$.k') as bigint) as k from events""")
def json_repairs(spark, d):
    broken = F.replace(F.col("props"), F.lit("}"), F.lit(",}"))
    return table(spark, d, "events").select("event_id", F.from_json(extract.repaired_json(broken), "k bigint")["k"].alias("k"))


@query(r"""select p_partkey, array_to_string(list_sort(list_distinct([lower(p_name)] || list_filter(string_split_regex(lower(p_name), '\s+'), lambda w: length(w) > 2))), '|') as tokens from part where length(trim(p_name)) > 2""")
def name_token_lists(spark, d):
    return table(spark, d, "part").where("length(trim(p_name)) > 2").select("p_partkey", F.array_join(F.array_sort(extract.name_tokens(F.col("p_name"))), "|").alias("tokens"))


@query(r"""select c_custkey, c_name as name from customer""")
def plain_names(spark, d):
    """Titles and suffixes put around every name come off again."""
    c = table(spark, d, "customer")
    worn = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Sen. ", "Lieutenant Governor ", "Prof. Dr. ", "")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"), F.element_at(F.array(*[F.lit(x) for x in (", Jr.", " III", "", " Ph.D.")]), (F.col("c_custkey") % 4 + 1).cast("int")))
    return c.select("c_custkey", names.without_honorifics(worn).alias("name"))


@query(r"""
with p as (select page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), ':\d+$', ''), '^www\.', '') as h, case page_id % 5 when 0 then 'YouTube: a' when 1 then 'Mastodon via b' when 2 then 'Daily' else 'Reddit r/x' end as n from pages)
select page_id, h as domain, case page_id % 5 when 0 then 'youtube' when 1 then 'mastodon' when 2 then '-' else 'reddit' end as platform from p""")
def platforms(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("YouTube: a", "Mastodon via b", "Daily", "Reddit r/x", "Reddit r/x")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), F.coalesce(text.platform(F.col("url"), name), F.lit("-")).alias("platform"))


@query(r"""
select c_custkey, c_custkey % 3 = 0 as junk, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Roe' as human, strftime(date '2020-01-01' + cast(c_custkey % 900 as int), '%Y-%m-%d') as day, c_custkey % 2 = 0 as same from customer""")
def name_scalars(spark, d):
    """Junk titles, humanised names, parsed dates and nicknames on values made of customers' keys."""
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, F.lit(" Untitled ")).otherwise(F.concat(F.lit("Story of "), "c_name"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int"))
    written = F.when(k % 2 == 0, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    same = names.same_person(F.lit("Bob Roe"), F.when(k % 2 == 0, F.lit("Rep. Robert Roe")).otherwise(F.lit("Robert Roe Jr.")), {"bob": "robert"})
    return table(spark, d, "customer").select("c_custkey", text.junk_title(title, ["untitled"]).alias("junk"), text.humanise_name(F.concat(F.lit("ROE, "), F.upper("c_mktsegment"))).alias("human"), F.date_format(text.parsed_date(written), "yyyy-MM-dd").alias("day"), same.alias("same"))


@query("""
with n as (select n_nationkey, n_nationkey::varchar as n, lpad(n_nationkey::varchar, 2, '0') as two, case when n_nationkey % 100 between 10 and 19 then 'th' else case n_nationkey % 10 when 1 then 'st' when 2 then 'nd' when 3 then 'rd' else 'th' end end as th from nation)
select n_nationkey, 'PA-' || two || case when n <> two then '|PA-' || n else '' end || '|PA' || two || '|PA ' || n || '|' || n || th || ' district|District ' || n || '|' || n || th || ' Congressional District' as forms,
  'Jane Q. Roe' as byline, len(json_extract(case when n_nationkey % 2 = 0 then '["a","b"]' else '[]' end, '$[*]')) as listed from n""")
def district_scalars(spark, d):
    n = table(spark, d, "nation")
    forms = F.array_join(names.district_forms(F.concat(F.lit("PA-"), F.col("n_nationkey").cast("string"))), "|")
    listed = F.size(text.json_list(F.when(F.col("n_nationkey") % 2 == 0, '["a","b"]').otherwise("not json"))).cast("long")
    return n.select("n_nationkey", forms.alias("forms"), names.byline(F.concat(F.lit("Head\nBy Jane Q. Roe\n"), "n_name")).alias("byline"), listed.alias("listed"))


@query("""
with r as (select event_id, value >= 60 or event_type in ('click', 'error') as pass from events) select pass, count(*) as n, min(event_id) as first from r group by 1""")
def review_partition(spark, d):
    """The review queue's two outputs from one predicate, and their counts."""
    good, bad = review.partition(table(spark, d, "events"), (F.col("value") >= 60) | F.col("event_type").isin("click", "error"))
    both = good.withColumn("pass", F.lit(True)).unionByName(bad.withColumn("pass", F.lit(False)))
    return both.groupBy("pass").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""select event_id, cast(floor(coalesce(user_id % 100, 0) * 0.6) + floor((event_id % 100) * 0.35) as bigint) as base from events""")
def priority_base(spark, d):
    p = scores.priority(F.col("user_id") % 100, F.col("event_id") % 100, F.lit("low"), F.lit(99), F.lit("good"), F.lit(False), F.lit(False))
    return table(spark, d, "events").select("event_id", p.cast("long").alias("base"))
