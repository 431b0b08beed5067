"""Scoring and classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the lifecycle rules.
DORMANT_DAYS, SPREADING, FADING = 14, 2.0, 0.5
SPIKE, DEAD_SPREAD = 2.0, 20.0


def reach_weight(visitors: Column, authority: Column) -> Column:
    return F.when(visitors > 0, visitors * 0.003).otherwise(F.coalesce(authority, F.lit(5)) / 10.0)


def velocity(week: Column, prior_weeks3: Column) -> Column:
    return week / F.greatest(prior_weeks3 / 3.0, F.lit(1.0))


def momentum(outlets: Column, clusters: Column, trend: Column) -> Column:
    up = [c >= SPIKE for c in (outlets, clusters, trend)]
    return F.when(up[0] & up[2], "viral").when(up[0], "amplified").when(up[1], "elite_only").when(up[2], "missing_coverage").otherwise("stable")


def stage(total: Column, week: Column, baseline: Column, days_since: Column, scale: dict[str, Column]) -> Column:
    """Lifecycle stage; scale: emerging, mainstream, resurfacing (totals), floor (weekly), baseline (weekly)."""
    return (
        F.when((total == 0) | days_since.isNull() | (days_since > DORMANT_DAYS), "dormant")
        .when(total <= scale["emerging"], "emerging")
        .when((total >= scale["resurfacing"]) & (week >= F.greatest(F.lit(2), F.floor(scale["floor"] / 2))) & (baseline == 0), "resurfacing")
        .when((week >= scale["floor"]) & (baseline >= scale["baseline"]) & (week >= baseline * SPREADING), "spreading")
        .when((baseline >= scale["baseline"] * 2) & (week < baseline * FADING), "fading")
        .when(total >= scale["mainstream"], "mainstream")
        .otherwise("active")
    )


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index int(p * (n - 1)) of a sorted array: no interpolation."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * p) + 1).cast("int"))


def confidence(spread: Column) -> Column:
    return F.when(spread.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / DEAD_SPREAD))


def blend(own: Column, own_spread: Column, other: Column, other_spread: Column) -> Column:
    """Confidence-weighted mean of a market's own price and 100 minus the other side's; the direct price where both are dead."""
    a = F.when(own.isNotNull(), confidence(own_spread)).otherwise(0.0)
    b = F.when(other.isNotNull(), confidence(other_spread)).otherwise(0.0)
    mean = (F.coalesce(own * a, F.lit(0.0)) + F.coalesce((100 - other) * b, F.lit(0.0))) / (a + b)
    return F.bround(F.when(a + b > 0, mean).otherwise(F.coalesce(own, 100 - other)), 2)


def priority(relevance: Column, actionability: Column, urgency: Column, age_days: Column, quality: Column, has_activity: Column, has_note: Column) -> Column:
    s = F.floor(F.coalesce(relevance, F.lit(0)) * 0.6) + F.floor(F.coalesce(actionability, F.lit(0)) * 0.35)
    s += F.when(urgency == "high", 10).when(urgency == "medium", 5).otherwise(0)
    s += F.when(has_activity, 20).otherwise(0) + F.when(has_note, 15).otherwise(0)
    s += F.when(age_days <= 3, 10).when(age_days <= 7, 5).otherwise(0)
    return F.greatest(F.lit(0), s - F.when(quality == "poor", 25).when(quality == "mixed", 10).otherwise(0))


def trend(current: Column, prior: Column) -> Column:
    """rising over 1.3 times the prior count, falling under 0.7; without a prior rising if there is any."""
    return F.when(prior == 0, F.when(current > 0, "rising").otherwise("stable")).when(current > prior * 1.3, "rising").when(current < prior * 0.7, "falling").otherwise("stable")


def review(score: Column, has_action: Column) -> Column:
    return F.when((score >= 55) | ((score >= 40) & has_action), "approve").when(score < 30, "dismiss").otherwise("keep")


#: Points of what is featured.
LENS_POINTS = {"high": 40, "medium": 20, "low": 5}
STAGE_POINTS = {"emerging": 15, "resurfacing": 12, "spreading": 8}
SIGNAL_POINTS = {"viral": 20, "missing_coverage": 18, "amplified": 15, "elite_only": 8}
TIER_POINTS = {"national": 6.0, "regional": 3.0, "local": 1.5, "social": 0.5}


def _points(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in table.items()], F.lit(0))


def acceleration(last3: Column, last14: Column) -> Column:
    """Points for a mean of the last 3 days of 3, 2 or 1.5 times that of 14; none below 5 items."""
    ratio = (last3 / 3.0) / (last14 / 14.0)
    return F.when(last14 < 5, 0).when(ratio >= 3, 25).when(ratio >= 2, 18).when(ratio >= 1.5, 10).otherwise(0)


def featured_score(urgency: Column, last3: Column, last14: Column, stage_: Column, tiers: dict[str, Column], active_days: Column, signal: Column, featured_days: Column) -> Column:
    """What speaks for featuring a frame: urgency, acceleration, novelty, spread over tiers (30 at most), persistence (14) and momentum, less 8 (24 at most) for each day beyond two it was featured."""
    spread = sum((F.coalesce(n, F.lit(0)) * TIER_POINTS[k] for k, n in tiers.items()), F.lit(0.0))
    worn = F.when(featured_days > 2, F.least((featured_days - 2) * 8, F.lit(24))).otherwise(0)
    return _points(urgency, LENS_POINTS) + acceleration(last3, last14) + _points(stage_, STAGE_POINTS) + F.least(spread, F.lit(30.0)) + F.least(active_days * 2, F.lit(14)) + _points(signal, SIGNAL_POINTS) - worn


#: Points by kind of source.
EVIDENCE_POINTS = {"public_record": 15, "news": 5, "canvassing": 5, "opponent_statement": 10, "social": -5}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def evidence(url: Column, name: Column, text: Column, kind: Column, quality: Column) -> Column:
    """0-100: a source that is named and linked, length, numbers, dates and kind speak for it, a bad extraction against."""
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    s = F.lit(30) + flag(F.length(url) > 0, 15) + flag(F.length(name) > 0, 10) + flag(F.length(text) > 500, 10) + flag(F.length(text) > 1500, 5)
    s = s + flag(text.rlike(r"\d"), 15) + flag(text.rlike(rf"(?i)\b({MONTHS})\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b"), 10) + _points(kind, EVIDENCE_POINTS)
    return F.greatest(F.lit(0), F.least(F.lit(100), s - flag(quality == "poor", 35) - flag(quality == "mixed", 15))).cast("int")
