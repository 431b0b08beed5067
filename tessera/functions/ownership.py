"""Who speaks: owners of sources, whom a piece favours, what a narrative calls for, and corrections of such labels.

Names, domains and word lists belong to a campaign and come in as parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import domain as host_of
from tessera.functions.text import keyword_pattern

#: Words that make a domain or a source's name that of a campaign.
DOMAIN_SIGNALS = ["campaign", "elect", "for", "vote"]
NAME_SIGNALS = ["campaign", "official", "elect", "press release"]


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def has(text: Column, words: list[str]) -> Column:
    """Whether any word or phrase stands in the text as such."""
    return F.coalesce(text.rlike(keyword_pattern(words)), F.lit(False)) if words else F.lit(False)


def owned_domain(domain: Column, name: str, signals: list[str] = DOMAIN_SIGNALS) -> Column:
    """A part of the name of over three letters stands in the domain, with a word of ownership or under .gov."""
    parts = [p.lower() for p in name.split() if len(p) > 3]
    named = _any([domain.contains(p) for p in parts])
    return F.coalesce(named & (domain.rlike(r"\.gov$") | _any([domain.contains(s) for s in signals])), F.lit(False))


def source_owner(kind: Column, title: Column, name: Column, url: Column, body: Column, candidate: str, opponents: list[str], committee: list[str], outside: list[str], community: list[str]) -> Column:
    """A struct of owner and confidence.  Names count in a source's name and domain, not inside what it writes about; the first rule that holds decides."""
    domain = F.coalesce(host_of(url), F.lit(""))
    full = F.lower(F.concat_ws(" ", title, name, url, body))
    meta = F.lower(F.concat_ws(" ", name, domain))
    mine, theirs = meta.contains(candidate.lower()), _any([meta.contains(o.lower()) for o in opponents])
    my_site, their_site = owned_domain(domain, candidate), _any([owned_domain(domain, o) for o in opponents])
    note, said = kind == "campaign_note", kind == "opponent_statement"
    party, group = has(full, committee), has(full, outside)
    campaign_like = _any([meta.contains(s) for s in NAME_SIGNALS])
    rules = [
        (note & (mine | my_site | full.contains(candidate.lower())), "candidate_statement", "high"),
        (note & (theirs | their_site | _any([full.contains(o.lower()) for o in opponents])), "opponent_statement", "medium"),
        (note, "community/manual", "low"),
        (said & ~party & ~group & (theirs | their_site), "opponent_statement", "high"),
        (said & ~party & ~group, "opponent_statement", "medium"),
        (party, "party_committee_statement", "high"),
        (group, "outside_group_statement", "high"),
        (my_site, "candidate_statement", "high"),
        (their_site, "opponent_statement", "high"),
        (mine & campaign_like, "candidate_statement", "medium"),
        (theirs & campaign_like, "opponent_statement", "medium"),
        (kind.isin("social", "news", "public_record") & _any([meta.contains(s) for s in ("campaign", "statement", "press release")]), "media", "medium"),
        (_any([full.contains(c) for c in community]) | (kind == "manual"), "community/manual", "medium"),
    ]
    owner = reduce(lambda out, r: out.when(r[0], r[1]), rules, F.when(F.lit(False), "")).otherwise("unclear")
    sure = reduce(lambda out, r: out.when(r[0], r[2]), rules, F.when(F.lit(False), "")).otherwise("low")
    return F.struct(owner.alias("owner"), sure.alias("confidence"))


def said_by(text: Column, names: list[str]) -> Column:
    """A name next to a verb of saying, either way round."""
    who = "|".join("".join("\\" + c if not (c.isalnum() or c == " ") else c for c in n.lower()) for n in sorted(names, key=len, reverse=True))
    verb = "said|says|stated|argued|announced|promised|told"
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{who})\b\s+(?:{verb})\b|\b(?:{verb})\s+(?:{who})\b"), F.lit(False)) if names else F.lit(False)


def perspective(owner: Column, outlet: Column, bias: dict[str, str], text: Column, candidate: list[str], opponents: list[str], newsroom: Column) -> Column:
    """A struct of perspective and method: an owner's statement (unless a newsroom carries it), the outlet's known bias, who is quoted, else neutral."""
    known = F.create_map(*[F.lit(x) for kv in bias.items() for x in kv]) if bias else F.create_map().cast("map<string,string>")
    leaning = F.try_element_at(known, F.lower(outlet))
    mine, theirs = said_by(text, candidate), said_by(text, opponents)
    own = F.when(~newsroom & (owner == "candidate_statement"), "pro_candidate").when(~newsroom & (owner == "opponent_statement"), "pro_opponent")
    quoted = F.when(mine & ~theirs, "pro_candidate").when(theirs & ~mine, "pro_opponent")
    method = F.when(own.isNotNull(), "existing").when(leaning.isNotNull(), "outlet").when(quoted.isNotNull(), "attribution").otherwise("fallback")
    return F.struct(F.coalesce(own, leaning, quoted, F.lit("neutral")).alias("perspective"), method.alias("method"))


#: Posture and urgency by what a narrative does and whose it is (candidate, opponent, media).
LENS = {
    "viral": (("amplify", "high"), ("defensive", "high"), ("monitor", "medium")),
    "amplified": (("offensive", "medium"), ("defensive", "medium"), ("monitor", "low")),
    "missing_coverage": (("offensive", "medium"), ("defensive", "medium"), ("monitor", "low")),
    "elite_only": (("offensive", "low"), ("monitor", "low"), ("ignore", "low")),
    "stable": (("monitor", "low"), ("monitor", "low"), ("ignore", "low")),
    "no_trend_signal": (("monitor", "low"), ("monitor", "low"), ("ignore", "low")),
}


def lens_table(spark) -> DataFrame:
    rows = [(signal, owner, *cell) for signal, cells in LENS.items() for owner, cell in zip(("candidate", "opponent", "media"), cells, strict=True)]
    return spark.createDataFrame(rows, "signal string, owner string, posture string, urgency string")


def strategic_lens(frames: DataFrame, signal: str = "signal", owner: str = "owner") -> DataFrame:
    """frames with posture and urgency; null where the pair is unknown or incomplete.  The table has a row for each pair."""
    return frames.join(F.broadcast(lens_table(frames.sparkSession).toDF(signal, owner, "posture", "urgency")), [signal, owner], "left")


def source_category(kind: Column, name: Column, outlet_type: Column, state: Column, home: str, campaign: list[str], social: list[str], local: list[str]) -> Column:
    """campaign_source, social_media, local_news, national_news or other; what the outlet is known as goes before its name."""
    near = outlet_type.isin("regional_news", "broadcast")
    return (
        F.when((kind == "opponent_statement") | has(name, campaign), "campaign_source")
        .when((kind == "social") | has(name, social), "social_media")
        .when((outlet_type == "local_news") | (near & (F.upper(state) == home)), "local_news")
        .when(near | outlet_type.isin("national", "blog"), "national_news")
        .when(has(name, local), "local_news")
        .when(F.trim(F.coalesce(name, F.lit(""))) != "", "national_news")
        .otherwise("other")
    )


def surname(name: str) -> str:
    return (name.split(",")[0] if "," in name else name.split()[-1] if name.split() else "").strip().lower()


def attacks(text: Column, name: str, verbs: list[str], nouns: list[str], phrases: list[str]) -> Column:
    """The text attacks the named one: its surname does something of verbs or phrases, or owns a noun that no "anti-" or "against" turns round."""
    last = surname(name)
    if len(last) < 3:
        return F.lit(False)
    words = lambda w: "|".join("".join("\\" + c if not (c.isalnum() or c in " ") else c for c in x) for x in w)
    low = F.lower(F.coalesce(text, F.lit("")))
    does = low.rlike(rf"\b{last}\s+(?:{words([*verbs, *phrases])})\b")
    turned = r"anti[\s\-]|against\s|fights?\s|opposes?\s|battling\s|combat(?:ing|s)?\s"
    owns = low.rlike(rf"\b{last}'s\s+(?:(?!{turned})\w+\s+){{0,3}}(?:{words(nouns)})\b")
    return does | owns


def corrected_owner(owner: Column, attacks_candidate: Column, attacks_opponent: Column) -> Column:
    """An attack serves the other side: an owner that the text attacks is turned round; both or neither attacked: as it is."""
    return F.when((owner == "opponent") & attacks_opponent & ~attacks_candidate, "candidate").when((owner == "candidate") & attacks_candidate & ~attacks_opponent, "opponent").otherwise(owner)


def corrected_label(span: Column, label: Column, rules: list[tuple[str, str, str]], required: dict[str, str]) -> Column:
    """A struct of label and rule: the first of rules (name, pattern, label) that fits overrides; else a label whose required pattern is absent goes."""
    given = F.trim(F.coalesce(span, F.lit(""))) != ""
    fits = [(given & span.rlike(f"(?i){p}"), n, to) for n, p, to in rules]
    lost = [(given & (label == k) & ~span.rlike(f"(?i){p}"), k) for k, p in required.items()]
    new = reduce(lambda out, r: out.when(r[0], r[2]), fits, F.when(F.lit(False), ""))
    new = reduce(lambda out, r: out.when(r[0], F.lit(None)), lost, new).otherwise(label)
    rule = reduce(lambda out, r: out.when(r[0], F.concat(F.when(label.eqNullSafe(F.lit(r[2])), "confirmed:").otherwise("positive:"), F.lit(r[1]))), fits, F.when(F.lit(False), ""))
    rule = reduce(lambda out, r: out.when(r[0], F.lit(f"sanity_downgrade_from:{r[1]}")), lost, rule).otherwise("kept")
    return F.struct(new.alias("label"), rule.alias("rule"))


def theme(text: Column, themes: dict[str, list[str]]) -> Column:
    """The first theme of which a keyword occurs; null without one."""
    low = F.lower(text)
    return reduce(lambda out, kv: out.when(_any([low.contains(w) for w in kv[1]]), kv[0]), themes.items(), F.when(F.lit(False), ""))


def sentence_kinds(sentence: Column, opponent: str, candidate: str, attack: list[str], claim: list[str], promise: list[str]) -> Column:
    """A struct of attack, claim, promise and verify for a sentence whose subject is the opponent, else null.

    Named after the candidate, the opponent is spoken of and not the subject; named before, the two may still be turned round: verify.
    """
    low = F.lower(sentence)
    at = lambda n: F.instr(low, n.lower())
    kinds = [_any([low.contains(m) for m in words]) for words in (attack, claim, promise)]
    subject = (at(opponent) > 0) & ((at(candidate) == 0) | (at(candidate) > at(opponent)))
    return F.when(subject & _any(kinds), F.struct(kinds[0].alias("attack"), kinds[1].alias("claim"), kinds[2].alias("promise"), (at(candidate) > 0).alias("verify")))


def linked_outlets(items: DataFrame, outlets: DataFrame) -> DataFrame:
    """items (id, url, name, outlet) with outlet set where it was null: by domain or alias, else by the publisher's name behind "news:" in the source's name.

    outlets: outlet, name, domains (array, aliases too).  An equal name goes before one that shares a word of over three letters; ties to the least outlet.
    """
    by_domain = outlets.select(F.explode("domains").alias("_d"), F.col("outlet").alias("_o")).groupBy("_d").agg(F.min("_o").alias("_by_domain"))
    out = items.withColumn("_d", host_of(F.col("url"))).join(by_domain, "_d", "left").drop("_d")
    publisher = F.lower(F.trim(F.regexp_extract("name", r"(?i)^[^:]*news:\s*(.+)$", 1)))
    by_name = outlets.select(F.lower("name").alias("_n"), F.col("outlet").alias("_o")).groupBy("_n").agg(F.min("_o").alias("_by_name"))
    out = out.withColumn("_n", publisher).join(by_name, "_n", "left")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[\s\-–]+"), lambda w: (F.char_length(w) > 3) & ~w.rlike(r"^\d+$")))
    said = out.select("_n").where("_n <> ''").distinct().withColumn("_w", F.explode(words(F.col("_n"))))
    known = outlets.select(F.explode(words(F.col("name"))).alias("_w"), F.col("outlet").alias("_o"))
    by_word = said.join(known, "_w").groupBy("_n").agg(F.min("_o").alias("_by_word"))
    out = out.join(by_word, "_n", "left")
    found = F.coalesce("outlet", "_by_domain", "_by_name", "_by_word")
    return out.withColumn("outlet", found).select(*items.columns)
