"""Names, districts, dates of elections and bylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles before a name, lower case, a dot after each word allowed.
PREFIXES = [
    "dr", "mr", "ms", "mrs", "mx", "miss", "rev", "reverend", "fr", "father", "sister", "sr", "prof", "professor",
    "rep", "representative", "sen", "senator", "gov", "governor", "mayor", "pres", "president", "vp", "vice president",
    "congressman", "congresswoman", "councilman", "councilwoman", "councilmember", "councilor", "secretary", "ambassador",
    "attorney general", "ag", "judge", "justice", "chief justice", "gen", "general", "lt gen", "lieutenant general",
    "maj gen", "major general", "brig gen", "brigadier general", "col", "colonel", "lt col", "lieutenant colonel",
    "maj", "major", "capt", "captain", "lt", "lieutenant", "sgt", "sergeant", "cpl", "corporal", "pvt", "private",
    "adm", "admiral", "cmdr", "commander", "officer", "detective", "lieutenant governor",
]
#: Suffixes after a name; the first five tell generations apart.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v", "esq", "esquire", "md", "phd", "jd", "mba", "dds", "rn", "cpa", "ret", "retired"]


def _alternation(words: list[str]) -> str:
    letters = {"md": r"m\.?d", "phd": r"ph\.?d", "jd": r"j\.?d", "rn": r"r\.?n", "vp": r"v\.?p", "ag": r"a\.?g"}
    return "|".join(r"\.?\s+".join(letters.get(p, p) for p in w.split()) + r"\.?" for w in sorted(words, key=lambda w: (-len(w), w)))


def without_honorifics(name: Column) -> Column:
    """Leading titles and trailing suffixes off, the longest first, as many as there are."""
    t = F.regexp_replace(F.trim(name), rf"^(?i:(?:(?:{_alternation(PREFIXES)})\s+)+)", "")
    return F.trim(F.regexp_replace(t, rf"(?i:(?:,?\s+(?:{_alternation(SUFFIXES)}))+)$", ""))


def same_person(a: Column, b: Column, nicknames: dict[str, str]) -> Column:
    """Equal surnames and generations (Jr., Sr., III), and equal first names once nicknames are read as their full forms."""
    full = F.create_map(*[F.lit(x) for kv in nicknames.items() for x in kv]) if nicknames else F.create_map().cast("map<string,string>")
    generation = lambda c: F.lower(F.regexp_extract(c, r"(?i)\b(Jr|Sr|III)\b\.?\s*$", 1))
    parts = lambda c: F.split(F.lower(without_honorifics(c)), r"\s+")
    first = lambda c: F.coalesce(F.try_element_at(full, F.get(parts(c), F.lit(0))), F.get(parts(c), F.lit(0)))
    last = lambda c: F.element_at(parts(c), -1)
    return (first(a) == first(b)) & (last(a) == last(b)) & (generation(a) == generation(b)) & (F.size(parts(a)) > 1) & (F.size(parts(b)) > 1)


def district_forms(code: Column) -> Column:
    """"PA-08" as the ways it is written: PA-08, PA-8, PA08, PA 8, 8th district ..."""
    state, n = F.upper(F.regexp_extract(code, r"^([A-Za-z]{2})-?0*(\d+)$", 1)), F.regexp_extract(code, r"^([A-Za-z]{2})-?0*(\d+)$", 2)
    last, teen = F.substring(n, -1, 1), n.rlike(r"1\d$")
    ordinal = F.concat(n, F.when(teen, "th").when(last == "1", "st").when(last == "2", "nd").when(last == "3", "rd").otherwise("th"))
    two = F.lpad(n, 2, "0")
    forms = [F.concat(state, F.lit("-"), two), F.concat(state, F.lit("-"), n), F.concat(state, two), F.concat(state, F.lit(" "), n), F.concat(ordinal, F.lit(" district")), F.concat(F.lit("District "), n), F.concat(ordinal, F.lit(" Congressional District"))]
    return F.when(n != "", F.array_distinct(F.array(*forms)))


def general_election(year: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Mon"), 1)


def nth_weekday(year: Column, month: Column, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), day), 7 * (n - 1))


def byline(text: Column) -> Column:
    """The name behind a leading "By": two to four capitalised words; null without one."""
    got = F.regexp_extract(text, r"(?m)(?:^|\n)\s*[Bb][Yy]:?\s+((?:[A-Z][A-Za-z.'\-]*[ \t]+){1,3}[A-Z][A-Za-z'\-]+)", 1)
    return F.when(got != "", F.trim(got))


def keyword_hits(text: Column, word: str) -> Column:
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in word.lower())
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9]){quoted}(?![a-z0-9])"))


def issue_strength(text: Column, keywords: list[str], weak: set[str] = frozenset(), bump: tuple = ()) -> Column:
    """0-100, 0 below 30: each keyword that occurs counts 30 (35 with a space, 12 if weak), 10 more in the title line, 5 more if it repeats."""
    title = F.substring_index(text, "\n", 1)
    total, strong, weak_hits = F.lit(0), F.lit(0), F.lit(0)
    for k in keywords:
        hits = keyword_hits(text, k)
        base = 12 if k in weak else 35 if " " in k else 30
        total += F.when(hits > 0, base + F.when(keyword_hits(title, k) > 0, 10).otherwise(0) + (0 if k in weak else F.when(hits > 1, 5).otherwise(0))).otherwise(0)
        if k in weak:
            weak_hits += hits
        else:
            strong += (hits > 0).cast("int")
    if bump:  # words that only raise what others have found
        total += F.when(sum((keyword_hits(text, w) for w in bump), F.lit(0)) > 0, 10).otherwise(0)
    return F.when(((strong > 0) | (weak_hits >= 2)) & (total >= 30), F.least(F.lit(100), total)).otherwise(0)
