"""Text, URL and name scalars as column expressions (JVM-side)."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a headline.
TITLE_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with", "will", "new", "says", "said", "over", "after", "before", "about"]
#: Further words that the hash of a body leaves out.
HASH_STOPWORDS = [*TITLE_STOPWORDS, "primary", "election"]
#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "share", "sharedfrom", "amp"]
OUTLET_SUFFIX = r"\s+[-|:]\s+[^-|:]{2,60}$"


def title_tokens(title: Column) -> Column:
    """Distinct comparison tokens: one outlet suffix off, lower case, words over two letters or numbers, no stopwords."""
    low = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), OUTLET_SUFFIX, ""))
    words = F.split(low, "[^a-z0-9]+")
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    keep = F.filter(words, lambda w: w.rlike("^[0-9]+$") | ((F.length(w) > 2) & ~F.array_contains(stop, w)))
    return F.array_distinct(keep)


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays as sets; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def publisher_stripped(title: Column) -> Column:
    """Lower-cased title without a last " - publisher" of 2 to 40 characters behind more than 20."""
    t = F.trim(F.coalesce(title, F.lit("")))
    head = F.regexp_extract(t, r"(?s)^(.*) - ", 1)
    tail = F.substring_index(t, " - ", -1)
    strip = t.contains(" - ") & (F.length(tail) > 1) & (F.length(tail) <= 40) & (F.length(head) > 20)
    return F.lower(F.trim(F.when(strip, head).otherwise(t)))


def title_numbers(title: Column) -> Column:
    """Digit runs of a headline without its outlet suffix."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.coalesce(title, F.lit("")), OUTLET_SUFFIX, ""), F.lit(r"(\d+)")))


def numbers_mismatch(a: Column, b: Column) -> Column:
    """Each side has a number that the other lacks."""
    return (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)


def domain(url: Column) -> Column:
    """Host without www. and port, lower case; null without a host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@|:\d+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def canonical_url(url: Column) -> Column:
    """scheme://host/path?sorted query: without www., tracking parameters (in any case), parameters without a value, fragment and trailing slashes; a port stays.  Null without a host."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    tracking = r"(?i)^(" + "|".join(TRACKING) + r")="
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.") & ~p.rlike(tracking)))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _character(entity: Column) -> Column:
    """What an entity's inside (#39, #x27, eacute) stands for; null if it stands for nothing."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    digits = F.coalesce(F.conv(F.nullif(F.regexp_extract(entity, "^#[xX]([0-9A-Fa-f]{1,6})$", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(entity, "^#([0-9]{1,7})$", 1), F.lit("")))
    code = digits.cast("int")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    number = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), number).otherwise(F.try_element_at(named, entity))


def unescaped(text: Column) -> Column:
    """text with every named and numeric entity as its character, once; what is none stays.  A space that does not break becomes a plain one."""
    parts = F.split(text, "(?=&)")

    def one(part: Column) -> Column:
        entity = F.regexp_extract(part, "^&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1)
        char = F.when(entity != "", _character(entity))
        return F.when(char.isNotNull(), F.concat(char, F.substring(part, F.char_length(entity) + 3, F.char_length(part)))).otherwise(part)

    decoded = F.array_join(F.transform(parts, one), "")
    return F.replace(F.when(F.contains(text, F.lit("&")), decoded).otherwise(text), F.lit("\u00a0"), F.lit(" "))


def strip_html(html: Column) -> Column:
    """Text of markup: scripts, styles and comments dropped, tags to spaces, entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(t), r"\s+", " "))


def keyword_pattern(words: list[str]) -> str:
    """An alternation of literal words, longest first, not inside a longer alphanumeric word; case does not matter."""
    quoted = ["".join("\\" + c if not (c.isalnum() or c == " ") else c for c in w) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    return r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(quoted) + r")(?![A-Za-z0-9])"


def junk_title(title: Column, placeholders: list[str]) -> Column:
    """Missing or blank titles, placeholders, file names and bare host names."""
    t = F.trim(title)
    return F.coalesce((t == "") | F.lower(t).isin(placeholders) | t.rlike(r"(?i)\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif)$") | t.rlike(r"(?i)^[a-z0-9\-]+(\.[a-z0-9\-]+)+/?$"), F.lit(True))


#: Hosts (with all under them), single hosts, parts of addresses and of hosts by platform, and the names of platforms in a source's name.
PLATFORM_HOSTS = {
    "bluesky": ["bsky.social", "bsky.app", "bsky.network"],
    "twitter": ["twitter.com", "x.com", "twiiit.com"],
    "reddit": ["reddit.com", "redd.it"],
    "youtube": ["youtube.com", "youtu.be", "youtube-nocookie.com"],
    "facebook": ["facebook.com", "fb.com", "fb.watch"],
    "instagram": ["instagram.com"],
}
MASTODON_HOSTS = ["mastodon.social", "mas.to", "mastodon.world", "mastodon.online", "journa.host", "c.im", "mstdn.social", "fosstodon.org", "infosec.exchange", "techhub.social", "newsie.social", "masto.ai", "universeodon.com", "hachyderm.io", "mstdn.party", "mastodon.green", "mvmt.social"]
ADDRESS_PART, HOST_PART = ("bsky.app", "bluesky"), ("nitter", "twitter")
PLATFORM_NAMES = ["twitter", "bluesky", "reddit", "mastodon", "youtube", "instagram", "facebook"]


def platform(url: Column, name: Column) -> Column:
    """Where a post lives: a known part of the address, else a known part of the host or its longest ending in a table, else a name within the source's; null for the web."""
    table = F.create_map(*[F.lit(x) for kind, hosts in PLATFORM_HOSTS.items() for h in hosts for x in (h, kind)])
    labels = F.split(F.coalesce(domain(url), F.lit("")), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.try_element_at(table, F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    by_host = F.get(F.filter(endings, lambda k: k.isNotNull()), F.lit(0))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    host = F.coalesce(domain(url), F.lit(""))
    by_part = F.when(low(url).contains(ADDRESS_PART[0]), ADDRESS_PART[1]).when(host.contains(HOST_PART[0]), HOST_PART[1])
    by_host = F.coalesce(by_host, F.when(host.isin(MASTODON_HOSTS), "mastodon"))
    by_name = F.coalesce(*[F.when(low(name).contains(n), n) for n in PLATFORM_NAMES])
    return F.coalesce(by_part, by_host, by_name)


def humanise_name(name: Column) -> Column:
    """"LAST, FIRST" as "First Last"; other names in title case."""
    parts = F.split(F.trim(name), r"\s*,\s*")
    return F.initcap(F.lower(F.when(F.size(parts) >= 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(F.trim(name))))


def parsed_date(text: Column) -> Column:
    """A timestamp by the first of the usual formats that fits, else null."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def json_list(text: Column) -> Column:
    """A JSON list of strings; empty for null or bad input."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
