"""PII: format-preserving Feistel pseudonyms, with DataFrame functions only.

Found values are validated (Luhn, calendar, octets, number plan, IBAN's mod 97), then permuted by a keyed Feistel network inside the
set of valid values of their kind.  Equal values get equal pseudonyms in every document, different ones
stay different, and punctuation and length stay.  A text is split at its matches and joined again in one pass; texts without any are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Only for tests and trials; a deployment sets spark.tessera.pii.key.
KEY = "a key of the deployment's own"

#: One alternation; the first that matches at a place decides.  What surrounds a number must not be part of a longer one.
PATTERN = "|".join(
    [
        r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}",  # e-mail; no repeated group, so a long domain needs no stack
        r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",  # access key
        r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_\-]{8,}",  # secret
        r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",  # IBAN
        r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",  # IPv4
        r"(?<![\d\-./])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d\-/])",  # date
        r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",  # social security number
        r"(?<![\d+])(?:\+?1[ .\-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.\-])[2-9]\d{2}[ .\-]\d{4}(?!\d)",  # phone, NANP
        r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{1,4}\)?){2,5}(?!\d)",  # phone, other countries
        r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d])",  # card
    ]
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _keyed(key: str, *parts: Column) -> Column:
    """A non-negative 60-bit number that depends on the key and on the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: int | Column, b: int | Column, key: str, kind: str | Column) -> Column:
    """A keyed permutation of 0 .. a*b - 1: rounds alternately shift the part below a and the part below b (both fit in 30 bits)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(_keyed(key, kind, i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(_keyed(key, kind, i, s["l"]), b), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of as many decimal digits (1 to 18): its halves are the two parts."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    tens = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("long")
    out = feistel(digits.cast("long"), tens(n - low), tens(low), key, F.concat(F.lit(kind), n))
    return F.lpad(out.cast("string"), n, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(chars, start, step, lambda acc: acc["s"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (and 9 taken off beyond 9), starting with the last undoubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = feistel_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, _refill(m, F.concat(body, check.cast("string")))).otherwise(m)


def _plan_digits(d: Column, key: str) -> Column:
    """Ten digits of the North American plan (area and exchange 200-999), permuted among themselves."""
    area, exchange, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    out = feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, 80_000, 80_000, key, "phone")
    high = F.floor(out / 10000).cast("long")
    return F.concat((F.floor(high / 800) + 200).cast("string"), (F.pmod(high, F.lit(800)) + 200).cast("string"), F.lpad(F.pmod(out, F.lit(10000)).cast("string"), 4, "0"))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    return _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _plan_digits(F.substring(d, F.length(d) - 9, F.lit(10)), key)))


def _abroad(m: Column, key: str) -> Column:
    """The country code's first two digits stay; 7 to 15 digits in all are a valid number."""
    d = _digits(m)
    changed = _refill(m, F.concat(F.substring(d, 1, 2), feistel_digits(F.substring(d, 3, 13), key, "abroad")))
    return F.when(F.length(d).between(7, 15), changed).otherwise(m)


def _address(m: Column, key: str) -> Column:
    """Four octets, permuted as 32 bits and written without leading zeros."""
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    out = feistel(o[0] * (1 << 24) + o[1] * (1 << 16) + o[2] * 256 + o[3], 1 << 16, 1 << 16, key, "ip")
    parts = [F.pmod(F.shiftright(out, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(F.forall(o, lambda x: x < 256), F.concat_ws(".", *parts)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Valid areas (001-665, 667-899), groups (01-99) and serials (0001-9999), permuted among themselves."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    out = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    high = F.floor(out / 9999).cast("long")
    p = F.floor(high / 99).cast("long")
    new = F.concat_ws("-", F.lpad((p + F.when(p > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.pmod(high, F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(out, F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(m)


def _leap_day(year: Column, key: str) -> Column:
    """A leap year of a 400-year cycle that starts at 0 like 1800 does: its 97 leap years, permuted among themselves."""
    j = F.floor(year / 4).cast("long")  # 1 to 99; of the centuries only the second (2000) is one
    place = j - 1 - F.when(j > 75, 2).when(j > 25, 1).otherwise(0)
    new = feistel(place, 97, 1, key, "leap day") + 1
    return (new + F.when(new >= 74, 2).when(new >= 25, 1).otherwise(0)) * 4


def _date(m: Column, key: str) -> Column:
    """Days of the years 200 to 9799, permuted among those of their 400 years (1800 to 2199 are such; 189 * 773 days); the writing stays.

    A slashed date is month first where that is a date.  The others, day first with a day above 12, are permuted
    among themselves, so the two ways of writing never meet: days 13 to 28 freely, later days by year only.
    """
    iso, slash = m.rlike(r"^\d{4}-"), m.contains("/")
    one, two, year = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4)
    day_first = slash & (one.cast("int") > 12)
    month = F.when(iso, F.substring(m, 6, 2)).when(slash & ~day_first, one).otherwise(two)
    day = F.when(iso, F.substring(m, 9, 2)).when(slash & ~day_first, two).otherwise(one)
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(year)
    start = F.lit("1800-01-01").cast("date")
    at = F.datediff(F.concat_ws("-", year, month, day).try_cast("date"), start).cast("long")
    cycle = F.floor(at / 146_097).cast("long")
    new = F.date_add(start, (feistel(at - cycle * 146_097, 189, 773, key, "date") + cycle * 146_097).cast("int"))
    four = lambda y: F.lpad(y.cast("string"), 4, "0")
    written = (four(F.year(new)), F.date_format(new, "MM"), F.date_format(new, "dd"))
    free = F.when(iso, F.concat_ws("-", *written)).when(slash, F.concat_ws("/", *written[1:], written[0])).otherwise(F.concat_ws(".", *written[::-1]))
    first_year = 1800 + cycle * 400
    d, mo, y = day.cast("long"), month.cast("long"), year.cast("long") - first_year
    early = feistel((y * 12 + mo - 1) * 16 + d - 13, 240, 320, key, "day first")
    ym = F.floor(early / 16).cast("long")
    early = F.concat_ws("/", (F.pmod(early, F.lit(16)) + 13).cast("string"), F.lpad((F.pmod(ym, F.lit(12)) + 1).cast("string"), 2, "0"), four(F.floor(ym / 12) + first_year))
    late_year = F.when((mo == 2) & (d == 29), _leap_day(y, key)).otherwise(feistel(y, 20, 20, key, F.concat(F.lit("year"), day, month)))
    late = F.concat_ws("/", day, month, four(late_year + first_year))
    return F.when(cycle.between(-4, 19), F.when(day_first, F.when(d <= 28, early).otherwise(late)).otherwise(free)).otherwise(m)


def _letters(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a text keyed-permuted in their classes: the halves take turns to shift each other, a Feistel network over characters."""
    low, high, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def shift(s: Column, by: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), by), 256)

        def one(h: Column, c: Column, j: Column) -> Column:
            k = F.conv(F.substring(h, F.pmod(j * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + j
            out = c
            for alphabet in (num, high, low):
                n = len(alphabet)
                at = F.instr(F.lit(alphabet), c)
                out = F.when((at > 0) & (c != ""), F.substring(F.lit(alphabet), F.pmod(at - 1 + k, F.lit(n)) + 1, F.lit(1))).otherwise(out)
            return out

        # The hash is bound by an outer transform, or it would be made anew for every character.
        return F.transform(F.array(h), lambda h: F.array_join(F.transform(F.split(s, ""), lambda c, j: one(h, c, j)), ""))[0]

    n = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), n).alias("l"), F.substring(text, n + 1, F.length(text)).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, shift(s["l"], s["r"], i)).otherwise(s["l"])
        right = F.when(i % 2 == 1, shift(s["r"], s["l"], i)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _iban(m: Column, key: str) -> Column:
    """The account part is permuted in its letter and digit classes, and the two check digits are set anew."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    code = lambda s: F.array_join(F.transform(F.split(s, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    mod = lambda s: F.aggregate(F.split(code(s), ""), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = _letters(body, key, "iban")
    check = F.lpad((98 - mod(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, new)
    spaced = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda a, c: F.struct(F.concat(a["s"], F.when(c == " ", c).otherwise(F.substring(whole, a["i"], F.lit(1)))).alias("s"), (a["i"] + (c != " ").cast("int")).alias("i")), lambda a: a["s"])
    return F.when((mod(F.concat(body, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34), spaced).otherwise(m)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of PATTERN; what does not validate as its kind is returned as it is."""
    host = F.substring_index(m, "@", -1)
    top = F.substring_index(host, ".", -1)
    under = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    mail = F.concat(_letters(F.substring_index(m, "@", 1), key, "mail"), F.lit("@"), _letters(under, key, "host"), top)
    head = F.regexp_extract(m, r"^.*[=:]\s*[\"']?", 0)
    secret = F.concat(head, _letters(F.substring(m, F.length(head) + 1, F.length(m)), key, "secret"))
    access = F.concat(F.substring(m, 1, 4), _letters(F.substring(m, 5, 16), key, "access"))
    return (
        F.when(m.contains("@"), mail)
        .when(m.rlike(r"^A[KS]IA[A-Z0-9]{16}$"), access)
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), _iban(m, key))
        .when(m.rlike("[=:]"), secret)
        .when(m.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), _address(m, key))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^\+[2-9]"), _abroad(m, key))
        .when(m.rlike(r"^\d(?:[ \-]?\d){12,18}$"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with the text column rewritten and n_pii (found values that were replaced) added; null texts stay null, n_pii 0.

    key: by default the session's spark.tessera.pii.key, or KEY where that is unset.  An address keeps the last label of its domain only.
    All rows, repeated ones too, and other columns are kept; an existing n_pii is replaced.  The pattern repeats no
    group without a bound, so its stack does not grow with a text.
    """
    key = key or docs.sparkSession.conf.get("spark.tessera.pii.key", KEY)
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    between = F.split(F.col(text), PATTERN, -1)
    some = F.col(text).rlike(r"[@\d]|(?i:password|passwd|pwd|secret|token|api[_-]?key)") & F.col(text).rlike(PATTERN)
    work = docs.drop("n_pii").withColumn("_found", F.when(some, found)).withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    joined = F.concat_ws("", F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(F.col("_new"), i), F.lit("")))))
    n = F.size(F.filter(F.arrays_zip("_found", "_new"), lambda z: z["_found"] != z["_new"]))
    out = work.withColumn("n_pii", F.when(F.col("_found").isNotNull(), n).otherwise(0)).withColumn(text, F.when(F.col("_found").isNotNull(), joined).otherwise(F.col(text)))
    return out.select(*docs.drop("n_pii").columns, "n_pii")
