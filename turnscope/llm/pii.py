"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DAY = "(?:0[1-9]|[12][0-9]|3[01])"
_MONTH = "(?:0[1-9]|1[0-2])"
_HEX = "[0-9A-Fa-f]{1,4}"
# Length of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of two digits (E.164); 1 and 7 have one digit, all others three.
COUNTRY_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98"
).split()
# How access keys of known services start.
KEY_STARTS = "gh[pousr]_|github_pat_|glpat-|npm_|sk-|xox[abprs]-|AIza|eyJ"


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}"


# What is looked for; the numbers and dates are validated after that.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"AKIA[0-9A-Z]{16}|password=[0-9a-zA-Z]{8,}|token = \"[0-9a-zA-Z]{16,}\"",
    "key": (
        r"(?<![0-9A-Za-z_-])(?:gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_-]{20,}|npm_[0-9A-Za-z]{36}"
        r"|sk-(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}"
        r"|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})"
    ),
    "iban": (
        rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items())})(?![0-9A-Za-z])"
    ),
    "ipv6": (
        rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![0-9A-Za-z:]|\.[0-9])"
    ),
    "world_phone": (
        r"(?<![0-9A-Za-z)\]+])\+(?:[2-9][0-9]{7,14}(?![0-9])"
        r"|[2-9][0-9]{0,2}(?: ?\([0-9]{1,5}\))?(?:[ .-][0-9]{1,8}){1,4}(?![0-9]|[ .-][0-9]))"
    ),
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "date": (
        rf"(?<![0-9./-])(?:[0-9]{{4}}-{_MONTH}-{_DAY}|[0-9]{{4}}/{_MONTH}/{_DAY}"
        rf"|{_DAY}\.{_MONTH}\.[0-9]{{4}}|{_DAY}/{_DAY}/[0-9]{{4}})(?![0-9]|[./-][0-9])"
    ),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
_ANY = "|".join(f"(?:{x})" for x in SHAPES.values())
# Days of 400 years, after which the calendar repeats: 189 * 773.
_CYCLE = 146097


def _draw(secret: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", F.lit(secret), *[x.cast("string") for x in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _halves(left: Column, right: Column, a, b, secret: str, kind: str) -> Column:
    """A keyed permutation of pairs below ``a`` and ``b``: the halves take turns, each moved by a hash of the other."""
    a, b = [x if isinstance(x, Column) else F.lit(x) for x in (a, b)]
    start = F.struct(
        left.cast("bigint").alias("l"), right.cast("bigint").alias("r"),
        a.cast("bigint").alias("a"), b.cast("bigint").alias("b"),
    )

    def step(s: Column, i: Column) -> Column:
        moved = F.pmod(s["l"] + F.pmod(_draw(secret, F.lit(kind), i, s["a"], s["r"]), s["a"]), s["a"])
        return F.struct(s["r"].alias("l"), moved.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel(value: Column, a, b, secret: str, kind: str) -> Column:
    """A keyed permutation of 0 … a*b-1 (``_halves``)."""
    a, b = [x if isinstance(x, Column) else F.lit(x) for x in (a, b)]
    moved = _halves(F.floor(value / b), F.pmod(value, b), a, b, secret, kind)
    return F.transform(F.array(moved), lambda s: s["l"] * s["b"] + s["r"])[0]


def _moved_digits(digits: Column, secret: str, kind: str) -> Column:
    """Two to 36 digits permuted among all of their number; null for fewer."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half)
    size = lambda k: F.pow(F.lit(10), k).cast("bigint")
    moved = _halves(left.try_cast("bigint"), right.try_cast("bigint"), size(half), size(n - half), secret, kind)
    joined = F.transform(F.array(moved), lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], n - half)))[0]
    return F.when(n >= 2, joined)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _pad(value: Column, width) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    text = value.cast("string")
    return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)


def _into(shape: Column, digits: Column, place: str = "^[0-9]$") -> Column:
    """``digits`` in the places of the digits of ``shape`` (or of other characters)."""
    marks = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike(place)
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(marks, start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 with every second digit from the right doubled."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.pmod(total + F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d), F.lit(10))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(text: Column, secret: str) -> Column:
    """The first digit (the network) stays, the check digit is computed again."""
    digits = _digits(text)
    inner = F.length(digits) - 2
    low = F.pow(F.lit(10), F.floor(inner / 2)).cast("bigint")
    high = F.pow(F.lit(10), inner - F.floor(inner / 2)).cast("bigint")
    moved = feistel(F.substr(digits, F.lit(2), inner).cast("bigint"), high, low, secret, "card")
    head = F.concat(F.substring(digits, 1, 1), _pad(moved, inner))
    check = F.pmod(10 - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) == 0, _into(text, F.concat(head, check)))


def _phone(text: Column, secret: str) -> Column:
    """Area and exchange codes of 200 to 999 stay in that range; a leading 1 stays. What is written with +1 but has
    other codes is moved among all ten digits."""
    digits = _digits(text)
    ten = F.substr(digits, F.length(digits) - 9, F.lit(10))
    area, office, line = F.substring(ten, 1, 3).cast("bigint"), F.substring(ten, 4, 3).cast("bigint"), F.substring(ten, 7, 4).cast("bigint")
    moved = feistel(((area - 200) * 800 + office - 200) * 10000 + line, 80000, 80000, secret, "phone")
    new = F.concat(
        F.substr(digits, F.lit(1), F.length(digits) - 10), _pad(F.floor(moved / 8000000) + 200, 3),
        _pad(F.pmod(F.floor(moved / 10000), F.lit(800)) + 200, 3), _pad(F.pmod(moved, F.lit(10000)), 4),
    )
    any_ = _pad(feistel(ten.cast("bigint"), 100000, 100000, secret, "phone-any"), 10)
    other = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), any_)
    return F.when((area >= 200) & (office >= 200), _into(text, new)).when(text.startswith("+1"), _into(text, other))


def _ssn(text: Column, secret: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    digits = _digits(text)
    area, group, serial = [F.substring(digits, i, n).cast("bigint") for i, n in ((1, 3), (4, 2), (6, 4))]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, secret, "ssn")
    new = F.floor(moved / (99 * 9999))
    new = F.when(new >= 665, new + 2).otherwise(new + 1)
    return F.when(
        valid,
        F.concat(_pad(new, 3), F.lit("-"), _pad(F.pmod(F.floor(moved / 9999), F.lit(99)) + 1, 2), F.lit("-"), _pad(F.pmod(moved, F.lit(9999)) + 1, 4)),
    )


def _ip(text: Column, secret: str) -> Column:
    octets = F.split(text, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda t, x: t * 256 + x.cast("bigint"))
    moved = feistel(value, 65536, 65536, secret, "ip")
    parts = [F.pmod(F.floor(moved / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)]
    return F.concat_ws(".", *parts)


def _mod97(text: Column) -> Column:
    """The remainder of a number whose letters stand for 10 to 35."""

    def step(total: Column, c: Column) -> Column:
        letter = total * 100 + F.ascii(c) - 55
        return F.pmod(F.when(c.rlike("^[A-Z]$"), letter).otherwise(total * 10 + F.ascii(c) - 48), F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(text: Column, secret: str) -> Column:
    """Digits of the account are permuted, country and letters stay, the check digits are computed again."""
    whole = F.replace(text, F.lit(" "), F.lit(""))
    country, account = F.substring(whole, 1, 2), F.substr(whole, F.lit(5), F.length(whole))
    moved = _into(account, _moved_digits(_digits(account), secret, "iban"))
    check = _pad(98 - _mod97(F.concat(moved, country, F.lit("00"))), 2)
    valid = _mod97(F.concat(account, F.substring(whole, 1, 4))) == 1
    return F.when(valid & moved.isNotNull(), _into(text, F.concat(country, check, moved), "^[0-9A-Z]$"))


def _world_phone(text: Column, secret: str) -> Column:
    """Eight to 15 digits; the country code stays."""
    digits = _digits(text)
    two = F.substring(digits, 1, 2).isin(COUNTRY_CODES)
    code = F.when(digits.startswith("7"), 1).when(two, 2).otherwise(3)
    rest = F.substr(digits, code + 1, F.length(digits))
    new = F.concat(F.substr(digits, F.lit(1), code), _moved_digits(rest, secret, "world-phone"))
    return F.when(F.length(digits).between(8, 15), _into(text, new))


def _ipv6(text: Column, secret: str) -> Column:
    """Written out in eight groups, so that all ways to write an address agree; its first two digits stay."""
    short = text.contains("::")
    groups = lambda part: F.transform(F.split(part, ":"), lambda g: F.lpad(g, 4, "0"))
    head = groups(F.substring_index(text, "::", 1))
    tail = F.when(short, groups(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    gap = 8 - F.size(head) - F.size(tail)
    valid = F.when(short, gap >= 1).otherwise(gap == 0) & text.rlike("[0-9]")
    middle = F.repeat(F.lit("0000"), F.greatest(gap, F.lit(0)))
    digits = F.lower(F.concat(F.array_join(head, ""), middle, F.array_join(tail, "")))
    number = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).try_cast("bigint")
    moved = _halves(number(3), number(18), 1 << 60, 1 << 60, secret, "ipv6")
    back = lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")
    whole = F.transform(F.array(moved), lambda s: F.concat(F.substring(digits, 1, 2), back(s["l"]), back(s["r"])))[0]
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(whole, i * 4 + 1, F.lit(4)))
    return F.when(valid, F.array_join(parts, ":"))


def _date(text: Column, secret: str) -> Column:
    """A valid day goes to another day of the same 400 years of the calendar; the order of its parts stays."""
    year_first = text.rlike("^[0-9]{4}")
    one, two = F.substring(text, 1, 2).cast("int"), F.substring(text, 4, 2).cast("int")
    day_first = text.contains(".") | (one > 12)
    year = F.when(year_first, F.substring(text, 1, 4)).otherwise(F.substring(text, 7, 4)).cast("int")
    month = F.when(year_first, F.substring(text, 6, 2).cast("int")).when(day_first, two).otherwise(one)
    day = F.when(year_first, F.substring(text, 9, 2).cast("int")).when(day_first, one).otherwise(two)
    cycle = F.floor(year / 400)
    # Days since the start of the year 2000's cycle, so that years 0 to 9999 need no calendar beyond it.
    when = F.try_to_date(F.concat_ws("-", _pad(2000 + F.pmod(year, F.lit(400)), 4), _pad(month, 2), _pad(day, 2)), "yyyy-MM-dd")
    start = F.to_date(F.lit("2000-01-01"))
    moved = F.date_add(start, feistel(F.datediff(when, start).cast("bigint"), 189, _CYCLE // 189, secret, "date").cast("int"))
    y = _pad(F.year(moved) - 2000 + cycle * 400, 4)
    m, d = _pad(F.month(moved), 2), _pad(F.dayofmonth(moved), 2)
    # An ambiguous day and month, as in 03/04/2001, is month first; the result is then a month-first date.
    new = F.when(year_first, F.concat(y, m, d)).when(day_first, F.concat(d, m, y)).otherwise(F.concat(m, d, y))
    return F.when(when.isNotNull(), _into(text, new))


def _letters(text: Column, secret: str, kind: str, width) -> Column:
    """A keyed digest in hexadecimal digits, as long as wanted."""
    width = width if isinstance(width, Column) else F.lit(width)
    digest = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), text), 256)
    return F.substr(F.repeat(digest, F.ceil(width / 64).cast("int")), F.lit(1), width)


def _email(text: Column, secret: str) -> Column:
    local = _letters(F.lower(text), secret, "email", 12)
    host = _letters(F.lower(F.substring_index(text, "@", -1)), secret, "host", 8)
    return F.concat(F.lit("u"), local, F.lit("@h"), host, F.lit(".example.invalid"))


def _secret(text: Column, secret: str) -> Column:
    value = F.regexp_replace(text, r'^(?:AKIA|password=|token = ")|"$', "")
    new = _letters(value, secret, "secret", F.length(value))
    return (
        F.when(text.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(new)))
        .when(text.startswith("password="), F.concat(F.lit("password="), new))
        .otherwise(F.concat(F.lit('token = "'), new, F.lit('"')))
    )


def _key(text: Column, secret: str) -> Column:
    start = F.regexp_extract(text, f"^(?:{KEY_STARTS})", 0)
    rest = F.substr(text, F.length(start) + 1, F.length(text))
    return F.concat(start, _letters(rest, secret, "key", F.length(rest)))


def _pseudonym(found: Column, secret: str) -> Column:
    """Null where the number or date is not valid."""

    def whole(kind: str) -> Column:
        return found.rlike(f"^(?:{SHAPES[kind]})$")

    return (
        F.when(found.contains("@"), _email(found, secret))
        .when(found.startswith("AKIA") | found.contains("="), _secret(found, secret))
        .when(whole("key"), _key(found, secret))
        .when(whole("iban"), _iban(found, secret))
        .when(whole("ipv6"), _ipv6(found, secret))
        .when(whole("world_phone"), _world_phone(found, secret))
        .when(whole("ip"), _ip(found, secret))
        .when(whole("date"), _date(found, secret))
        .when(whole("ssn"), _ssn(found, secret))
        .when(whole("phone"), _phone(found, secret))
        .otherwise(_card(found, secret))
    )


def pseudonymised(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """Replace personal data in a text column by keyed pseudonyms; adds ``n_replaced``, all other columns stay.

    Payment cards (Luhn digit checked and computed again), IBANs (check digits likewise), social security numbers, North
    American phone numbers, others with ``+`` and a country code, IPv4 and IPv6 addresses and calendar dates are permuted inside their own format by a Feistel network under ``secret``: the result is
    valid again, has the same separators, and no two values share one. So equal values stay linked over all
    documents, and whoever has the key can undo it. A number or date that is not valid stays as it is. E-mail addresses and
    access keys (of AWS, GitHub, GitLab, npm, Slack, Google, ``sk-`` keys, web tokens), which have no number format, get keyed
    digests. A phone number written in groups that another number follows after one blank is not told from it and stays; an
    IPv6 address with fewer than two groups before ``::`` stays. ``secret`` must not be stored with the result.

    Null text stays null with ``n_replaced`` 0. Empty text, ties and repeated rows need no care: each row is for
    itself, nothing is shuffled. Texts without digit, ``@`` or a secret's name are not searched. A column named
    ``n_replaced`` is overwritten.
    """
    source = F.col(text)
    found = F.regexp_extract_all(source, F.lit(_ANY), F.lit(0))
    new = F.transform(found, lambda x: F.struct(x.alias("old"), _pseudonym(x, secret).alias("new")))
    may = source.rlike(f"[0-9@]|AKIA|password=|token = |{KEY_STARTS}")
    made = "_new"
    while made in map(str.lower, docs.columns):
        made = "_" + made
    parts = docs.withColumn(made, F.when(may, new))
    put = F.zip_with(
        F.split(source, _ANY, -1), made,
        lambda piece, x: F.concat(piece, F.coalesce(x["new"], x["old"], F.lit(""))),
    )
    hits = F.size(F.filter(made, lambda x: x["new"].isNotNull()))
    changed = F.when(F.col(made).isNotNull() & (hits > 0), F.array_join(put, "")).otherwise(source)
    kept = [F.col(f"`{c}`") if c != text else changed.alias(text) for c in docs.columns if c != "n_replaced"]
    return parts.select(*kept, F.greatest(F.coalesce(hits, F.lit(0)), F.lit(0)).alias("n_replaced"))
