"""Phone numbers by numbering plan: found in text, matched to a country by the longest calling code, checked by
the lengths and first digits of national numbers, written as E.164.  Built-in expressions only.

A number with ``+`` or ``00`` names its country; any other is national and needs a country to be given, whose
trunk prefix goes.  Defined cases: null, too short, too long, an unknown calling code, or first digits that no
national number of the country has: null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits with the signs that may stand between them.
CANDIDATE = r"(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,16}"

# Country, calling code, least and most digits of a national number, trunk prefix, its first digits.
PLAN = (
    ("US", "1", 10, 10, "1", "[2-9][0-9]{2}[2-9]"),
    ("RU", "7", 10, 10, "8", "[3489]"),
    ("EG", "20", 8, 10, "0", "[1-9]"),
    ("ZA", "27", 9, 9, "0", "[1-8]"),
    ("GR", "30", 10, 10, "", "[2-9]"),
    ("NL", "31", 9, 9, "0", "[1-9]"),
    ("BE", "32", 8, 9, "0", "[1-9]"),
    ("FR", "33", 9, 9, "0", "[1-9]"),
    ("ES", "34", 9, 9, "", "[5-9]"),
    ("HU", "36", 8, 9, "06", "[1-9]"),
    ("IT", "39", 6, 11, "", "[03-9]"),
    ("RO", "40", 9, 9, "0", "[237-9]"),
    ("CH", "41", 9, 9, "0", "[2-9]"),
    ("AT", "43", 4, 13, "0", "[1-9]"),
    ("GB", "44", 9, 10, "0", "[1-9]"),
    ("DK", "45", 8, 8, "", "[2-9]"),
    ("SE", "46", 7, 10, "0", "[1-9]"),
    ("NO", "47", 8, 8, "", "[2-9]"),
    ("PL", "48", 9, 9, "", "[1-9]"),
    ("DE", "49", 6, 12, "0", "[1-9]"),
    ("PE", "51", 8, 9, "0", "[1-9]"),
    ("MX", "52", 10, 10, "", "[1-9]"),
    ("AR", "54", 10, 11, "0", "[1-9]"),
    ("BR", "55", 10, 11, "0", "[1-9]"),
    ("CL", "56", 9, 9, "", "[2-9]"),
    ("CO", "57", 10, 10, "", "[36]"),
    ("MY", "60", 8, 10, "0", "[1-9]"),
    ("AU", "61", 9, 9, "0", "[2-478]"),
    ("ID", "62", 7, 12, "0", "[1-9]"),
    ("PH", "63", 8, 10, "0", "[2-9]"),
    ("NZ", "64", 8, 10, "0", "[2-9]"),
    ("SG", "65", 8, 8, "", "[3689]"),
    ("TH", "66", 8, 9, "0", "[2-9]"),
    ("JP", "81", 9, 10, "0", "[1-9]"),
    ("KR", "82", 8, 10, "0", "[1-7]"),
    ("VN", "84", 9, 10, "0", "[2-9]"),
    ("CN", "86", 10, 11, "0", "[1-9]"),
    ("TR", "90", 10, 10, "0", "[2-5]"),
    ("IN", "91", 10, 10, "0", "[1-9]"),
    ("PK", "92", 9, 10, "0", "[2-9]"),
    ("LK", "94", 9, 9, "0", "[1-9]"),
    ("IR", "98", 10, 10, "0", "[1-9]"),
    ("MA", "212", 9, 9, "0", "[5-8]"),
    ("TN", "216", 8, 8, "", "[2-9]"),
    ("NG", "234", 7, 10, "0", "[1-9]"),
    ("KE", "254", 9, 9, "0", "[1-9]"),
    ("PT", "351", 9, 9, "", "[2-9]"),
    ("IE", "353", 7, 9, "0", "[1-9]"),
    ("FI", "358", 5, 12, "0", "[1-9]"),
    ("BG", "359", 7, 9, "0", "[2-9]"),
    ("UA", "380", 9, 9, "0", "[3-9]"),
    ("HR", "385", 8, 9, "0", "[1-9]"),
    ("CZ", "420", 9, 9, "", "[2-9]"),
    ("SK", "421", 9, 9, "0", "[2-9]"),
    ("HK", "852", 8, 8, "", "[2-9]"),
    ("BD", "880", 8, 10, "0", "[1-9]"),
    ("TW", "886", 8, 9, "0", "[2-9]"),
    ("LB", "961", 7, 8, "0", "[1-9]"),
    ("JO", "962", 8, 9, "0", "[2-9]"),
    ("IQ", "964", 8, 10, "0", "[1-7]"),
    ("KW", "965", 8, 8, "", "[1-9]"),
    ("SA", "966", 9, 9, "0", "[15]"),
    ("OM", "968", 8, 8, "", "[279]"),
    ("AE", "971", 8, 9, "0", "[2-79]"),
    ("IL", "972", 8, 9, "0", "[2-9]"),
    ("BH", "973", 8, 8, "", "[1367]"),
    ("QA", "974", 8, 8, "", "[3-7]"),
)


def _lookup(key: int, value: int) -> Column:
    """The plan as a map; calling codes are free of prefixes, so a number has one."""
    return F.create_map(*[F.lit(str(x)) for row in PLAN for x in (row[key], row[value])])


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), 0)


def _national(code: Column, digits: Column) -> Column:
    """E.164 of a calling code and a national number, if the country has such numbers."""
    least, most, first = (F.element_at(_lookup(1, i), code) for i in (2, 3, 5))
    fits = F.length(digits).between(least.cast("int"), most.cast("int")) & F.regexp_like(digits, F.concat(F.lit("^"), first))
    return F.when(fits, F.concat(F.lit("+"), code, digits))


def e164(number: Column, country: str | None = None) -> Column:
    """``number`` as E.164; one without a calling code is of ``country``."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    abroad = number.startswith("+") | number.startswith("(+") | digits.startswith("00")
    whole = F.when(digits.startswith("00") & ~number.contains("+"), F.substring(digits, 3, 20)).otherwise(digits)
    known = _lookup(1, 0)
    code = F.coalesce(*[F.when(F.element_at(known, F.substring(whole, 1, n)).isNotNull(), F.substring(whole, 1, n)) for n in (3, 2, 1)])
    # a zero in brackets after the code is the trunk prefix of the country
    rest = F.substring(whole, F.length(code) + 1, F.lit(20))
    rest = F.when(number.contains("(0)"), F.regexp_replace(rest, "^0", "")).otherwise(rest)
    found = _national(code, rest)
    if country is None:
        return F.when(abroad, found)
    of = next(row for row in PLAN if row[0] == country)
    home = F.regexp_replace(digits, f"^{of[4]}", "") if of[4] else digits
    return F.when(abroad, found).otherwise(F.coalesce(_national(F.lit(of[1]), home), _national(F.lit(of[1]), digits)))


def country_of(number: Column) -> Column:
    """The country of an E.164 number; where several share a code, the largest of them."""
    digits = F.substring(number, 2, 20)
    return F.coalesce(*[F.element_at(_lookup(1, 0), F.substring(digits, 1, n)) for n in (3, 2, 1)])
