"""Text and name functions as column expressions; all stay in the JVM.

Null arguments give '' unless stated otherwise, as the text of nothing.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as a class for Java regular expressions.
SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
#: A full postcode of the United Kingdom.
POSTCODE = "\\b[A-Z]{1,2}\\d[A-Z\\d]?\\s*\\d[A-Z]{2}\\b"

# Labels of description lines and the columns they fill, and labels kept as notes.
LABELS = {
    "open for": "open_for",
    "best for": "best_for",
    "must-try dish": "must_try_dish",
    "must try dish": "must_try_dish",
    "know before you go": "know_before_you_go",
    "outdoor seating": "outdoor_seating",
    "also at": "additional_location_notes",
    "a second location is at": "additional_location_notes",
    "price": "price_range",
    "price range": "price_range",
}
NOTE_LABELS = ("chilli oil status", "vibe check", "pro tip", "nb")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{SPACE}+", " "))


def empty_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def first_existing(*cs: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def _accents() -> tuple[str, str]:
    """Each composed letter whose canonical decomposition is a plain character and marks U+0300-036F, and that character."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x386, 0x3D5), *range(0x400, 0x4FA), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(code))
        rest = "".join(c for c in base if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(code) and len(rest) == 1:
            pairs.append((chr(code), rest))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without combining marks U+0300-036F, for Latin, Greek and Cyrillic letters."""
    return F.regexp_replace(F.translate(text(c), _ACCENTED, _PLAIN), "[\\x{300}-\\x{36F}]", "")


def base_name(name: Column) -> Column:
    """The place in "Dish @ Place" and "Dish at Place": after the last @, else after the last at."""
    n = trimmed(name)
    pieces = F.split(n, f"{SPACE}+@{SPACE}+")
    after = F.regexp_extract(n, f"(?i)^.*{SPACE}+at{SPACE}+(.+)$", 1)
    return trimmed(F.when(F.size(pieces) > 1, F.element_at(pieces, -1)).when(after != "", after).otherwise(n))


def _plain_words(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]+", " ")


def name_key(name: Column) -> Column:
    """Key that groups spellings of one place's name; '' if nothing is left of it."""
    k = F.regexp_replace(F.lower(strip_accents(base_name(name))), "&", " and ")
    k = F.regexp_replace(_plain_words(k), "\\bstreet\\b", "st")
    k = F.regexp_replace(k, "\\b(the|restaurant|london)\\b", " ")
    return F.trim(F.regexp_replace(k, " +", " "))


def description_key(c: Column) -> Column:
    """Key under which near-identical descriptions are one."""
    return F.trim(F.regexp_replace(_plain_words(F.lower(strip_accents(c))), " +", " "))


def full_postcode(address: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.upper(text(address)), POSTCODE, 0), "\\s+", "")


def is_clean_name(name: Column) -> Column:
    """True for a name without " @ " and " at "."""
    return ~F.rlike(text(name), F.lit(f"(?i){SPACE}+@{SPACE}+|{SPACE}+at{SPACE}+"))


def split_name(name: Column) -> Column:
    """struct(dish, base): split at the last @, else at the first at or from."""
    n = trimmed(name)
    pieces = F.split(n, f"{SPACE}+@{SPACE}+")
    pattern = f"(?i)^(.*?){SPACE}+(?:at|from){SPACE}+(.+)$"
    by_word = F.regexp_extract(n, pattern, 2) != ""
    many = F.size(pieces) > 1
    dish = F.when(many, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), " @ ")).when(by_word, F.regexp_extract(n, pattern, 1)).otherwise(F.lit(""))
    base = F.when(many, F.element_at(pieces, -1)).when(by_word, F.regexp_extract(n, pattern, 2)).otherwise(n)
    return F.struct(trimmed(dish).alias("dish"), trimmed(base).alias("base"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text(c), f"{SPACE}+"), lambda w: w != ""))


def is_all_caps(c: Column) -> Column:
    return (c == F.upper(c)) & F.rlike(c, F.lit("[A-Z]"))


def address_score(a: Column) -> Column:
    """How complete an address is: a postcode's start 2, the country 1, the city 1, and its length by 100."""
    part = lambda p, n: F.when(F.rlike(a, F.lit(p)), F.lit(n)).otherwise(F.lit(0))
    return part("[A-Z]{1,2}\\d", 2) + part("(?i)\\bUK\\b", 1) + part("(?i)london", 1) + F.length(a) / 100


def station_key(name: Column) -> Column:
    """Key of a station's name: without a leading city, case, full stops and apostrophes."""
    k = F.lower(F.regexp_replace(text(name), "(?i)^London ", ""))
    k = F.regexp_replace(F.regexp_replace(k, "&", "and"), "[.'’]", "")
    return F.trim(F.regexp_replace(k, f"{SPACE}+", " "))


def safe_slug(c: Column, longest: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9._-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^[-._]+|[-._]+$", ""), 1, longest), F.lit("")), F.lit("root"))


def price_range(c: Column) -> Column:
    """The first run of one to four dollar signs; null if there is none."""
    return F.nullif(F.regexp_extract(text(c), "\\${1,4}", 0), F.lit(""))


def merge_notes(values: Column) -> Column:
    """Values of an array joined by '; ', each left out if empty or contained in what is there."""
    spaced = F.filter(F.transform(values, normalize_space), lambda v: v != "")
    return F.aggregate(spaced, F.lit(""), lambda acc, v: F.when(acc == "", v).when(F.contains(acc, v), acc).otherwise(F.concat(acc, F.lit("; "), v)))


def labelled(c: Column) -> Column:
    """struct(label, value, column) of a line "Label: value"; column: what the label fills, 'note' for notes, else null."""
    line = normalize_space(c)
    pattern = "^([^:]{2,48}):\\s*(.*)$"
    label = normalize_space(F.regexp_extract(line, pattern, 1))
    known = F.create_map(*(F.lit(x) for pair in [*LABELS.items(), *((n, "note") for n in NOTE_LABELS)] for x in pair))
    return F.struct(F.nullif(label, F.lit("")).alias("label"), normalize_space(F.regexp_extract(line, pattern, 2)).alias("value"), F.try_element_at(known, F.lower(label)).alias("column"))


def joined_lower(*cs: Column) -> Column:
    """Non-empty texts joined by a space, lower-cased."""
    return F.lower(F.concat_ws(" ", *(F.nullif(c.cast("string"), F.lit("")) for c in cs)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves up, towards positive infinity: -2.5 becomes -2."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / F.lit(scale)


def half_even(x: Column, digits: int) -> Column:
    """A double to so many decimals (22 at most) by its exact binary value, ties to the even digit; null, NaN and infinity stay.

    The error of x * 10^digits is had exactly from the halves of both factors, so that its sign tells on which side of a tie
    the value lies. From 2^52 units of the last digit on a double has none between them and stays too.
    """
    x, scale, half = x.cast("double"), 10.0**digits, 2.0**27 + 1
    scale_high = scale * half - (scale * half - scale)
    scale_low = scale - scale_high
    product = x * scale
    high = x * half - (x * half - x)
    low = x - high
    error = high * scale_high - product + high * scale_low + low * scale_high + low * scale_low
    down = F.floor(product)
    side = product - down - 0.5 + error
    up = (side > 0) | (side == 0) & (down % 2 != 0)
    return F.when(F.abs(product) < 2.0**52, (down + up.cast("long")) / F.lit(scale)).otherwise(x)


def format_distance(metres: Column) -> Column:
    """Metres to ten below 950, else kilometres with one decimal below 9.5; '' if unknown."""
    m = metres.cast("double")
    near = F.concat((F.floor(m / 10 + 0.5) * 10).cast("string"), F.lit(" m"))
    km = F.when(m < 9500, F.format_string("%.1f km", m / 1000)).otherwise(F.format_string("%.0f km", m / 1000))
    known = m.isNotNull() & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf")))
    return F.when(~known, F.lit("")).when(m < 950, near).otherwise(km)


def pretty_url(url: Column) -> Column:
    u = F.regexp_replace(F.regexp_replace(text(url), "^https?://", ""), "^www\\.", "")
    return F.regexp_replace(u, "/$", "")


def in_locale(c: Column) -> Column:
    """A text that compares as readers expect: letters before case, accents beside their letter, punctuation before both.

    Texts that differ by code points only where a reader sees none are equal in it, so an order needs the text itself next.
    """
    return F.collate(c, "UNICODE")


def casefold(c: Column) -> Column:
    """Lower case in which ß is ss and a final sigma is like any other; of full case folding the rest is lower case."""
    return F.translate(F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss")), "ς", "σ")


def casefold_equal(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x == y, map(casefold, (a, b)))
