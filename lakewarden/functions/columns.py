"""Column expressions: missing values, patterns, masks, text measures. All stay inside the JVM."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import config

# Words that keyword search and questions leave out.
SEARCH_STOPWORDS = "the a an of to in is are and or for on with that this it as be by from at which any not no has have was were its their such".split()
QUESTION_STOPWORDS = "the a an of to in is are and or for on with that this it as be by from at which what why how any all me my do does show tell list there has have was".split()


def normalised(c: Column, kind: T.DataType) -> Column:
    """Sentinel strings and NaN as null; other values as they are."""
    if isinstance(kind, T.StringType):
        return F.when(~c.isin(config.SENTINELS), c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def normalised_column(name: str, kind: T.DataType) -> Column:
    """The same of a column by its exact name. One expression text instead of a column object for each sentinel, which adds up over wide tables."""
    quoted = "`" + name.replace("`", "``") + "`"
    if isinstance(kind, T.StringType):
        listed = ", ".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in config.SENTINELS)
        return F.expr(f"CASE WHEN {quoted} NOT IN ({listed}) THEN {quoted} END")
    return normalised(F.col(quoted), kind)


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as patterns see it; fractions without exponents."""
    return c.cast("decimal(38,6)").cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else c.cast("string")


def whole_match(c: Column, pattern: str) -> Column:
    """The whole cell matches, and not only up to a last line break."""
    return c.rlike(rf"\A(?:{pattern})\z")


def contains(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


_MONTH = "(?i:" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in config.MONTHS) + "|sept)"
_CLOCK = r"(?:(?:[Tt]|[ ,]+)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,9})?))?[ ]*([AaPp][Mm])?[ ]*([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?"
_ORDINAL = "([0-9]{1,2})(?:st|nd|rd|th)?"
#: Dates by where their fields stand (year, month, day, then the clock's five), in the order in which they are tried.
_DATES = [
    ("([0-9]{4})[-/. ]([0-9]{1,2}|" + _MONTH + ")[-/. ]([0-9]{1,2})", "$1|$2|$3"),
    ("([0-9]{4})([0-9]{2})([0-9]{2})", "$1|$2|$3"),
    ("([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})", "$3|$1|$2"),
    ("(?:[A-Za-z]{3,9},?[ ]+)?" + _ORDINAL + "[-/. ]?(" + _MONTH + ")[-/., ]*([0-9]{4})", "$3|$2|$1"),
    ("(?:[A-Za-z]{3,9},?[ ]+)?(" + _MONTH + ")[-/. ]+" + _ORDINAL + "[-/., ]+([0-9]{4})", "$3|$1|$2"),
]


def as_timestamp(c: Column, kind: T.DataType) -> Column:
    """A timestamp of a cell by its own form, else null: cells of one column may differ. A day and a month in figures are month first, unless that is no month.

    Years of two figures lie from config.FIRST_SHORT_YEAR on. A time with an offset is that instant; without one it is of the session's zone. Forms without a day, bare years, words and times aren't dates."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    # One pattern for all forms spares other cells the rest. Both steps are functions of an element, so that a cell and its fields are made once, and the code that Spark generates stays small.
    cell = F.trim(c)
    made = F.get(F.transform(F.transform(F.array(cell), _date_fields), _date_of), F.lit(0))
    plain = cell.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2}:[0-9]{2})?\z")  # the commonest form needs no more than a cast
    any_form = F.length(c).between(6, 60) & cell.rlike(rf"\A(?:{'|'.join(form for form, _ in _DATES)}){_CLOCK}\z")
    return F.when(plain, cell.try_cast("timestamp")).when(any_form, made)


def _date_fields(cell: Column) -> Column:
    """Year, month, day, hour, minute, second, half of the day and zone, as they are written; null for what is no date."""
    fields = None
    for form, order in _DATES:
        whole = rf"\A{form}{_CLOCK}\z"
        found = F.split(F.regexp_replace(cell, whole, f"{order}|$4|$5|$6|$7|$8"), r"\|")
        fields = F.when(cell.rlike(whole), found) if fields is None else fields.when(cell.rlike(whole), found)
    # Only figures that stand before the year can be the other way round.
    return F.when(fields.isNotNull(), F.concat(fields, F.array(cell.rlike(r"\A[0-9]{1,2}[-/.][0-9]").cast("string"))))


def _date_of(fields: Column) -> Column:
    year, month, day, hour, minute, second, half, zone, either = (F.get(fields, F.lit(i)) for i in range(9))
    number = lambda x: x.try_cast("int")
    names = F.create_map(*[F.lit(x) for i, m in enumerate(config.MONTHS, 1) for x in (m[:3], i)])
    first = F.coalesce(number(month), F.element_at(names, F.left(F.lower(month), F.lit(3))))
    swapped = (either == "true") & (number(month) > 12) & (number(day) <= 12)
    base = config.FIRST_SHORT_YEAR
    years = F.when(F.length(year) == 2, F.pmod(number(year) - base % 100, F.lit(100)) + base).otherwise(number(year))
    clock = F.coalesce(number(hour), F.lit(0))
    clock = F.when(half == "", clock).when((clock < 1) | (clock > 12), F.lit(None)).otherwise(F.pmod(clock, F.lit(12)) + F.when(F.lower(half) == "pm", 12).otherwise(0))
    seconds = F.coalesce(second.try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
    at = (years, F.when(swapped, number(day)).otherwise(first), F.when(swapped, number(month)).otherwise(number(day)), clock, F.coalesce(number(minute), F.lit(0)), seconds)
    offset = F.regexp_replace(F.when(F.lower(zone) == "z", "+00:00").otherwise(zone), r"\A([+-][0-9]{2}):?([0-9]{2})\z", "$1:$2")
    return F.when(zone == "", F.try_make_timestamp(*at)).otherwise(F.try_make_timestamp(*at, offset))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


# Masks. The same value always gives the same mask, and null gives an empty string.


def mask_default(c: Column, kind: str, salt: str = config.MASK_SALT) -> Column:
    return F.concat(F.lit(kind[:3] + "_"), F.left(F.sha2(F.concat(c, F.lit(salt)), 256), F.lit(10)))


def mask_email(c: Column) -> Column:
    at = F.instr(c, "@")
    shown = F.concat(F.when(at == 1, F.lit("*")).otherwise(F.left(c, F.lit(1))), F.lit("***@"), F.substr(c, at + 1))
    return F.when(at > 0, shown).otherwise(mask_default(c, "email"))


def mask_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n >= 4, F.concat(F.repeat(F.lit("*"), n - 4), F.right(digits, F.lit(4)))).otherwise(mask_default(c, "phone"))


def mask_name(c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.concat(F.left(c, F.lit(1)), F.lit(".")))


def mask(c: Column, kind: str) -> Column:
    c = c.cast("string")
    by = {"email": mask_email, "phone": mask_phone, "person_name": mask_name}
    return F.coalesce(by[kind](c) if kind in by else mask_default(c, kind), F.lit(""))


# Text.


def search_tokens(c: Column) -> Column:
    """Distinct lower-case words of over two characters that aren't stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(SEARCH_STOPWORDS)))


def stem(t: Column) -> Column:
    """Without a first ending of ing, ed or s that leaves at least four characters."""
    cut = F.when(t.endswith("ing") & (F.length(t) >= 7), F.left(t, F.length(t) - 3))
    cut = cut.when(t.endswith("ed") & (F.length(t) >= 6), F.left(t, F.length(t) - 2))
    return cut.when(t.endswith("s") & (F.length(t) >= 5), F.left(t, F.length(t) - 1)).otherwise(t)


def question_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.transform(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(QUESTION_STOPWORDS)), stem))


def keyword_score(wanted: Column, have: Column) -> Column:
    """Common words over the geometric mean of both counts."""
    both = F.size(F.array_intersect(wanted, have)).cast("double")
    return both / F.sqrt(F.greatest(F.size(wanted), F.lit(1)).cast("double") * F.greatest(F.size(have), F.lit(1)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def numbers(c: Column) -> Column:
    """Distinct numbers in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0), lambda x: x.cast("double")))


def invented_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text with no allowed one within a half."""
    return F.filter(numbers(text), lambda f: ~F.exists(allowed, lambda a: F.abs(f - a) <= 0.5))


def whole(x: Column) -> Column:
    """The digits of a double's floor, exactly; from 1e38 on, where no decimal holds them, the double as text."""
    # Division by powers of two and remainders are exact; each part fits a long.
    parts = ((x / 2.0**100, 2**100), (x % 2.0**100 / 2.0**50, 2**50), (x % 2.0**50, 1))
    large = sum((F.floor(part).cast("decimal(19,0)") * F.lit(Decimal(by)) for part, by in parts), F.lit(Decimal(0)))
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("string")).when((x > 0) & (x < 1e38), large.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def forbidden_terms(text: Column) -> Column:
    """The first match of each forbidden pattern."""
    return F.filter(F.array(*[F.regexp_extract(text, f"(?i){p}", 0) for p in config.FORBIDDEN]), lambda x: x != "")


def _by_number(code: Column) -> Column:
    """The character of a numeric reference as HTML5 reads it: windows-1252 for 128 to 159, none for codes that stand for no character."""
    windows = [bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0)]
    none = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE)
    char = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�")
    char = char.when(code.between(0x80, 0x9F), F.get(F.array(*[F.lit(w) for w in windows]), code - 0x80)).when(none, "")
    return char.otherwise(F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32"))


def decoded(c: Column) -> Column:
    """Character references as characters: by number or by the names of HTML5, of which the older ones need no semicolon."""
    common = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;")  # found first in the map
    named = F.from_json(F.lit(json.dumps({n: html5[n] for n in (*common, *html5)})), "map<string,string>")
    older = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def one(p: Column) -> Column:
        number, name, short = (F.regexp_extract(p, x, 0) for x in (r"\A#(?:[0-9]+|[xX][0-9a-fA-F]+);?", r"\A[A-Za-z][A-Za-z0-9]{0,31};", rf"\A(?:{older})"))
        digits = F.regexp_replace(number, r"\A#[xX]?0*|;", "")
        value = [F.conv(F.concat(F.lit("0"), digits), base, 10).cast("int") for base in (16, 10)]
        code = F.when(F.length(digits) > 7, 0x110000).when(number.rlike(r"\A#[xX]"), value[0]).otherwise(value[1])
        rest = lambda token: F.substr(p, F.length(token) + 1)
        out = F.when(number != "", F.concat(_by_number(code), rest(number)))
        for token in (name, short):
            out = out.when((token != "") & F.try_element_at(named, token).isNotNull(), F.concat(F.try_element_at(named, token), rest(token)))
        return out.otherwise(F.concat(F.lit("&"), p))

    parts = F.split(c, "&")
    return F.when(~F.contains(c, F.lit("&")), c).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), "")))


def html_lines(c: Column) -> Column:
    """Plain text of an HTML fragment, a line a block: scripts and styles go, list items begin with a dash, character references are decoded."""
    for pattern, by in ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?i)<li[^>]*>", " \n- "), (r"(?i)</(p|div|li|tr|h[0-9])>", "\n"), (r"<[^>]+>", " ")):
        c = F.regexp_replace(c, pattern, by)
    c = decoded(c)
    c = F.regexp_replace(c, r"[ \t\f\r ]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n+", "\n"), r"\A[\n ]+|[\n ]+\z", "")


def passages(c: Column, most: int = 900) -> Column:
    """A text in passages of at most `most` characters, cut at sentence ends only; a longer sentence stays whole."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\n\r\f\u000b]+", " "))
    sentences = F.split(flat, r"(?<=[.;:]) ")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, x: Column) -> Column:
        full = (s["now"] != "") & (F.length(s["now"]) + F.length(x) + 1 > most)
        return F.when(full, F.struct(F.array_append(s["done"], s["now"]).alias("done"), x.alias("now"))).otherwise(
            F.struct(s["done"].alias("done"), F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x)).alias("now"))
        )

    return F.aggregate(sentences, state, add, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def described(c: Column) -> Column:
    """(description, glossary_term) of a text with an optional `TERM:` part."""
    parts = F.split(c, "TERM:", 2)
    return F.struct(F.trim(parts[0]).alias("description"), F.when(F.size(parts) > 1, F.trim(parts[1])).alias("glossary_term"))
