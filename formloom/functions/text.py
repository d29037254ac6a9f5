"""Scalar building blocks: Python-like text handling as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags under which a pattern means what it means in a case-insensitive Unicode search.
FLAGS = "(?iuUd)"


#: Line ends and white space as Python's splitlines, strip and split take them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x1c-\x1f]"


def strip(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_empty(v: Column) -> Column:
    """Null or blank-length text; zero counts as present."""
    return v.isNull() | (v == "")


def is_empty_list(v: Column) -> Column:
    return v.isNull() | (F.size(v) == 0)


def usable(v: Column) -> Column:
    """A value with a letter or digit that does not start with a run of filler."""
    return v.rlike("[a-zA-Z0-9]") & ~v.rlike(r"^[_\-=~]{3,}")


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first usable value among ordered patterns, each tried at its first match only."""
    tries = []
    for p in patterns:
        found = F.regexp_extract(text, FLAGS + p.replace("(?P<value>", "("), 1)
        # Bound once: a plain column would be searched for anew wherever it is referred to.
        tries.append(let(found, lambda v: let(strip(v), lambda x: F.when(usable(x), x))))
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def money(v: Column) -> Column:
    """Number of a text without commas and dollar signs, null if it is none."""
    bare = F.regexp_replace(v, "[,$]", "")
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def valid_date(v: Column) -> Column:
    """Whether a text is a date written year-month-day, month/day/year or year/month/day."""
    forms = [
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ]
    tests = [v.rlike(r) & F.try_to_date(v, f).isNotNull() for r, f in forms]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), rf"(?U){SPACE}+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with white space collapsed."""
    return F.sha2(collapse(F.coalesce(text, F.lit(""))), 256)


def sections(text: Column) -> Column:
    """Stripped lines that are not blank."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def upload_name(name: Column, content: Column) -> Column:
    """``stem_hash8.suffix`` of an uploaded file."""
    suffix = F.regexp_extract(name, r"(?<=.)(\.[^./]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(content, 256), 1, 8), suffix)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def block(text: Column, pattern: str) -> Column:
    """Group 1 of a pattern over several lines; null where it does not match."""
    p = "(?iuUds)" + pattern
    return F.when(text.rlike(p), F.regexp_extract(text, p, 1))


#: What Python's float() takes, after stripping.
PY_FLOAT = r"(?i)^[+-]?(inf(inity)?|nan|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)$"


def lines_of(text: Column) -> Column:
    """Stripped lines, blank ones kept."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)


def py_float(v: Column) -> Column:
    """A number as Python writes a float: no exponent from 0.0001 up to 10**16."""
    text = v.cast("double").cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(F.contains(text, F.lit("E")) & F.abs(v).between(1e-4, 9.999999999999998e15), plain).otherwise(text)


def one_decimal(v: Column) -> Column:
    """A number from 0 up to 10**12 with one decimal as Python and C write it: by its binary value, exact ties to the even digit."""
    tenths = F.floor(v * 10)
    # 20 * v less the odd number 2 * tenths + 1, in two steps of which neither loses the sign.
    over = (v * 16 - (tenths * 2 + 1)) + v * 4
    rounded = tenths + F.when((over > 0) | ((over == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def to_number(v: Column) -> Column:
    """The number that a text means without commas and dollar signs, as Python's float reads it; null if it is none."""
    bare = strip(F.regexp_replace(strip(v), "[,$]", ""))
    return F.when(bare.rlike(PY_FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
