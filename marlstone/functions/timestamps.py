"""Timestamp texts to one unambiguous form: notation parsing, all in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in minutes.
FIXED_ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420,
    "CET": 60, "CEST": 120,
}

_ZONE = r"(Z|UTC|GMT|EST|EDT|PST|PDT|CET|CEST|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AP]M))?"
_FIELDS = "y m d h i s f p z".split()  # year, month, day, hour, minute, second, fraction, half of the day, zone

# The notations: a pattern and the field that each of its groups holds. 'o' marks a date
# whose month and day stand in an order that the text alone does not tell.
_NOTATIONS = [
    (rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[T ]{_CLOCK} ?{_ZONE}", "y m d h i s f p z"),
    (rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}),? {_CLOCK} ?{_ZONE}", "y m d h i s f p z"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d+))? ?{_ZONE}", "y m d h i s f z"),
    (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_CLOCK} ?{_ZONE}", "d m y h i s f p z"),
    (rf"(?:[A-Z]{{3,9}},? )?(\d{{1,2}}) ([A-Z]{{3}})[A-Z]* (\d{{4}}),? {_CLOCK} ?{_ZONE}", "d m y h i s f p z"),
    (rf"(?:[A-Z]{{3,9}},? )?([A-Z]{{3}})[A-Z]* (\d{{1,2}}),? (\d{{4}}),? {_CLOCK} ?{_ZONE}", "m d y h i s f p z"),
    (rf"\[?(\d{{1,2}})([/-])(\d{{1,2}})[/-](\d{{4}}|\d{{2}}),? {_CLOCK} ?{_ZONE}\]?", "m o d y h i s f p z"),
]


def _one_pattern() -> tuple[str, str]:
    """All notations as one pattern, and the form that puts their fields in one order."""
    groups: dict[str, list[int]] = {name: [] for name in [*_FIELDS, "o"]}
    at = 0
    for _, names in _NOTATIONS:
        for name in names.split():
            at += 1
            groups[name].append(at)
    form = "|".join("".join(f"${{g{k}}}" for k in groups[name]) for name in [*_FIELDS, "o"])
    count = iter(range(1, at + 1))
    whole = "|".join(pattern for pattern, _ in _NOTATIONS)
    named = re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?<g{next(count)}>", whole)
    return f"^(?:{named})$", form


PATTERN, FORM = _one_pattern()
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
NUMBER = r"^[+]?\d{9,}(\.\d*)?(E\+?\d+)?$|^\d\.\d+E\d+$"


def tidy_stamp(text: Column) -> Column:
    """Upper case, direction marks dropped, any run of white space one blank."""
    plain = F.regexp_replace(text, "[\\u200b-\\u200f\\u202a-\\u202e\\u2060\\ufeff]", "")
    return F.upper(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def notation(stamp: Column) -> Column:
    """Field texts of a tidied stamp: year, month, day, hour, minute, second, fraction, half, zone, open.

    The last is empty where the order of the fields is known. Stamps of no known notation
    give an array of another length, from which F.get returns nulls.
    """
    return F.split(F.regexp_replace(stamp, PATTERN, FORM), r"\|", -1)


def month_text(field: Column) -> Column:
    """Month number, as text, of a number or of the first three letters of an English name."""
    at = F.instr(F.lit(_MONTHS), field)
    return F.when(field.rlike("^[A-Z]{3}$"), F.when(at % 3 == 1, F.floor((at + 2) / 3).cast("string"))).otherwise(field)


def clock_micros(fields: Column) -> Column:
    """Microseconds since midnight of the split field array, null if impossible; finer digits are cut."""
    hour, minute, half = F.get(fields, F.lit(3)).try_cast("int"), F.get(fields, F.lit(4)).try_cast("int"), F.get(fields, F.lit(7))
    second = F.coalesce(F.get(fields, F.lit(5)).try_cast("int"), F.lit(0))
    micro = F.rpad(F.substring(F.get(fields, F.lit(6)), 1, 6), 6, "0").try_cast("long")
    full = F.when(half == "", F.when(hour < 24, hour)).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return F.when((minute < 60) & (second < 60), (full * 3600 + minute * 60 + second).cast("long") * 1000000 + micro)


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of texts; years of two digits are 20xx; null for impossible dates."""
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.unix_date(F.concat_ws("-", full, month, day).try_cast("date"))


def fixed_offset_seconds(zone: Column) -> Column:
    """Offset of a zone text ('Z', 'EST', '+05:30', '-0300'); null for an empty one."""
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in FIXED_ZONES.items() for x in (k, v * 60)]), zone)
    digits = F.regexp_replace(zone, ":", "")
    sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    hours = F.substring(digits, 2, 2).cast("int")
    minutes = F.when(F.length(digits) == 5, F.substring(digits, 4, 2).cast("int")).otherwise(0)
    return F.when(zone.rlike(r"^[+-]"), sign * (hours * 3600 + minutes * 60)).when(zone != "", named)


def epoch_micros(stamp: Column, rounded: Column) -> Column:
    """Microseconds of an epoch number in seconds, milli- or microseconds, told by its size.

    Digits beyond the microsecond are cut, or rounded where `rounded` holds.
    """
    value = F.when(stamp.rlike(NUMBER), stamp.try_cast("decimal(38,12)"))
    scaled = F.when(value < 100_000_000_000, value * 1_000_000).when(value < 100_000_000_000_000, value * 1_000).when(
        value < 100_000_000_000_000_000, value * 1
    )
    return F.when(rounded, F.round(scaled, 0)).otherwise(F.floor(scaled)).try_cast("bigint")
