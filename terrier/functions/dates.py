"""Dates in numerals of any script or with a month's name."""

from __future__ import annotations

from pyspark.sql import Column

from terrier.functions.text import applied, decomposed, first_of_sql, fold_numerals_sql, let_sql, quoted, strip_sql, to_number_sql
from terrier.functions.values import DAY_SUFFIXES, MONTHS

KIND = "struct<raw:string,iso:string>"
_NUMERIC = r"(\p{Nd}{1,2})[/\-.](\p{Nd}{1,2})[/\-.](\p{Nd}{4})"
_YEARS = r"(?U)\b((?:18|19|20)\p{Nd}{2})\b"
#: A year by itself, or four digits behind the last letter of a name: without one of them no date with a month's name has a year.
_DATED = rf"{_YEARS}|[\p{{L}}\p{{M}}]\s*\p{{Nd}}{{4}}"
#: What a text must match to hold a date.
MAYBE_DATE = rf"{_NUMERIC}|{_DATED}"
_SHORT_CODES = [1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12]


_NAMES = [(decomposed(name), code) for language, names in MONTHS.items() for name, code in zip(names, _SHORT_CODES if language == "short" else range(1, 13), strict=True)]


def _iso(year: str, month: str, day: str) -> str:
    return let_sql(f"named_struct('y', {year}, 'm', {month}, 'd', {day})", "ymd", "CASE WHEN ymd.d BETWEEN 1 AND 31 AND ymd.m BETWEEN 1 AND 12 AND ymd.y BETWEEN 1800 AND 2100 THEN concat(ymd.y, '-', lpad(ymd.m, 2, '0'), '-', lpad(ymd.d, 2, '0')) END")


def _numeric(text: str) -> str:
    d, m, y = (to_number_sql(f"parts[{i}]", "int") for i in range(3))
    parted = let_sql(f"split(run, {quoted('[/.-]')})", "parts", _iso(y, m, d))
    return let_sql(f"regexp_extract({text}, {quoted(_NUMERIC)}, 0)", "run", f"CASE WHEN run != '' THEN {parted} END")


def _named(text: str) -> str:
    """The first month, in the order of MONTHS, that stands in the text with a day before it and a year.

    Only months that stand in the text are read, so their patterns may be computed.
    """
    suffix = "|".join(DAY_SUFFIXES)
    months = "array(" + ", ".join(f"named_struct('name', {quoted(name)}, 'code', {code})" for name, code in _NAMES) + ")"
    broad = to_number_sql(f"try_element_at(regexp_extract_all({text}, {quoted(_YEARS)}, 1), -1)", "int")

    def number(before: str, after: str) -> str:
        pattern = f"concat({quoted(before)}, {quoted(chr(92) + 'Q')}, named.name, {quoted(chr(92) + 'E' + after)})"
        return to_number_sql(f"regexp_extract({text}, {pattern}, 1)", "int")

    day = number(rf"(?iuU)(\p{{Nd}}{{1,2}})\s*(?:{suffix})?\s*", "")
    year = let_sql(number("(?iuU)", r"\s*(\p{Nd}{4})"), "near", f"CASE WHEN near != 0 THEN near ELSE {broad} END")
    there = let_sql(f"lower({text})", "lowered", f"filter({months}, named -> contains(lowered, named.name))")
    return first_of_sql(there, "string", "named", _iso(year, "named.code", day))


def date_sql(text: str) -> str:
    """:func:`parse_date` as SQL text over a name."""
    named = f"CASE WHEN regexp_like(said.norm, {quoted(_DATED)}) THEN {_named('said.norm')} END"
    iso = f"CASE WHEN regexp_like(said.norm, {quoted(r'\p{Nd}')}) THEN coalesce({_numeric('said.norm')}, {named}) END"
    told = f"CASE WHEN coalesce(said.raw, '') != '' THEN named_struct('raw', said.raw, 'iso', {iso}) ELSE named_struct('raw', cast(null AS string), 'iso', cast(null AS string)) END"
    return let_sql(strip_sql(text), "stripped", let_sql(f"named_struct('raw', stripped, 'norm', {fold_numerals_sql('stripped')})", "said", told))


def parse_date(text: Column) -> Column:
    """(raw, iso) of a date, day before month. iso is text and isn't held against a calendar: 31/02/2010 is 2010-02-31.

    The first run of numerals like a date is tried; if it is out of range or there is none, months by name. Blank text gives nulls.
    """
    return applied(date_sql("given.text"), text=text)
