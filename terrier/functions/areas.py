"""Areas of land: numbers with regional units, summed to square metres."""

from __future__ import annotations

from pyspark.sql import Column

from terrier.functions.text import applied, decomposed, fold_numerals_sql, let_sql, quoted, strip_sql, to_number_sql
from terrier.functions.values import UNIT_SQUARE_METRES, UNIT_WORDS

KIND = "struct<raw_text:string,value:double,unit:string,sq_meters:double>"
_NUMBER = r"(\p{Nd}+(?:\.\p{Nd}+)?)"


def _amounts(low: str) -> str:
    """(unit, amount) of the units in the text, by their places in UNIT_WORDS: of each unit the first number before the first of its words that has one before it.

    Few of the words stand in a text; only for those numbers are looked for.
    """
    words = "array(" + ", ".join(f"named_struct('unit', {i}, 'word', {quoted(decomposed(w))})" for i, ws in enumerate(UNIT_WORDS.values()) for w in ws) + ")"
    number = f"get(regexp_extract_all({low}, concat({quoted(f'(?U){_NUMBER}')}, {quoted(r'\s*\Q')}, said.word, {quoted(r'\E')}), 1), 0)"
    found = f"filter(transform(filter({words}, said -> contains({low}, said.word)), said -> named_struct('unit', said.unit, 'text', {number})), said -> said.text IS NOT NULL)"
    firsts = let_sql(found, "told", "filter(told, (said, i) -> i = 0 OR told[i - 1].unit != said.unit)")
    return f"filter(transform({firsts}, said -> named_struct('unit', said.unit, 'amount', {to_number_sql('said.text', 'double')})), said -> said.amount IS NOT NULL)"


def _factors(key: str) -> str:
    """Square metres of each unit in a state's table, in the order of UNIT_WORDS; 1 for a unit that the table lacks."""
    rows = {name: "array(" + ", ".join(f"{float(table.get(u, 1.0))!r}D" for u in UNIT_WORDS) + ")" for name, table in UNIT_SQUARE_METRES.items()}
    of_states = ", ".join(f"{quoted(name)}, {row}" for name, row in rows.items() if name != "default")
    return f"coalesce(try_element_at(map({of_states}), {key}), {rows['default']})"


def area_sql(text: str, state: str) -> str:
    """:func:`parse_area` as SQL text over two names."""
    units = "array(" + ", ".join(f"'{u}'" for u in UNIT_WORDS) + ")"
    total = "aggregate(area.amounts, 0D, (sum, said) -> sum + said.amount * area.factors[said.unit])"
    metres = let_sql(total, "total", "CASE WHEN total > 0 THEN round(total, 2) END")
    told = f"""named_struct('raw_text', area.raw, 'value', CASE WHEN size(area.amounts) > 0 THEN area.amounts[0].amount ELSE area.bare END,
        'unit', CASE WHEN size(area.amounts) > 0 THEN {units}[area.amounts[0].unit] WHEN area.bare IS NOT NULL THEN 'Unspecified Unit' ELSE 'Unspecified' END, 'sq_meters', {metres})"""
    bare = to_number_sql(f"get(regexp_extract_all(low, {quoted(_NUMBER)}, 1), 0)", "double")
    parts = f"""named_struct('amounts', {_amounts('low')}, 'bare', {bare},
        'raw', {strip_sql(text)}, 'factors', {_factors(f"lower({strip_sql(f"coalesce({state}, '')")})")})"""
    lowered = let_sql(f"lower({strip_sql(text)})", "whole", let_sql(fold_numerals_sql("whole"), "low", let_sql(parts, "area", told)))
    return f"CASE WHEN coalesce({text}, '') != '' THEN {lowered} END"


def parse_area(text: Column, state: Column) -> Column:
    """(raw_text, value, unit, sq_meters) of an area such as "2 acre 10 cent".

    value and unit are those of the first unit in the order of UNIT_WORDS, not of the text; sq_meters sums all units, by the
    state's table (others': the default's), rounded to 2 places, null if nothing or 0. A number without a unit has none. A null or
    empty text gives null.
    """
    return applied(area_sql("given.text", "given.state"), text=text, state=state)
