"""The rules as SQL functions: ``register(spark)``, then ``SELECT parse_date(text).iso FROM deeds``.

They are temporary functions of a session, written in SQL, so a query that calls one has its text in its plan: nothing
runs in Python, and the optimizer sees through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrier.functions.areas import KIND as AREA
from terrier.functions.areas import area_sql
from terrier.functions.dates import KIND as DATE
from terrier.functions.dates import date_sql
from terrier.functions.scripts import script_sql
from terrier.functions.text import fold_numerals_sql, lines_sql, normalise_indic_sql
from terrier.functions.values import ANCHORS
from terrier.operators.extract import KINDS, fields_sql

#: Name, arguments, result and body of each function.
SCALARS = {
    "fold_numerals": ("text STRING", "STRING", fold_numerals_sql("text")),
    "parse_date": ("text STRING", DATE, date_sql("text")),
    "parse_area": ("text STRING, state STRING", AREA, area_sql("text", "state")),
    "script_of": ("text STRING", "struct<script:string,lang:string,confidence:double>", script_sql("text")),
    "deed_fields": ("text STRING, lang STRING, state STRING", f"struct<{','.join(f'{f}:{KINDS[f]}' for f in ANCHORS)}>", fields_sql("text", "lang", "state")),
}


def register(spark: SparkSession) -> None:
    """Make the functions in this session; again, if they are there.

    ``fold_numerals(text)``, ``parse_date(text)``, ``parse_area(text, state)`` and ``script_of(text)`` are those of the
    Python functions. ``deed_fields(text, lang, state)`` gives what the lines of a deed yield, null fields for a null or empty
    text. ``deed_lines(text, lang)`` is a table of (pos, line), to be joined laterally; a text without a line has no row.
    """
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    lines = lines_sql(normalise_indic_sql("coalesce(text, '')", "lang"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION deed_lines(text STRING, lang STRING) RETURNS TABLE(pos INT, line STRING) RETURN SELECT pos, line FROM posexplode({lines}) AS t(pos, line)")
