"""Scalars over recognised text: numerals, spaces, lines, letters with a dot below."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrier.functions.values import NOT_FOLDED, ZEROS

#: What Python calls white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Between the two of \r\n is a blank line, which is dropped like others.
LINE_END = "[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
EDGES = " :|-—=ঃ"

_FOLDED = [(chr(zero + d), str(d)) for zero in ZEROS.values() for d in range(10) if zero + d not in NOT_FOLDED]
_FROM, _TO = ("".join(x) for x in zip(*_FOLDED, strict=True))
#: Digits of any script, for numbers that are computed with.
_ALL = [(chr(c), str(unicodedata.digit(chr(c)))) for c in range(0x0600, 0x11000) if unicodedata.category(chr(c)) == "Nd"]
_ALL_FROM, _ALL_TO = ("".join(x) for x in zip(*_ALL, strict=True))
#: Letters whose dot below is stored apart, with what they are made of.
_DOTS = "़়਼଼"
_DOTTED = [(chr(c), two) for c in range(0x0900, 0x0E00) if len(two := unicodedata.normalize("NFD", chr(c))) == 2 and two[1] in _DOTS]
#: Languages whose text is normalised.
INDIC = ["bn", "hi", "mr", "ta", "te", "kn", "gu", "pa", "or", "ml"]


def quoted(value: str) -> str:
    """A text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_sql(values: list[str]) -> str:
    """A list of texts as a SQL literal."""
    return f"array({', '.join(map(quoted, values))})"


def _beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def fold_numerals(text: Column) -> Column:
    """Digits of nine scripts to 0-9, one for one; null to the empty text. Three digits are left (see NOT_FOLDED)."""
    return F.when(_beyond_ascii(text), F.translate(text, _FROM, _TO)).otherwise(F.coalesce(text, F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; it also keeps large expressions out of generated code.

    It is the last step of a fold over nothing. Taking the first element of a mapped list would do as well, but asks for
    the type of all that it nests each time.
    """
    return F.aggregate(F.expr("cast(array() as array<int>)"), value, lambda x, _: x, body)


def let_sql(value: str, name: str, body: str) -> str:
    """:func:`let` as SQL text: ``body`` calls the value ``name``."""
    return f"aggregate(cast(array() AS array<int>), {value}, (a, b) -> a, {name} -> {body})"


def first_of_sql(items: str, kind: str, name: str, read: str) -> str:
    """What ``read`` (of type ``kind``) gives for the first item, called ``name``, that gives something; those after it aren't read."""
    return f"aggregate({items}, cast(null AS {kind}), (found, {name}) -> coalesce(found, {read}))"


def applied(body: str, **given: Column) -> Column:
    """SQL text over columns, which it calls ``given.name``.

    A rule of some hundred expressions is one call as text; built of columns it takes thousands of calls from Python to the JVM.
    """
    value = F.struct(*[c.alias(name) for name, c in given.items()])
    return F.call_function("aggregate", F.expr("cast(array() AS array<int>)"), value, F.expr("(a, b) -> a"), F.expr(f"given -> {body}"))


def folded(term: str) -> str:
    return term.translate(str.maketrans(_FROM, _TO))


def fold_numerals_sql(text: str) -> str:
    return f"CASE WHEN octet_length({text}) > length({text}) THEN translate({text}, {quoted(_FROM)}, {quoted(_TO)}) ELSE coalesce({text}, '') END"


def to_number_sql(digits: str, kind: str) -> str:
    """Digits of any script as a number; null if they aren't one."""
    translated = f"try_cast(translate(digits, {quoted(_ALL_FROM)}, {quoted(_ALL_TO)}) AS {kind})"
    return let_sql(digits, "digits", f"CASE WHEN octet_length(digits) > length(digits) THEN {translated} ELSE try_cast(digits AS {kind}) END")


def unless_empty_sql(value: str) -> str:
    """The text, or null for an empty one."""
    return let_sql(value, "filled", "CASE WHEN filled != '' THEN filled END")


def strip_sql(text: str) -> str:
    return f"btrim({text}, {quoted(WHITE)})"


def strip_edges_sql(text: str) -> str:
    """Without the marks that stand between an anchor and its value."""
    return f"btrim({text}, {quoted(EDGES)})"


def lines_sql(text: str) -> str:
    """The stripped lines of a text, blank ones dropped."""
    return f"filter(transform(split({text}, {quoted(LINE_END)}), l -> {strip_sql('l')}), l -> l != '')"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    """The stripped lines of a text, blank ones dropped."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def decompose(text: Column) -> Column:
    """Letters with a dot below as two code points, as anchors and months are stored."""
    pairs = F.expr("array(" + ", ".join(f"struct({quoted(one)} AS one, {quoted(two)} AS two)" for one, two in _DOTTED) + ")")
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["one"], p["two"]))


def decomposed(term: str) -> str:
    for one, two in _DOTTED:
        term = term.replace(one, two)
    return term


def normalise_indic(text: Column, lang: Column) -> Column:
    """Text of the Indic languages decomposed, other text as it is. It stands in for a normaliser library that isn't at hand and changes less than that."""
    dotted = F.when(text.rlike("[" + "".join(one for one, _ in _DOTTED) + "]"), decompose(text)).otherwise(text)
    return F.when(lang.isin(INDIC), dotted).otherwise(text)


def normalise_indic_sql(text: str, lang: str) -> str:
    pairs = ", ".join(f"struct({quoted(one)} AS one, {quoted(two)} AS two)" for one, two in _DOTTED)
    own = ", ".join(map(quoted, INDIC))
    return f"CASE WHEN {lang} IN ({own}) THEN aggregate(array({pairs}), {text}, (dotted, p) -> replace(dotted, p.one, p.two)) ELSE {text} END"


def chunks(text: Column, size: int = 500) -> Column:
    """The text cut after every ``size`` code points, as entity models take it; an empty text gives none."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def title_from_filename(name: Column) -> Column:
    """The last extension dropped, ``_`` and ``-`` as spaces."""
    return F.translate(F.regexp_replace(name, r"\.[^/.]+$", ""), "_-", "  ")


def type_label(kind: Column) -> Column:
    return F.upper(F.replace(kind, F.lit("_"), F.lit(" ")))


def megabytes(size: Column) -> Column:
    return F.format_string("%.2f", size / F.lit(1048576.0))
