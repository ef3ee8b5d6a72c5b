"""Certificates from deed text: anchors, first match per field, confidence, verification.

Each field is a fold over the document's lines: the first line that yields a value. The fold is a filter over an
array in the row, so extraction takes no shuffle; :func:`first_by_explode` is the same fold as an aggregation, for
documents of very many lines. Documents carry their language; anchors of a language are a literal list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.areas import KIND as AREA, area_sql
from terrier.functions.dates import KIND as DATE, MAYBE_DATE, date_sql
from terrier.functions.text import WHITE, array_sql, decomposed, first_of_sql, fold_numerals, fold_numerals_sql, folded, let_sql, lines, lines_sql, normalise_indic, normalise_indic_sql, quoted, strip_edges_sql, unless_empty_sql
from terrier.functions.values import ANCHORS, AREA_HINTS, GUARDIANS, NOT_NUMBERS

ENGINE = "terrier_rules"
ANCHOR_CONFIDENCE = 0.88
AREA_CONFIDENCE, HINTED_AREA_CONFIDENCE, DATE_CONFIDENCE = 0.85, 0.80, 0.90
LEAST_FIELDS, LEAST_CONFIDENCE = 2, 0.60


def terms(field: str, lang: str, lexicon: dict = ANCHORS) -> list[str]:
    """Anchors of a field for documents in ``lang``, longest first: its own and the English ones; for a language that isn't listed, all."""
    table = lexicon[field]
    own = [*table.get(lang, []), *table.get("en", [])]
    if lang not in table:
        own += [t for ts in table.values() for t in ts]
    return sorted((decomposed(t) for t in dict.fromkeys(own)), key=len, reverse=True)


def terms_sql(field: str, lang: str, lexicon: dict = ANCHORS) -> str:
    """The anchors as a list, lower-cased with numerals folded, by the document's language."""
    listed = {k: array_sql([folded(t).lower() for t in terms(field, k, lexicon)]) for k in [*lexicon[field], ""]}
    other = listed.pop("")
    by_lang = ", ".join(f"{quoted(k)}, {v}" for k, v in listed.items())
    return f"coalesce(try_element_at(map({by_lang}), {lang}), {other})" if by_lang else other


def prepared(lines: Column) -> Column:
    """Lines as (line, low): as they are, and lower-cased with numerals folded, to look for anchors in."""
    return F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(fold_numerals(x)).alias("low")))


def standing_sql(anchors: str, low: str) -> str:
    """Those of ``anchors`` that stand anywhere in a text; what lines are looked through for is mostly in none, so it is told once for all of them."""
    return f"filter({anchors}, anchor -> contains({low}, anchor))"


def value_after_sql(x: str, anchors: str) -> str:
    """The value behind the first of ``anchors`` (longest first) that stands anywhere in the line and leaves one; null if none does.

    An alternation of all anchors would take the leftmost instead. The value ends before ``|`` and ``;``.
    """
    rest = strip_edges_sql(f"substring({x}.line, instr({x}.low, anchor) + length(anchor), length({x}.line))")
    rest = f"trim(LEADING {quoted(':|-—=ঃ' + WHITE)} FROM {rest})"
    for end in "|\n;":
        rest = f"substring_index({rest}, {quoted(end)}, 1)"
    return first_of_sql(anchors, "string", "anchor", f"CASE WHEN contains({x}.low, anchor) THEN {unless_empty_sql(strip_edges_sql(rest))} END")


def _number(value: str, pattern: str) -> str:
    """The first number in an anchored value, the whole value if it has none; null where the value can't be one."""
    bad = "|".join(map(decomposed, NOT_NUMBERS))
    found = let_sql(fold_numerals_sql(value), "norm", f"coalesce(get(regexp_extract_all(norm, {quoted(pattern)}, 1), 0), norm)")
    return let_sql(found, "number", f"CASE WHEN {value} IS NOT NULL AND NOT regexp_like(lower(number), {quoted(bad)}) THEN named_struct('value', number, 'raw', {value}) END")


def _owner(value: str) -> str:
    """Name and guardian, parted by the first of GUARDIANS that stands in the value."""

    def part(i: int, other: str) -> str:
        cases = ""
        for g in map(decomposed, GUARDIANS):
            parts = f"split({value}, {quoted(f'(?iu){chr(92)}Q{g}{chr(92)}E')})"
            cases += f" WHEN contains(lower({value}), {quoted(g)}) AND size({parts}) > 1 THEN {strip_edges_sql(f'get({parts}, {i})')}"
        return f"CASE{cases} ELSE {other} END"

    return f"CASE WHEN {value} IS NOT NULL THEN named_struct('name', {part(0, value)}, 'guardian', {part(1, 'cast(null AS string)')}) END"


def _area(line: str, low: str, value: str, state: str) -> str:
    """An anchored area, or the whole line read as one if it has no anchor but a unit's word."""
    hinted = f"regexp_like({low}, {quoted('|'.join(map(decomposed, AREA_HINTS)))})"
    text = f"coalesce({value}, CASE WHEN {hinted} THEN {line} END)"
    base = f"CASE WHEN {value} IS NOT NULL THEN {AREA_CONFIDENCE}D ELSE {HINTED_AREA_CONFIDENCE}D END"
    return let_sql(text, "extent", let_sql(area_sql("extent", state), "read", f"CASE WHEN read.value IS NOT NULL THEN named_struct('area', read, 'base', {base}) END"))


def _dated(text: str) -> str:
    return let_sql(text, "dated", let_sql(date_sql("dated"), "read", "CASE WHEN read.iso IS NOT NULL THEN read END"))


SURVEY = r"(\p{Nd}+(?:[/-]\p{Nd}+)*[a-zA-Z]?)"
KHATA = r"(\p{Nd}+(?:[/-]\p{Nd}+)*)"


#: What each field's reader gives.
KINDS = {
    "survey": "struct<value:string,raw:string>",
    "khata": "struct<value:string,raw:string>",
    "owner": "struct<name:string,guardian:string>",
    "area": f"struct<area:{AREA},base:double>",
    "registered": DATE,
    "issued": DATE,
    "village": "string",
}


def readers(x: str, state: str) -> dict:
    """For each field, SQL text of what the line ``x`` yields by a list of anchors; null if nothing."""
    after = lambda read: lambda t: let_sql(value_after_sql(x, t), "value", read("value"))
    return {
        "survey": after(lambda v: _number(v, SURVEY)),
        "khata": after(lambda v: _number(v, KHATA)),
        "owner": after(_owner),
        "area": after(lambda v: _area(f"{x}.line", f"{x}.low", v, state)),
        "registered": after(lambda v: _dated(f"coalesce({v}, {x}.line)")),
        "issued": after(_dated),
        "village": lambda t: value_after_sql(x, t),
    }


def _likely(field: str, low: str) -> str | None:
    """What must hold of a line to yield the field: a digit for areas, a year for dates, whose four digits are looked for first."""
    dated = f"regexp_like({low}, {quoted(r'\p{Nd}{4}')}) AND regexp_like({low}, {quoted(MAYBE_DATE)})"
    return {"area": f"regexp_like({low}, {quoted(r'\p{Nd}')})", "registered": dated, "issued": dated}.get(field)


#: Fields that are read behind an anchor only.
ANCHORED = ("survey", "khata", "owner", "issued", "village")


def _first(field: str, lines: str, anchors: str, read: str) -> str:
    """What the first yielding line yields; without an anchor in any line, lines aren't read for a field that needs one."""
    found = first_of_sql(lines, KINDS[field], "x", read)
    return f"CASE WHEN size({anchors}) > 0 THEN {found} END" if field in ANCHORED else found


def _low_sql(lines: str) -> str:
    return f"array_join(transform({lines}, x -> x.low), '\\n')"


def first_in_lines(df: DataFrame, state: Column, lexicon: dict = ANCHORS) -> DataFrame:
    """``df`` (lang, lines) with a column for each field: what its first yielding line yields. Unlikely lines are left out before they are read."""
    df = df.withColumns({"_lines": prepared(F.col("lines")), "_state": state})
    df = df.withColumn("_low", F.expr(_low_sql("_lines")))
    df = df.withColumns({f"_t_{f}": F.expr(standing_sql(terms_sql(f, "lang", lexicon), "_low")) for f in lexicon})
    likely = {p: f"_likely_{i}" for i, p in enumerate(sorted({_likely(f, "x.low") for f in lexicon} - {None}))}
    df = df.withColumns({c: F.expr(f"filter(_lines, x -> {p})") for p, c in likely.items()})
    read = readers("x", "_state")
    fields = {f: F.expr(_first(f, likely.get(_likely(f, "x.low"), "_lines"), f"_t_{f}", read[f](f"_t_{f}"))) for f in lexicon}
    return df.withColumns(fields).drop("_lines", "_state", "_low", *likely.values(), *[f"_t_{f}" for f in lexicon])


def fields_sql(text: str, lang: str, state: str, lexicon: dict = ANCHORS) -> str:
    """The fields of a text as SQL text over three names."""
    split = lines_sql(normalise_indic_sql(f"coalesce({text}, '')", lang))
    of_lines = f"transform({split}, l -> named_struct('line', l, 'low', lower({fold_numerals_sql('l')})))"
    read, fields = readers("x", state), []
    for f in lexicon:
        likely = f"filter(deed, x -> {_likely(f, 'x.low')})" if _likely(f, "x.low") else "deed"
        fields.append(f"'{f}', " + let_sql(standing_sql(terms_sql(f, lang, lexicon), "low"), "anchors", _first(f, likely, "anchors", read[f]("anchors"))))
    return let_sql(of_lines, "deed", let_sql(_low_sql("deed"), "low", f"named_struct({', '.join(fields)})"))


def first_by_explode(df: DataFrame, key: str, state: str, lexicon: dict = ANCHORS) -> DataFrame:
    """(key, a column for each field): the same as an aggregation over (key, line), with one shuffle on the key.

    A line is told likely before it is read.
    """
    each = df.select(key, "lang", F.col(state).alias("_state"), F.posexplode(prepared(F.col("lines"))).alias("pos", "line"))
    each = each.withColumns({f"_t_{f}": F.expr(terms_sql(f, "lang", lexicon)) for f in lexicon})
    read = readers("line", "_state")
    gated = lambda f: f"CASE WHEN {_likely(f, 'line.low')} THEN {read[f](f'_t_{f}')} END" if _likely(f, "line.low") else read[f](f"_t_{f}")
    found = each.select(key, "pos", *[F.expr(gated(f)).alias(f) for f in lexicon])
    return found.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in lexicon])


def certificates(df: DataFrame, key: str, text: str = "raw_text", lang: Column | None = None, script: Column | None = None, state: Column | None = None, district: Column | None = None, document_type: Column | None = None, ocr_confidence: Column | None = None, entities: str | None = None, lexicon: dict = ANCHORS) -> DataFrame:
    """(key, certificate) of every document.

    Defaults: en, Latin, no state and district, other, 80. ``entities`` names a column of (text, label, confidence) from an entity
    model: its first PER is the owner and its first LOC the village where lines gave none. A null or empty text
    gives an empty certificate with its document type only, en and Latin.
    """
    none = F.lit(None).cast("string")
    lang, script = F.coalesce(lang if lang is not None else none, F.lit("en")), F.coalesce(script if script is not None else none, F.lit("Latin"))
    state, district = state if state is not None else none, district if district is not None else none
    kind = F.coalesce(document_type if document_type is not None else none, F.lit("other"))
    ocr = F.coalesce(ocr_confidence if ocr_confidence is not None else F.lit(None).cast("double"), F.lit(80.0)).cast("double")
    # an empty text has an empty certificate, whatever a model says of it
    ents = F.when(F.length(text) > 0, F.col(entities)) if entities else F.lit(None).cast("array<struct<text:string,label:string,confidence:double>>")
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text"), lang.alias("lang"), script.alias("script"), state.alias("state"), district.alias("district"), kind.alias("kind"), ocr.alias("ocr"), ents.alias("ents"))
    d = d.withColumn("lines", lines(normalise_indic(F.coalesce("text", F.lit("")), F.col("lang"))))
    d = first_in_lines(d, F.col("state"), lexicon)

    def scaled(base: Column | float) -> Column:
        return F.round((F.lit(base) if isinstance(base, float) else base) * F.col("ocr") / 100.0, 2)

    def entity(label: str) -> Column:
        return F.get(F.filter("ents", lambda e: e["label"] == label), 0)

    person, place = entity("PER"), entity("LOC")
    owner = F.when(F.col("owner").isNotNull(), F.struct(F.col("owner.name").alias("name"), F.lit("Pattadar / Khatedar").alias("relation"), F.col("owner.guardian").alias("guardian_name"), F.col("owner.name").alias("raw"), scaled(ANCHOR_CONFIDENCE).alias("confidence"))).when(
        person.isNotNull(), F.struct(person["text"].alias("name"), F.lit("Named Person / Party").alias("relation"), none.alias("guardian_name"), person["text"].alias("raw"), scaled(person["confidence"]).alias("confidence"))
    )

    def number(f: str) -> Column:
        return F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.value").alias("value"), F.col(f"{f}.raw").alias("raw"), scaled(ANCHOR_CONFIDENCE).alias("confidence"), F.lit("lexicon_rule").alias("source")))

    def dated(f: str, base: float) -> Column:
        return F.when(F.col(f).isNotNull(), F.struct(F.col(f"{f}.iso").alias("value"), F.col(f"{f}.raw").alias("raw"), scaled(base).alias("confidence")))

    area = F.when(F.col("area").isNotNull(), F.struct(F.col("area.area.raw_text").alias("raw"), F.col("area.area.value").alias("value"), F.col("area.area.unit").alias("unit"), F.col("area.area.sq_meters").alias("sq_meters"), scaled(F.col("area.base")).alias("confidence")))
    d = d.select("key", "text", "lang", "script", "state", "district", "kind", owner.alias("o"), number("survey").alias("survey_number"), number("khata").alias("khata_number"), area.alias("area_extent"), dated("registered", DATE_CONFIDENCE).alias("registration_date"), dated("issued", ANCHOR_CONFIDENCE).alias("issue_date"), F.coalesce(F.col("village"), place["text"]).alias("village"))
    scores = F.filter(F.array(*[F.col(f"{c}.confidence") for c in ("o", "survey_number", "khata_number", "area_extent", "registration_date")]), lambda x: x.isNotNull())
    d = d.withColumn("scores", scores)
    n = F.size("scores")
    overall = F.when(n > 0, F.round(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x) / n, 2)).otherwise(0.0)
    some = F.coalesce(F.col("text"), F.lit("")) != ""
    d = d.withColumn("overall", F.when(some, overall).otherwise(0.0))
    return d.select(
        F.col("key").alias(key),
        F.struct(
            F.when(F.col("o").isNotNull(), F.array("o")).otherwise(F.array().cast("array<struct<name:string,relation:string,guardian_name:string,raw:string,confidence:double>>")).alias("owners"),
            *["survey_number", "khata_number", "area_extent", "registration_date", "issue_date"],
            F.when(some, F.struct("village", "district", "state")).alias("location"),
            F.col("kind").alias("document_type"),
            F.when(some, F.col("lang")).otherwise("en").alias("detected_language"),
            F.when(some, F.col("script")).otherwise("Latin").alias("detected_script"),
            F.col("overall").alias("overall_confidence"),
            F.when((n >= LEAST_FIELDS) & (F.col("overall") >= LEAST_CONFIDENCE), "VERIFIED").otherwise("NEEDS_REVIEW").alias("verification_status"),
            F.lit(ENGINE).alias("extraction_engine"),
        ).alias("certificate"),
    )
