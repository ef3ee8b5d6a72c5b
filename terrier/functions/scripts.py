"""Script and language of recognised text, with the state's language as a hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.text import let, let_sql, quoted, strip
from terrier.functions.values import SCRIPTS, STATES

_KIND = "struct<code:string,name:string,script:string,tess:string>"
MEANT, SHARE = 5, 0.15


def _letters(text: Column) -> dict[str, Column]:
    """Letters of each script in a text. What is ASCII is taken out first, so the other scripts' counts read little of a Latin text."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    out = {}
    for script, (lo, hi, _, _) in SCRIPTS.items():
        if script == "Latin":
            out[script] = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
        else:
            out[script] = F.regexp_count(beyond, F.lit(f"[\\x{{{lo:04x}}}-\\x{{{hi:04x}}}]"))
    return out


def with_script(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with script, lang and script_confidence (names led by ``prefix``) of the column ``text``.

    A script other than Latin wins with 5 letters, or 15% of all; else the one with most letters, ties by the order of SCRIPTS.
    Text without a letter, blank and null text is Latin, en, 1.0. Confidence is the share of letters, to 3 places.
    """
    counts = _letters(F.coalesce(F.col(text), F.lit("")))
    names = {s: f"_{prefix}n_{s}" for s in SCRIPTS}
    df = df.withColumns({names[s]: c for s, c in counts.items()})
    indic = [F.col(names[s]) for s in SCRIPTS if s != "Latin"]
    top, most = F.greatest(*indic), F.greatest(*indic, F.col(names["Latin"]))
    total = sum((F.col(n) for n in names.values()), F.lit(0))
    share = F.greatest(total, F.lit(1))
    strong = (top >= MEANT) | (top / share >= SHARE)
    best = F.when(strong & (total > 0), top).otherwise(most)
    script, lang = F.lit("Latin"), F.lit("en")
    for s, (_, _, code, _) in reversed(SCRIPTS.items()):
        mine = (F.col(names[s]) == best) & (total > 0)
        if s == "Latin":
            mine = mine & ~strong
        script, lang = F.when(mine, s).otherwise(script), F.when(mine, code).otherwise(lang)
    confidence = F.when(total > 0, F.round(best / share, 3)).otherwise(1.0)
    return df.withColumns({f"{prefix}script": script, f"{prefix}lang": lang, f"{prefix}script_confidence": confidence}).drop(*names.values())


def script_sql(text: str) -> str:
    """What :func:`with_script` tells of a text as SQL text: (script, lang, confidence)."""
    indic = {s: v for s, v in SCRIPTS.items() if s != "Latin"}
    counts = ", ".join(f"regexp_count(beyond, '[\\\\x{{{lo:04x}}}-\\\\x{{{hi:04x}}}]')" for lo, hi, _, _ in indic.values())
    latin = f"length(coalesce({text}, '')) - length(regexp_replace(coalesce({text}, ''), '[A-Za-z]+', ''))"
    listed = lambda values: "array(" + ", ".join(map(quoted, values)) + ")"
    pick = lambda values, other: f"CASE WHEN share.total > 0 AND array_contains(share.n, share.best) THEN get({listed(values)}, cast(array_position(share.n, share.best) AS int) - 1) ELSE '{other}' END"
    told = f"named_struct('script', {pick(indic, 'Latin')}, 'lang', {pick([v[2] for v in indic.values()], 'en')}, 'confidence', CASE WHEN share.total > 0 THEN round(share.best / greatest(share.total, 1), 3) ELSE 1D END)"
    strong = f"counted.total > 0 AND (array_max(counted.n) >= {MEANT} OR array_max(counted.n) / greatest(counted.total, 1) >= {SHARE}D)"
    best = f"CASE WHEN {strong} THEN array_max(counted.n) ELSE greatest(array_max(counted.n), counted.latin) END"
    shared = let_sql(f"named_struct('n', counted.n, 'total', counted.total, 'best', {best})", "share", told)
    summed = let_sql("named_struct('n', letters.n, 'latin', letters.latin, 'total', aggregate(letters.n, 0, (s, k) -> s + k) + letters.latin)", "counted", shared)
    beyond = f"regexp_replace(coalesce({text}, ''), '[\\\\x00-\\\\x7F]+', '')"
    return let_sql(beyond, "beyond", let_sql(f"named_struct('n', array({counts}), 'latin', {latin})", "letters", summed))


def state_language(state: Column) -> Column:
    """(code, name, script, tess) of the first state in the order of STATES whose name holds the text or is held by it; null for null and empty text.

    The lookup is a literal in the plan, so it takes no join. White space alone is held by every name.
    """
    rows = F.expr("array(" + ", ".join(f"named_struct('state', '{s}', 'code', '{c}', 'name', '{n}', 'script', '{w}', 'tess', '{t}')" for s, (c, n, w, t) in STATES.items()) + ")")
    found = let(F.lower(strip(state)), lambda own: F.get(F.filter(rows, lambda r: F.contains(own, r["state"]) | F.contains(r["state"], own)), 0))
    picked = F.struct(*[found[k].alias(k) for k in ("code", "name", "script", "tess")])
    return F.when((F.coalesce(state, F.lit("")) != "") & found.isNotNull(), picked).otherwise(F.lit(None).cast(_KIND))


def state_table(spark) -> DataFrame:
    """The states as a table (ord, state, code, name, script, tess) of 24 rows."""
    return spark.createDataFrame([(i, s, *row) for i, (s, row) in enumerate(STATES.items())], "ord int, state string, code string, name string, script string, tess string")


def with_state_language_by_join(df: DataFrame, state: str) -> DataFrame:
    """The same lookup as a join with the table of 24 states, for tables in which few distinct states stand."""
    table = F.broadcast(state_table(df.sparkSession).withColumnRenamed("state", "_name"))
    distinct = df.select(F.col(state).alias("_state")).filter("_state <> ''").distinct()
    own = F.lower(strip(F.col("_state")))
    hit = distinct.join(table, F.contains(own, F.col("_name")) | F.contains(F.col("_name"), own))
    first = hit.groupBy("_state").agg(F.min_by(F.struct("code", "name", "script", "tess"), "ord").alias("state_language"))
    return df.join(first, df[state] == first["_state"], "left").drop("_state")


def with_language(df: DataFrame, text: str, state: str) -> DataFrame:
    """``df`` with language_code, script, language_name and confidence (as text) of a document of the given state."""
    df = with_script(df, text, "_d_").withColumn("_state", state_language(F.col(state)))
    s, script = F.col("_state"), F.col("_d_script")
    same = s.isNotNull() & (s["script"] == script)
    default = F.lit(None).cast("string")
    for k, (_, _, _, name) in SCRIPTS.items():
        default = F.when(script == k, name).otherwise(default)
    code = F.when(script == "Latin", "en").when(same, s["code"]).otherwise(F.col("_d_lang"))
    name = (
        F.when((script == "Latin") & s.isNotNull(), F.concat(F.lit("English ("), s["name"], F.lit(" Jurisdiction)")))
        .when(script == "Latin", "English")
        .when(same, s["name"])
        .when(script == "Devanagari", "Hindi / Marathi (Devanagari)")
        .otherwise(default)
    )
    return df.withColumns({"language_code": code, "script": script, "language_name": name, "confidence": F.col("_d_script_confidence").cast("string")}).drop("_d_script", "_d_lang", "_d_script_confidence", "_state")


def ocr_pack(state: Column, present: list[str]) -> Column:
    """The OCR languages for a state: its own and English if that pack is present, else the first present of six and English; just English if none is."""
    own = state_language(state)["tess"]
    other = next((p for p in ("ben", "hin", "kan", "tam", "tel", "mar") if p in present), None)
    fallback = f"{other}+eng" if other else "eng"
    return F.when(own.isin(present) if present else F.lit(False), F.concat(own, F.lit("+eng"))).otherwise(fallback)


def handwriting_language(state: Column) -> Column:
    """The language of a state's handwriting model, by parts of the state's name; bn if none fits."""
    low = F.lower(F.coalesce(state, F.lit("")))
    has = lambda *ws: low.rlike("|".join(ws))
    return F.when(has("karnataka"), "kn").when(has("maharashtra"), "mr").when(has("tamil"), "ta").when(has("telangana", "andhra"), "te").when(has("uttar", "bihar", "madhya"), "hi").otherwise("bn")
