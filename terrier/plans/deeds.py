"""Deeds written from the columns of the given tables; what they say must be read back, so the columns are the truth."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrier.functions.areas import parse_area
from terrier.functions.dates import parse_date
from terrier.functions.scripts import handwriting_language, ocr_pack, state_language, with_language, with_script, with_state_language_by_join
from terrier.functions.text import fold_numerals
from terrier.functions.values import SCRIPTS, ZEROS
from terrier.operators.components import shared_folder
from terrier.operators.extract import certificates, first_by_explode
from terrier.plans.registry import query, spread, table
from terrier.sources.certificates import read_certificates, write_certificates

BENGALI = "".join(chr(ZEROS["Bengali"] + d) for d in range(10))


def in_bengali(text):
    return F.translate(text, "0123456789", BENGALI)


def deeds(spark, sf_dir):
    """Line items as deeds, with an OCR confidence of 50 plus the quantity."""
    body = F.concat(F.lit("Survey No: "), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit("\nArea: "), F.col("l_quantity").cast("int"), F.lit(" acre\nDated: "), F.date_format("l_shipdate", "dd/MM/yyyy"))
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.monotonically_increasing_id().alias("at")).alias("row"), body.alias("raw_text"), (F.col("l_quantity") + 50).alias("ocr"))


#: The confidences of a deed, and their mean, as DuckDB computes them.
DEED_SQL = """deeds AS (SELECT *, round(CAST(0.88 AS DOUBLE) * (l_quantity + 50) / 100.0::DOUBLE, 2) AS c1, round(CAST(0.85 AS DOUBLE) * (l_quantity + 50) / 100.0::DOUBLE, 2) AS c2, round(CAST(0.9 AS DOUBLE) * (l_quantity + 50) / 100.0::DOUBLE, 2) AS c3 FROM lineitem),
scored AS (SELECT *, round((c1 + c2 + c3) / 3, 2) AS overall FROM deeds), judged AS (SELECT *, CASE WHEN overall >= 0.6 THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS verdict FROM scored)"""


def read_deeds(spark, sf_dir):
    return certificates(deeds(spark, sf_dir), "row", ocr_confidence=F.col("ocr"))


@query(f"""WITH {DEED_SQL} SELECT l_orderkey, l_linenumber, l_orderkey || '/' || l_linenumber AS survey, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS area_value, 'acre' AS area_unit,
round(CAST(l_quantity AS INT) * CAST(4046.86 AS DOUBLE), 2) AS sq_meters, strftime(l_shipdate, '%Y-%m-%d') AS registered, overall AS overall_confidence, verdict AS verification_status FROM judged""")
def extract_certificate_flat(spark, sf_dir):
    c = F.col("certificate")
    return read_deeds(spark, sf_dir).select("row.l_orderkey", "row.l_linenumber", c["survey_number"]["value"].alias("survey"), c["area_extent"]["value"].alias("area_value"), c["area_extent"]["unit"].alias("area_unit"), c["area_extent"]["sq_meters"].alias("sq_meters"), c["registration_date"]["value"].alias("registered"), c["overall_confidence"].alias("overall_confidence"), c["verification_status"].alias("verification_status"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey || '/' || l_linenumber AS survey, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS area_value, strftime(l_shipdate, '%Y-%m-%d') AS registered FROM lineitem""")
def extract_by_explode(spark, sf_dir):
    d = deeds(spark, sf_dir).select("row", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("state"), F.split("raw_text", "\n").alias("lines"))
    return first_by_explode(d, "row", "state").select("row.l_orderkey", "row.l_linenumber", F.col("survey.value").alias("survey"), F.col("area.area.value").alias("area_value"), F.col("registered.iso").alias("registered"))


@query(f"WITH {DEED_SQL} SELECT verdict AS verification_status, l_returnflag, count(*) AS n FROM judged GROUP BY ROLLUP (verdict, l_returnflag)")
def verify_status_counts(spark, sf_dir):
    d = read_deeds(spark, sf_dir).select(F.col("certificate.verification_status").alias("verification_status"), F.col("row.l_returnflag").alias("l_returnflag"))
    return d.rollup("verification_status", "l_returnflag").agg(F.count("*").alias("n"))


@query(f"WITH {DEED_SQL} SELECT verdict AS verification_status, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS DOUBLE) AS area, strftime(min(l_shipdate), '%Y-%m-%d') AS earliest, 0 AS owned FROM judged GROUP BY verdict, l_returnflag")
def certificate_variants(spark, sf_dir):
    """Certificates stored as variants, read by path and rolled up."""
    folder = f"{shared_folder(spark)}/certificates-{uuid.uuid4().hex}"
    write_certificates(read_deeds(spark, sf_dir).select("row.l_returnflag", "certificate"), folder)
    paths = {"verification_status": ("$.verification_status", "string"), "area": ("$.area_extent.value", "double"), "registered": ("$.registration_date.value", "string"), "owner": ("$.owners[0].name", "string")}
    read = read_certificates(spark, folder, paths)
    return read.groupBy("verification_status", "l_returnflag").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.min("registered").alias("earliest"), F.count("owner").cast("int").alias("owned"))


@query(f"WITH {DEED_SQL} SELECT overall AS overall_confidence, count(*) AS n FROM judged GROUP BY overall")
def overall_confidence(spark, sf_dir):
    return read_deeds(spark, sf_dir).groupBy(F.col("certificate.overall_confidence").alias("overall_confidence")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, 'দাগ নং ' || l_orderkey || '/' || l_linenumber AS folded FROM lineitem")
def numerals_fold(spark, sf_dir):
    text = F.concat(F.lit("দাগ নং "), in_bengali(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))))
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", fold_numerals(text).alias("folded"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_parse_numeric(spark, sf_dir):
    text = F.concat(F.lit("  "), F.when(F.col("o_orderkey") % 2 == 0, in_bengali(F.date_format("o_orderdate", "d/M/yyyy"))).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy")))
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", parse_date(text)["iso"].alias("iso"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_parse_month_name(spark, sf_dir):
    d, m, y = F.date_format("o_orderdate", "d"), F.date_format("o_orderdate", "MMMM"), F.date_format("o_orderdate", "yyyy")
    long = F.concat(F.lit("the "), d, F.lit("th "), m, F.lit(", "), y)
    short = F.concat(d, F.lit(" "), F.upper(F.substring(m, 1, 3)), F.lit(" "), y)
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", parse_date(F.when(F.col("o_orderkey") % 2 == 0, long).otherwise(short))["iso"].alias("iso"))


def area_columns(df):
    """The parts of a parsed area; a column of its own, it is parsed once for all three."""
    return df.select("l_orderkey", "l_linenumber", F.col("area.value").alias("area_value"), F.col("area.unit").alias("area_unit"), F.col("area.sq_meters").alias("sq_meters"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS area_value, 'bigha' AS area_unit, round(CAST(l_quantity AS INT) * CASE WHEN l_linenumber % 2 = 0 THEN CAST(1333.33 AS DOUBLE) ELSE 2500.0::DOUBLE END, 2) AS sq_meters FROM lineitem")
def area_parse_simple(spark, sf_dir):
    text = F.concat(in_bengali(F.col("l_quantity").cast("int").cast("string")), F.lit(" বিঘা"))
    area = parse_area(text, F.when(F.col("l_linenumber") % 2 == 0, " West Bengal "))
    return area_columns(spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", area.alias("area")))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS area_value, 'acre' AS area_unit, round(CAST(l_quantity AS INT) * CAST(4046.86 AS DOUBLE) + l_linenumber * CAST(101.17 AS DOUBLE) + 7 * CAST(40.47 AS DOUBLE), 2) AS sq_meters FROM lineitem")
def area_parse_compound(spark, sf_dir):
    text = F.concat(F.col("l_linenumber"), F.lit(" Guntha 7 cent and "), F.col("l_quantity").cast("int"), F.lit(" acres"))
    area = parse_area(text, F.lit("Karnataka"))
    return area_columns(spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", area.alias("area")))


@query("SELECT o_orderkey, o_orderkey || '/' || o_custkey || 'B' AS survey, CAST(o_custkey AS VARCHAR) || '-' || o_orderkey AS khata FROM orders")
def anchor_survey_khata(spark, sf_dir):
    o = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    text = F.concat(F.lit("Deed of "), F.col("o_orderpriority"), F.lit("\r\n  KHASRA NUMBER :- "), in_bengali(F.col("o_orderkey").cast("string")), F.lit("/"), F.col("o_custkey"), F.lit("B | plot\n\nখতিয়ান নং — "), in_bengali(F.col("o_custkey").cast("string")), F.lit("-"), F.col("o_orderkey"), F.lit("; end"))
    c = certificates(o.select("o_orderkey", text.alias("raw_text")), "o_orderkey", lang=F.lit("bn"))
    return c.select("o_orderkey", F.col("certificate.survey_number.value").alias("survey"), F.col("certificate.khata_number.value").alias("khata"))


@query("SELECT c_custkey, c_name AS owner, n_name || ' ' || c_mktsegment AS guardian, 'Pattadar / Khatedar' AS relation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def anchor_owner_guardian(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    text = F.concat(F.lit("Pattadar Name: "), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, " S/O ").otherwise(" w/o : "), F.col("n_name"), F.lit(" "), F.col("c_mktsegment"))
    found = certificates(c.select("c_custkey", text.alias("raw_text")), "c_custkey")
    o = F.get("certificate.owners", 0)
    return found.select("c_custkey", o["name"].alias("owner"), o["guardian_name"].alias("guardian"), o["relation"].alias("relation"))


@query("SELECT c_custkey, n_name AS village, r_name AS district FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def anchor_village(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    text = F.concat(F.lit("no anchor here\nMouza = "), F.col("n_name"), F.lit(" | JL No: 7\nMouza: elsewhere"))
    found = certificates(c.select("c_custkey", "r_name", text.alias("raw_text")).withColumn("k", F.struct("c_custkey")), "k", district=F.col("r_name"))
    return found.select("k.c_custkey", F.col("certificate.location.village").alias("village"), F.col("certificate.location.district").alias("district"))


def _case(key, cases):
    """The text of the case that the key picks."""
    return F.element_at(F.array(*[F.lit(c[0]) for c in cases]), (key % len(cases) + 1).cast("int"))


def _want(key: str, values: list) -> str:
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[{key} % {len(values)} + 1]"


#: Texts at the edges of dates, and what must be read: blank, out of range, no calendar, the last year of several, a month inside a word.
DATE_CASES = [("", None, None), (" \t", None, None), (None, None, None), ("31/02/2010", "31/02/2010", "2010-02-31"), ("32/01/2010", "32/01/2010", None), ("45/45/2010 or 3 march 2011", "45/45/2010 or 3 march 2011", "2011-03-03"), ("7/8/20101", "7/8/20101", "2010-08-07"), ("1/2/1799", "1/2/1799", None), ("28th march, 2001", "28th march, 2001", "2001-03-28"), ("in 1950, 5th may; copy of 1999", "in 1950, 5th may; copy of 1999", "1999-05-05"), ("40 march 2001, 4 may 2002", "40 march 2001, 4 may 2002", "2002-05-04"), ("no date 12", "no date 12", None)]


@query(f"SELECT c_custkey, {_want('c_custkey', [c[1] for c in DATE_CASES])} AS raw, {_want('c_custkey', [c[2] for c in DATE_CASES])} AS iso FROM customer")
def date_edge_cases(spark, sf_dir):
    d = parse_date(_case(F.col("c_custkey"), DATE_CASES))
    return table(spark, sf_dir, "customer").select("c_custkey", d["raw"].alias("raw"), d["iso"].alias("iso"))


#: Texts at the edges of areas in the default table: no unit, no number, a unit's word inside a longer one, a thousands separator, nothing but zero.
AREA_CASES = [("12.5 of land", 12.5, "Unspecified Unit", None), ("no number", None, "Unspecified", None), ("5 century", 5.0, "cent", 202.35), ("1,200 acre", 200.0, "acre", 809372.0), ("0 acre", 0.0, "acre", None), ("3 are", 3.0, "are", 3.0), ("", None, None, None)]


@query(f"SELECT c_custkey, {_want('c_custkey', [c[1] for c in AREA_CASES])}::DOUBLE AS area_value, {_want('c_custkey', [c[2] for c in AREA_CASES])} AS area_unit, {_want('c_custkey', [c[3] for c in AREA_CASES])}::DOUBLE AS sq_meters FROM customer")
def area_edge_cases(spark, sf_dir):
    a = parse_area(_case(F.col("c_custkey"), AREA_CASES), F.lit("Karnataka"))
    return table(spark, sf_dir, "customer").select("c_custkey", a["value"].alias("area_value"), a["unit"].alias("area_unit"), a["sq_meters"].alias("sq_meters"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Clerk ' || o_custkey WHEN 1 THEN 'Entity ' || o_custkey END AS owner, CASE o_orderkey % 4 WHEN 0 THEN 'Pattadar / Khatedar' WHEN 1 THEN 'Named Person / Party' END AS relation,
CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS issued, CASE o_orderkey % 4 WHEN 0 THEN 'Town ' || o_custkey WHEN 1 THEN 'Place ' || o_custkey END AS village, o_orderkey % 4 < 2 AS located, CASE WHEN o_orderkey % 4 < 2 THEN 'bn' ELSE 'en' END AS lang_read, 'patta' AS kind FROM orders""")
def certificate_edge_cases(spark, sf_dir):
    """An issue date beside a registration date, entities where lines have nothing, and texts that are empty or null."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    full = F.concat(F.lit("Owner Name: Clerk "), c, F.lit("\nMouza: Town "), c, F.lit("\nDated: 1/1/1990\nIssue Date: "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" | office"))
    text = F.when(k == 0, full).when(k == 1, "plain words of nothing").when(k == 2, "")
    entity = lambda t, label, n: F.struct(F.concat(F.lit(t), c).alias("text"), F.lit(label).alias("label"), F.lit(n).alias("confidence"))
    found = F.array(entity("Org ", "ORG", 0.99), entity("Entity ", "PER", 0.9), entity("Other ", "PER", 0.95), entity("Place ", "LOC", 0.8))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw_text"), found.alias("found"))
    got = certificates(o, "o_orderkey", lang=F.lit("bn"), script=F.lit("Bengali"), document_type=F.lit("patta"), entities="found")
    x, owner = F.col("certificate"), F.get("certificate.owners", 0)
    return got.select("o_orderkey", owner["name"].alias("owner"), owner["relation"].alias("relation"), x["issue_date"]["value"].alias("issued"), x["location"]["village"].alias("village"), x["location"].isNotNull().alias("located"), x["detected_language"].alias("lang_read"), x["document_type"].alias("kind"))


def _script_sql(text: str) -> str:
    counts = {s: f"length(regexp_replace({text}, '[^\\x{{{lo:04x}}}-\\x{{{hi:04x}}}]', '', 'g'))" if s != "Latin" else f"length(regexp_replace({text}, '[^A-Za-z]', '', 'g'))" for s, (lo, hi, _, _) in SCRIPTS.items()}
    names = ", ".join(f"{c} AS n{i}" for i, c in enumerate(counts.values()))
    top, last = "greatest(" + ", ".join(f"n{i}" for i in range(10)) + ")", "n10"
    pick = lambda values: "CASE " + " ".join(f"WHEN total > 0 AND n{i} = best {'AND NOT strong ' if i == 10 else ''}THEN '{v}'" for i, v in enumerate(values)) + " END"
    return f"""counted AS (SELECT *, {names} FROM texts), summed AS (SELECT *, {' + '.join(f'n{i}' for i in range(11))} AS total, {top} AS top FROM counted),
    strongly AS (SELECT *, top >= 5 OR top / greatest(total, 1)::DOUBLE >= 0.15 AS strong FROM summed), found AS (SELECT *, CASE WHEN strong AND total > 0 THEN top ELSE greatest(top, {last}) END AS best FROM strongly),
    told AS (SELECT *, coalesce({pick(SCRIPTS)}, 'Latin') AS script, coalesce({pick([v[2] for v in SCRIPTS.values()])}, 'en') AS lang, CASE WHEN total > 0 THEN round(best / greatest(total, 1)::DOUBLE, 3) ELSE 1.0 END AS script_confidence FROM found)"""


@query(f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_script_sql('t')} SELECT doc_id, script, lang AS told_lang, script_confidence FROM told")
def script_detect(spark, sf_dir):
    d = with_script(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "text")
    return d.select("doc_id", "script", F.col("lang").alias("told_lang"), "script_confidence")


#: A letter of six scripts, as many as customer and nation say, before Latin ones.
LETTERS = ["দ", "ख", "ಕ", "த", "ਕ", "م"]


@query(f"""WITH texts AS (SELECT c_custkey, repeat(({LETTERS!r})[c_nationkey % 6 + 1], CAST(c_custkey % 8 AS INT)) || repeat('ख', CAST(c_custkey % 3 AS INT)) || repeat('Zz 9é', CAST(c_custkey % 11 AS INT)) AS t FROM customer), {_script_sql('t')}
SELECT c_custkey, script, lang, script_confidence FROM told""")
def script_detect_indic(spark, sf_dir):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    text = F.concat(F.repeat(F.element_at(F.array(*map(F.lit, LETTERS)), n % 6 + 1), (k % 8).cast("int")), F.repeat(F.lit("ख"), (k % 3).cast("int")), F.repeat(F.lit("Zz 9é"), (k % 11).cast("int")))
    return with_script(table(spark, sf_dir, "customer").select("c_custkey", text.alias("t")), "t").select("c_custkey", "script", "lang", "script_confidence")


#: Digits and full stops of a script count as its letters; others don't.
DIGIT_CASES = [("১২৩", "Bengali"), ("१२ ab", "Devanagari"), ("12345 !?", "Latin"), ("।।", "Devanagari"), ("abcdefghijklmnopq ১", "Latin"), ("٣٤٥٦٧", "Urdu_Arabic")]


@query(f"SELECT c_custkey, {_want('c_custkey', [c[1] for c in DIGIT_CASES])} AS script FROM customer")
def script_of_digits(spark, sf_dir):
    return with_script(table(spark, sf_dir, "customer").select("c_custkey", _case(F.col("c_custkey"), DIGIT_CASES).alias("t")), "t").select("c_custkey", "script")


#: States as people write them, and the language that must be found (None: none).
SAID = [("West Bengal", "bn", "Bengali"), (" KARNATAKA ", "kn", "Kannada"), ("New Delhi", "hi", "Hindi"), ("a", "kn", "Kannada"), ("  ", "kn", "Kannada"), ("", None, None), ("Kerala State", "ml", "Malayalam"), ("goa", "kok", "Konkani"), ("pradesh", "te", "Telugu"), ("Atlantis", None, None), ("Bihar", "hi", "Hindi"), ("Maharashtra", "mr", "Marathi")]


def _said(key):
    return F.element_at(F.array(*[F.lit(s) for s, _, _ in SAID]), (key % len(SAID) + 1).cast("int"))


def _said_sql(key: str, i: int) -> str:
    return f"([{', '.join('NULL' if s[i] is None else repr(s[i]) for s in SAID)}])[{key} % {len(SAID)} + 1]"


@query(f"SELECT c_custkey, {_said_sql('c_custkey', 1)} AS code, {_said_sql('c_custkey', 2)} AS name FROM customer")
def lang_from_state(spark, sf_dir):
    s = state_language(_said(F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", s["code"].alias("code"), s["name"].alias("name"))


@query(f"SELECT c_custkey, {_said_sql('c_custkey', 1)} AS code, {_said_sql('c_custkey', 2)} AS name FROM customer")
def lang_from_state_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", _said(F.col("c_custkey")).alias("state"))
    return with_state_language_by_join(c, "state").select("c_custkey", "state_language.code", "state_language.name")


@query(f"""WITH c AS (SELECT c_custkey, {_said_sql('c_custkey', 1)} AS code, {_said_sql('c_custkey', 2)} AS name, c_nationkey % 3 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'en' WHEN 1 THEN CASE WHEN code IN ('hi', 'mr', 'kok') THEN code ELSE 'hi' END ELSE 'bn' END AS language_code,
CASE k WHEN 0 THEN 'Latin' WHEN 1 THEN 'Devanagari' ELSE 'Bengali' END AS script,
CASE k WHEN 0 THEN CASE WHEN name IS NULL THEN 'English' ELSE 'English (' || name || ' Jurisdiction)' END WHEN 1 THEN CASE WHEN code IN ('hi', 'mr', 'kok') THEN name ELSE 'Hindi / Marathi (Devanagari)' END ELSE 'Bengali' END AS language_name,
CASE k WHEN 0 THEN '1.0' ELSE '0.5' END AS confidence FROM c""")
def lang_resolve(spark, sf_dir):
    text = F.element_at(F.array(F.lit("a deed"), F.lit("खख abcd खख"), F.lit("দাগ দা abcde")), F.col("c_nationkey") % 3 + 1)
    c = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), _said(F.col("c_custkey")).alias("state"))
    return with_language(c, "text", "state").select("c_custkey", "language_code", "script", "language_name", "confidence")


@query(f"""WITH c AS (SELECT c_custkey, {_said_sql('c_custkey', 0)} AS state, {_said_sql('c_custkey', 1)} AS code FROM customer)
SELECT c_custkey, CASE code WHEN 'kn' THEN 'kan+eng' WHEN 'mr' THEN 'mar+eng' ELSE 'hin+eng' END AS pack,
CASE WHEN lower(state) LIKE '%karnataka%' THEN 'kn' WHEN lower(state) LIKE '%maharashtra%' THEN 'mr' WHEN lower(state) LIKE '%bihar%' THEN 'hi' ELSE 'bn' END AS handwriting FROM c""")
def ocr_languages(spark, sf_dir):
    s = _said(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", ocr_pack(s, ["hin", "kan", "mar"]).alias("pack"), handwriting_language(s).alias("handwriting"))
