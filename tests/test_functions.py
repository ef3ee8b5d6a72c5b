import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrier.functions import areas, dates, scripts, text, values
from terrier.operators.extract import terms


def column(spark, xs, f, kind="string"):
    rows = [(i, x) for i, x in enumerate(xs)]
    return [r.v for r in spark.createDataFrame(rows, f"i int, x {kind}").withColumn("v", f(F.col("x"))).orderBy("i").collect()]


def test_fixed_values():
    assert len(text._FOLDED) == 87 and len(values.STATES) == 24 and len(values.SCRIPTS) == 11
    assert sum(map(len, values.MONTHS.values())) == 47 and len(values.UNIT_WORDS) == 8
    assert sum(len(t) for f in values.ANCHORS.values() for t in f.values()) == 204


def test_numerals(spark):
    got = column(spark, ["দাগ নং ১২৩", "੬੮", "୪୫", "۱", None, "", "௧౨೩"], text.fold_numerals)
    assert got == ["দাগ নং 123", "੬੮", "୪5", "۱", "", "", "123"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x0DFF), max_size=30), min_size=1, max_size=40))
def test_folding_keeps_length_and_repeats(spark, xs):
    once = column(spark, xs, text.fold_numerals)
    assert [len(x) for x in once] == [len(x) for x in xs]
    assert column(spark, once, text.fold_numerals) == once


def test_lines_and_strip(spark):
    got = column(spark, [" a \r\n\n b c\x1cd ", "", " \t", "x"], text.lines)
    assert got == [["a", "b", "c", "d"], [], [], ["x"]]
    assert column(spark, ["\x1f a \x1e"], text.strip) == ["a"]


def test_dots_below(spark):
    assert column(spark, ["য়ड़"], text.decompose) == ["য়ड़"]


def test_chunks_and_titles(spark):
    assert column(spark, ["ab" * 600, "", None], lambda c: F.transform(text.chunks(c), F.length)) == [[500, 500, 200], [], []]
    assert column(spark, ["my_deed-1.v2.pdf", "plain"], text.title_from_filename) == ["my deed 1.v2", "plain"]
    assert column(spark, [5242880], text.megabytes, "long") == ["5.00"]


@pytest.mark.parametrize(
    "said, iso",
    [
        ("২৮ শে অক্টোবর ২০০১", "2001-10-28"),
        ("১১/৩/২০১০", "2010-03-11"),
        ("28-10-2001", "2001-10-28"),
        ("31/02/2010", "2010-02-31"),
        ("45/12/2010", None),
        ("12/12/20101", "2010-12-12"),
        ("28th march, 2001", "2001-03-28"),
        ("12 marla 2001", "2001-03-12"),
        ("45/13/2010 on 3 May 1999", "1999-05-03"),
        ("5 जून 2011", "2011-06-05"),
        ("in 1999 or 2004 on 7th Sept", "2004-09-07"),
        ("no date", None),
    ],
)
def test_dates(spark, said, iso):
    assert column(spark, [f" {said} "], dates.parse_date) == [(said, iso)]


def test_blank_dates(spark):
    assert column(spark, ["   ", None, ""], dates.parse_date) == [(None, None)] * 3


@pytest.mark.parametrize(
    "said, state, value, unit, metres",
    [
        ("2 acre 10 cent", "Karnataka", 2.0, "acre", 8498.42),
        ("৫ বিঘা ৩ কাঠা", "West Bengal", 5.0, "bigha", 6866.66),
        ("5 katha 2 bigha", "West Bengal", 2.0, "bigha", 3000.01),
        ("3 katha", None, 3.0, "katha", 3.0),
        ("12 guntha", "Maharashtra", 12.0, "gunta", 1214.04),
        ("1,200 acre", None, 200.0, "acre", 809372.0),
        ("5 century", None, 5.0, "cent", 202.35),
        ("0 acre", None, 0.0, "acre", None),
        ("7", None, 7.0, "Unspecified Unit", None),
        ("none", None, None, "Unspecified", None),
    ],
)
def test_areas(spark, said, state, value, unit, metres):
    assert column(spark, [said], lambda c: areas.parse_area(c, F.lit(state).cast("string"))) == [(said, value, unit, metres)]


def test_scripts(spark):
    xs = ["", "123 .,-", "দাগ abc", "abcdefghij क", "खसरा", None, "éñ", "م" * 5 + "a" * 90]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    got = [(r.script, r.lang, r.script_confidence) for r in scripts.with_script(df, "x").orderBy("i").collect()]
    assert got == [("Latin", "en", 1.0), ("Latin", "en", 1.0), ("Bengali", "bn", 0.5), ("Latin", "en", 0.909), ("Devanagari", "hi", 1.0), ("Latin", "en", 1.0), ("Latin", "en", 1.0), ("Urdu_Arabic", "ur", 0.053)]


def test_states_by_literal_and_by_join(spark):
    xs = ["New Delhi", "a", "  ", "", None, "Telangana", "nowhere", "GOA"]
    want = ["hi", "kn", "kn", None, None, "te", None, "kok"]
    assert column(spark, xs, lambda c: scripts.state_language(c)["code"]) == want
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    joined = scripts.with_state_language_by_join(df, "x").orderBy("i").select("state_language.code").collect()
    assert [r.code for r in joined] == want


def test_languages(spark):
    rows = [(1, "खसरा", "Maharashtra"), (2, "खसरा", None), (3, "deed", "Kerala"), (4, "দাগ নং", "Assam"), (5, "દસ્તાવેજ", "Goa")]
    got = {r.i: (r.language_code, r.script, r.language_name, r.confidence) for r in scripts.with_language(spark.createDataFrame(rows, "i int, t string, s string"), "t", "s").collect()}
    assert got == {1: ("mr", "Devanagari", "Marathi", "1.0"), 2: ("hi", "Devanagari", "Hindi / Marathi (Devanagari)", "1.0"), 3: ("en", "Latin", "English (Malayalam Jurisdiction)", "1.0"), 4: ("as", "Bengali", "Assamese", "1.0"), 5: ("gu", "Gujarati", "Gujarati", "1.0")}


def test_terms_are_longest_first_and_all_for_unknown_languages():
    assert terms("owner", "en")[-1] == "name"
    assert len(terms("survey", "gu")) > len(terms("survey", "bn")) > len(terms("survey", "en"))
    assert [len(t) for t in terms("area", "bn")] == sorted((len(t) for t in terms("area", "bn")), reverse=True)


def test_words_that_dont_stand_in_a_text_are_not_read(spark):
    """F12, F14, F18 to F20: of 36 words of units only those in the text are read, each unit once, and the first in the order of UNIT_WORDS counts."""
    read = areas._amounts("low")
    got = [[(a.unit, a.amount) for a in r.v] for r in spark.sql(f"SELECT i, {read} AS v FROM VALUES (0, 'plot'), (1, '7 cent and 2 acres 3 acre'), (2, 'acre'), (3, '১২ acre') AS t(i, low) ORDER BY i").collect()]
    names = [*values.UNIT_WORDS]
    assert got == [[], [(names.index("acre"), 2.0), (names.index("cent"), 7.0)], [], [(names.index("acre"), 12.0)]]
    shown = column(spark, ["12.5 of land", "no number", "2 cent", ""], lambda x: areas.parse_area(x, F.lit(None).cast("string"))["unit"])
    assert shown == ["Unspecified Unit", "Unspecified", "cent", None]
