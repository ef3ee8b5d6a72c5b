from pyspark.sql import functions as F

from terrier.functions import sql
from terrier.functions.areas import parse_area
from terrier.functions.dates import parse_date
from terrier.functions.scripts import with_script
from terrier.functions.text import fold_numerals
from terrier.operators.extract import first_in_lines
from terrier.functions.text import lines
from terrier.sources.certificates import read_certificates, write_certificates

TEXTS = [None, "", " \t", "১২ মার্চ ১৯৯০", "31/02/2010", "2 acre 10 cent", "৫ বিঘা", "খখ abc", "it's 5\\n", "দাগ নং ১২৩/৪\nArea: 2 acre\r\n\nDated: 1/2/1990", "Owner Name: A s/o B\nMouza: C"]


def test_functions_in_sql_are_those_of_columns(spark):
    sql.register(spark)
    sql.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    want = with_script(df, "text").select("id", fold_numerals(F.col("text")).alias("f"), parse_date(F.col("text")).alias("d"), parse_area(F.col("text"), F.lit("karnataka")).alias("a"), "script", "lang", "script_confidence")
    got = spark.sql("SELECT id, fold_numerals(text) AS f, parse_date(text) AS d, parse_area(text, 'karnataka') AS a, s.script, s.lang, s.confidence AS script_confidence FROM (SELECT *, script_of(text) AS s FROM {df})", df=df)
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


def test_fields_and_lines_in_sql(spark):
    sql.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    want = first_in_lines(df.select("id", F.lit("en").alias("lang"), lines(F.coalesce("text", F.lit(""))).alias("lines")), F.lit(None).cast("string"))
    got = spark.sql("SELECT id, f.* FROM (SELECT id, deed_fields(text, 'en', NULL) AS f FROM {df})", df=df)
    assert got.orderBy("id").collect() == want.select(got.columns).orderBy("id").collect()
    each = spark.sql("SELECT id, pos, line FROM {df}, LATERAL deed_lines(text, 'en') WHERE id >= 9", df=df).collect()
    assert sorted(map(tuple, each)) == [(9, 0, "দাগ নং ১২৩/৪"), (9, 1, "Area: 2 acre"), (9, 2, "Dated: 1/2/1990"), (10, 0, "Owner Name: A s/o B"), (10, 1, "Mouza: C")]


def test_variants(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    write_certificates(spark.sql("SELECT 1 AS id, named_struct('a', named_struct('v', 2.5D), 'o', array('x')) AS certificate"), folder)
    write_certificates(spark.sql("SELECT 2 AS id, named_struct('a', 'text', 'new', 7) AS certificate UNION ALL SELECT 3, NULL"), folder)
    got = read_certificates(spark, folder, {"v": ("$.a.v", "double"), "o": ("$.o[0]", "string"), "new": ("$.new", "int")})
    assert sorted(map(tuple, got.collect())) == [(1, 2.5, "x", None), (2, None, None, 7), (3, None, None, None)]
