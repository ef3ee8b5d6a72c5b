"""Recognised words, made from the words of documents: lines, best passes, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrier.operators import words
from terrier.plans.registry import dealt, query, table

#: Word i of document d in pass p has confidence (37 i + 11 d + 7 p) mod 101 - 1; line ends are blank words.
WORDS = r"""t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'single' WHEN doc_id % 3 = 1 THEN 'left' ELSE 'right' END AS section, regexp_split_to_array(replace(text, chr(10), '  '), ' ') AS ws FROM documents),
e AS (SELECT doc_id, section, ws, unnest(range(1, len(ws) + 1)) AS i FROM t), p AS (SELECT * FROM e CROSS JOIN (VALUES (4, 0), (6, 1)) AS v (psm, psm_ord)),
w AS (SELECT doc_id, section, psm, psm_ord, i, CASE WHEN i % 50 = 0 THEN '' ELSE trim(ws[i]) END AS word, (37 * i + 11 * doc_id + 7 * psm) % 101 - 1 AS conf FROM p),
l AS (SELECT *, sum(CASE WHEN word = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, psm ORDER BY i) AS line FROM w),
j AS (SELECT doc_id, section, psm, psm_ord, line, string_agg(word, ' ' ORDER BY i) FILTER (WHERE word <> '' AND conf > 0) AS t, sum(conf) FILTER (WHERE word <> '' AND conf > 0) AS c, count(*) FILTER (WHERE word <> '' AND conf > 0) AS n FROM l GROUP BY ALL),
k AS (SELECT doc_id, section, psm, psm_ord, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE t <> ''), '') AS text, coalesce(round(sum(c) / sum(n)::DOUBLE, 2), 0.0) AS confidence FROM j GROUP BY ALL),
b AS (SELECT doc_id, section, text, CASE WHEN text = '' THEN 0.0 ELSE confidence END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY length(text) DESC, psm_ord) AS rn FROM k) WHERE rn = 1)"""


def recognised(spark, sf_dir):
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    i = F.col("doc_id")
    section = F.when(i % 3 == 0, "single").when(i % 3 == 1, "left").otherwise("right")
    e = d.select("doc_id", section.alias("section"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("  ")), " ")).alias("at", "text"))
    e = e.select("*", F.inline(F.array(*[F.struct(F.lit(p).alias("psm"), F.lit(o).alias("psm_ord")) for o, p in enumerate((4, 6))])))
    n = F.col("at") + 1
    # a blank word may be a tab, and a word may bring its own
    text = F.when(n % 50 == 0, "\t").when(n % 50 == 1, F.concat(F.lit("\t"), F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    return e.select("doc_id", "section", "psm", "psm_ord", n.alias("i"), text.alias("text"), ((37 * n + 11 * i + 7 * F.col("psm")) % 101 - 1).cast("double").alias("conf"))


@query(f"WITH {WORDS} SELECT doc_id, section, psm, text, confidence FROM k")
def ocr_words_to_lines(spark, sf_dir):
    return words.passes(recognised(spark, sf_dir)).select("doc_id", "section", "psm", "text", "confidence")


@query(f"WITH {WORDS} SELECT doc_id, section, text, confidence FROM b")
def ocr_best_pass(spark, sf_dir):
    return words.best_passes(words.passes(recognised(spark, sf_dir)))


@query(f"""WITH {WORDS}, s AS (SELECT doc_id % 40 AS doc_id, CASE section WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END AS r, doc_id AS d, section, text, confidence FROM b)
SELECT d AS doc_id, CASE section WHEN 'left' THEN '--- REGISTRATION ENDORSEMENT ---' || chr(10) || text WHEN 'right' THEN '--- PROPERTY SCHEDULE & DEED BODY ---' || chr(10) || text ELSE text END AS text, round(confidence, 2) AS confidence FROM s WHERE text <> ''
UNION ALL SELECT d, '', 0.0 FROM s WHERE text = ''""")
def ocr_documents(spark, sf_dir):
    return words.documents(words.best_passes(words.passes(recognised(spark, sf_dir))))


@query(f"""WITH {WORDS}, d AS (SELECT doc_id, min(section) AS section, CASE WHEN doc_id % 2 = 0 THEN 'Kerala' END AS state FROM t GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN d.section = 'left' THEN '--- REGISTRATION ENDORSEMENT ---' || chr(10) || text WHEN d.section = 'right' THEN '--- PROPERTY SCHEDULE & DEED BODY ---' || chr(10) || text ELSE text END AS text, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round(confidence, 2) END AS confidence,
'en' AS language_code, 'Latin' AS script, CASE WHEN state IS NULL THEN 'English' ELSE 'English (Malayalam Jurisdiction)' END AS language_name FROM d LEFT JOIN b ON d.doc_id = b.doc_id""")
def ocr_recognised(spark, sf_dir):
    i = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 == 0, 1).otherwise(2).alias("columns"), F.when(i % 2 == 0, "Kerala").alias("state"))
    read = recognised(spark, sf_dir)
    # what another section or mode says of a page is not asked for
    rest = [F.col(c) for c in ("i", "text", "conf")]
    both = F.array(F.struct("section", "psm", *rest), F.struct(F.when(i % 3 == 0, "left").otherwise("single").alias("section"), F.lit(6).alias("psm"), *rest))
    return words.recognised(read.select("doc_id", F.inline(both)), pages)


@query(f"""WITH turns AS (SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'left' ELSE 'right' END AS section, string_agg(text, chr(10) ORDER BY turn, text) AS text, CAST(min(turn) * 10 + 5 AS DOUBLE) AS confidence FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE section WHEN 'left' THEN '--- REGISTRATION ENDORSEMENT ---' ELSE '--- PROPERTY SCHEDULE & DEED BODY ---' END || chr(10) || text AS body FROM turns)
SELECT conv_id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY section) FILTER (WHERE text <> ''), '') AS text, coalesce(round(avg(confidence) FILTER (WHERE text <> ''), 2), 0.0) AS confidence FROM s GROUP BY conv_id""")
def ocr_two_columns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null").withColumn("section", F.when(F.col("turn") % 2 == 0, "left").otherwise("right"))
    s = c.groupBy("conv_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"), (F.min("turn") * 10 + 5).cast("double").alias("confidence"))
    return words.documents(s, "conv_id")
