"""Text from tables of recognised words: lines, passes, sections, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.functions.scripts import with_language
from terrier.functions.text import strip

#: The headers of the two columns' sections.
SECTIONS = {"left": "--- REGISTRATION ENDORSEMENT ---", "right": "--- PROPERTY SCHEDULE & DEED BODY ---"}
#: The recogniser's modes for each section, in the order in which they are tried.
MODES = {"left": (4, 6), "right": (4, 6, 11), "single": (4, 6, 11)}


def passes(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "section", "psm", "psm_ord")) -> DataFrame:
    """(keys, text, confidence) of each pass of ``words`` (keys, i, text, conf).

    In the order of i, a blank word ends a line; words of confidence 0 or less are left out but end none. Lines are joined by line
    feeds; confidence is the mean of what was kept, to 2 places, 0 if nothing was.
    """
    clean = strip(F.coalesce("text", F.lit("")))
    placed = words.select(*keys, "i", "conf", clean.alias("word"))
    kept = (F.col("word") != "") & (F.col("conf") > 0)
    told = F.collect_list(F.when(kept | (F.col("word") == ""), F.struct("i", "word")))
    out = placed.groupBy(*keys).agg(F.sort_array(told).alias("ws"), F.sum(F.when(kept, F.col("conf"))).alias("c"), F.count_if(kept).alias("n"))
    ends = F.array_compact(F.transform("ws", lambda w, at: F.when(w["word"] == "", at + 1)))
    cuts = F.concat(F.array(F.lit(0)), ends, F.array(F.size("ws") + 1))
    line = lambda c, at: F.array_join(F.transform(F.slice("ws", c + 1, F.get("cuts", at + 1) - c - 1), lambda w: w["word"]), " ")
    lines = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), line)
    text = F.array_join(F.filter(lines, lambda t: t != ""), "\n")
    return out.withColumn("cuts", cuts).select(*keys, text.alias("text"), F.when(F.col("n") > 0, F.round(F.col("c") / F.col("n"), 2)).otherwise(0.0).alias("confidence"))


def best_passes(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "section")) -> DataFrame:
    """The pass with the longest text of each section, the earlier one if they tie; one that is empty has confidence 0."""
    best = F.max_by(F.struct("text", "confidence"), F.struct(F.length("text"), -F.col("psm_ord"))).alias("b")
    return found.groupBy(*keys).agg(best).select(*keys, "b.text", F.when(F.col("b.text") == "", 0.0).otherwise(F.col("b.confidence")).alias("confidence"))


def documents(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, confidence): the sections under their headers, left first, empty ones left out; a single section has no header. Confidence is their plain mean, to 2 places, 0 if there are none."""
    rank = F.when(F.col("section") == "left", 0).when(F.col("section") == "right", 1).otherwise(2)
    head = F.lit(None).cast("string")
    for s, title in SECTIONS.items():
        head = F.when(F.col("section") == s, title).otherwise(head)
    body = F.when(head.isNotNull(), F.concat(head, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    full = F.col("text") != ""
    out = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.when(full, F.struct(rank.alias("r"), body.alias("t"))))).alias("s"), F.avg(F.when(full, F.col("confidence"))).alias("c"))
    return out.select(key, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"), F.coalesce(F.round("c", 2), F.lit(0.0)).alias("confidence"))


def recognised(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text, confidence, language_code, script, language_name) of every row of ``pages`` (doc_id, columns, state).

    ``words`` (doc_id, section, psm, i, text, conf) are what a recogniser read. A page of two columns or more takes its sections
    left and right, any other one its section single; each section takes the modes of ``MODES`` and the best of them. Words of
    other sections and modes are left out. A page without words has an empty text, confidence 0 and English.
    """
    order = F.lit(None).cast("int")
    for section, modes in MODES.items():
        for at, psm in enumerate(modes):
            order = F.when((F.col("section") == section) & (F.col("psm") == psm), at).otherwise(order)
    asked = F.when(F.col("columns") >= 2, F.col("section").isin("left", "right")).otherwise(F.col("section") == "single")
    own = words.withColumn("psm_ord", order).filter("psm_ord is not null").join(pages.select("doc_id", "columns"), "doc_id").filter(asked)
    texts = documents(best_passes(passes(own)))
    whole = pages.select("doc_id", "state").join(texts, "doc_id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    told = with_language(whole.withColumnRenamed("confidence", "_ocr"), "text", "state")
    return told.select("doc_id", "text", F.col("_ocr").alias("confidence"), "language_code", "script", "language_name")
