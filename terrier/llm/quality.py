"""Quality rules by the divergence of a document's histograms from those of its language. DataFrame functions only.

Two histograms of a document, of character classes and of common words, are held against the sums of the same
histograms over all documents of its language that pass the base rules, by Jensen-Shannon distance; so junk that fails
them anyhow doesn't shift what its language looks like. A document with too few words for a histogram to tell isn't judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.shared import stored

# Common function words of four languages, the most frequent first; other languages get their own most frequent ones from the documents.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by", "be", "this", "are", "at", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "par", "qui", "dans", "avec", "sur", "pas", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "su", "una", "para", "es", "al", "lo"],
}
#: A mix of these lists, whose length is that of the lists that other languages get.
OTHER_WORDS = list(dict.fromkeys(w for k in range(8) for ws in COMMON_WORDS.values() for w in ws[k : k + 1]))[:20]

SPACES = " \t\n\x0b\x0c\r"
#: Character classes, each taken from what the ones before left; the rest is a class of its own.
CLASSES = ("[a-z]+", "[A-Z]+", r"[^\x00-\x7F]+", "[0-9]+", "[#*$%&|<>]+", "[.,;:]+")
SYMBOLS_AT = 4
N_CLASSES, N_WORDS = len(CLASSES) + 1, len(OTHER_WORDS) + 1

MIN_WORDS, MOST_REPEATED = 50, 50
#: Distances above which a document is dropped, and the fewest words for the histogram to be held against it.
MOST_CLASS_DISTANCE, LEAST_WORDS_FOR_CLASSES = 0.35, 50
MOST_WORD_DISTANCE, LEAST_WORDS_FOR_WORDS = 0.3, 100
#: Languages without a fixed list up to which their words are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def _shares(counts: Column) -> Column:
    """Counts to shares: a list that sums to 1, or zeros."""
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two lists of shares, 0 to 1."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def in_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """doc_id, lang, text and its words."""
    d = docs.select("doc_id", F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "text", F.split(F.btrim("text", F.lit(SPACES)), r"[\x20\x09-\x0D]+").alias("words"))
    return d.select("doc_id", "lang", "text", F.when(F.element_at("words", 1) == "", F.array().cast("array<string>")).otherwise(F.col("words")).alias("words"))


def learned_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """_lang and learned, the most frequent words over all its rows, of each language without a fixed list (null is one); ties by code points."""
    other = F.coalesce(~F.col(lang).isin(list(COMMON_WORDS)), F.lit(True))
    counts = in_words(docs.filter(other), text, lang).select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("n", F.row_number().over(order)).filter(F.col("n") < N_WORDS)
    return top.groupBy(F.col("lang").alias("_lang")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("learned"))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts and the two histograms (lists of counts) of every row."""
    learned = stored(learned_words(docs, text, lang), "words")
    n_learned = learned.count()
    d = in_words(docs, text, lang)
    if n_learned:
        few = n_learned <= BROADCAST_LANGUAGES
        d = d.join(F.broadcast(learned) if few else learned, d["lang"].eqNullSafe(learned["_lang"]), "left").drop("_lang")
    else:
        d = d.withColumn("learned", F.lit(None).cast("array<string>"))
    # what is left of the words' characters after each class
    d = d.withColumn("left0", F.array_join("words", ""))
    for i, c in enumerate(CLASSES):
        d = d.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", c, ""))
    sizes = [F.length(f"left{i}") for i in range(N_CLASSES)]
    classes = F.array(*[(sizes[i] - sizes[i + 1]).cast("double") for i in range(N_CLASSES - 1)], sizes[-1].cast("double"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.expr("slice(words, 1, size(words) - 2)"), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
    )
    d = d.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("left0").cast("long").alias("word_chars"),
        (sizes[SYMBOLS_AT] - sizes[SYMBOLS_AT + 1]).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        classes.alias("classes"),
        F.when(F.col("learned").isNull(), F.filter("words", lambda w: w.isin(every))).otherwise(F.filter("words", lambda w: F.array_contains("learned", w))).alias("common"),
        "learned",
        windows.alias("windows"),
    )
    lists = F.lit(None).cast("array<string>")
    for k, ws in COMMON_WORDS.items():
        lists = F.when(F.col("lang") == k, F.array(*map(F.lit, ws))).otherwise(lists)
    # a language without words has no list
    listed = F.coalesce(lists, F.col("learned"), F.array().cast("array<string>"))
    d = d.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "classes",
        "common",
        listed.alias("listed"),
        # only a text in which a window comes back needs the places
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    back = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    d = d.withColumn("places", F.when(F.col("sorted").isNotNull(), F.array_sort(F.transform(back, lambda x: x["i"]))))
    # a window covers three words, or those up to the next one
    reach = F.transform("places", lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3)))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    counts = F.transform("listed", lambda k: (F.size("common") - F.size(F.array_remove("common", k))).cast("double"))
    # a language may have fewer words than the list has places
    d = d.withColumn("counts", F.concat(counts, F.array_repeat(F.lit(0.0), F.lit(N_WORDS - 1) - F.size("listed"))))
    rest = F.col("n_words") - F.aggregate("counts", F.lit(0.0), lambda s, x: s + x)
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "classes", F.concat("counts", F.array(rest)).alias("commons"))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the two distances.

    A null or empty text has no words and fails the base rules. Documents without a language are one language. A language
    of which no document passes the base rules has distance 0 everywhere. Repeated rows are judged alike and count each in the
    references; an empty table gives no row; other columns are ignored.
    """
    rows = stored(measured(docs, text, lang), "measured")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    sums = rows.filter(~failed).groupBy("lang").agg(F.array(*[F.sum(F.col("classes")[i]) for i in range(N_CLASSES)]).alias("all_classes"), F.array(*[F.sum(F.col("commons")[i]) for i in range(N_WORDS)]).alias("all_commons"))
    references = sums.select(F.col("lang").alias("_lang"), _shares(F.col("all_classes")).alias("class_ref"), _shares(F.col("all_commons")).alias("word_ref"))
    near = rows.join(references, rows["lang"].eqNullSafe(references["_lang"]), "left")
    near = near.withColumns({"class_shares": _shares(F.col("classes")), "word_shares": _shares(F.col("commons"))})
    near = near.withColumns({f"{k}_distance": F.coalesce(js_distance(F.col(f"{k}_shares"), F.col(f"{k}_ref")), F.lit(0.0)) for k in ("class", "word")})
    far = ((F.col("n_words") >= LEAST_WORDS_FOR_CLASSES) & (F.col("class_distance") > MOST_CLASS_DISTANCE)) | ((F.col("n_words") >= LEAST_WORDS_FOR_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE))
    return near.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far).alias("kept"), F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance")
    )
