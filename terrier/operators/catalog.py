"""The register of documents: search, pages, single rows, changes, and what a list shows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.text import strip
from terrier.sources.uploads import table_schema

SEARCHED = ("title", "original_filename", "parcel_identifier", "district", "raw_text")
PATCHABLE = ("title", "document_type", "parcel_identifier", "district", "state", "status", "detected_language", "detected_script", "raw_text", "ocr_confidence", "extracted_data")
MOST_ROWS = 200
DASH = "—"


def _pattern(search: str) -> str:
    """The ILIKE pattern of a search. % and _ stay wildcards; a backslash before anything else is one character."""
    text, out, i = search.strip(), "", 0
    while i < len(text):
        if text[i] == "\\" and (i + 1 == len(text) or text[i + 1] not in "%_\\"):
            out += "\\\\"
        elif text[i] == "\\":
            out, i = out + text[i : i + 2], i + 1
        else:
            out += text[i]
        i += 1
    return f"%{out}%"


def search(docs: DataFrame, document_type: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    """Rows of the type, the status and with the text in one of the searched columns; ALL and empty mean any. A blank text finds every row with one searched column that isn't null."""
    if document_type and document_type != "ALL":
        docs = docs.filter(F.col("document_type") == document_type.lower())
    if status and status != "ALL":
        docs = docs.filter(F.col("status") == status.upper())
    if text:
        pattern = _pattern(text)
        docs = docs.filter(reduce(lambda a, b: a | b, [_like(F.col(c), pattern) for c in SEARCHED if c in docs.columns]))
    return docs


def _like(column: Column, pattern: str) -> Column:
    """ILIKE behind a plain search for the ASCII words of the pattern: a text that lacks one is never held against the pattern."""
    pieces = [p for p in re.split(r"\\.|[%_]", pattern, flags=re.S) if p and p.isascii()]
    return reduce(lambda a, b: a & b, [*[F.contains(F.lower(column), F.lit(p.lower())) for p in pieces], column.ilike(pattern)])


def rows(docs: DataFrame) -> DataFrame:
    """The 20 columns that a list of documents answers with, in the table's order; null where ``docs`` lacks one."""
    return docs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table_schema()])


def page(docs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page, newest first; rows of the same time by falling id, so pages don't overlap."""
    if skip < 0 or not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"skip must be 0 or more and limit 1 to {MOST_ROWS}")
    return docs.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def one(docs: DataFrame, key: int) -> DataFrame:
    return docs.filter(F.col("id") == key).limit(1)


def inserted(docs: DataFrame, uploads: DataFrame) -> DataFrame:
    """``docs`` and the uploads (title, original_filename, document_type, parcel_identifier, district, state, ...) as pending rows.

    The title is the file's name if none is given; type is lower case; of optional fields an empty one is null and a blank one is empty.
    """
    optional = {c: strip(F.nullif(F.col(c), F.lit(""))) for c in ("parcel_identifier", "district", "state")}
    new = uploads.withColumns({"title": F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.col("original_filename")), "document_type": F.lower("document_type"), "status": F.lit("PENDING"), **optional})
    return docs.unionByName(new, allowMissingColumns=True)


def _last(changes: DataFrame, order: str) -> DataFrame:
    """One row of ``changes`` for each id: the last by ``order`` where there is such a column, ties and else by the largest of all columns."""
    by = [order] if order in changes.columns else []
    rest = [c for c in changes.columns if c not in ("id", order)]
    last = changes.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(*by, *rest)).alias("_last")) if rest else changes.select("id").distinct()
    return last.select("id", *[F.col("_last")[c].alias(c) for c in rest])


def patched(docs: DataFrame, patches: DataFrame, order: str = "at") -> DataFrame:
    """``docs`` with what each patch (id, set_fields, columns) says; a field in set_fields overwrites, with null too. Of several patches of
    a row the last counts, by the column ``order`` (without it, and for ties, the largest by set_fields, then by the other columns)."""
    named = [c for c in PATCHABLE if c in docs.columns and c in patches.columns]
    p = _last(patches.select("id", "set_fields", *named, *[c for c in (order,) if c in patches.columns]), order)
    p = p.select("id", "set_fields", *[F.col(c).alias(f"_new_{c}") for c in named])
    out = docs.join(p, "id", "left")
    new = {c: F.when(F.array_contains("set_fields", c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in named}
    if "updated_at" in docs.columns:
        new["updated_at"] = F.when(F.col("set_fields").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at"))
    return out.withColumns(new).select(*docs.columns)


def deleted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return docs.join(keys.select("id"), "id", "left_anti")


def started(docs: DataFrame, keys: DataFrame | None = None, auto_process: bool = True) -> DataFrame:
    """``docs`` with the rows whose id is in ``keys`` (all, without it) marked as being processed; as they are if that isn't asked for."""
    if not auto_process:
        return docs
    if keys is None:
        return docs.withColumns({"status": F.lit("PROCESSING")} | ({"updated_at": F.current_timestamp()} if "updated_at" in docs.columns else {}))
    marked = docs.join(keys.select("id").distinct().withColumn("_start", F.lit(True)), "id", "left")
    new = {"status": F.when(F.col("_start"), "PROCESSING").otherwise(F.col("status"))}
    if "updated_at" in docs.columns:
        new["updated_at"] = F.when(F.col("_start"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return marked.withColumns(new).select(*docs.columns)


def written_back(docs: DataFrame, results: DataFrame, order: str = "at") -> DataFrame:
    """``docs`` with the six result columns of ``results`` (id, ..., error): DIGITIZED if there is text, else and on an error FAILED; rows
    without a result stay, the others have a new updated_at. Of several results of a row the last counts, as with patches."""
    columns = ("processed_file_path", "detected_language", "detected_script", "raw_text", "ocr_confidence", "extracted_data")
    named = [c for c in columns if c in docs.columns and c in results.columns]
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    r = _last(results.select("id", error.alias("_error"), *named, *[c for c in (order,) if c in results.columns]), order)
    r = r.select("id", F.lit(True).alias("_done"), "_error", *[F.col(c).alias(f"_new_{c}") for c in named])
    ok = F.col("_done").isNotNull() & F.col("_error").isNull()
    text = F.col("_new_raw_text") if "raw_text" in named else F.lit(None).cast("string")
    status = F.when(ok & (F.length(text) > 0), "DIGITIZED").when(F.col("_done").isNotNull(), "FAILED").otherwise(F.col("status"))
    new = {"status": status, **{c: F.when(ok, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in named}}
    if "updated_at" in docs.columns:
        new["updated_at"] = F.when(F.col("_done"), F.current_timestamp()).otherwise(F.col("updated_at"))
    return docs.join(r, "id", "left").withColumns(new).select(*docs.columns)


def served_path(processed: Column) -> Column:
    return F.when(processed & F.col("processed_file_path").isNotNull(), F.col("processed_file_path")).otherwise(F.col("file_path"))


def dashboard(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "DIGITIZED").alias("digitized"), F.count_if(F.col("status") == "PENDING").alias("pending"))


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(DASH))


def parcel_label(parcel: Column, survey: Column, survey_first: bool = False) -> Column:
    """The list shows the given parcel before the survey number that was read, the preview the other way round."""
    return _first(survey, parcel) if survey_first else _first(parcel, survey)


def place_label(district: Column, state: Column) -> Column:
    d, s = F.nullif(district, F.lit("")), F.nullif(state, F.lit(""))
    return F.when(d.isNotNull() & s.isNotNull(), F.concat(d, F.lit(", "), s)).when(d.isNotNull(), d).otherwise(DASH)


def location_label(read: Column, given: Column | None = None) -> Column:
    """A preview's village (which only the certificate has), district or state: what was read, else what was given."""
    return _first(read) if given is None else _first(read, given)


def has_extracted(certificate: Column) -> Column:
    return F.coalesce((F.size(certificate["owners"]) > 0) | certificate["survey_number"].isNotNull(), F.lit(False))


def owner_label(owners: Column) -> Column:
    return F.array_join(F.transform(owners, lambda o: o["name"]), ", ")


def confidence_bucket(confidence: Column) -> Column:
    """success from 80, warning from 50, else destructive; shares up to 1 count as per cent; null has none."""
    score = F.floor(F.when(confidence <= 1, confidence * 100).otherwise(confidence) + 0.5)
    return F.when(score >= 80, "success").when(score >= 50, "warning").when(score.isNotNull(), "destructive")


def verification_label(verification: Column, status: Column) -> Column:
    return F.coalesce(F.nullif(verification, F.lit("")), F.when(status == "DIGITIZED", "VERIFIED").otherwise("PENDING REVIEW"))


def issue_label(issued: Column, created_at: Column) -> Column:
    return F.coalesce(F.nullif(issued, F.lit("")), F.date_format(created_at, "yyyy-MM-dd"))


def number_label(value: Column) -> Column:
    """A double as a browser shows it: no decimals where there are none, plain digits from a millionth up to 1e21, beyond that a small e."""
    v = value.cast("double")
    plain = F.regexp_replace(v.cast("string").cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(v.cast("string"), r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return F.when(F.abs(v).between(1e-6, 1e20), plain).when(v == 0, "0").otherwise(short)


def area_label(value: Column, unit: Column) -> Column:
    """An area and its unit; one that isn't named is square units. No value, none and not a number have a dash."""
    return F.when((value != 0) & ~F.isnan(value), F.concat(number_label(value), F.lit(" "), F.coalesce(F.nullif(unit, F.lit("")), F.lit("sq. units")))).otherwise(DASH)
