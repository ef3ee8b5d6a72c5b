"""Files as a source: type checks, stable names, and the table of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrier.functions.values import FILE_TYPES, MOST_FILE_BYTES, OTHER_EXTENSIONS

#: What a certificate holds, as ``operators.extract.certificates`` makes it.
CERTIFICATE = """STRUCT<owners: ARRAY<STRUCT<name: STRING, relation: STRING, guardian_name: STRING, raw: STRING, confidence: DOUBLE>>,
survey_number: STRUCT<value: STRING, raw: STRING, confidence: DOUBLE, source: STRING>, khata_number: STRUCT<value: STRING, raw: STRING, confidence: DOUBLE, source: STRING>,
area_extent: STRUCT<raw: STRING, value: DOUBLE, unit: STRING, sq_meters: DOUBLE, confidence: DOUBLE>,
registration_date: STRUCT<value: STRING, raw: STRING, confidence: DOUBLE>, issue_date: STRUCT<value: STRING, raw: STRING, confidence: DOUBLE>,
location: STRUCT<village: STRING, district: STRING, state: STRING>, document_type: STRING, detected_language: STRING, detected_script: STRING,
overall_confidence: DOUBLE, verification_status: STRING, extraction_engine: STRING>"""
TABLE_SCHEMA = f"""id BIGINT, title STRING, original_filename STRING, file_name STRING, file_path STRING, file_size BIGINT, mime_type STRING, document_type STRING,
parcel_identifier STRING, district STRING, state STRING, status STRING, processed_file_path STRING, detected_language STRING, detected_script STRING, raw_text STRING,
ocr_confidence DOUBLE, extracted_data {CERTIFICATE}, created_at TIMESTAMP, updated_at TIMESTAMP"""


def table_schema() -> StructType:
    return StructType.fromDDL(TABLE_SCHEMA)


def extension(name: Column) -> Column:
    """The lower-case ending of a file's name with its dot; none for names that only begin with one."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def accepted_type(mime: Column, name: Column) -> Column:
    """The file's type if it is taken: its own, else the one of its ending; null if neither is."""
    low, ext = F.lower(F.coalesce(mime, F.lit(""))), extension(F.coalesce(name, F.lit("")))
    by_ending = F.lit(None).cast("string")
    for end, m in [*((e, m) for m, e in FILE_TYPES.items()), *OTHER_EXTENSIONS.items()]:
        by_ending = F.when(ext == end, m).otherwise(by_ending)
    return F.when(low.isin(list(FILE_TYPES)), low).otherwise(by_ending)


def stored_name(content_hash: Column, mime: Column, name: Column) -> Column:
    """A name from the content, so loading a file again gives the same one."""
    ending = F.lit("")
    for m, e in FILE_TYPES.items():
        ending = F.when(mime == m, e).otherwise(ending)
    return F.concat(content_hash, F.coalesce(F.nullif(extension(name), F.lit("")), ending))


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files under ``path``: up to 50 MB and of a type that is taken, and the rest with the reason."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumns({"original_filename": name, "mime_type": accepted_type(F.lit(None).cast("string"), name)})
    reason = F.when(F.col("length") > MOST_FILE_BYTES, "too large").when(F.col("mime_type").isNull(), "unsupported type")
    accepted = files.filter(reason.isNull()).withColumn("file_name", stored_name(F.sha2("content", 256), F.col("mime_type"), F.col("original_filename")))
    return accepted.withColumnsRenamed({"path": "file_path", "length": "file_size"}), files.drop("content").withColumn("reason", reason).filter("reason is not null")


def create_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TABLE_SCHEMA}) USING parquet")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
