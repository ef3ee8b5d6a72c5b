"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm import decontaminate, language, mixing, sharding, simhash
from terrier.llm.shared import stored
from terrier.session import ship

#: A document is rejected if no learned language codes it better than its plain bytes, or none is likelier than the rest together.
MOST_BITS_PER_BYTE = 8.0
LEAST_SCORE = 0.5
#: Ids up to which the documents to drop are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter (null and empty texts too), or like none of the languages, go. Equal rows share their fate."""
    ship(spark)
    got = language.predicted(docs, language.model_of(docs))
    told = (F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS_PER_BYTE) & (F.col("score") >= LEAST_SCORE)
    return got.filter(told).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row of smallest doc_id (null last; of rows that share it, the first). An empty table stays empty."""
    ship(spark)
    # numbered and written once, so that the rows dropped are those that were compared
    packed = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    prints = stored(simhash.with_fingerprints(packed.select("doc.doc_id", "doc.text", "row"), keep=("doc_id", "row")), "prints")
    keyed = prints.select(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row").alias("doc_id"), "fp")
    drop = stored(simhash.grouped(keyed).filter("doc_id.row != component_id.row").select(F.col("doc_id.row").alias("row")), "dropped")
    few = drop.count() <= BROADCAST_IDS
    kept = packed.join(F.broadcast(drop) if few else drop, "row", "left_anti")
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all, where that is empty."""
    ship(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix draws them: a row for each epoch that takes words of a document. Null sources are a source."""
    ship(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, rows with null ids and equal rows too."""
    return sharding.shards(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shard),
]

#: SQL can express neither the language models nor the mix's permutations; a test holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
