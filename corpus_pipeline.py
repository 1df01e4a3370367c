"""From raw documents to packed training sequences: five operators, each on all that the one before kept.

Every stage but the last returns the columns of documents; each result is written as Parquet and read again.  Stages decide
row by row: rows get a number that is written with the stage's input, so doc_id may be repeated or null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelground.llm._common import stored
from levelground.llm.decontaminate import decontaminate
from levelground.llm.exact_dedup import exact_dedup
from levelground.llm.jaccard_join import jaccard_components
from levelground.llm.language import identify
from levelground.llm.packing import pack


#: Number of a row of a stage's input, and its language as found: names that no table has.
ROW, FOUND = "_stage_row", "_stage_language"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, written, so that all reads see the same numbers."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, gone: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Rows of docs whose ROW is not among those of gone, without ROW."""
    return docs.join(F.broadcast(gone) if gone.limit(limit + 1).count() <= limit else gone, ROW, "left_anti").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter, whose language is undetermined, and names the language of those that have none.

    Null and empty texts go, with whatever id; repeated rows are judged one by one; an empty table stays empty.  All
    columns pass through."""
    docs = _numbered(docs)
    found = stored(identify(docs, ROW).select(ROW, F.col("lang_pred").alias(FOUND)), "languages")
    unnamed = stored(found.where(f"{FOUND} <> 'und'").join(docs.where("lang IS NULL").select(ROW), ROW, "left_semi"), "unnamed")
    few = unnamed.limit(1_000_001).count() <= 1_000_000
    known = docs.join(F.broadcast(unnamed) if few else unnamed, ROW, "left").withColumn("lang", F.coalesce("lang", FOUND))
    return _without(known.drop(FOUND), stored(found.where(f"{FOUND} = 'und'").select(ROW), "no-language"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest id; null is less than any id.  Of repeated rows one stays; rows that
    share an id but not a text are judged apart; an empty table stays empty."""
    docs = _numbered(docs)
    found = exact_dedup(docs.withColumn("place", F.struct("doc_id", ROW)), id_col="place")
    return _without(docs, stored(found.where("NOT kept").select(f"place.{ROW}"), "copies"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four fifths of all runs of five words shared) one row stays, of the smallest id; null
    is larger than any id.  Null and wordless texts are near nothing and stay; repeated rows are equal texts; an empty
    table stays empty."""
    docs = _numbered(docs)
    found = jaccard_components(docs.withColumn("place", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", ROW)), id_col="place", k=5, percent=80)
    return _without(docs, stored(found.where("component_id <> place").select(f"place.{ROW}"), "near-copies"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.  Rows are judged by their texts, whatever their ids; null
    and wordless texts stay; an empty table, or an empty benchmark, changes nothing."""
    docs = _numbered(docs)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW)
    return _without(docs, stored(found.where("contaminated").select(ROW), "leaks"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.  Null and empty texts are an end mark alone; rows that share
    an id are packed each for itself; an empty table gives no pieces."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Language identification and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
