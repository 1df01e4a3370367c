"""Exact deduplication by content-defined chunk recipes.

A text is cut after a word where the hash of the word and the one before it is 0 modulo `every`: boundaries depend on
content alone, so equal texts get equal chunks.  A text's recipe is the ordered list of its chunks' hashes.  Only
recipes, a few longs each, travel.  Texts whose recipe occurs once are unique; of the others the chunks are
deduplicated by their bytes: a hash that stands for one chunk only is a verified identifier, and the chunks of a hash
that stands for several get a number each, which joins the recipe.  Texts are then equal when, and only when, their
ordered lists of verified identifiers are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.llm._common import id_text, semi, spread, stored


def _cut(df: DataFrame, every: int) -> DataFrame:
    """Adds words, hashes (of words) and cuts (1-based numbers of the words that end a chunk)."""
    df = df.withColumn("words", F.split("text", " "))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    ends = F.transform("hashes", lambda h, i: F.when((i + 1 == F.size("hashes")) | (F.pmod(F.xxhash64(F.get("hashes", i - 1), h), F.lit(every)) == 0), i + 1))
    return df.withColumn("cuts", F.array_compact(ends))


def _over_chunks(of: Callable[[Column, Column], Column]) -> Column:
    """of(first word, number of words) for each chunk."""

    def chunk(end: Column, i: Column) -> Column:
        start = F.coalesce(F.get("cuts", i - 1), F.lit(0))
        return of(start + 1, end - start)

    return F.transform("cuts", chunk)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 128, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when all their characters are; null counts as empty.  Of equal texts the row with the largest id
    stays, null being less than any id; of rows that share that id too, exactly one.  keep_id is the id of the row
    that stays (null if all ids of the group are).  No rows give no rows; other columns are left out.

    every: words per chunk on average.  hash_bits: bits kept of a chunk's hash, lowered only by tests to force
    collisions.
    """
    texts = id_text(docs, id_col, text_col)

    def hashed(chunk: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(chunk), 64 - hash_bits) if hash_bits < 64 else F.xxhash64(chunk)

    recipe = _over_chunks(lambda first, n: hashed(F.slice("hashes", first, n)))
    light = _cut(texts, every).select("id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("tkey"), F.octet_length("text").alias("n"), recipe.alias("recipe"))
    light = stored(light.withColumn("rid", F.monotonically_increasing_id()).withColumn("rkey", F.xxhash64("recipe")), "recipes")

    # Texts whose recipe occurs again, and the bytes of their chunks.
    again = light.groupBy("rkey", "n").agg(F.count("*").alias("c"), F.min("tkey").alias("low"), F.max("tkey").alias("high")).where("c > 1")
    of_again = again.select(F.col("low").alias("tkey")).union(again.where("low <> high").select("high"))
    # between low and high there may be more texts with one recipe; then all texts of the recipe are taken
    more = spread(light, "rkey", "n").join(spread(again.where("low <> high"), "rkey", "n").select("rkey", "n", "_spread"), ["rkey", "n", "_spread"], "left_semi").select("tkey")
    wanted = stored(of_again.union(more).distinct(), "again")
    there = semi(texts.withColumn("tkey", F.xxhash64("text")), wanted, ["tkey"])
    chunks = F.arrays_zip(recipe.alias("h"), _over_chunks(lambda first, n: F.array_join(F.slice("words", first, n), " ")).alias("chunk"))
    cut = _cut(there, every)
    seen = cut.select(F.explode(chunks).alias("c")).select(F.col("c.h").alias("h"), F.col("c.chunk").alias("chunk")).distinct()
    several = stored(seen.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1").select("h"), "several")

    if several.limit(1).count():
        numbered = seen.join(several, "h", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        placed = cut.select("tkey", F.sha2("text", 256).alias("sha"), F.posexplode(chunks).alias("at", "c")).select("tkey", "sha", "at", F.col("c.h").alias("h"), F.col("c.chunk").alias("chunk"))
        placed = placed.join(several, "h", "left_semi").distinct().join(numbered, ["h", "chunk"])
        numbers = placed.groupBy("tkey", "sha").agg(F.sort_array(F.collect_list(F.struct("at", "number"))).alias("numbers"))
        light = light.join(numbers, ["tkey", "sha"], "left").withColumn("numbers", F.coalesce(F.to_json("numbers"), F.lit("")))
    else:
        light = light.withColumn("numbers", F.lit(""))

    keys = ["recipe", "numbers", "n"]
    groups = light.groupBy(*keys).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.max_by("rid", "id"), F.max("rid")).alias("keep_rid"))
    out = spread(light, *keys).join(spread(groups, *keys), [*keys, "_spread"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
