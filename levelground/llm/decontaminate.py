"""Benchmark decontamination by winnowing.

Words are hashed in k-grams, and of every `window - k + 1` consecutive k-grams the least hash is a fingerprint: two texts
that share `window` words share the fingerprint of that stretch.  One pass over the documents writes their numbers of
words and fingerprints; fingerprints are joined with those of items.  Only documents with a hit are read again: each hit
is extended word by word to both sides, and a stretch of at least `window` equal words around it is a hit of all its
words.  A window of shared words has a fingerprint inside it, so every one is found and every one is verified.  Items
shorter than a window are looked up by the longest run of 1, 2, 4, 8... words at their beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import BROADCAST_ROWS, col, id_text, semi, spread, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after A-Z were lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: str) -> Column:
    """A-Z in lower case and nothing else changed; the fast lower() where it does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.array_remove(F.split(lower_ascii("text"), GAP), ""))


def _prints(df: DataFrame, k: int, window: int, short: set[int], keep: list[str]) -> DataFrame:
    """(keep..., n_words, at, k, h), at 0-based: winnowed k-grams of texts of a window or more, and all m-grams for the m in
    short, with -m for k.  The first word of each text has a row in any case, with a null for h if need be, and so has a
    text without words, with a null for at.

    A gram is the leftmost least of some window if the grams next to it that are not less, those before it greater, make a
    window with it.  Texts become rows of one word and its neighbours' hashes, all in generated code; only the hashes
    of words are made in a lambda."""
    runs = window - k + 1
    df = df.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # an outer explode, as for a plain one Spark infers a filter that evaluates the lambda anew
    df = df.select(*keep, "n_words", "hashes", F.posexplode_outer("hashes").alias("at", "_own"))
    near = {j: F.coalesce(F.get("hashes", F.col("at") + j), F.lit(0)).alias(f"_h{j}") for j in range(1 - runs, window)}
    gram = lambda m, i: F.xxhash64(*[F.col(f"_h{i + j}") for j in range(m)])
    df = df.select(*keep, "n_words", "at", *near.values())
    # a column that is not deterministic: no filter on it is pushed below it, where all these expressions would be repeated
    df = df.withColumn("_gram", F.when(F.monotonically_increasing_id() >= 0, gram(k, 0)).otherwise(0))
    left, right = F.lit(0), F.lit(0)
    for j in reversed(range(1, runs)):
        left = F.when((F.col("at") >= j) & (gram(k, -j) > F.col("_gram")), left + 1).otherwise(0)
        right = F.when((F.col("at") + j + k <= F.col("n_words")) & (gram(k, j) >= F.col("_gram")), right + 1).otherwise(0)
    picked = (F.col("at") + k <= F.col("n_words")) & (left + right + 1 >= runs)
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    own = [*keep, "n_words", "at"]
    if not short:
        return df.where(picked | first).select(*own, F.lit(k).alias("k"), F.when(picked, F.col("_gram")).alias("h"))
    sizes = F.array(F.struct(F.lit(k).alias("k"), F.when(picked, F.col("_gram")).alias("h")), *[F.struct(F.lit(-m).alias("k"), F.when(F.col("at") + m <= F.col("n_words"), gram(m, 0)).alias("h")) for m in sorted(short)])
    out = df.select(*own, F.inline(sizes))
    return out.where(F.col("h").isNotNull() | (first & (F.col("k") == k)))


def _key(df: DataFrame) -> DataFrame:
    """Adds key and check, which stand for (id, text): 96 bits of hashes and the length."""
    own = F.coalesce(F.col("id").cast("string"), F.lit("\x00"))
    return df.withColumns({"key": F.xxhash64(own, F.col("id").isNull(), "text"), "check": F.hash("text", own).cast("long") * (1 << 31) + F.length("text")})


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, k: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, key, check, n_words) of docs, and stretches (key, check, item, first, last): document words, 0-based and
    inclusive, that windows of items cover.  item is the item's id as text, null where it has none."""
    items = id_text(benchmark, item_col, item_text_col).select(F.col("id").cast("string").alias("item"), "text").distinct()
    items = _words(items).where(F.size("words") > 0).drop("text")
    items = stored(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    sizes = items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect()  # window - 1 numbers at most
    short = {1 << (r.n.bit_length() - 1) for r in sizes}
    prints = _prints(items, k, window, short, ["item_key", "item"]).where("h IS NOT NULL")
    head = F.expr("shiftleft(1, cast(floor(log2(n_words)) as int))")  # words of a short item that are looked up
    prints = prints.where(F.when(F.col("n_words") < window, (F.col("at") == 0) & (F.col("k") == -head)).otherwise(F.col("k") == k))
    around = prints.join(items.select("item_key", "words"), "item_key")
    reach = window - k
    around = around.select("item_key", "item", F.col("n_words").alias("n_item"), "k", "h", *_around("words", F.col("at"), reach, window, "item_"))
    bench = stored(around, "item-prints")
    wanted = stored(bench.select("h", "k").distinct(), "wanted-prints")

    # One pass: a row for each document, and one for each fingerprint (for each that an item has, too, if these are few).
    texts = _key(id_text(docs, id_col, text_col))
    found = _prints(_words(texts).drop("text"), k, window, short, ["id", "key", "check"])
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    if small := wanted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = found.join(F.broadcast(wanted.withColumn("known", F.lit(True))), ["h", "k"], "left").where(F.col("known") | first)
        found = found.withColumn("h", F.when(F.col("known"), F.col("h")))
    found = stored(found.select("id", "key", "check", "n_words", "at", "k", "h"), "prints")
    rows = found.where(first & (F.col("k") == k)).select("id", "key", "check", "n_words")
    met = found.where("h IS NOT NULL").select("key", "check", "at", "k", "h").distinct()
    if not small:
        met = spread(met, "h", "k").join(spread(wanted, "h", "k"), ["h", "k", "_spread"], "left_semi").drop("_spread")
    met = stored(met, "hits")

    # only texts with a hit are split into words again, and each hit takes the few words around it along
    places = met.groupBy("key", "check").agg(F.collect_list(F.struct("k", "at", "h")).alias("places"))
    hit = _words(semi(texts, met.select("key").distinct(), ["key"]).dropDuplicates(["key", "check"])).select("key", "check", "words")
    near = hit.join(places, ["key", "check"]).select("key", "check", F.inline(F.transform("places", lambda p: F.struct(p["k"].alias("k"), p["at"].alias("at"), p["h"].alias("h"), *_around("words", p["at"], reach, window, "")))))
    # a word stretch that a third of all documents share is the same few words: compared once for each item it meets
    sides = ["h", "k", "before", "after"]
    kinds = stored(near.select(*sides, "key", "check", "at"), "around")
    distinct = kinds.select(*sides).distinct()
    pairs = distinct.join(F.broadcast(bench), ["h", "k"]) if bench.limit(broadcast_rows // 16 + 1).count() <= broadcast_rows // 16 else distinct.join(bench, ["h", "k"])

    def run(x: Column, y: Column) -> Column:
        unequal = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        return F.when(unequal > 0, unequal - 1).otherwise(F.least(F.size(x), F.size(y)))

    pairs = pairs.withColumn("left", run(F.reverse("before"), F.reverse("item_before"))).withColumn("right", run(F.col("after"), F.col("item_after")))
    need = F.least(F.lit(window), F.col("n_item"))
    # what stands after the place of the gram begins with the gram itself, which must be equal
    true = pairs.where((F.col("right") >= F.abs("k")) & (F.col("left") + F.col("right") >= need)).select(*sides, "item", "left", "right").distinct()
    stretches = spread(kinds, "h").join(spread(true, "h"), [*sides, "_spread"])
    return rows.select("id", "key", "check", "n_words"), stretches.select("key", "check", "item", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right") - 1).alias("last"))


def _around(words: str, at: Column, reach: int, window: int, prefix: str) -> list[Column]:
    before, after = F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach))), F.slice(words, at + 1, F.lit(window))
    return [before.alias(f"{prefix}before"), after.alias(f"{prefix}after")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, broadcast_rows: int = BROADCAST_ROWS // 4) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items (long), items_sha256, contaminated.

    Words are runs of a-z (A-Z lower-cased first), 0-9 and characters beyond ASCII.  Null or wordless texts and items
    have no words and no hits; of repeated items each id counts once, and hits of an item whose id is null count as
    hits but not as items.  Repeated rows of docs give repeated rows.  An empty benchmark leaves all clean; other
    columns are left out.

    Distinct fingerprints of items (16 bytes each) are broadcast if they number at most broadcast_rows, and shuffled
    otherwise; the result is the same.
    """
    rows, hits = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, k, broadcast_rows)
    hits = stored(hits, "stretches")
    both = ["key", "check"]
    covered = hits.select(*both, "first", "last").distinct().select(*both, F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy(*both).agg(F.count("*").alias("n_hit"))
    items = hits.select(*both, "item").distinct().groupBy(*both).agg(F.collect_list("item").alias("items"))  # no nulls
    out = rows.join(covered.join(items, both), both, "left").withColumn("items", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw USING (m, s)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
