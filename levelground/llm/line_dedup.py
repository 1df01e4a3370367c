"""Removal of repeated multi-line chunks, with boundaries that the lines themselves choose.

Lines are hashed, and a chunk ends after a line where the rolling hash over the last `window` line hashes is 0 modulo
`every` and that of the line before is not: lines put in or taken out shift no boundary but the next ones, and no chunk but a
text's last is a single line.  Chunks of at least `min_lines` lines are grouped by hash; those whose hash recurs are compared
byte by byte, and every occurrence of the same bytes but the first (by id, then place) goes, across documents and within one.
A passage rarely begins and ends at a boundary, so from each such occurrence lines go on going, to both sides, while they equal
those beside the first one: over the chunk next to it, and backward over `window` lines more.  That is all of an equal stretch:
boundaries that see only equal lines lie at the same places in both texts, so that a chunk between two of them is found itself.
Every line that goes has an equal one at an earlier place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.llm._common import BROADCAST_ROWS, col, semi, spread, stored


def _chunked(texts: DataFrame, window: int, every: int, hash_bits: int) -> DataFrame:
    """Adds lines and chunks: array of (at, first, n, h), first 1-based."""
    df = texts.withColumn("lines", F.split("text", "\n")).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    rolling = lambda h, i: F.xxhash64(*[F.get("hashes", i - back) for back in range(window - 1, 0, -1)], h)
    df = df.withColumn("hits", F.transform("hashes", lambda h, i: (i + 1 >= window) & (F.pmod(rolling(h, i), F.lit(every)) == 0)))
    ends = F.transform("hits", lambda hit, i: F.when((i + 1 == F.size("hits")) | (hit & ~F.coalesce(F.get("hits", i - 1), F.lit(False))), i + 1))
    df = df.withColumn("cuts", F.array_compact(ends))

    def chunk(end, i):
        first = F.coalesce(F.get("cuts", i - 1), F.lit(0)) + 1
        h = F.xxhash64(F.slice("hashes", first, end - first + 1))
        return F.struct(i.alias("at"), first.alias("first"), (end - first + 1).alias("n"), (F.shiftrightunsigned(h, 64 - hash_bits) if hash_bits < 64 else h).alias("h"))

    return df.withColumn("chunks", F.transform("cuts", chunk))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, every: int = 2, min_lines: int = 2, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed (lines), text (what is left, null where it was null).

    Lines end at a newline and are compared whole and unchanged; empty text is one empty line.  Chunks without any
    character but newlines stay, if no stretch beside them covers them.  A text of which all goes becomes empty.  Rows that share an id count as one after
    the other, in no given order, and null ids come first.  No rows give no rows; other columns are left out.

    window: line hashes in the rolling hash.  every: chunks have every^2 / (every - 1) lines on average.  min_lines: the
    shortest chunk that is removed.  hash_bits: lowered only by tests to force collisions.
    """
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("raw"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text")), 256)

    # Light rows: one per chunk of enough lines.  The key stands for (id, text); rows that share it are told apart by copy.
    cut = _chunked(texts, window, every, hash_bits).withColumn("key", key)
    long_ones = F.filter("chunks", lambda c: c["n"] >= min_lines)
    rows = stored(cut.select("id", "key", F.size("lines").alias("n_lines"), long_ones.alias("chunks")).withColumn("rid", F.monotonically_increasing_id()), "line-chunks")
    at = rows.select("id", "key", "rid", F.inline("chunks"))
    recurs = stored(at.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "recurring")

    # The bytes of recurring hashes.  A hash of one variant stands for its bytes; others are told apart by number.
    recurring_at = stored(at.join(recurs, "h", "left_semi"), "recurring-at")
    keyed = texts.withColumn("key", key).withColumn("brief", F.xxhash64("key"))
    keyed = semi(keyed, recurring_at.select(F.xxhash64("key").alias("brief")).distinct(), ["brief"])
    # inline over an expression: over a column Spark infers a filter, pushes it down and evaluates the lambdas anew per line
    with_bytes = _chunked(keyed, window, every, hash_bits).select("key", "lines", F.inline(F.filter("chunks", lambda c: c["n"] >= min_lines)))
    chunk_bytes = with_bytes.select("key", "at", "h", F.array_join(F.slice("lines", F.col("first"), F.col("n")), "\n").alias("chunk"))
    variants = chunk_bytes.select("h", "chunk").distinct()
    judged = stored(variants.join(recurs, "h", "left_semi").groupBy("h").agg(F.count("*").alias("variants"), F.max(F.length(F.translate("chunk", "\n", ""))).alias("chars")), "variants")
    several = judged.where("variants > 1")
    if several.limit(1).count():
        number = variants.join(several.select("h"), "h", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))).withColumn("chars", F.length(F.translate("chunk", "\n", "")))
        told = chunk_bytes.join(number, ["h", "chunk"]).select("key", "at", "h", "number", "chars").distinct()
        alone = recurring_at.join(judged.where("variants = 1"), "h").withColumn("number", F.lit(1)).select("id", "key", "rid", "at", "first", "n", "h", "number", "chars")
        same = alone.unionByName(recurring_at.join(told, ["key", "at", "h"]).select(*alone.columns))
    else:
        same = spread(recurring_at, "h").join(spread(judged, "h"), ["h", "_spread"]).withColumn("number", F.lit(1))
    same = same.where("chars > 0")

    # First occurrence by id, then row, then place, each as a plain minimum so that hash aggregation does it.
    first = same.groupBy("h", "number").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "rid", "at", "key")).alias("first_at"))
    gone = spread(same, "h", "number").join(spread(first, "h", "number"), ["h", "number", "_spread"]).where((F.col("rid") != F.col("first_at.rid")) | (F.col("at") != F.col("first_at.at")))
    gone = stored(gone.select("rid", "key", "at", "first", "n", F.col("first_at.key").alias("key0"), F.col("first_at.at").alias("at0")), "gone")
    every_chunk = _chunked(keyed, window, every, hash_bits)
    before = lambda c: F.slice("lines", F.greatest(c["first"] - window, F.lit(1)), F.least(c["first"] - 1, F.lit(window)))
    pieces = F.transform("chunks", lambda c: F.struct(c["at"].alias("at"), F.slice("lines", c["first"], c["n"]).alias("piece"), before(c).alias("before")))
    beside = gone.select(F.explode(F.array(F.struct("key", (F.col("at") - 1).alias("at")), F.struct("key", (F.col("at") + 1).alias("at")), F.struct(F.col("key0").alias("key"), (F.col("at0") - 1).alias("at")), F.struct(F.col("key0").alias("key"), (F.col("at0") + 1).alias("at")))).alias("b")).select("b.*").distinct()
    pieces = stored(every_chunk.select("key", F.inline(pieces)).dropDuplicates(["key", "at"]).join(beside, ["key", "at"], "left_semi"), "beside")

    def beyond(step: int) -> DataFrame:
        met = F.col("piece") if step > 0 else F.reverse(F.concat("before", "piece"))  # nearest line first
        side = pieces.select("key", F.col("at").alias("_a"), met.alias("piece"))
        own = spread(gone.withColumn("_a", F.col("at") + step), "key", "_a").join(spread(side, "key", "_a"), ["key", "_a", "_spread"])
        other = side.select(F.col("key").alias("key0"), F.col("_a").alias("_a0"), F.col("piece").alias("piece0"))
        both = spread(own.drop("_spread").withColumn("_a0", F.col("at0") + step), "key0", "_a0").join(spread(other, "key0", "_a0"), ["key0", "_a0", "_spread"])
        unequal = F.array_position(F.zip_with("piece", "piece0", lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        more = F.when(unequal > 0, unequal - 1).otherwise(F.least(F.size("piece"), F.size("piece0")))
        return both.withColumn("more", more).where("more > 0").select("rid", (F.col("first") + F.col("n") if step > 0 else F.col("first") - F.col("more")).alias("first"), F.col("more").alias("n"))

    # stretches of one row may overlap: each line counts once
    gone = gone.select("rid", "first", "n").unionByName(beyond(-1)).unionByName(beyond(1))
    lines_gone = gone.select("rid", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("line")).distinct()
    cuts = lines_gone.groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("gone"), F.count("*").alias("n_removed"))
    # Only texts that lose lines move; all others pass through the scan, once it is known that the others are few.
    cuts = stored(cuts.join(rows.select("rid", "key", "n_lines"), "rid", "left"), "cuts")
    changed = stored(cuts.select(F.xxhash64("key").alias("brief")).distinct(), "changed")
    changed = F.broadcast(changed) if changed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else changed
    source = texts.withColumn("key", key).withColumn("brief", F.xxhash64("key"))
    same_text = source.join(changed, "brief", "left_anti")
    own = rows.select("rid", "key", "n_lines").withColumn("brief", F.xxhash64("key")).join(changed, "brief", "left_semi")
    per_row = own.join(cuts.select("rid", "gone", "n_removed"), "rid", "left")
    source = source.join(changed, "brief", "left_semi")
    repeated = bool(own.groupBy("key").count().where("count > 1").limit(1).count())
    per_row, source = (df.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(by)) if repeated else F.lit(1)) for df, by in ((per_row, "rid"), (source, "key")))
    joined = source.drop("brief").join(per_row.drop("brief"), ["key", "copy"])
    # what lies between one line that goes and the next, slice by slice, of lines that are split once
    prior = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(0))
    between = lambda lines: F.flatten(F.transform(F.concat("gone", F.array(F.size(lines) + 1)), lambda at, i: F.slice(lines, prior(i) + 1, at - prior(i) - 1)))
    kept = F.get(F.transform(F.array(F.split("text", "\n")), between), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("raw")).otherwise(F.array_join(kept, "\n"))
    columns = lambda n, removed, text: [F.col("id").alias(id_col), n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), text.alias(text_col)]
    whole = same_text.select(*columns(F.size(F.split("text", "\n")), F.lit(0), F.col("raw")))
    return whole.unionByName(joined.select(*columns(F.col("n_lines"), F.coalesce("n_removed", F.lit(0)), text)))


def op5_line_dedup(spark, sf_dir):
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
