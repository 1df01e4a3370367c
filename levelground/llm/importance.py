"""Importance resampling towards a target distribution by hashed n-grams.

One scan of a document keeps a ring of running CRC states, one for each of the last n starts: a word opens a state, and
extends those already open by a space and itself, so that every run of 1 to n words gets its hash without being written
out.  The scan emits the runs' buckets.  Buckets are counted over the corpus and over the target, a bucket's gain is the
logarithm of the smoothed ratio of both, a document weighs as much as its features gain on average, and documents are drawn
without replacement by Gumbel noise added to their weights: the highest sums are the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import arrow_rows, id_text, stored

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of a-z (A-Z lower-cased first), 0-9 and characters beyond ASCII, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def run_hashes(of: list[bytes], n: int) -> list[int]:
    """CRC-32 of each run of 1 to n words joined by a space, by the run's last word, longest first."""
    if n == 1:
        return list(map(crc32, of))  # a ring of one start is never extended
    ring: list[int] = []
    out: list[int] = []
    for word in of:
        spaced = b" " + word
        ring = [crc32(spaced, state) for state in ring[max(0, len(ring) - n + 1) :]]
        ring.append(crc32(word))
        out += ring
    return out


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _scan(n: int, buckets: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, out = [], []
        for text in batch.column("text").to_pylist():
            of = words(text)
            n_words.append(len(of))
            out.append((np.array(run_hashes(of, n), np.int64) % buckets).astype(_kind(buckets)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(out, pa.binary())], ["id", "n_words", "buckets"])


def _counts(buckets: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task, one row for each bucket that it met."""
    seen = np.zeros(buckets, np.int64)
    for batch in batches:
        for own in batch.column("buckets"):
            seen += np.bincount(np.frombuffer(own.as_buffer(), _kind(buckets)), minlength=buckets)
    met = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(seen[met], pa.int64())], ["bucket", "n"])


def _weigh(buckets: int, gains, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number, weight = [], []
        for own in batch.column("buckets"):
            of = np.frombuffer(own.as_buffer(), _kind(buckets))
            number.append(len(of))
            weight.append(int(gains.value[of].sum()) // len(of) if len(of) else 0)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(number, pa.int64()), pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])


def feature_buckets(docs: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, buckets) of each row: the buckets of all features in order, little-endian, two bytes each (four where
    there are more than 65,536 buckets)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(arrow_rows(id_text(docs, id_col, text_col), partial(_scan, n, buckets), f"id {kind}, n_words long, buckets binary"), "features")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one number for each reaches the driver, however many rows there are."""
    found = arrow_rows(features.select("buckets"), partial(_counts, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's share to the corpus's, both smoothed by one in each bucket)."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank (long).

    Features are all runs of 1 to n words, repeats counted; those of docs and of target are counted whole.  Of the N rows
    with at least least_words words the floor(percent * N / 100) of highest score are drawn and ranked from 1; rank is
    null for all others.  Ties go to the smaller id, a null id counting as the largest (its noise is that of an empty
    string); of repeated rows each is drawn for itself.  Null and wordless texts have no features and weight 0.  An empty
    target leaves the smoothing alone; no rows give no rows; other columns are left out.

    One number for each bucket (a parameter) is collected and broadcast.
    """
    features = feature_buckets(docs, n, buckets, id_col, text_col)
    wanted = feature_buckets(target.select(F.lit(0).alias("item"), F.col(target_text_col).alias("text")), n, buckets, "item", "text")
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets)))
    weighed = arrow_rows(features, partial(_weigh, buckets, gains), f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise).withColumn("no", F.col("n_words") < least_words), "scored")

    # Ranges of the order, each sorted and numbered within; a row for each range tells where it begins.
    order = ["no", F.desc("score"), F.asc_nulls_last("id")]
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    begins, rows, eligible = [], 0, 0
    for own in sorted(placed.groupBy("range").agg(F.count("*").alias("n"), F.count_if(~F.col("no")).alias("yes")).collect()):
        begins.append((own["range"], rows))
        rows, eligible = rows + own["n"], eligible + own["yes"]
    starts = docs.sparkSession.createDataFrame(begins, "range long, start long")
    rank = F.col("start") + F.col("place") + 1
    out = placed.join(F.broadcast(starts), "range")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(rank <= eligible * percent // 100, rank).alias("rank"))


def op13_importance_resampling(spark, sf_dir):
    return importance_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 from its definition (reflected polynomial 0xEDB88320, a table for each byte), once for each distinct word.
SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entry FROM bits WHERE k = 8),
dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
d AS (SELECT doc_id, word, count(*) AS n FROM dw GROUP BY ALL),
b AS (SELECT word, count(*) AS n FROM bw GROUP BY ALL),
known AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM d UNION SELECT word FROM b)),
step AS (SELECT word, hx, 0 AS j, 4294967295 AS state FROM known
  UNION ALL SELECT word, hx, j + 1, xor(entry[1 + (xor(state, CAST('0x' || substr(hx, 2 * j + 1, 2) AS BIGINT)) & 255)], state >> 8) FROM step, crc WHERE 2 * j < length(hx)),
bucket AS (SELECT word, xor(state, 4294967295) % 10000 AS k FROM step WHERE 2 * j = length(hx)),
s AS (SELECT k, sum(n) AS s FROM d JOIN bucket USING (word) GROUP BY k),
t AS (SELECT k, sum(n) AS t FROM b JOIN bucket USING (word) GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
           / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (k)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM d JOIN bucket USING (word) JOIN gain USING (k) GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM a WHERE n_features >= 20)
SELECT a.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (doc_id)
"""
