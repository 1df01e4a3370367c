"""Token counts without token ids.

Pre-tokens are counted over the whole corpus, and each distinct one is given to the tokenizer once, for its number of
pieces.  Documents then need their pre-tokens' frequencies alone: a document's tokens are the sum of frequency times
pieces.  The most frequent pre-tokens, a bounded number of them, are joined inside the scan as a broadcast table, so hot
words never move; the others, of which each document has few, are shuffled and joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import arrow_rows, id_text, stored
from levelground.llm.pretokens import ByteLevel

#: Pre-tokens of a task that are counted before they are handed on.
FLUSH = 1_000_000


def _count(path: str, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter, seen = ByteLevel(path), Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        seen.clear()
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["pretoken", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(splitter.split(text)[0])
            if len(seen) > FLUSH:
                yield from flush()
    yield from flush()


def _pieces(path: str, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = ByteLevel(path)
    for batch in batches:
        pieces = splitter.counts(batch.column("pretoken").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array(pieces, pa.int32())], ["pretoken", "n", "pieces"])


def _frequencies(path: str, head, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter, known = ByteLevel(path), head.value
    for batch in batches:
        n_bytes, sums, starts, tokens, times = [], [], [0], [], []
        for text in batch.column("text").to_pylist():
            pretokens, special = splitter.split(text)
            pieces = [known.get(t) for t in pretokens]
            rest = Counter([t for t, n in zip(pretokens, pieces) if n is None])
            sums.append(special + sum([n for n in pieces if n is not None]))
            tokens += rest
            times += rest.values()
            starts.append(len(tokens))
            n_bytes.append(len(text.encode()))
        tail = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int32())], ["pretoken", "n"])
        tail = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tail)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(sums, pa.int64()), tail], ["id", "n_bytes", "summed", "tail"])


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head: int = 1 << 19) -> DataFrame:
    """One row per row of docs: id, n_bytes (of UTF-8), n_tokens (long), over_limit (n_tokens > limit).

    tokenizer_path: a file of the tokenizers library with a byte-level BPE model.  No begin, end or padding is added;
    special strings inside a text are one token each.  Null or empty texts have 0 bytes and tokens; repeated rows give
    repeated rows; no rows give no rows; other columns are left out.

    head: the most pre-tokens that are broadcast (about 40 bytes each), whatever the corpus.
    """
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    distinct = arrow_rows(texts.select("text"), partial(_count, tokenizer_path), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    pieces = stored(arrow_rows(distinct, partial(_pieces, tokenizer_path), "pretoken string, n long, pieces int"), "pieces")

    # The lowest power of two such that at most `head` pre-tokens are as frequent: 63 rows reach the driver.
    least, running = 1 << 62, 0
    for power, number in sorted(pieces.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True):
        running += number
        if running > head:
            break
        least = 1 << power
    top = pieces.where(F.col("n") >= least).select("pretoken", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column("pretoken").to_pylist(), top.column("pieces").to_pylist())))

    kind = docs.schema[id_col].dataType.simpleString()
    per_row = arrow_rows(texts, partial(_frequencies, tokenizer_path, known), f"id {kind}, n_bytes long, summed long, tail array<struct<pretoken:string,n:int>>")
    per_row = stored(per_row.withColumn("rid", F.monotonically_increasing_id()), "frequencies")
    tail = per_row.select("rid", F.inline("tail")).withColumnRenamed("n", "times").join(pieces.where(F.col("n") < least).select("pretoken", "pieces"), "pretoken")
    tail = tail.groupBy("rid").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = per_row.select("rid", "id", "n_bytes", "summed").join(tail, "rid", "left").withColumn("n_tokens", F.col("summed") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
