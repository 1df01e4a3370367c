"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most `size` tokens, and only the number of pieces of each length goes to the driver: at
most `size` rows, whatever the corpus.  Best-fit decreasing runs on these counts, moving whole groups of equal bins at
once, and gives runs of slots: so many pieces of one length, to so many sequences from a number on, at one offset.  Each
piece takes the slot of its rank among the pieces of its length.  Ranks come from the rank within the task that made
the piece and the number of such pieces in the tasks before, so no length is ever gathered in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.llm._common import arrow_rows, id_text, stored
from levelground.llm.pretokens import word_level

#: Runs of slots that are broadcast (36 bytes each).
PLAN_ROWS = 200_000


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset) runs that place every piece.

    Best fit, longest first: all pieces of a length go to the bins with the least room that is enough.  Bins with the
    same room are kept as intervals of sequence numbers."""
    import bisect

    out = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> intervals (first sequence, number)
    order: list[int] = []  # rooms that have bins, ascending
    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                # as many pieces of this length as fit side by side, in as many new sequences as that takes
                per = size // length
                bins = -(-left // per)
                room, first = size, fresh
                fresh += bins
                for j in range(per):
                    n = min(left, bins)
                    if not n:
                        break
                    out.append((length, rank, n, first, length * j))
                    rank, left = rank + n, left - n
                    if n < bins:
                        _put(rooms, order, size - length * j, first + n, bins - n)
                    bins, room = n, size - length * (j + 1)
                _put(rooms, order, room, first, bins)
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            take = min(n, left)
            out.append((length, rank, take, first, size - room))
            rank, left = rank + take, left - take
            _put(rooms, order, room - length, first, take)
            _put(rooms, order, room, first + take, n - take)
    return out


def _put(rooms: dict, order: list[int], room: int, first: int, n: int) -> None:
    import bisect

    if n and room:
        if room not in rooms:
            bisect.insort(order, room)
            rooms[room] = []
        rooms[room].append((first, n))


def _pieces(path: str, size: int, end_id: int, with_ids: bool, task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, ranks, end = word_level(path), Counter(), end_id.to_bytes(4, "little")
    for batch in batches:
        out = {n: [] for n in ("id", "piece", "start", "length", "crc", "task", "local", "ids")}
        for doc, ids in zip(batch.column("id").to_pylist(), words.ids(batch.column("text").to_pylist())):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                n = len(part) // 4
                for name, value in zip(out, (doc, piece, at // 4, n, zlib.crc32(part), task, ranks[n], part if with_ids else None)):
                    out[name].append(value)
                ranks[n] += 1
        kinds = (batch.column("id").type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 1, with_ids: bool = False, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """One row per piece: id, piece (int), start, length, ids_crc32, sequence_id, offset (long), and ids (little-endian
    unsigned 32-bit) if with_ids.

    A document's tokens are its text's, without special ones added, and end_id.  Documents over size tokens are cut
    into pieces of size, the last one shorter if need be; a null or empty text is end_id alone.  A sequence's pieces
    follow each other from 0 without gaps.  Rows that share an id are documents of their own; no rows give no rows;
    other columns are left out.

    plan_rows: runs of slots that may be broadcast; more are joined by a shuffle.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = id_text(docs, id_col, text_col)
    made = arrow_rows(texts, partial(_pieces, tokenizer_path, size, end_id, with_ids), f"id {kind}, piece int, start long, length int, crc long, task int, local long, ids binary")
    pieces = stored(made, "pieces")
    per_task = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    slots = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in runs], pa.int32() if i == 0 else pa.int64()) for i, n in enumerate(("length", "first", "number", "sequence", "offset"))})) if runs else spark.createDataFrame([], "length int, first long, number long, sequence long, offset long")
    ranked = pieces.join(ranks, ["length", "task"]).withColumn("rank", F.col("before") + F.col("local"))
    slots = F.broadcast(slots) if len(runs) <= plan_rows else slots
    out = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number"))).drop(slots["length"])
    columns = [F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"]
    return out.select(*columns, *["ids"] * with_ids)


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
