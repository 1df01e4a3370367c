"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers' tokens cover a text's bytes without gaps.  The union of both arrays of end offsets cuts the bytes into
elementary intervals; an interval has one owner on either side, found by binary search of its end, so each interval is one
overlap of two tokens and no two intervals share a pair of tokens.  Ends that both sides have close groups; the pairs of a
group's tokens are the product of its sides, of which the overlaps are a part.  The arrays of many texts are handled as one,
since a text's end is an end on both sides.

How often a pair of ids is linked is counted in documents over the whole corpus: distinct pairs of each document are counted
in the tasks and summed by pair.  The most frequent pairs, a bounded number of them, come back to the documents as a
broadcast table; the others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import arrow_rows, id_text, stored
from levelground.llm.pretokens import TOGETHER, ByteLevel, _Known

SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*")
#: Longest pre-token or chunk, in characters, whose ids are remembered.
SHORT = 64
#: Distinct pairs that a task counts before it hands them on.
FLUSH = 1_000_000


class _Ids:
    """Ids of a text as little-endian unsigned 32-bit bytes, by its parts; a part's ids are None if its tokens' bytes are not
    the part."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.token_bytes, self._known = token_bytes, _Known()
        self.lengths = np.array(list(map(len, token_bytes)), np.int64)

    def parts(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, parts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _checked(self, ids: list[int], part: str) -> bytes | None:
        same = b"".join([self.token_bytes[i] for i in ids]) == part.encode("utf-8", "surrogatepass")
        return struct.pack(f"<{len(ids)}I", *ids) if same else None

    def of(self, texts: list[str]) -> list[bytes | None]:
        """Of each text its ids, or None if their bytes are not the text's.  Where a part fails, the whole text decides."""
        known, out, holes, new = self._known, [], [], {}
        for text in texts:
            parts = self.parts(text)
            found = list(map(known.get, parts))
            if None in found:
                empty = [(i, parts[i]) for i, ids in enumerate(found) if ids is None]
                new.update(dict.fromkeys([p for _, p in empty]))
                holes.append((len(out), empty))
            out.append(found)
        if new:
            known.room(len(new))
            new = {p: known.again(p) for p in new}
            unknown = [p for p, ids in new.items() if ids is None]
            for p, ids in zip(unknown, self.encode(unknown)):
                new[p] = ids = self._checked(ids, p)
                if ids is not None and len(p) <= SHORT:
                    known[p] = ids
            for at, empty in holes:
                for i, p in empty:
                    out[at][i] = new[p]
                if None in out[at]:
                    out[at] = [self._checked(self.whole(texts[at]), texts[at])]
        return [None if found[:1] == [None] else b"".join(found) for found in out]


class ByteTokens(_Ids):
    """Of a byte-level BPE file of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str) -> None:
        self._level = ByteLevel(path)
        self._level.special, self._library = [], self._level.library
        self._library.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = self._library.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(tokens)

    def parts(self, text: str) -> list[str]:
        return self._level.split(text)[0]

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(parts, add_special_tokens=False)]

    def whole(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids


class PieceTokens(_Ids):
    """Of a sentencepiece model that adds a space in front; texts given here begin with that space.

    No piece may hold a space behind another character, as none of the vocabularies cut at white space does; a chunk of
    spaces and what follows then has the same pieces alone as in its text.  Other models go over whole texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self._apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self._lead = len(self._model.encode("x"))
        super().__init__([bytes([int(p[3:-1], 16)]) if self._model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])

    def parts(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if self._apart else [text]

    def encode(self, parts: list[str]) -> list[list[int]]:
        if self._apart:  # behind a letter, so that a chunk of spaces alone is not taken for an empty text
            return [ids[self._lead :] for ids in self._model.encode(["x" + p for p in parts], num_threads=1)]
        return [self.whole(p) for p in parts]

    def whole(self, text: str) -> list[int]:
        return self._model.encode(text[1:])


@lru_cache(maxsize=1)
def _sides(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    """Made once in a worker, whose later tasks find what earlier ones learned."""
    return ByteTokens(a_path), PieceTokens(b_path)


class Aligned(NamedTuple):
    """Tokens of several texts in turn: ids of either side, the token of either side that owns each interval, the group of
    each token, and where each text's tokens, groups and intervals stop."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    stop_a: np.ndarray
    stop_b: np.ndarray
    stop_groups: np.ndarray
    stop_links: np.ndarray


def align(a: list[bytes], b: list[bytes], a_lengths: np.ndarray, b_lengths: np.ndarray) -> Aligned:
    """a, b: ids of each text; *_lengths: bytes of each id's token.  Both sides of a text have as many bytes."""
    stop_a, stop_b = (np.cumsum([len(x) // 4 for x in side], dtype=np.int64) for side in (a, b))
    a_ids, b_ids = (np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in (a, b))
    end_a, end_b = np.cumsum(a_lengths[a_ids]), np.cumsum(b_lengths[b_ids])
    both = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # merges what is sorted already
    again = both[1:] == both[:-1]
    shared, ends = both[1:][again], both[np.append(True, ~again)[: len(both)]]
    stops = np.concatenate([[0], end_a])[stop_a]  # in bytes
    return Aligned(
        a_ids, b_ids, np.searchsorted(end_a, ends), np.searchsorted(end_b, ends), np.searchsorted(shared, end_a), np.searchsorted(shared, end_b),
        stop_a, stop_b, np.searchsorted(shared, stops, "right"), np.searchsorted(ends, stops, "right"),
    )


def products(x: Aligned) -> np.ndarray:
    """Of each group, how many pairs its sides' product holds."""
    n = int(x.stop_groups[-1]) if len(x.stop_groups) else 0
    return np.bincount(x.group_a, minlength=n) * np.bincount(x.group_b, minlength=n)


def group_texts(x: Aligned, a_names: np.ndarray, b_names: np.ndarray) -> list[bytes]:
    """Of each text `a1,a2|b1;a3|b2,b3`.  *_names: of each id, its number with the mark behind it inside a group, and with
    the mark behind its group's last token."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True).astype(np.int64) if len(g) else np.zeros(0, np.int64) for g in (x.group_a, x.group_b))
    out = np.empty(len(x.a) + len(x.b), object)
    out[np.arange(len(x.a)) + np.searchsorted(x.group_b, x.group_a)] = a_names[2 * x.a + last_a]
    out[np.arange(len(x.b)) + np.searchsorted(x.group_a, x.group_b, "right")] = b_names[2 * x.b + last_b]
    stops = (x.stop_a + x.stop_b).tolist()
    return [b"".join(out[start:stop].tolist())[:-1] for start, stop in zip([0, *stops], stops)]


def _names(n: int, inside: str, behind: str) -> np.ndarray:
    out = np.empty(2 * n, object)
    out[0::2], out[1::2] = [f"{i}{inside}".encode() for i in range(n)], [f"{i}{behind}".encode() for i in range(n)]
    return out


def _texts(a_path: str, b_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """(ids of rows, both sides' tokens) of some million characters of text at a time; without tokens both are empty."""
    sides = _sides(a_path, b_path)
    for batch in batches:
        texts, start, size = batch.column("text").to_pylist(), 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > TOGETHER or i + 1 == len(texts):
                spaced = [" " + t for t in texts[start : i + 1]]
                a, b = (side.of(spaced) for side in sides)
                none = [x is None or y is None or len(t) == 1 for x, y, t in zip(a, b, spaced)]
                yield batch.column("id").slice(start, len(spaced)), *([b"" if no else x for x, no in zip(side, none)] for side in (a, b))
                start, size = i + 1, 0


def _spans(stops: np.ndarray) -> np.ndarray:
    return np.diff(stops, prepend=0)


def _summaries(a_path: str, b_path: str, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a_side, b_side = _sides(a_path, b_path)
    a_names, b_names, n_b = _names(len(a_side.lengths), ",", "|"), _names(len(b_side.lengths), ",", ";"), len(b_side.lengths)
    room = len(a_side.lengths) * n_b
    for ids, a, b in _texts(a_path, b_path, batches):
        x = align(a, b, a_side.lengths, b_side.lengths)
        text = np.repeat(np.arange(len(a)), _spans(x.stop_links))
        pairs, times = np.unique(text * room + x.a[x.link_a] * n_b + x.b[x.link_b], return_counts=True)
        stops = np.searchsorted(pairs, (np.arange(len(a)) + 1) * room)
        pairs, times = (pairs % room).astype("<u4" if room <= 1 << 32 else "<u8"), times.astype("<u4")
        both = [(pairs[s:e].tobytes(), times[s:e].tobytes()) for s, e in zip([0, *stops.tolist()], stops.tolist())]
        many = _spans(np.concatenate([[0], np.cumsum(products(x))])[x.stop_groups])
        sha = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, a_names, b_names)]
        columns = [_spans(x.stop_a), _spans(x.stop_b), _spans(x.stop_groups), _spans(x.stop_links), many]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in columns], pa.array(sha), pa.array([p for p, _ in both], pa.binary()), pa.array([t for _, t in both], pa.binary())], ["id", "n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256", "pairs", "times"])


def _tokens(a_path: str, b_path: str, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a_side, b_side = _sides(a_path, b_path)
    for ids, a, b in _texts(a_path, b_path, batches):
        x = align(a, b, a_side.lengths, b_side.lengths)
        own = lambda values, stops, first: pa.ListArray.from_arrays(pa.array([0, *stops], pa.int32()), pa.array(values - np.repeat(first, _spans(stops)), pa.int32()))
        none, starts = np.zeros(len(a), np.int64), lambda stops: stops - _spans(stops)
        yield pa.RecordBatch.from_arrays([
            ids, own(x.a, x.stop_a, none), own(x.b, x.stop_b, none), own(x.group_a, x.stop_a, starts(x.stop_groups)), own(x.group_b, x.stop_b, starts(x.stop_groups)),
            own(x.link_a, x.stop_links, starts(x.stop_a)), own(x.link_b, x.stop_links, starts(x.stop_b)),
        ], ["id", "a", "b", "group_a", "group_b", "link_a", "link_b"])


def _pair_kind(room: int) -> str:
    return "<u4" if room <= 1 << 32 else "<u8"


def _count_pairs(kind: str, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, number, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([seen, *waiting]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([number, np.ones(size)])).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(seen), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[i : i + 100_000]), pa.array(number[i : i + 100_000])], ["pair", "n"])

    for batch in batches:
        for own in batch.column("pairs"):
            waiting.append(np.frombuffer(own.as_buffer(), kind).astype(np.int64))
            size += len(waiting[-1])
        if size > FLUSH:
            seen, number = merged()
            waiting, size = [], 0
            if len(seen) > FLUSH:
                yield from rows()
                seen, number = np.empty(0, np.int64), np.empty(0, np.int64)
    seen, number = merged()
    yield from rows()


def _look_up(kind: str, head, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, number, best = head.value
    for batch in batches:
        n_best, sums, starts, rest, rest_times = [], [], [0], [], []
        for pairs, times in zip(batch.column("pairs"), batch.column("times")):
            pairs, times = np.frombuffer(pairs.as_buffer(), kind).astype(np.int64), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1) if len(known) else np.zeros(len(pairs), np.int64)
            there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums.append(int((number[at[there]] * times[there]).sum()))
            n_best.append(int(times[there][best[at[there]]].sum()))
            rest.append(pairs[~there])
            rest_times.append(times[~there])
            starts.append(starts[-1] + len(rest[-1]))
        tail = pa.StructArray.from_arrays([pa.array(np.concatenate(rest), pa.int64()), pa.array(np.concatenate(rest_times), pa.int64())], ["pair", "times"])
        tail = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tail)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), tail], ["rid", "n_best", "count_sum", "tail"])


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, a, b (ids of the space in front and the text), group_a, group_b (each token's group, from
    0), link_a, link_b (each overlap's tokens, by place): arrays of int.  Texts without tokens have empty arrays."""
    lists = ", ".join(f"{c} array<int>" for c in ("a", "b", "group_a", "group_b", "link_a", "link_b"))
    out = arrow_rows(id_text(docs, id_col, text_col), partial(_tokens, a_path, b_path), f"id {docs.schema[id_col].dataType.simpleString()}, {lists}")
    return out.withColumnRenamed("id", id_col)


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = 1 << 19) -> DataFrame:
    """One row per row of docs: id, n_a, n_b (tokens), n_groups, n_links (overlaps), n_products (pairs of tokens of one group),
    n_best (links whose pair of ids is in as many documents as any pair of its a id), count_sum (over links, documents that
    hold the pair linked): long; groups_sha256.

    a_path: a byte-level BPE file of the tokenizers library; b_path: a sentencepiece model that adds a space in front.
    Special strings are plain text.  Null and empty texts, and texts that the tokens' bytes do not give back, have no
    tokens: zeros and an empty groups_sha256.  A document is a row: repeated rows count each for itself.  No rows give no
    rows; other columns are left out.

    head: the most pairs that are broadcast (17 bytes each), whatever the corpus.  Of the a ids, one number each is broadcast.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    a_side, b_side = _sides(a_path, b_path)
    n_b = len(b_side.lengths)
    pair_kind = _pair_kind(len(a_side.lengths) * n_b)
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, pairs binary, times binary"
    per_row = arrow_rows(id_text(docs, id_col, text_col), partial(_summaries, a_path, b_path), schema)
    per_row = stored(per_row.withColumn("rid", F.monotonically_increasing_id()), "alignments")

    counts = arrow_rows(per_row.select("pairs"), partial(_count_pairs, pair_kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {n_b}")), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    counts = stored(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")

    # The lowest power of two such that at most `head` pairs are as frequent: 63 rows reach the driver.
    least, running = 1 << 62, 0
    for power, number in sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True):
        running += number
        if running > head:
            break
        least = 1 << power
    top = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("pair", "n", "best")))

    found = stored(arrow_rows(per_row.select("rid", "pairs", "times"), partial(_look_up, pair_kind, known), "rid long, n_best long, count_sum long, tail array<struct<pair:long,times:long>>"), "looked-up")
    tail = found.select("rid", F.inline("tail")).join(counts.where(F.col("n") < least), "pair")
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    out = per_row.drop("pairs", "times").join(found.drop("tail"), "rid").join(tail, "rid", "left")
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256", "n_products")


def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
