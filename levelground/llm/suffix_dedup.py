"""Removal of long byte strings that an earlier document has, by a sparse suffix array.

Every string of `length` bytes holds one anchor: of the hashes of its 24-byte runs the least, the leftmost among equals, which
the string alone decides.  So equal strings meet at their anchors, and a suffix array of anchors, one in some 14 bytes, finds
them all.  An anchor's record is its context: the bytes of all strings that chose it.

1. Of equal texts one goes on; the others are covered by it.
2. Anchors' hashes are dealt out to buckets as packed arrays; those that several texts have come back as places in each text.
3. The contexts of these anchors are range-partitioned by the suffix that begins at the anchor, with sampled splitters, and by
   document, so that a suffix that very many documents have takes several buckets.
4. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time, with NumPy's sort as the partitioning step of all
   open runs at once; then what stands before the anchor, nearest byte first.  Equal contexts are now neighbours, and the
   strings of an anchor that has several contexts are sorted in the same way.  The least document of each string is known.
5. Runs that may go on in the neighbouring bucket, its first and last, are compared across boundaries: each distinct string of
   them goes with its least document to a bucket of its own hash, and what was found smaller there comes back.

No hash decides: strings are equal when all their bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import BROADCAST_ROWS, arrow_rows, id_text, spread, stored

#: Bytes of an anchor's run.  Shorter ones leave fewer anchors, but meet by chance the more often the larger the corpus is.
RUN = 24
#: Texts are hashed in blocks of so many bytes, that the arrays stay in a core's cache.
BLOCK = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
#: Anchors that a task holds before it hands them on; rows of a batch; strings sorted at once; contexts of a bucket.
FLUSH, ROWS_OUT, STRINGS, CONTEXTS = 1_000_000, 50_000, 2_000_000, 200_000
#: Bytes of packed anchors or spans that are broadcast at most.
BROADCAST_BYTES = 32 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _block(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor in turn: its piece, the first string that chose it, how many strings did, its place, its hash."""
    size = np.array(list(map(len, pieces)), np.int64)
    stop, n = np.cumsum(size), int(size.sum())
    words = np.ndarray((n + RUN - 8,), "<u8", b"".join(pieces) + bytes(RUN), strides=(1,)).copy()
    hashes = np.zeros(n, np.uint64)
    for at in range(0, RUN, 8):
        hashes = _mixed(hashes + words[at : at + n])
    least = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, window = 1, length - RUN + 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & _PLACE).astype(np.int64)
    first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, stop - size)
    first = first[first < len(anchor)]
    piece = np.searchsorted(stop, first, "right")
    number = np.minimum(np.append(first[1:], n), stop[piece] - length + 1) - first
    first, piece, number = first[number > 0], piece[number > 0], number[number > 0]
    begin = (stop - size)[piece]
    return piece, first - begin, number, anchor[first] - begin, hashes[anchor[first]]


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first, number, place, hash, ordinal): each anchor's text, the start of the first of the strings that chose it, how
    many did, its own place, its hash, and which of its text's anchors it is."""
    pieces, size, found = [], 0, [tuple(np.zeros(0, kind) for kind in ("i8", "i8", "i8", "i8", "u8"))]

    def hashed() -> None:
        piece, first, number, place, hashes = _block([t for _, _, t in pieces], length)
        text, at = (np.array(x, np.int64)[piece] for x in ([i for i, _, _ in pieces], [s for _, s, _ in pieces]))
        found.append((text, first + at, number, place + at, hashes))
        pieces.clear()

    for i, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, BLOCK):  # each string of `length` bytes is in one piece
            pieces.append((i, start, text[start : start + BLOCK + length - 1]))
            size += len(pieces[-1][2])
            if size > BLOCK:
                hashed()
                size = 0
    if pieces:
        hashed()
    out = tuple(map(np.concatenate, zip(*found)))
    return *out, np.arange(len(out[0])) - np.searchsorted(out[0], out[0])


# Packed arrays: a row for each target and many values in it, one column's after the other's.

_HASHES = {"tag": "<u4", "rid": "<i8", "ordinal": "<i4"}  # rid and ordinal as differences
_SPANS = {"rid": "<i8", "start": "<i8", "stop": "<i8"}
_SMALLER = {"string": "<i4", "lowest": "<i8"}


def _string_kinds(length: int) -> dict[str, str]:
    return {f"w{level}": "<u8" for level in range((length + 7) // 8)} | _SMALLER


def _pack(kinds: dict[str, str], columns: dict[str, np.ndarray]) -> bytes:
    raw = b"".join([columns[c].astype(kind, copy=False).tobytes() for c, kind in kinds.items()])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(kinds: dict[str, str], blob: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), "zstd", asbytes=True)
    size = [np.dtype(kind).itemsize for kind in kinds.values()]
    n = len(raw) // sum(size)
    return {c: np.frombuffer(raw, kind, n, n * sum(size[:i])) for i, (c, kind) in enumerate(kinds.items())}


def _dealt(target: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns of each target that occurs, in the order given."""
    order = np.argsort(target, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(target[order]) != 0)) if len(order) else order
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        yield int(target[order[s]]), {name: c[order[s:e]] for name, c in columns.items()}


# Anchors that several texts have.


def _deal_hashes(buckets: int, length: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rid, ordinal, hashes = map(np.concatenate, zip(*held))
        held.clear()
        hashes = _mixed(hashes)  # the least of several hashes are small
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        rows = [(b, _pack(_HASHES, own | {c: np.diff(own[c], prepend=0) for c in ("rid", "ordinal")})) for b, own in _dealt(bucket, tag=hashes.astype(np.uint32), rid=rid, ordinal=ordinal)]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    for batch in batches:
        text, _, _, _, hashes, ordinal = anchors(batch.column("text").cast(pa.binary()).to_pylist(), length)
        held.append((batch.column("rid").to_numpy()[text], ordinal, hashes))
        if sum(len(x[0]) for x in held) > FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _repeated(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, rids, ordinals = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            own = _unpack(_HASHES, blob)
            keys.append(own["tag"].astype(np.uint64) | np.uint64(bucket << 32))
            rids.append(np.cumsum(own["rid"]))
            ordinals.append(np.cumsum(own["ordinal"]))
    key, rid, ordinal = np.concatenate(keys), np.concatenate(rids), np.concatenate(ordinals)
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    several = np.minimum.reduceat(rid[order], starts) != np.maximum.reduceat(rid[order], starts)
    order = order[np.repeat(several, np.diff(np.append(starts, len(order))))]
    for i in range(0, len(order), ROWS_OUT):
        own = order[i : i + ROWS_OUT]
        yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(ordinal[own], pa.int32())], ["rid", "ordinal"])


def _bits(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, a bit for each anchor up to the last that is wanted."""
    for batch in batches:
        out = []
        for own in batch.column("ordinals"):
            at = own.values.to_numpy()
            bits = np.zeros(int(at.max()) + 1, bool)
            bits[at] = True
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.binary())], ["rid", "wanted"])


def _contexts(length: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        text, first, number, place, _, _ = anchors(texts, length)
        wanted = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in batch.column("wanted").to_pylist()]
        chosen = np.concatenate([s + at for s, at in zip(np.searchsorted(text, np.arange(len(texts))).tolist(), wanted)])
        text, first, number, place = text[chosen], first[chosen], number[chosen], place[chosen]
        data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])[text] + first
        rid, key = batch.column("rid").to_numpy()[text], batch.column("key").to_numpy()[text]
        for i in range(0, len(text), ROWS_OUT):
            part = slice(i, i + ROWS_OUT)
            size = number[part] + length - 1
            offsets = np.append(0, np.cumsum(size))
            of = data[np.repeat(begin[part] - offsets[:-1], size) + np.arange(offsets[-1])]
            ctx = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(of)])
            yield pa.RecordBatch.from_arrays([pa.array(rid[part]), pa.array(key[part]), pa.array(first[part]), pa.array((place - first)[part], pa.int32()), ctx], ["rid", "key", "first", "at", "ctx"])


# Sorted buckets.


def multikey(order: np.ndarray, same: np.ndarray, keys: list[Callable[[np.ndarray], np.ndarray]]) -> None:
    """Sorts each run of order by one key after the other, in place.  same: whether an item is in the run of the one before;
    afterwards, whether all keys are equal too.  Items alone in their run are not looked at again."""
    for key in keys:
        at = np.flatnonzero(same | np.append(same[1:], False))
        if not len(at):
            return
        values, inside = key(order[at]), same[at]
        run = np.cumsum(~inside)
        uneven = np.zeros(run[-1] + 1, bool)
        uneven[run[1:][inside[1:] & (values[1:] != values[:-1])]] = True
        open_ = uneven[run]
        at, values, inside, run = at[open_], values[open_], inside[open_], run[open_]
        if len(at):
            by = np.lexsort((values, run))
            order[at], values = order[at][by], values[by]
            same[at] = inside & np.append(False, values[1:] == values[:-1])


class _Bytes:
    """Words of eight bytes of strings in one buffer, as numbers that sort like the bytes."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.concatenate([np.zeros(64, np.uint8), data, np.zeros(64, np.uint8)])
        self._ahead, self._back = (np.ndarray((len(padded) - 7,), kind, padded, strides=(1,)) for kind in (">u8", "<u8"))

    @staticmethod
    def _first(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first n bytes of each word, zeros behind."""
        n = np.clip(n, 0, 8).astype(np.uint64)
        return np.where(n == 0, np.uint64(0), values & (~np.uint64(0) << (np.uint64(64) - np.maximum(n, 1) * np.uint64(8))))

    def ahead(self, begin: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
        return self._first(self._ahead[64 + begin + np.minimum(8 * level, size)].astype(np.uint64), size - 8 * level)

    def back(self, begin: np.ndarray, size: np.ndarray, level: int) -> np.ndarray:
        """Of the bytes before begin, the nearest first."""
        return self._first(self._back[56 + begin - np.minimum(8 * level, size)].astype(np.uint64), size - 8 * level)


def _string_keys(of: _Bytes, begin: np.ndarray, length: int) -> list[Callable[[np.ndarray], np.ndarray]]:
    """Keys of strings of one length, the ends first, where strings with one anchor differ most often."""
    levels = list(range((length + 7) // 8))
    levels = [levels[0], *levels[:0:-1]]
    size = np.full(len(begin), length)
    return [lambda i, level=level: of.ahead(begin[i], size[i], level) for level in levels]


def _runs(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~same)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each size in turn."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _cover(least: np.ndarray, number: np.ndarray, item: np.ndarray, key: np.ndarray, rid: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, stop) of what goes.  least: the least document of each string, of one context (number strings each) after the
    other; item: each record's context; key, rid, first: of the records."""
    begin = np.append(0, np.cumsum(number))
    cut = np.append(True, least[1:] != least[:-1]) if len(least) else np.zeros(0, bool)
    cut[begin[:-1][number > 0]] = True
    segment = np.flatnonzero(cut)
    size = np.diff(np.append(segment, len(least)))
    lo, hi = np.searchsorted(segment, begin[:-1]), np.searchsorted(segment, begin[1:])
    of = _ranges(lo[item], (hi - lo)[item])
    record = np.repeat(np.arange(len(item)), (hi - lo)[item])
    gone = least[segment[of]] < key[record]
    of, record = of[gone], record[gone]
    start = first[record] + segment[of] - begin[item[record]]
    return rid[record], start, start + size[of] + length - 1


def _bucket(buckets: int, length: int, task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (rid, start, stop), what goes from a text, and of packed arrays: strings and records of the runs that may go on in
    a neighbouring bucket."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    table = pa.Table.from_batches(table).combine_chunks()
    rid, key, first = (table.column(c).to_numpy() for c in ("rid", "key", "first"))
    ctx, at = table.column("ctx").chunk(0), table.column("at").to_numpy().astype(np.int64)
    offsets = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
    of = _Bytes(np.frombuffer(ctx.buffers()[2], np.uint8))
    begin, size = offsets[:-1], np.diff(offsets)
    number, anchor, after = size - length + 1, begin + at, size - at

    order, same = np.arange(len(rid)), np.append(False, np.ones(len(rid) - 1, bool))
    suffix = lambda level: lambda i: of.ahead(anchor[i], after[i], level)
    prefix = lambda level: lambda i: of.back(anchor[i], at[i], level)
    words = range(RUN // 8, (length + 7) // 8)
    multikey(order, same, [suffix(level) for level in range(RUN // 8)])
    runs = _runs(same)
    multikey(order, same, [suffix(level) for level in words] + [lambda i: after[i]] + [prefix(level) for level in range((length - RUN + 7) // 8)] + [lambda i: at[i]])

    # Contexts: one for each set of equal records.  Their strings are sorted where an anchor has several, or may have elsewhere.
    heads = _runs(same)
    context = np.cumsum(~same) - 1  # of each record in order
    one = order[heads]
    least = np.minimum.reduceat(key[order], heads)
    own_run = np.searchsorted(runs, heads, "right") - 1
    per_run = np.bincount(own_run, minlength=len(runs))
    outer = (own_run == 0) | (own_run == len(runs) - 1)
    sorted_ = (per_run[own_run] > 1) | outer
    alone = ~sorted_[context]
    gone = alone & (key[order] > least[context])
    spans = [(rid[order[gone]], first[order[gone]], first[order[gone]] + size[order[gone]])]

    some = np.flatnonzero(sorted_)
    total = np.cumsum(number[one[some]])
    while len(some):
        n = max(1, int(np.searchsorted(total - (total[0] - number[one[some[0]]]), STRINGS)))
        if n < len(some):  # whole runs, of which one may be longer
            n = int(np.searchsorted(own_run[some], own_run[some[n]])) or int(np.searchsorted(own_run[some], own_run[some[0]], "right"))
        yield from _strings(spans, buckets, length, task, of, some[:n], one, number, begin, at, own_run, least, outer, order, heads, rid, key, first)
        some, total = some[n:], total[n:]
    yield from _span_rows(buckets, *map(np.concatenate, zip(*spans)))


def _strings(spans, buckets, length, task, of, some, one, number, begin, at, own_run, least, outer, order, heads, rid, key, first) -> Iterator[pa.RecordBatch]:
    """The strings of some contexts, all of their runs: see _bucket, whose arrays the others are.  Adds to spans what goes."""
    many = number[one[some]]
    item = np.repeat(np.arange(len(some)), many)
    string = _ranges(begin[one[some]], many)  # its place in the buffer
    ahead = at[one[some[item]]] - (string - begin[one[some[item]]])  # bytes before the anchor
    run = own_run[some[item]]
    by = np.lexsort((ahead, run))
    same = np.append(False, (run[by][1:] == run[by][:-1]) & (ahead[by][1:] == ahead[by][:-1]))
    multikey(by, same, _string_keys(of, string, length))
    starts = _runs(same)
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(~same) - 1
    lowest = np.minimum.reduceat(least[some[item]][by], starts)

    stops = np.append(heads[1:], len(order))
    records = lambda of_: (order[_ranges(heads[of_], (stops - heads)[of_])], np.repeat(np.arange(len(of_)), (stops - heads)[of_]))
    mine, theirs = records(some)
    here = ~outer[some][theirs]
    spans.append(_cover(lowest[kind], many, theirs[here], key[mine[here]], rid[mine[here]], first[mine[here]], length))

    if outer[some].any():
        apart = outer[some]
        strings, where = np.unique(kind[apart[item]], return_inverse=True)
        place = string[by[starts]][strings]
        bytes_ = np.stack([of.ahead(place, np.full(len(place), length), level) for level in range((length + 7) // 8)], 1)
        hashes = np.zeros(len(place), np.uint64)
        for level in range(bytes_.shape[1]):
            hashes = _mixed(hashes + bytes_[:, level])
        # each context's strings by number, and the records of each context, which are numbered anew
        own = (np.cumsum(apart) - 1)[theirs[~here]]
        mine = mine[~here]
        record = {"string": where.astype(np.int32), "lowest": lowest[strings], "many": many[apart], "context": own, "key": key[mine], "rid": rid[mine], "first": first[mine]}
        yield _packed_row("record", task, b"".join([len(c).to_bytes(8, "little") + c.astype("<i8").tobytes() for c in record.values()]), batch=int(some[0]))
        for bucket, own in _dealt(((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), at=np.arange(len(place))):
            columns = {f"w{level}": bytes_[own["at"], level] for level in range(bytes_.shape[1])}
            yield _packed_row("string", bucket, _pack(_string_kinds(length), columns | {"lowest": lowest[strings][own["at"]], "string": own["at"]}), origin=task, batch=int(some[0]))


def _record(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, "<i8", n, at + 8))
        at += 8 + 8 * n
    return out


_OUT = "what string, bucket int, origin int, batch int, blob binary"


def _packed_row(what: str, bucket: int, blob: bytes, origin: int = 0, batch: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([what]), *[pa.array([x], pa.int32()) for x in (bucket, origin, batch)], pa.array([blob], pa.binary())], ["what", "bucket", "origin", "batch", "blob"])


def _span_rows(buckets: int, rid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    for bucket, own in _dealt((_mixed(rid.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), rid=rid, start=start, stop=stop):
        yield _packed_row("span", bucket, _pack(_SPANS, own))


def _across(length: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings that several buckets may have, those of which another bucket has a smaller document."""
    held = [(o, b, _unpack(_string_kinds(length), x)) for batch in batches for o, b, x in zip(*[batch.column(c).to_pylist() for c in ("origin", "batch", "blob")])]
    if not held:
        return
    size = [len(x["string"]) for _, _, x in held]
    column = lambda name: np.concatenate([x[name] for _, _, x in held])
    words, lowest = [column(f"w{level}") for level in range((length + 7) // 8)], column("lowest")
    order, same = np.arange(len(lowest)), np.append(False, np.ones(len(lowest) - 1, bool))
    multikey(order, same, [lambda i, w=w: w[i] for w in words])
    starts = _runs(same)
    now = np.empty(len(order), np.int64)
    now[order] = np.repeat(np.minimum.reduceat(lowest[order], starts), np.diff(np.append(starts, len(order))))
    smaller = now < lowest
    held_by, string = np.repeat(np.arange(len(held)), size), column("string")
    for i, own in _dealt(held_by[smaller], string=string[smaller], lowest=now[smaller]):
        yield _packed_row("smaller", held[i][0], _pack(_SMALLER, own), batch=held[i][1])


def _outer_spans(buckets: int, length: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes from the records of first and last runs, once strings have met across boundaries."""
    records, smaller = {}, {}
    for batch in batches:
        for what, bucket, part, blob in zip(*[batch.column(c).to_pylist() for c in ("what", "bucket", "batch", "blob")]):
            if what == "record":
                records[bucket, part] = _record(blob)
            else:
                smaller.setdefault((bucket, part), []).append(_unpack(_SMALLER, blob))
    spans = []
    for place, (string, lowest, many, context, key, rid, first) in records.items():
        lowest = lowest.copy()
        for x in smaller.get(place, []):
            lowest[x["string"]] = x["lowest"]
        spans.append(_cover(lowest[string], many, context, key, rid, first, length))
    if spans:
        yield from _span_rows(buckets, *map(np.concatenate, zip(*spans)))


# Spans of each text.


def _merged(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjoining spans of each text as one."""
    held = [_unpack(_SPANS, x) for batch in batches for x in batch.column("blob").to_pylist()]
    if not held:
        return
    rid, start, stop = (np.concatenate([x[c] for x in held]) for c in _SPANS)
    by = np.lexsort((start, rid))
    rid, start, stop = rid[by], start[by], stop[by]
    text = np.cumsum(np.append(False, rid[1:] != rid[:-1]))
    base = text * (int(stop.max()) + 1)
    stop = np.maximum.accumulate(base + stop) - base
    new = np.append(True, (rid[1:] != rid[:-1]) | (start[1:] > stop[:-1]))
    at = np.flatnonzero(new)
    rid, start, stop = rid[at], start[at], stop[np.append(at[1:] - 1, len(stop) - 1)]
    texts = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
    edges, removed, number = np.stack([start, stop], 1).astype("<i8"), np.add.reduceat(stop - start, texts), np.diff(np.append(texts, len(rid)))
    for i in range(0, len(texts), ROWS_OUT):
        part = texts[i : i + ROWS_OUT]
        spans = [edges[s : s + n].tobytes() for s, n in zip(part.tolist(), number[i : i + ROWS_OUT].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(rid[part]), pa.array(spans, pa.binary()), *[pa.array(x[i : i + ROWS_OUT], pa.int64()) for x in (removed, number)]], ["rid", "spans", "n_removed", "n_spans"])


def _kept(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
            edges = np.frombuffer(spans.as_buffer(), "<i8").tolist()
            text = memoryview(text.as_buffer())
            kept.append(b"".join([text[s:e] for s, e in zip([0, *edges[1::2]], [*edges[0::2], len(text)])]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(kept, pa.binary())], ["rid", "kept"])


def _of_texts(texts: DataFrame, packed: DataFrame, column: str) -> DataFrame:
    """The texts of which there is something packed (rid and column, stored), which is broadcast after its rows and bytes were
    checked; beyond that the texts are shuffled."""
    n, size = packed.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    few = n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    packed = packed.select("rid", column)
    return texts.join(F.broadcast(packed) if few else packed, "rid")


def _analysed(docs: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows; copies (rid) of a text with a smaller id; spans (rid, spans, n_removed, n_spans) of the others that lose bytes)."""
    if length < RUN:
        raise ValueError(f"strings of fewer than {RUN} bytes have no anchor")
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    last = F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1))
    texts = texts.select(F.monotonically_increasing_id().alias("rid"), "id", last.alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    texts = stored(texts, "texts")
    first = texts.groupBy("sha", "n_bytes").agg(F.min("key").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    on = ["sha", "n_bytes"]
    copies = spread(texts.select("rid", "key", *on), *on).join(spread(first, *on), [*on, "_spread"]).where("key > least").select("rid")
    copies = stored(copies, "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    single = texts.where(F.col("n_bytes") >= length).join(F.broadcast(copies) if few else copies, "rid", "left_anti").select("rid", "key", "text")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = arrow_rows(single.select("rid", "text"), partial(_deal_hashes, 4 * parts, length), "bucket int, blob binary").repartition(parts, "bucket")
    marks = arrow_rows(dealt, _repeated, "rid long, ordinal int").groupBy("rid").agg(F.collect_list("ordinal").alias("ordinals"))
    marks = stored(arrow_rows(marks, _bits, "rid long, wanted binary"), "marks")
    contexts = arrow_rows(_of_texts(single, marks, "wanted"), partial(_contexts, length), "rid long, key long, first long, at int, ctx binary")
    contexts = stored(contexts, "contexts")

    parts = max(parts, -(-contexts.count() // CONTEXTS))
    ranged = contexts.repartitionByRange(parts, F.expr("substring(ctx, at + 1)"), "key")
    found = stored(arrow_rows(ranged, partial(_bucket, parts, length), _OUT), "found")
    strings = found.where("what = 'string'").select("bucket", "origin", "batch", "blob").repartition(parts, "bucket")
    smaller = arrow_rows(strings, partial(_across, length), _OUT)
    met = found.where("what = 'record'").unionByName(smaller).select("what", "bucket", "batch", "blob").repartition(parts, "bucket")
    spans = found.where("what = 'span'").unionByName(arrow_rows(met, partial(_outer_spans, parts, length), _OUT)).select("bucket", "blob").repartition(parts, "bucket")
    spans = arrow_rows(spans, _merged, "rid long, spans binary, n_removed long, n_spans long")
    return texts, copies, stored(spans, "spans")


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of docs that loses bytes: id, spans (what goes, in bytes: pairs of long, start and stop, little-endian), kept
    (binary: the bytes that stay).  See suffix_dedup."""
    texts, copies, spans = _analysed(docs, id_col, text_col, length)
    kept = arrow_rows(_of_texts(texts.select("rid", "text"), spans, "spans"), _kept, "rid long, kept binary").join(spans.select("rid", "spans"), "rid")
    long = texts.where(F.col("n_bytes") >= length).join(copies, "rid", "left_semi")
    edge = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 16, "0"), i, 2) for i in range(15, 0, -2)]))
    whole = long.select("rid", F.lit(b"").alias("kept"), F.concat(edge(F.lit(0)), edge(F.col("n_bytes"))).alias("spans"))
    return kept.unionByName(whole).join(texts.select("rid", "id"), "rid").select(F.col("id").alias(id_col), "spans", "kept")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal runs of removed bytes) (long), kept_sha256.

    A byte goes if a string of `length` bytes covers it that also starts in a row with a smaller id; strings never reach over
    the end of a text, and are judged on the input.  Ids are whole numbers; a null id is larger than any, and rows that share
    an id never take from each other.  Null and empty texts, and those shorter than `length`, keep all.  No rows give no rows;
    other columns are left out.
    """
    texts, copies, spans = _analysed(docs, id_col, text_col, length)
    kept = arrow_rows(_of_texts(texts.select("rid", "text"), spans, "spans"), _kept, "rid long, kept binary").select("rid", F.sha2("kept", 256).alias("kept_sha256"))
    gone = spans.select("rid", "n_removed", "n_spans").join(kept, "rid")
    gone = gone.unionByName(copies.select("rid", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(_EMPTY).alias("kept_sha256")))
    out = texts.select("rid", "id", "n_bytes", F.lower(F.hex("sha")).alias("sha")).join(gone, "rid", "left")
    lost = F.when(F.col("n_bytes") >= length, F.coalesce("n_removed", F.when(F.col("n_spans").isNotNull(), F.col("n_bytes"))))
    n_removed = F.coalesce(lost, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "n_bytes", n_removed.alias("n_removed"), F.when(n_removed > 0, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"), F.when(n_removed > 0, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"))


def op11_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
