"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A document is the set of its word shingles.  Shingles are ordered, rare ones first (by hash), then frequent ones (by
corpus count).  Two sets that are similar enough share a shingle among the first n - ceil(t n) + 1 of each: if the first
one they share is rare, the index of single rare shingles finds them.  If it is frequent, so are all they share, and of
prefixes longer by c shingles they share c + 1; frequent shingles fall into c classes, so two of these fall into one
class, and the index of two-shingle combinations within a class finds them.  c follows from the least number of shingles
that a set shares with one of its size or smaller, and is less than it; each set is indexed for the c of every size that
it can be similar to.

Candidates only say which sets must be compared.  Pairs come from single rare shingles, and from combinations that few sets
hold; a pair stays if the parity sketches of its sets differ in no more bits than similar sets may differ in shingles, which no
similar pair fails.  A single pairs its holders with one of them first, as many rows as it has holders; only holders that these
pairs leave in different components are then paired with each other, after the length and position filters.  A combination that many sets hold gives a star
around one of them.  A single that more than LISTED sets hold in their prefixes was taken for rare wrongly: no pairs are
listed of it, but the sets that hold it there are indexed once more with it among the frequent ones.  (Similar sets whose
first shared shingle it is both hold it there, and the prefix rule holds for any order, so this finds them.)

A component too large for one block is first told apart by sketches, of some 100 bytes a set: only sets that their sketches
leave together go on as a component, so that sets which merely share frequent passages are not compared by shingles in the square.

The components of this graph are compared set by set in blocks, by counts of common shingles, and of each block only links that connect something new are
handed on.  In a component of several blocks, sets are first compared with one of them; those that it links to need no
comparison with each other.  Sets that are equal are one node from the start.  So nothing but sets and trees of links moves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import BROADCAST_ROWS, arrow_rows, components, id_text, semi, spread, stored

#: Shingles of a task that are counted together, and the least count in them that is handed on.
FLUSH, LEAST_LOCAL = 4_000_000, 2
#: Corpus count of a frequent shingle (counts under LEAST_LOCAL in a task left out), and the most of them (16 bytes each) that are broadcast; beyond, the count rises.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Sets compared at once with as many others, shingles in these on average at most, and the most holders of a key whose pairs are listed.
BLOCK, BLOCK_SHINGLES, LISTED = 256, 2_000_000, 64
#: Sets whose sketches are compared at once with those of as many others, and 64-bit words of these on average at most.
SKETCHES, SKETCH_WORDS = 2_048, 1 << 17
#: How often sets are indexed anew for singles that many hold; such singles left then give stars, as combinations do.
DEPTH = 3
#: Least bits of a parity sketch: bit i is the number of shingles whose hash is i modulo the bits, modulo 2.
SKETCH = 1024
_WORDS_KEPT = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k hashes."""
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def shingles(text: str, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words (of all words, if fewer); words are what stands between ASCII
    white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(_mix(h, min(k, len(words))))


def node_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def classes_of(least: int) -> int:
    """c for sets that share at least so many shingles, and less than that: 8 up to 255, about a 32nd beyond."""
    return min(least - 1, 8 << max(0, least.bit_length() - 8))


def bands(n: int, percent: int) -> set[int]:
    """c of every size from n to the largest that n can be similar to: a larger set of m shares percent of m, n at most."""
    least = -(-percent * n // 100)
    return {classes_of(m) for m in (*range(least, min(n, 9) + 1), least, n, *(1 << b for b in range(least.bit_length(), n.bit_length())))}


def keys_of(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single rare shingles of the prefix, their places, and combinations of frequent ones."""
    n = len(found)
    at = np.searchsorted(frequent, found)
    at[at == len(frequent)] = 0
    often = frequent[at] == found if len(frequent) else np.zeros(n, bool)
    rare = found[~often]
    prefix = n - (percent * n + 99) // 100 + 1
    singles = rare[:prefix]
    if len(rare) >= n:
        return singles, np.arange(len(singles)), np.empty(0, np.uint64)
    heavy = found[often]
    heavy = heavy[np.lexsort((heavy, counts[at[often]]))]
    combos = []
    for c in bands(n, percent):
        own = heavy[: max(0, prefix + c - len(rare))]
        if not c:  # one shingle may be all that two sets share
            combos.append(own * np.uint64(0xD6E8FEB86659FD93))
            continue
        kind = own % np.uint64(c)
        for one in np.unique(kind):
            same = np.sort(own[kind == one])
            if len(same) > 1:
                i, j = np.triu_indices(len(same), 1)
                x = (same[i] * np.uint64(0x9E3779B97F4A7C15)) ^ (same[j] >> np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
                combos.append((x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(c))
    return singles, np.arange(len(singles)), np.concatenate(combos) if combos else np.empty(0, np.uint64)


def _survey(k: int, kind: pa.DataType, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (id, node, n, tkey), and rows (h, c) of shingles that the task holds several times."""
    hashes, held, size, seen = _Hashes(), [], 0, set()
    names = ["id", "node", "n", "tkey", "h", "c"]

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= LEAST_LOCAL].view(np.int64), c[c >= LEAST_LOCAL]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), kind), pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.int64()), pa.array(h), pa.array(c.astype(np.int64))], names)
        held.clear()
        seen.clear()

    for batch in batches:
        nodes, sizes = [], []
        for text in batch.column("text").to_pylist():
            found = shingles(text, k, hashes)
            node = node_of(found)
            nodes.append(node)
            sizes.append(len(found))
            if node not in seen:
                seen.add(node)
                held.append(found)
                size += len(found)
        rows = len(nodes)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), batch.column("tkey"), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
        if size > FLUSH:
            yield from flush()
            size = 0
    yield from flush()


def _index(k: int, percent: int, model, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (frequent, counts), seen = _Hashes(), model.value, set()
    for batch in batches:
        out = {n: [] for n in ("s", "n", "sketch", "singles", "combos")}
        for text in batch.column("text").to_pylist():
            found = shingles(text, k, hashes)
            if not len(found):
                continue
            node = node_of(found)
            if node in seen:
                continue
            if len(seen) < 200_000:
                seen.add(node)
            singles, _, combos = keys_of(found, frequent, counts, percent)
            for name, value in zip(out, (short(node), len(found), sketch(found), singles.view(np.int64), combos.view(np.int64))):
                out[name].append(value)
        kinds = (pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def sketch(found: np.ndarray) -> np.ndarray:
    """Of a power of two of bits, half as many as shingles or more: similar sets then differ in far fewer bits than
    others do.  Its two halves added are the sketch of half the bits."""
    bits = max(SKETCH, 1 << (len(found).bit_length() - 1))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def short(node: bytes) -> int:
    """64 bits of a node for the search of candidates.  Two nodes in one share a sketch there, and all else that is
    found for either is compared for both."""
    return int.from_bytes(node[:8], "big", signed=True)


def _sets(k: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, seen = _Hashes(), set()
    for batch in batches:
        out = {n: [] for n in ("s", "node", "shingles")}
        for text in batch.column("text").to_pylist():
            found = shingles(text, k, hashes)
            node = node_of(found)
            if node not in seen:
                if len(seen) < 200_000:
                    seen.add(node)
                for name, value in zip(out, (short(node), node, found.tobytes())):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.binary(), pa.binary()))], list(out))


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(m), sizes)
    shared = np.bincount(where, minlength=len(tokens)) > 1
    place = np.cumsum(shared) - 1
    use = shared[where]
    rows, columns = rows[use], place[where[use]]
    by = np.argsort(columns, kind="stable")
    rows, columns = rows[by], columns[by]
    common = np.zeros((m, m), np.float32)
    width = max(256, 4_000_000 // m)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(columns, (start, start + width))
        matrix = np.zeros((m, width), np.float32)
        matrix[rows[a:b], columns[a:b] - start] = 1
        common += matrix @ matrix.T
    common = common.astype(np.int64)
    linked = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    parent, out = list(range(m)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _near(percent: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, node, shingles, centre, middle) as (label, node, shingles, centre, near): does middle link to shingles?"""
    for batch in batches:
        near = []
        for own, middle in zip(batch.column("shingles"), batch.column("middle")):
            own, middle = (np.frombuffer(x.as_buffer(), np.uint64) for x in (own, middle))
            common = len(np.intersect1d(own, middle, assume_unique=True))
            near.append(100 * common >= percent * (len(own) + len(middle) - common))
        names = ["label", "node", "shingles", "centre"]
        yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(near, pa.bool_())], [*names, "near"])


def _compare(percent: int, group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates("node")
    nodes = group["node"].tolist()
    found = links_within([np.frombuffer(s, np.uint64) for s in group["shingles"]], percent) if len(nodes) > 1 else []
    return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype=object)


def alike(sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches may be of similar sets."""
    label, out = np.arange(len(sizes)), []
    words = np.array([len(x) for x in sketches])
    for width in np.unique(words):
        both = np.flatnonzero((words == width) | (words == 2 * width))
        both = both[np.argsort(sizes[both], kind="stable")]
        n, wide = sizes[both], words[both] > width
        bits = np.stack([sketches[i] if len(sketches[i]) == width else sketches[i][:width] ^ sketches[i][width:] for i in both])
        last = np.searchsorted(percent * n, 100 * n, side="right")  # where sets begin that are too large to be similar
        step = int(max(1, 2_000_000 // (len(both) * width)))
        for start in range(0, len(both), step):
            own, other = np.arange(start, min(start + step, len(both))), np.arange(start, last[min(start + step, len(both)) - 1])
            differ = np.bitwise_count(bits[own, None] ^ bits[None, other]).sum(axis=2, dtype=np.int64)
            may = differ * (100 + percent) <= (n[own, None] + n[other]) * (100 - percent)
            may &= (other > own[:, None]) & (other < last[own, None]) & ~(wide[own, None] & wide[other])
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                x, there = both[own[i]], both[other[may[i]]]
                for one, at in zip(*np.unique(label[there], return_index=True)):
                    if one != label[x]:
                        label[label == one] = label[x]
                        out.append((int(x), int(there[at])))
    return out


def _alike(percent: int, group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates("s")
    found = alike(group["n"].to_numpy(np.int64), [np.asarray(x, np.int64) for x in group["sketch"]], percent)
    s = group["s"].to_numpy()
    return pd.DataFrame({"a": [s[i] for i, _ in found], "b": [s[j] for _, j in found]}, dtype=np.int64)


def _may_link(x: str, y: str, percent: int) -> Column:
    """May x and y, with columns n and sketch, be similar, by their sizes and sketches?"""
    nx, ny, sx, sy = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    half = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    differ = F.aggregate(F.zip_with(half(sx, sy), half(sy, sx), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return F.when(sizes, F.coalesce(differ * (100 + percent) <= (nx + ny) * (100 - percent), F.lit(False))).otherwise(False)


def _meeting(told: DataFrame, by: list[str], node: str, apart: Column, beside: Column) -> DataFrame:
    """Rows of told once for each pair (i, j) of blocks of their group that they meet in.  apart, beside: numbers of blocks of
    sets apart from the centre, which come first and meet all blocks, and of those near it, which meet only the former."""
    parts = stored(told.groupBy(*by).agg(apart.alias("apart"), beside.alias("beside")).where("apart > 0"), "parts")
    met = spread(told, *by).join(spread(parts, *by), [*by, "_spread"])
    slot = lambda number: F.pmod(F.xxhash64(node), number).cast("int")
    met = met.withColumn("own", F.when(F.col("near"), F.col("apart") + slot(F.col("beside"))).otherwise(slot(F.col("apart"))))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("near"), F.col("apart")).otherwise(F.col("apart") + F.col("beside")) - 1)))
    return met.select(*told.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _parts_of(most: int, size: Column, most_size: int) -> list[Column]:
    """Numbers of blocks of the sets apart from and near a centre: most sets, and most_size in all, to a block."""
    return [F.ceil(F.greatest(F.count_if(some) / most, F.sum(F.when(some, size).otherwise(0)) / most_size)).cast("int") for some in (~F.col("near"), F.col("near"))]


def _told_apart(many: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """many: s, label and n of the sets of large components; s and label of those that sketches leave together with others.

    Sets meet by sizes: those of one band of sizes, as wide as similar sets may differ, and of the next.  Those that may link to
    the centre of the two bands do not meet each other."""
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-3)).cast("int")
    many = many.select("s", "label").join(known, "s").withColumn("band", F.explode(F.array(band, band - 1)))
    many = stored(many, "sketches")
    middle = many.groupBy("label", "band").agg(F.min_by(F.struct("s", "n", "sketch"), "s").alias("m"))
    many = spread(many, "label", "band").join(spread(middle, "label", "band"), ["label", "band", "_spread"]).select("label", "band", F.col("m.s").alias("centre"), "m", F.struct("s", "n", "sketch").alias("x"))
    many = stored(many.select("label", "band", "centre", "x.*", _may_link("x", "m", percent).alias("near")), "beside")
    parts = _parts_of(SKETCHES, F.size("sketch"), SKETCH_WORDS)
    met = _meeting(many, ["label", "band"], "s", *parts).select("label", "band", "i", "j", "s", "n", "sketch")
    links = stored(met.groupBy("label", "band", "i", "j").applyInPandas(partial(_alike, percent), "a long, b long"), "alike")
    links = links.unionByName(many.where("near AND s <> centre").select(F.col("centre").alias("a"), F.col("s").alias("b")))
    return components(links).withColumnRenamed("id", "s")


def _apart(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of holders of a single, its star's centre left out, that are not in one group yet, after the length and
    position filters.  shared: depth, key, held, a (the centre), s, n, at."""
    labelled = shared.where("held > 2").join(groups.withColumnRenamed("id", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    labelled = stored(labelled.where("a <> s").select("depth", "key", "s", "n", "at", "label"), "labelled")
    mixed = labelled.groupBy("depth", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("depth", "key")
    mixed = stored(labelled.join(mixed, ["depth", "key"], "left_semi"), "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    same = (F.col("x.depth") == F.col("y.depth")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.s") < F.col("y.s")) & (F.col("x.label") != F.col("y.label"))
    return x.join(y, same & (100 * small >= percent * large) & (rest * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, n_shingles (long), component_id.

    Two documents link if 100 * common >= percent * union of their shingle sets; component_id is the least id among all
    that are reachable by links, the row's own included.  Null, empty and wordless texts have no shingles and no links,
    and are their own component; null ids count as larger than all others, and a component of null ids alone has a
    null id.  Rows that share an id are nodes of their own; no rows give no rows; other columns are left out.

    frequent: the corpus count from which shingles are indexed in combinations.  block: sets compared at once.
    """
    spark = docs.sparkSession
    schema_kind = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    texts = id_text(docs, id_col, text_col).withColumn("tkey", F.xxhash64("text"))
    survey = stored(arrow_rows(texts, partial(_survey, k, to_arrow_type(docs.schema[id_col].dataType)), f"id {schema_kind}, node binary, n int, tkey long, h long, c long"), "survey")
    rows = survey.where("node IS NOT NULL").select("id", "node", "n", "tkey")

    counted = stored(survey.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= frequent), "frequent")
    least, running = 1 << 62, 0
    for power, number in sorted(counted.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().collect(), reverse=True):
        running += number
        if running > MOST_FREQUENT:
            break
        least = 1 << power
    often = counted.where(F.col("c") >= least).select("h", "c").toArrow()
    h, c = often.column("h").to_numpy().astype(np.int64).view(np.uint64), often.column("c").to_numpy()

    first = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts of the sets s, perhaps of some more."""
        wanted = rows.where("n > 0").groupBy("node").agg(F.min("tkey").alias("tkey")).withColumn("s", first).join(ids.select("s"), "s", "left_semi").select("tkey").distinct()
        return semi(texts.select("tkey", "text"), stored(wanted, "wanted"), ["tkey"]).select("text")

    todo, known, shared, combos, stars = texts.select("text"), None, [], [], []
    for depth in range(DEPTH):
        by = np.argsort(h)
        h, c = h[by], c[by]
        model = spark.sparkContext.broadcast((h, c))
        index = stored(arrow_rows(todo, partial(_index, k, percent, model), "s long, n int, sketch array<long>, singles array<long>, combos array<long>"), "index")
        known = index if known is None else known
        combos.append(index.where(F.size("combos") > 0).select("s", F.explode("combos").alias("key")))
        single = index.select("s", "n", F.posexplode("singles").alias("at", "key"))
        # A set may come once from each of several tasks: holders are counted first, and told apart where they are many.
        keys = stored(single.groupBy("key").agg(F.count("*").alias("held"), F.min("s").alias("a"), F.max("s").alias("z")).where("a < z").drop("z"), "keys")
        crowd = keys.where(F.col("held") > LISTED)
        if crowd.limit(1).count():
            distinct = semi(single, crowd.select("key"), ["key"]).select("key", "s").distinct()
            crowd = stored(distinct.groupBy("key").agg(F.count("*").alias("held"), F.min("s").alias("a")).where(F.col("held") > LISTED), "crowded")
        room = MOST_FREQUENT - len(h)
        number = crowd.limit(room + 1).count()
        few = F.broadcast(crowd.select("key")) if number <= min(room, BROADCAST_ROWS) else crowd.select("key")
        light = keys.join(few, "key", "left_anti") if number else keys
        shared.append(stored(single.join(light, "key").withColumn("depth", F.lit(depth)), "shared"))
        if not number:
            break
        hot = stored(spread(single.select("key", "s"), "key").join(spread(crowd, "key"), ["key", "_spread"]).select("a", "s").distinct(), "crowd")
        if depth + 1 == DEPTH or number > room:
            stars.append(hot.where("a <> s").select("a", F.col("s").alias("b")))
            break
        more = crowd.select("key", "held").toArrow()
        h = np.concatenate([h, more.column("key").to_numpy().astype(np.int64).view(np.uint64)])
        c = np.concatenate([c, more.column("held").to_numpy()])
        todo = texts_of(hot.select("s").distinct())

    both = [F.col("x.s").alias("a"), F.col("y.s").alias("b")]
    combo = stored(reduce(DataFrame.unionByName, combos).distinct(), "combinations")
    held = stored(combo.groupBy("key").agg(F.min("s").alias("a"), F.count("*").alias("held")).where("held > 1"), "held")
    few = combo.join(held.where(F.col("held") <= LISTED), "key").select("key", "s")
    u, v = few.alias("x"), few.alias("y")
    listed = u.join(v, (F.col("x.key") == F.col("y.key")) & (F.col("x.s") < F.col("y.s"))).select(*both)
    known = known.select("s", "n", "sketch").dropDuplicates(["s"])

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sketches may be of similar sets."""
        pairs = stored(pairs.distinct(), "pairs")
        own, other = known.select(F.col("s").alias("a"), F.struct("n", "sketch").alias("x")), known.select(F.col("s").alias("b"), F.struct("n", "sketch").alias("y"))
        return pairs.join(own, "a").join(other, "b").where(_may_link("x", "y", percent)).select("a", "b")

    alone = reduce(DataFrame.unionByName, shared)
    stars.append(spread(combo, "key").join(spread(held.where(F.col("held") > LISTED), "key"), ["key", "_spread"]).where("a <> s").select("a", F.col("s").alias("b")).distinct())
    starred = likely(listed.unionByName(alone.where("a <> s").select("a", F.col("s").alias("b"))))
    groups = components(reduce(DataFrame.unionByName, [starred, *stars]))
    rest = likely(_apart(alone, groups, percent))
    groups = components(groups.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(rest))

    def in_blocks(groups: DataFrame) -> DataFrame:
        """s and label as s, label, n and the number of blocks of all that have the label."""
        groups = stored(groups.select("s", "label").join(known.select("s", "n"), "s"), "sized")
        sizes = groups.groupBy("label").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        return stored(spread(groups, "label").join(spread(sizes, "label"), ["label", "_spread"]).select("s", "label", "n", "blocks"), "groups")

    placed = in_blocks(groups.withColumnRenamed("id", "s"))
    if placed.where("blocks > 1").limit(1).count():
        refined = in_blocks(_told_apart(placed.where("blocks > 1"), known, percent))
        placed = placed.where("blocks = 1").unionByName(refined)
    kinds = "s long, node binary, shingles binary"
    compare, pair = partial(_compare, percent), "a binary, b binary"
    sets = arrow_rows(texts_of(placed.where("blocks = 1")), partial(_sets, k), kinds).join(placed.where("blocks = 1"), "s")
    links = stored(sets.select("label", "node", "shingles").groupBy("label").applyInPandas(compare, pair), "links")

    if placed.where("blocks > 1").limit(1).count():
        many = placed.where("blocks > 1")
        sets = stored(arrow_rows(texts_of(many), partial(_sets, k), kinds).join(many, "s").dropDuplicates(["node"]), "sets")
        middle = sets.where("s = label").groupBy("label").agg(F.min_by(F.struct("node", "shingles"), "node").alias("m")).select("label", F.col("m.node").alias("centre"), F.col("m.shingles").alias("middle"))
        told = spread(sets, "label").join(spread(middle, "label"), ["label", "_spread"]).select("label", "node", "shingles", "centre", "middle")
        told = stored(arrow_rows(told, partial(_near, percent), "label long, node binary, shingles binary, centre binary, near boolean"), "told")
        links = links.unionByName(told.where("near AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        told = _meeting(told, ["label"], "node", *_parts_of(block, F.length("shingles") / 8, BLOCK_SHINGLES)).select("label", "i", "j", "node", "shingles")
        links = links.unionByName(stored(told.groupBy("label", "i", "j").applyInPandas(compare, pair), "links"))

    joined = components(links)
    labelled = spread(rows.where("n > 0"), "node").join(spread(joined.withColumnRenamed("id", "node"), "node"), ["node", "_spread"], "left").select("id", "n", F.coalesce("label", "node").alias("label"))
    least_id = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    out = spread(labelled, "label").join(spread(least_id, "label"), ["label", "_spread"]).select("id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
