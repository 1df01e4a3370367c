"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point.  An n-gram's vector binds (multiplies) its
letters' vectors, each permuted by its place; a text's vector bundles (adds) those of its n-grams.  A language's
prototype bundles its training texts, from which what all languages share is taken off, and a text belongs to the
language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import arrow_rows, col, stored

#: Of an n-gram: words are padded with a space on either side, and letters alone count.
N = 3
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: n-gram vectors kept in a task (of a byte for each dimension), and looked up at once.
REMEMBERED, AT_ONCE = 60_000, 4_000


@lru_cache(maxsize=100_000)
def letter_vector(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng(0x9E3779B9 + code).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def ngram_vector(gram: int, dims: int) -> np.ndarray:
    """gram: N code points of 21 bits each, the first one highest."""
    out = np.ones(dims, np.int8)
    for place in range(N):
        out *= np.roll(letter_vector((gram >> (21 * (N - 1 - place))) & 0x1FFFFF, dims), N - 1 - place)
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, and how often each occurs; none if it has no letter."""
    letters = "".join([c if c.isalpha() or c == " " else " " for c in text.lower()]) if not text.isascii() else text.lower()
    letters = _NOT_LETTERS.sub(" ", letters).strip()
    if not letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return np.unique(grams, return_counts=True)


def _train(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language, the n-grams of a task and their numbers."""
    sums: dict[str, dict[int, int]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, of in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(of.keys(), pa.int64()), pa.array(of.values(), pa.int64())], ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            of = sums.setdefault(lang, {})
            found = [ngrams(t) for t in own]
            grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            for g, n in zip(grams.tolist(), np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64).tolist()):
                of[g] = of.get(g, 0) + n
        if sum(map(len, sums.values())) > 500_000:
            yield from flush()
    yield from flush()


def _bundle(dims: int, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language, the bundle of a task's n-grams."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, gram, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n"))):
            if lang not in sums:
                sums[lang] = np.zeros(dims)
            sums[lang] += n * ngram_vector(gram, dims).astype(np.float64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims), pa.int32()), pa.array(v)], ["lang", "dim", "v"])


def _predict(dims: int, model, _task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    langs, prototypes = model.value
    rows: dict[int, int] = {}
    vectors = np.zeros((1024, dims), np.int8)
    for batch in batches:
        labels, scores = [], []
        for text in batch.column("text").to_pylist():
            grams, counts = ngrams(text)
            if not len(grams) or not langs:
                labels.append("und")
                scores.append(0.0)
                continue
            v = np.zeros(dims, np.float32)
            for at in range(0, len(grams), AT_ONCE):
                part = grams[at : at + AT_ONCE].tolist()
                if len(rows) + len(part) > REMEMBERED:
                    rows.clear()
                for g in part:
                    if g not in rows:
                        if len(rows) == len(vectors):
                            vectors = np.concatenate([vectors, np.zeros_like(vectors)])
                        vectors[len(rows)] = ngram_vector(g, dims)
                        rows[g] = len(rows)
                v += counts[at : at + AT_ONCE].astype(np.float32) @ vectors[[rows[g] for g in part]].astype(np.float32)
            cosines = prototypes @ (v / max(float(np.linalg.norm(v)), 1e-9))
            best = int(np.argmax(cosines))
            labels.append(langs[best])
            scores.append(float(min(1.0, max(0.0, cosines[best]))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 1024) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (cosine, 0 to 1).

    Rows that are not held out (crc32 of the id as text, modulo 4, is not 2) and have a language train; a null id is
    the empty text.  lang_pred is und, with score 0, if the text is null or has no letter or nothing was learned; among
    equal cosines the first language by name is taken.  Repeated rows train as often as they occur and give repeated
    rows; no rows give no rows; other columns are left out.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"), col(lang_col).cast("string").alias("lang"), held_out(col(id_col)).alias("held_out"))
    counts = arrow_rows(base.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"), _train, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bundles = arrow_rows(counts, partial(_bundle, dims), "lang string, dim int, v double").groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    model: dict[str, np.ndarray] = {}
    for r in stored(bundles, "prototypes").collect():  # dims numbers for each language
        model.setdefault(r.lang, np.zeros(dims))[r.dim] = r.v
    langs = sorted(model)
    prototypes = np.array([model[x] / max(np.linalg.norm(model[x]), 1e-9) for x in langs]) if langs else np.zeros((0, dims))
    if len(langs) > 1:
        prototypes -= prototypes.mean(axis=0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    shipped = spark.sparkContext.broadcast((langs, prototypes.astype(np.float32)))
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(base.select("id", "held_out", "text"), partial(_predict, dims, shipped), f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
