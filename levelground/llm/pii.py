"""Personal data by bootstrapped contextual extraction.

What the base patterns find are the seeds.  The two words to the left of a seed, the word on each side of it, or one
neighbouring word with the seed's shape of digits and letters, are a lexical pattern of its kind; the same patterns around other identifier-like tokens (with a digit or an @) make a graph
of patterns and instances.  Each round scores every pattern by how many distinct instances of its kind are known
already, takes those of at least `min_support` known instances and `min_precision` among the known, if no more than half
of all are unknown, and learns the tokens they enclose as new instances; so entities found in one round raise other patterns in the next.  Tokens so learned are spans of
their kind beside the base ones, which always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.llm._common import arrow_rows, id_text, spread, stored
from levelground.llm.spans import PRIVATE_KINDS, digest, listed, private_spans

_MARK = re.compile("[0-9@]")
_REST = re.compile(r"\S*")
#: Code points of a neighbouring word that a pattern takes at most, those nearest to what it stands by.
REACH = 64
_NEXT = re.compile(r"\s*(\S{1,%d})" % REACH)
_DIGITS, _LETTERS = re.compile("[0-9]+"), re.compile("[^\\W\\d_]+")
_TRIM = ".,;:!?()[]{}<>\"'|"

_SCHEMA = "doc string, base array<struct<start:int,stop:int,kind:string>>, tokens array<struct<start:int,stop:int,kind:string,instance:string,pattern:array<string>>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
_TOKEN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("instance", pa.string()), ("pattern", pa.list_(pa.string()))])


def shape(token: str) -> str:
    """Its kinds of characters in order, runs as one: 9 for digits, a for letters."""
    return _LETTERS.sub("a", _DIGITS.sub("9", token))


def patterns(text: str, start: int, stop: int) -> list[str]:
    """Lexical contexts of text[start:stop], the two words before it, the words on either side, and the word
    on one side with the shape of what it stands by.  Of a word its REACH nearest code points count, so that a text without white
    space takes time and memory in proportion to its length."""
    before, after, at = [], [], start
    for _ in range(2):
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        at = end
        while at > max(0, end - REACH) and not text[at - 1].isspace():
            at -= 1
        if at < end:
            before.append(text[at:end].lower())
    if m := _NEXT.match(text, stop):
        after.append(m.group(1).lower())
    out, own = [], shape(text[start:stop])
    if len(before) == 2:
        out.append(f"{before[1]} {before[0]} _")
    if before and after:
        out.append(f"{before[0]} _ {after[0]}")
    if before:
        out.append(f"{before[0]} <{own}>")
    if after:
        out.append(f"<{own}> {after[0]}")
    return out


def identifier_like(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space with an @ or at least four digits, without the punctuation at their ends."""
    m = _MARK.search(text)
    while m:
        s, e = m.start(), _REST.match(text, m.start()).end()
        while s and not text[s - 1].isspace():
            s -= 1
        token = text[s:e]
        start, stop = s + len(token) - len(token.lstrip(_TRIM)), e - len(token) + len(token.rstrip(_TRIM))
        if start < stop and ("@" in token or sum(c.isdigit() for c in token) >= 4):
            yield start, stop
        m = _MARK.search(text, e)


def scan(text: str) -> tuple[list, list]:
    base = private_spans(text)
    tokens = [{"start": s, "stop": e, "kind": k, "instance": text[s:e], "pattern": patterns(text, s, e)} for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    i = 0
    for s, e in identifier_like(text):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if any(a < e and s < b for a, b in taken[max(0, i - 8) : i + 8]):
            continue
        tokens.append({"start": s, "stop": e, "kind": None, "instance": text[s:e], "pattern": patterns(text, s, e)})
    return [{"start": s, "stop": e, "kind": k} for s, e, k in base], tokens


def _scan(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([b for b, _ in found], pa.list_(_SPAN)), pa.array([t for _, t in found], pa.list_(_TOKEN))], ["doc", "base", "tokens"])


def _finish(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(PRIVATE_KINDS)}
    for batch in batches:
        out = {"doc": batch.column("doc").to_pylist()} | {f"n_{k}": [] for k in PRIVATE_KINDS} | {"base_sha256": [], "spans": [], "n_learned": []}
        for base, more in zip(batch.column("base").to_pylist(), batch.column("learned").to_pylist()):
            own = [(x["start"], x["stop"], x["kind"]) for x in base]
            learned = {(x["start"], x["stop"], x["kind"]) for x in more or ()}
            for k in PRIVATE_KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in own))
            out["base_sha256"].append(digest(own))
            out["spans"].append(listed(sorted([*own, *learned], key=lambda x: (x[0], order[x[2]]))))
            out["n_learned"].append(len(learned))
        kinds = [pa.string()] + [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 50, min_support: int = 5, min_precision: float = 0.8, min_known: float = 0.5) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and learned),
    n_learned.

    Null or empty texts have no spans; repeated rows give repeated rows; no rows give no rows; other columns are left
    out.  A token that patterns of several kinds teach takes the kind of the highest precision, then the first listed.

    rounds: the most of scoring and learning, which ends when a round teaches nothing.  min_support: known distinct
    instances that a pattern needs.  min_precision: share of those whose kind is known
    that must be of this one.  min_known: share of all its distinct instances whose kind must be known.
    """
    kind_of_id = docs.schema[id_col].dataType
    texts = id_text(docs, id_col, text_col).select(F.col("id").cast("string").alias("doc"), "text")
    found = stored(arrow_rows(texts, _scan, _SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "private")
    tokens = found.where(F.size("tokens") > 0).select("rid", F.inline("tokens"))
    edges = stored(tokens.select("instance", "kind", F.explode("pattern").alias("pattern")).groupBy("pattern", "instance").agg(F.min("kind").alias("kind")), "private-edges")
    known = stored(tokens.where("kind IS NOT NULL").select("instance", "kind").distinct(), "private-known")
    ordered = F.array_position(F.array(*map(F.lit, PRIVATE_KINDS)), F.col("kind"))
    for _ in range(rounds):
        seen = spread(edges.drop("kind"), "instance").join(spread(known, "instance"), ["instance", "_spread"], "left")
        per_kind = seen.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("support"))
        total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
        judged = per_kind.groupBy("pattern").agg(F.sum("support").alias("judged"))
        good = per_kind.where(F.col("support") >= min_support).join(judged, "pattern").join(total, "pattern").withColumn("precision", F.col("support") / F.col("judged"))
        good = good.where((F.col("precision") >= min_precision) & (F.col("judged") >= min_known * F.col("total")))
        # only a pattern that encloses unknown instances can teach any
        good = stored(good.where("judged < total").select("pattern", "kind", "precision"), "private-patterns")
        if not good.limit(1).count():
            break
        first = Window.partitionBy("instance").orderBy(F.desc("precision"), ordered)
        unknown = seen.where("kind IS NULL").select("pattern", "instance")
        taught = unknown.join(good, "pattern").groupBy("instance", "kind").agg(F.max("precision").alias("precision"))
        taught = stored(taught.withColumn("n", F.row_number().over(first)).where("n = 1").select("instance", "kind"), "private-taught")
        if not taught.limit(1).count():
            break
        known = stored(known.unionByName(taught), "private-known")
    # an instance that a base pattern found elsewhere is known here too, by the first kind listed if it has several
    one = known.groupBy("instance").agg(F.min_by("kind", ordered).alias("kind"))
    unknown = tokens.where("kind IS NULL").drop("kind", "pattern")
    new = spread(unknown, "instance").join(spread(one, "instance"), ["instance", "_spread"]).groupBy("rid").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("learned"))
    out = arrow_rows(found.select("doc", "rid", "base").join(new, "rid", "left").select("doc", "base", "learned"), _finish, "doc string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_learned long")
    return out.select(F.col("doc").cast(kind_of_id).alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_learned")


def op1_pii(spark, sf_dir):
    return private_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
