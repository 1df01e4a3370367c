"""Secret scans with corpus-wide ownership frequency.

Candidates are what the base patterns find, and tokens that look generated (long, of mixed kinds of characters, of high
entropy).  Each candidate value's hash is counted over the corpus by distinct repositories and distinct owners.  A value
that many owners share is a widely copied example; one that looks generated and that few own is a live-looking
credential.  Base spans always stay and are labelled; tokens outside them are spans of kind token if live-looking.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.llm._common import arrow_rows, col, spread, stored
from levelground.llm.spans import SECRET_KINDS, digest, listed, secret_spans

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_SCHEMA = "doc string, repo string, owner string, found array<struct<start:int,stop:int,kind:string,hash:string,looks:boolean>>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("hash", pa.string()), ("looks", pa.bool_())])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_generated(value: str) -> bool:
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return len(value) >= 12 and kinds >= 2 and bool(re.search("[0-9]", value)) and entropy(value) >= 3.0


def scan(text: str) -> list[dict]:
    base = secret_spans(text)
    out = [{"start": s, "stop": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "looks": looks_generated(v)} for s, e, k, v in base]
    ends, stop = [], 0  # of base spans, by start: the farthest end so far
    for _, e, _, _ in base:
        stop = max(stop, e)
        ends.append(stop)
    starts = [s for s, _, _, _ in base]
    for m in TOKEN.finditer(text):
        v, before = m.group(), bisect_left(starts, m.end())  # base spans that begin before the token ends
        if all(re.search(p, v) for p in ("[a-z]", "[A-Z]", "[0-9]")) and entropy(v) >= 3.5 and not (before and ends[before - 1] > m.start()):
            out.append({"start": m.start(), "stop": m.end(), "kind": "token", "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "looks": True})
    return out


def _scan(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([scan(t) for t in batch.column("text").to_pylist()], pa.list_(_SPAN))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("repo"), batch.column("owner"), found], ["doc", "repo", "owner", "found"])


def _finish(_task: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*SECRET_KINDS, "token"))}
    for batch in batches:
        out = {"doc": batch.column("doc").to_pylist()} | {f"n_{k}": [] for k in SECRET_KINDS} | {"base_sha256": [], "spans": [], "n_live": [], "n_copied": []}
        for found, counts in zip(batch.column("found").to_pylist(), batch.column("counts").to_pylist()):
            spread_of = {x["hash"]: x["copied"] for x in counts or ()}
            base = [(x["start"], x["stop"], x["kind"]) for x in found if x["kind"] != "token"]
            live = [x for x in found if x["looks"] and not spread_of.get(x["hash"], True)]
            more = [(x["start"], x["stop"], x["kind"]) for x in live if x["kind"] == "token"]
            for k in SECRET_KINDS:
                out[f"n_{k}"].append(sum(x[2] == k for x in base))
            out["base_sha256"].append(digest(base))
            out["spans"].append(listed(sorted([*base, *more], key=lambda x: (x[0], order[x[2]]))))
            out["n_live"].append(len(live))
            out["n_copied"].append(sum(spread_of.get(x["hash"], False) for x in found if x["kind"] != "token"))
        kinds = [pa.string()] + [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex (base spans), base_sha256, spans (base ones and
    live-looking tokens), n_live, n_copied.

    A value is widely copied if more than max_owners owners hold it, or more than one in more than max_repos
    repositories; what one owner alone holds is theirs however often they copy it.  Null or empty
    texts have no spans; a null owner or repository is one of its own; repeated rows give repeated rows and are one
    repository's; no rows give no rows; other columns are left out.
    """
    kind_of_id = docs.schema[id_col].dataType
    texts = docs.select(col(id_col).cast("string").alias("doc"), F.coalesce(col(repo_col).cast("string"), F.lit("\x00")).alias("repo"), F.coalesce(col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = stored(arrow_rows(texts, _scan, _SCHEMA).withColumn("rid", F.monotonically_increasing_id()), "secrets")
    at = found.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found.hash").alias("hash")).distinct()
    # Distinct pairs first: a value that a third of all rows hold is a few rows per task before anything moves.
    owners = at.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repos = at.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    held = stored(owners.join(repos, "hash").select("hash", ((F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("repos") > max_repos))).alias("copied")), "secret-owners")
    counts = spread(at.select("rid", "hash"), "hash").join(spread(held, "hash"), ["hash", "_spread"]).groupBy("rid").agg(F.collect_list(F.struct("hash", "copied")).alias("counts"))
    out = arrow_rows(found.select("doc", "rid", "found").join(counts, "rid", "left").select("doc", "found", "counts"), _finish, "doc string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_copied long")
    return out.select(F.col("doc").cast(kind_of_id).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")


def op4_secret_scan(spark, sf_dir):
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
