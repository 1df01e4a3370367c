"""What the operators of this subpackage share: stored intermediates, size-checked semi-joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

#: Rows of (id or hash) that may be broadcast: 16 to 24 bytes each, so at most some 25 MB.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode without one, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_DIR.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="levelground-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts the lineage, so that lost executors
    cost no recomputation of what came before, and row ids made while writing stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/levelground-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text): whatever other columns the input has, none can clash later.  A null text is empty."""
    return df.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))


def semi(df: DataFrame, keys: DataFrame, on: list[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose `on` is among keys.  The keys are broadcast after their number was checked, and shuffled
    beyond the limit."""
    return df.join(F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys, on, "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Adds a redundant join key, so that a join after an aggregation on the same keys shuffles anew and adaptive
    execution can split a hot key's partition."""
    return df.withColumn("_spread", F.xxhash64(*keys) % 16381)


#: Rows that a Python function, and Spark's side of it, holds at a time, and bytes of them in one batch of Arrow.
ROWS, BATCH_BYTES = 512, 8 << 20


def arrow_rows(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """mapInArrow over (task number, iterator of batches of at most ROWS rows).

    Lowers the session's bounds of Arrow batches to ROWS and BATCH_BYTES where they are higher: Spark's own, made for
    narrow rows, would hold tens of MB of texts several times on either side."""
    _lower(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    _lower(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))
        try:
            yield from make(TaskContext.get().partitionId(), parts)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def _lower(spark: SparkSession, key: str, most: int) -> None:
    now = spark.conf.get(key)
    now = int(now) if now.isdigit() else 0  # with a unit or a sign: not lower
    if not 0 < now <= most:
        spark.conf.set(key, most)


def give_back() -> None:
    """Returns freed memory to the system, as workers live on and serve other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of (a, b) links between long ids: (id, label), label the smallest id of its component,
    for every id of edges.  Smallest labels of neighbours spread and labels jump to their label's label, each round
    written to the shared folder, so that a chain of n ids takes about log n rounds and nothing is collected."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # the old label also hears of the lower one, and everyone then takes its label's label
        told = low.select(F.col("label").alias("id"), "low").unionByName(low.select("id", "low")).groupBy("id").agg(F.min("low").alias("low"))
        told = stored(told, "told")
        jump = told.alias("x").join(told.select(F.col("id").alias("low"), F.col("low").alias("next")), "low", "left").select("id", F.least("low", F.coalesce("next", "low")).alias("label"))
        new = stored(jump, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
