"""Clouds made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terrain of 37.5 points per square metre over all of orders: a gentle slope, a ramp of 31 degrees and obstacles
    overhead.  kx and ky are the lattice integers of x and y."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    side = orders.agg(F.sqrt(F.count("*") / F.lit(37.5)).alias("l"))
    k = F.col("o_orderkey").cast("long")
    t = orders.crossJoin(F.broadcast(side)).select(k.alias("pid"), (k * 7919 % 10007).alias("kx"), (k * 3571 % 10009).alias("ky"), F.col("o_totalprice").cast("double").alias("price"), "l")  # one row
    t = t.withColumns({"x": F.col("l") * F.col("kx") / F.lit(10007.0), "y": F.col("l") * F.col("ky") / F.lit(10009.0)})
    z = F.lit(4e-8) * F.col("price") + F.when(F.col("x") > F.col("l") / 2, F.lit(0.6) * (F.col("x") - F.col("l") / 2)).otherwise(F.lit(0.05) * F.col("x"))
    z = z + F.when((F.col("pid") % 97 == 0) & (F.col("y") > F.lit(0.75) * F.col("l")), F.lit(2.0)).otherwise(F.lit(0.0))
    return t.select(F.lit("orders").alias("cloud_id"), "pid", "kx", "ky", "x", "y", z.alias("z"), (F.col("pid") * 31 % 5).cast("double").alias("intensity"))
