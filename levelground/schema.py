"""Schemas of clouds and results.  A point is a row; its identity is an explicit pid, as rows have no position."""

from pyspark.sql import types as T

CLOUD = T.StructType([T.StructField("cloud_id", T.StringType()), T.StructField("pid", T.LongType()), *[T.StructField(c, T.FloatType()) for c in ("x", "y", "z", "intensity")]])
CANDIDATE = "attempt long, seed_pid long, seed_x double, seed_y double, seed_z double, data_confidence double, relief double, roughness double, patch_radius double, score double"
GROWTH = "rung int, radius double, n long, flat boolean, circularity double, area double, perimeter double, a double, b double, c double, d double, relief double, roughness double, cx double, cy double, reach double, max_z double"
HULL = "n_vertices int, area double, perimeter double, circularity double"
EMPTY_METRIC = -1.0
