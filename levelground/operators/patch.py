"""Operators on patches: points grouped by some keys (an attempt, a rung, a simulation...), as plain group-bys where SQL
can say it and Arrow functions for hulls, which merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.functions.geometry import hull2d, hull2d_rows, hull3d, hull3d_area, measured_hull
from levelground.operators.cloud import classify, normals
from levelground.schema import EMPTY_METRIC, HULL


def at_least(patches: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """Groups of at least n points, with n_points."""
    return patches.groupBy(*by).agg(F.count("*").alias("n_points")).where(F.col("n_points") >= n)


def local_normals(patches: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, pid, nx, ny, nz, slope_deg from the k nearest points of the patch itself (not of the cloud)."""
    return normals(patches, k, tuple(by)).select(*by, "pid", "nx", "ny", "nz", "slope_deg")


def classified(patches: DataFrame, by: list[str], limit: float, k: int) -> DataFrame:
    """Patch points with slope_deg and inlier; a point without a normal is an outlier."""
    return patches.join(local_normals(patches, by, k).select(*by, "pid", "slope_deg"), [*by, "pid"], "left").withColumn("inlier", classify(F.col("slope_deg"), limit))


def flatness(points: DataFrame, by: list[str]) -> DataFrame:
    """n_points, n_outliers and flat (no outlier) from classified points."""
    outliers = F.count_if(~F.col("inlier"))
    return points.groupBy(*by).agg(F.count("*").alias("n_points"), outliers.alias("n_outliers"), (outliers == 0).alias("flat"))


def relief(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.coalesce(F.max("z") - F.min("z"), F.lit(EMPTY_METRIC)).alias("relief"))


def plane_distance() -> Column:
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) / norm


def roughness(points: DataFrame, planes: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square distance of a group's points to its plane (a, b, c, d); -1 without a plane."""
    joined = points.join(planes.select(*by, "a", "b", "c", "d"), by, "left")
    return joined.groupBy(*by).agg(F.coalesce(F.sqrt(F.avg(F.pow(plane_distance(), 2))), F.lit(EMPTY_METRIC)).alias("roughness"))


def patch_data(points: DataFrame, by: list[str]) -> DataFrame:
    """cx, cy (mean), reach (the largest distance to it on the ground) and max_z."""
    centre = points.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    return points.join(centre, by).groupBy(*by, "cx", "cy").agg(far.alias("reach"), F.max("z").alias("max_z"))


#: Rows that a task holds before it looks for their hulls, and the parts of one group that are merged apart.
HELD, PARTS = 20_000, 32


def _corners(table: pa.Table, by: list[str], axes: str, rows_of: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """Of each group of the table, the rows that span its hull."""
    codes = np.zeros((table.num_rows, 1), np.int64)
    for c in by:
        codes = np.column_stack([codes, table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)])
    group = np.unique(codes, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(group, kind="stable")
    at = np.column_stack([table[c].to_numpy().astype(float) for c in axes])
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    return table.take(np.sort(np.concatenate([rows[rows_of(at[rows])] for rows in np.split(order, cuts)])))


def spanning(points: DataFrame, by: list[str], axes: str) -> DataFrame:
    """by and axes of points that have the same hulls as all points: each task leaves out what lies inside the hull of what
    it has met, and holds at most some HELD rows beside one batch.  Where patches are small nothing is left out, and rows
    pass through."""
    rows_of = hull2d_rows if axes == "xy" else lambda xyz: hull3d(xyz)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                table = _corners(pa.Table.from_batches(held), by, axes, rows_of)
                held, n = table.to_batches(), table.num_rows
                if n > HELD // 2:  # little was left out
                    yield from held
                    held, n = [], 0
        if n:
            yield from _corners(pa.Table.from_batches(held), by, axes, rows_of).to_batches()

    few = points.select(*by, *axes)
    return few.mapInArrow(run, few.schema)


def _hull_of_hulls(points: DataFrame, by: list[str], axes: str, measure: Callable[[np.ndarray], tuple], kinds: str) -> DataFrame:
    """by and measure(vertices of the group's hull).  Hulls of what tasks hold, of parts of a group, and of the group: a
    group that every task has points of moves as vertices alone, and no task gets more than PARTS hulls of it."""

    def last(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *measure(group[list(axes)].to_numpy(float)))])

    part = F.pmod(F.xxhash64(*axes), F.lit(PARTS))
    merged = spanning(spanning(points, by, axes).withColumn("_part", part).repartition(*by, "_part"), by, axes)
    keys = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)
    return merged.groupBy(*by).applyInPandas(last, f"{keys}, {kinds}")


def hulls(points: DataFrame, by: list[str]) -> DataFrame:
    """n_vertices, area, perimeter and circularity of each patch's convex hull on the ground; n_vertices of less than three
    different points is their number, and the others are 0."""
    return _hull_of_hulls(points, by, "xy", lambda xy: measured_hull(hull2d(xy)), HULL)


def hull_vertices(points: DataFrame, by: list[str]) -> DataFrame:
    """by and vertices: array<struct<x, y>> of each patch's hull on the ground, counterclockwise from the least (x, y)."""
    return _hull_of_hulls(points, by, "xy", lambda xy: ([{"x": x, "y": y} for x, y in hull2d(xy).tolist()],), "vertices array<struct<x: double, y: double>>")


def density2d(points: DataFrame, by: list[str]) -> DataFrame:
    """Points per square metre of the hull on the ground; -1 if it has no area."""
    n = points.groupBy(*by).agg(F.count("*").alias("n_points"))
    return _density(hulls(points, by), n, by)


def density3d(points: DataFrame, by: list[str]) -> DataFrame:
    """Points per square metre of the surface of the convex hull in space; -1 if there is none."""
    n = points.groupBy(*by).agg(F.count("*").alias("n_points"))
    return _density(_hull_of_hulls(points, by, "xyz", lambda xyz: (hull3d_area(xyz),), "area double"), n, by)


def _density(areas: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    return areas.join(n, by).select(*by, F.when(F.col("area") > 0, F.col("n_points") / F.col("area")).otherwise(EMPTY_METRIC).alias("data_confidence"))


def blocked(patches: DataFrame, cloud: DataFrame, by: list[str], margin: float = 0.01, clearance: float = 10.0, step: float = 0.2, cell: float = 4.0, on: tuple[str, ...] = ()) -> DataFrame:
    """Keys of patches (cx, cy, reach, max_z) with an obstacle: a point over max_z + margin inside one of the spheres of
    radius reach whose centres stand over the patch from max_z to max_z + clearance, step apart.

    The sphere that is nearest in height decides, so one comparison does for all.  Patches are spread over all the cells
    their reach touches, of a side that keeps these few, and meet the points of their cells only.
    """
    steps = int(np.ceil(clearance / step))
    sides = lambda c, r: F.sequence(F.floor((F.col(c) - F.col(r)) / cell), F.floor((F.col(c) + F.col(r)) / cell))
    spread = patches.select(*by, *[c for c in on if c not in by], "cx", "cy", "reach", "max_z").withColumn("_cx", F.explode(sides("cx", "reach"))).withColumn("_cy", F.explode(sides("cy", "reach")))
    points = cloud.select(*on, "x", "y", "z", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    near = spread.join(points, [*on, "_cx", "_cy"])
    i = F.least(F.lit(float(steps)), F.greatest(F.lit(0.0), F.round((F.col("z") - F.col("max_z")) / step)))
    up = F.col("z") - (F.col("max_z") + step * i)
    h2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    return near.where((F.col("z") > F.col("max_z") + margin) & (h2 + up * up < F.col("reach") * F.col("reach"))).select(*by).distinct()


def clear(patches: DataFrame, cloud: DataFrame, by: list[str], **how) -> DataFrame:
    return patches.join(blocked(patches, cloud, by, **how), by, "left_anti")


METRICS = ("ALL", "DATA_CONFIDENCE", "RELIEF", "ROUGHNESS")


def hazard(points: DataFrame, metric: str = "ALL", planes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """metric, data_confidence, relief, roughness and score of a cloud's inliers, or of each group.

    Only what the metric names is computed and the others are 0; score = confidence - relief - roughness, with -1 for a
    metric that could not be computed left in.  A name that is not in METRICS gives zeros.  Without a given plane, one is
    fitted to the points.
    """
    from levelground.operators.cloud import plane

    keys = list(by) or ["_all"]
    points = points if by else points.withColumn("_all", F.lit(1))
    out = points.groupBy(*keys).agg(F.lit(metric).alias("metric")) if by else points.sparkSession.range(1).select(F.lit(1).alias("_all"), F.lit(metric).alias("metric"))
    wanted = set(METRICS[1:]) if metric == "ALL" else {metric}
    empty = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = out.join(empty, keys, "left")
    if "DATA_CONFIDENCE" in wanted:
        out = out.join(density2d(points, keys), keys, "left")
    if "RELIEF" in wanted:
        out = out.join(relief(points, keys), keys, "left")
    if "ROUGHNESS" in wanted:
        fitted = plane(points, tuple(keys)) if planes is None else (planes if by else planes.withColumn("_all", F.lit(1)))
        out = out.join(roughness(points, fitted, keys), keys, "left")
    for c in ("data_confidence", "relief", "roughness"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)) if c in out.columns else F.lit(0.0))
    return out.select(*by, "metric", "data_confidence", "relief", "roughness", (F.col("data_confidence") - F.col("relief") - F.col("roughness")).alias("score"))


def within_limits(candidates: DataFrame, min_radius: float = 2.5, max_slope: float = 25.0, min_density: float = 30.0, max_relief: float = 0.25, max_roughness: float = 0.02) -> DataFrame:
    """Candidates that keep to all thresholds."""
    ok = (F.col("patch_radius") >= min_radius) & (F.col("slope_deg") <= max_slope) & (F.col("data_confidence") >= min_density)
    return candidates.where(ok & (F.col("relief") <= max_relief) & (F.col("roughness") <= max_roughness))
