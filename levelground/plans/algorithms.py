"""Zone finders that configurations name, and their Monte-Carlo comparison.

Only the growing circles are defined by code; the others are known by name and parameters alone and are extensions of
our own: region growing after Rabbani et al. 2006 with the curvature of Pauly et al. 2002, and grid cells, separate or
overlapping, that keep to the hazard limits, clustered with their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelground.functions.geometry import covariance, slope, with_normal
from levelground.operators.cloud import STEP, normals, off_edge, terrains, valid, with_index
from levelground.operators.growth import candidates, first_zones
from levelground.operators.patch import within_limits
from levelground.operators.spatial import radius_join
from levelground.operators.storage import stored
from levelground.plans.config import Benchmark
from levelground.sources.pcd import load_cloud


#: Cells (powers of two) along the side of the first blocks and how much wider the next ones are; edges that one call may have.
FIRST_BLOCK, WIDER, AT_LAST = 5, 3, 200_000


def clusters(edges: DataFrame, nodes: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(id, cluster): connected components of edges over nodes (id), named by their least id.

    edges: on, a, b and the cells (ax, ay, bx, by) that both lie in; ends are near each other by and large.  Edges inside a block
    of cells are joined up in one call, and of the others each end becomes the least id that it is joined to; they go on in blocks
    of eight times the side, so that what a call gets grows with a block's border.  The few that are left at last, or those
    that any block holds, take one call.  So the passes grow with the logarithm of the cloud's side, not with the steps
    from one end of a cluster to the other."""

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        id, least = least_joined(group["a"].to_numpy(), group["b"].to_numpy())
        return pd.DataFrame({"id": id, "cluster": least})

    left, ends, maps, size = edges.select(*on, "a", "b", "ax", "ay", "bx", "by"), ("ax", "ay", "bx", "by"), [], FIRST_BLOCK
    while True:
        whole = size > 62 - WIDER or (bool(maps) and left.count() <= AT_LAST)
        at = {c: F.lit(0) if whole else F.expr(f"shiftright({c}, {size})") for c in ends}
        inside = (at["ax"] == at["bx"]) & (at["ay"] == at["by"])
        block = [*([] if whole else on), at["ax"].alias("_bx"), at["ay"].alias("_by")]
        maps.append(stored(left.where(inside).groupBy(*block).applyInPandas(joined, "id long, cluster long"), "joined"))
        if whole:
            break
        left = left.where(~inside)
        for c in "ab":
            left = left.join(maps[-1].withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("cluster", c)).drop("cluster")
        left = stored(left.select(*on, "a", "b", *[at[c].alias(c) for c in ends]).distinct().select(*on, "a", "b", *[F.expr(f"shiftleft({c}, {size})").alias(c) for c in ends]), "between")
        size += WIDER
    of = maps.pop()
    while maps:
        step = maps.pop()
        wider = step.join(of.select(F.col("id").alias("cluster"), F.col("cluster").alias("_next")), "cluster", "left").select("id", F.coalesce("_next", "cluster").alias("cluster"))
        of = wider.unionByName(of)
    return stored(nodes.select("id").join(of, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the least id that each is joined to over edges a, b), of those that are joined to a lesser one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    of, (u, v) = np.arange(len(ids)), at.reshape(2, -1)
    while len(u):
        np.minimum.at(of, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := of[of], of):
            of = up
        u, v = of[u], of[v]
        u, v = u[apart := u != v], v[apart]
    lesser = of != np.arange(len(ids))
    return ids[lesser], ids[of[lesser]]


def curvature() -> Column:
    """Least eigenvalue over the sum of all three."""
    total = F.col("xx") + F.col("yy") + F.col("zz")
    return F.when(total > 0, F.greatest(F.col("lam"), F.lit(0.0)) / total)


def region_growing(cloud: DataFrame, curvature_threshold: float = 0.05, min_cluster_size: int = 50, cluster_tolerance: float = 0.25, k: int = 10, alpha: float = 0.1, smoothness: float = 10.0, on: tuple[str, ...] = ()) -> DataFrame:
    """on, pid, cluster and size of smooth regions.

    Two points within the tolerance are linked if their heights differ by at most alpha and their normals by at most
    `smoothness` degrees.  Points of low curvature grow a region over all links between them; other points end one: they join
    the linked region that would have been grown first, that of the point of least curvature (ties by number)."""
    surface = normals(cloud, k, on, "xyz").select(*on, "pid", "x", "y", "z", "nx", "ny", "nz", curvature().alias("curvature")).where("curvature IS NOT NULL")
    surface = stored(surface.withColumn("id", F.monotonically_increasing_id() if on else F.col("pid")).withColumn("smooth", F.col("curvature") <= curvature_threshold), "surface")
    left = surface.where("smooth").select(*on, F.col("id").alias("a"), *[F.col(c).alias(f"seed_{c}") for c in "xyz"], *[F.col(f"n{c}").alias(f"m{c}") for c in "xyz"])
    right = surface.select(*on, F.col("id").alias("b"), "x", "y", "z", "nx", "ny", "nz", "smooth")
    alike = F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") + F.col("mz") * F.col("nz") >= math.cos(math.radians(smoothness))
    links = radius_join(left, right, cluster_tolerance, on).where(alike & (F.abs(F.col("z") - F.col("seed_z")) <= alpha) & (F.col("a") != F.col("b")))
    cells = [F.floor(F.col(c) / cluster_tolerance).alias(n) for c, n in (("seed_x", "ax"), ("seed_y", "ay"), ("x", "bx"), ("y", "by"))]
    links = stored(links.where(~F.col("smooth") | (F.col("a") < F.col("b"))).select(*on, "a", "b", "smooth", *cells), "links")
    grown = clusters(links.where("smooth"), surface.where("smooth").select("id"), on)
    first = grown.join(surface.select("id", "curvature"), "id").groupBy("cluster").agg(F.min("curvature").alias("least"))
    ends = links.where("NOT smooth").join(grown.withColumnRenamed("id", "a"), "a").join(first, "cluster").groupBy("b").agg(F.min(F.struct("least", "cluster")).alias("of"))
    found = stored(grown.unionByName(ends.select(F.col("b").alias("id"), F.col("of.cluster").alias("cluster"))), "regions")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_cluster_size)
    return surface.select(*on, "pid", "id").join(found.join(sizes, "cluster"), "id").select(*on, "pid", "cluster", "size")


def _kept(cells: DataFrame, area: float, max_slope: float, min_density: float, max_relief: float, max_roughness: float) -> DataFrame:
    """Of groups with covariances, n and relief, those that keep to the limits."""
    fit = with_normal(cells).withColumn("slope_deg", slope()).withColumn("density", F.col("n") / F.lit(area))
    fit = fit.withColumn("roughness", F.sqrt(F.greatest(F.col("lam"), F.lit(0.0))))
    ok = (F.col("slope_deg") <= max_slope) & (F.col("density") >= min_density) & (F.col("relief") <= max_relief) & (F.col("roughness") <= max_roughness)
    return fit.where(ok).withColumnRenamed("mz", "z")


def cell_zones(cloud: DataFrame, cell_size: float = 1.0, overlap: int = 1, max_slope: float = 25.0, min_density: float = 30.0, max_relief: float = 0.25, max_roughness: float = 0.02, on: tuple[str, ...] = ()) -> DataFrame:
    """Square cells that keep to the hazard limits: on, gx, gy, n, density, relief, roughness, slope_deg and mean height z.
    overlap 2 puts a cell at every half side, so that each point is in four."""
    pitch = cell_size / overlap
    i = [F.explode(F.sequence(F.floor((F.col(c) - cell_size) / pitch) + 1, F.floor(F.col(c) / pitch))) for c in "xy"]
    cells = cloud.withColumn("gx", i[0]).withColumn("gy", i[1]).groupBy(*on, "gx", "gy").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("relief"), *covariance())
    return _kept(cells, cell_size * cell_size, max_slope, min_density, max_relief, max_roughness).select(*on, "gx", "gy", "n", "density", "relief", "roughness", "slope_deg", "z")


def radius_zones(cloud: DataFrame, cell_size: float = 1.0, max_slope: float = 25.0, min_density: float = 30.0, max_relief: float = 0.25, max_roughness: float = 0.02, on: tuple[str, ...] = ()) -> DataFrame:
    """As cell_zones, but of each occupied cell the points within half its side of the centroid, wherever they lie, are
    weighed (density over the circle), so that a zone is not cut at its cell's border."""
    cell = [F.floor(F.col(c) / cell_size).alias(f"g{c}") for c in "xy"]
    seeds = cloud.groupBy(*on, *cell).agg(*[F.avg(c).alias(f"seed_{c}") for c in "xyz"])
    near = radius_join(seeds, cloud.select(*on, "x", "y", "z"), cell_size / 2, on)
    groups = near.groupBy(*on, "gx", "gy").agg(F.count("*").alias("n"), (F.max("z") - F.min("z")).alias("relief"), *covariance())
    return _kept(groups, math.pi * cell_size * cell_size / 4, max_slope, min_density, max_relief, max_roughness).select(*on, "gx", "gy", "n", "density", "relief", "roughness", "slope_deg", "z")


def clustered_cells(zones: DataFrame, cell_size: float = 1.0, overlap: int = 1, tolerance: float = 1.0, alpha: float = 0.1, on: tuple[str, ...] = ()) -> DataFrame:
    """on, gx, gy, cluster: cells whose corners are at most the tolerance apart and whose mean heights differ by at most
    alpha belong together."""
    pitch = cell_size / overlap
    a = stored(zones.select(*on, "gx", "gy", "z", (F.col("gx") * F.lit(1 << 31) + F.col("gy")).alias("own") if not on else F.monotonically_increasing_id().alias("own")), "cells")
    at = [(F.col(f"g{c}") * pitch).alias(f"seed_{c}") for c in "xy"]
    left = a.select(*on, F.col("own").alias("a"), F.col("z").alias("height"), *at, F.lit(0.0).alias("seed_z"))
    right = a.select(*on, F.col("own").alias("b"), F.col("z").alias("level"), *[(F.col(f"g{c}") * pitch).alias(c) for c in "xy"], F.lit(0.0).alias("z"))
    edges = radius_join(left, right, tolerance * (1 + 1e-9), on, inclusive=True).where((F.col("a") < F.col("b")) & (F.abs(F.col("height") - F.col("level")) <= alpha))
    cells = [F.floor(F.col(c) / max(tolerance, pitch)).alias(n) for c, n in (("seed_x", "ax"), ("seed_y", "ay"), ("x", "bx"), ("y", "by"))]
    edges = stored(edges.select(*on, "a", "b", *cells), "links")
    return a.join(clusters(edges, a.select(F.col("own").alias("id")), on).withColumnRenamed("id", "own"), "own").select(*on, "gx", "gy", "cluster")


def simulated_zones(cloud: DataFrame, simulations: DataFrame, max_attempts: int, radius: float, k: int, limit: float, increment: float, max_rungs: int | None = None, zones: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, max_relief: float | None = None) -> DataFrame:
    """Zones of each simulation (sim, salt): one plan for all, with sim as one key more.  A cloud that has sim is one
    terrain for each; another is the same for all, and not copied.  zones: only the first so many by attempt that `keep`
    keeps, and a simulation that has them ends (see first_zones); otherwise all attempts are grown.  max_relief: zones of more
    relief are left out, and not grown to their end."""
    on = ("sim",) if "sim" in cloud.columns else ()
    attempts = simulations.crossJoin(F.broadcast(cloud.sparkSession.range(max_attempts).select(F.col("id").alias("attempt"))))  # max_attempts rows
    sizes = cloud.groupBy(*on).agg(F.count("*").alias("n"))
    attempts = attempts.join(F.broadcast(sizes), list(on)) if on else attempts.crossJoin(F.broadcast(sizes))  # one row, or one for each simulation
    attempts = attempts.where("n > 0").select("sim", "attempt", ((F.col("attempt") * STEP + F.col("salt")) % F.col("n")).alias("index"))
    seeds = attempts.join(with_index(cloud, on=on, wanted=attempts.select(*on, "index").distinct()), [*on, "index"])
    seeds = seeds.select("sim", "attempt", F.col("pid").alias("seed_pid"), *[F.col(c).alias(f"seed_{c}") for c in "xyz"])
    inside = stored(off_edge(seeds, cloud, radius, on), "seeds")
    if zones is None:
        return candidates(inside, cloud, radius, k, limit, increment, max_rungs, keys=("sim", "attempt"), on=on, max_relief=max_relief)
    return first_zones(inside, cloud, zones, radius, k, limit, ("sim",), on, keep=keep, increment=increment, max_rungs=max_rungs, max_relief=max_relief)


def monte_carlo(spark: SparkSession, config: Benchmark, density: float = 37.5, radius: float = 0.5, max_rungs: int | None = None, cloud: DataFrame | None = None) -> DataFrame:
    """sim, algorithm, n_zones and best_score of each configured algorithm over each simulation; no zones are 0, and a
    null score.

    Each simulation has a made-up terrain of its own; with a pcd_file_path, or a cloud given, all have that cloud, and other seeds.  Growing
    circles keep to the hazard limits, and the first max_landing_zones of them by attempt count, not the best; of the
    other algorithms clusters count, the best score being the highest density (region growing: the largest size)."""
    simulations = spark.range(config.num_simulations).select(F.col("id").alias("sim"), (F.col("id") + 13).alias("salt"))
    on: tuple[str, ...] = ()
    if config.pcd_file_path or cloud is not None:
        cloud = stored(valid(load_cloud(spark, config.pcd_file_path if cloud is None else cloud)), "terrain")
    else:
        on = ("sim",)
        cloud = stored(terrains(simulations, config.terrain_size, int(config.terrain_size**2 * density)), "terrains")
    limits = {"max_slope": config.max_slope, "min_density": config.min_density, "max_relief": config.max_relief, "max_roughness": config.max_roughness}
    out = None
    for algorithm in config.algorithms or [{"name": "kdtree_InflatingCircles"}]:
        name, p = algorithm["name"], algorithm.get("parameters") or {x: y for x, y in algorithm.items() if x != "name"}
        size, alpha = float(p.get("cell_size", 1.0)), float(p.get("alpha", 0.1))
        if name == "kdtree_InflatingCircles":
            kept = lambda found: within_limits(found, config.min_radius, **limits)
            first = simulated_zones(cloud, simulations, config.max_attempts, radius, int(p.get("k", 30)), config.max_slope, float(p.get("radiusIncrement", 0.1)), max_rungs, config.max_landing_zones, kept, config.max_relief)
            best = first.groupBy("sim").agg(F.count("*").alias("n_zones"), F.max("score").alias("best_score"))
        elif name in ("seq_overlap", "sequentialApproach", "sequentialApproachKdtree"):
            overlap = 2 if name == "seq_overlap" else 1
            cells = radius_zones(cloud, size, on=on, **limits) if name == "sequentialApproachKdtree" else cell_zones(cloud, size, overlap, on=on, **limits)
            cells = stored(cells, "zones")
            grouped = clustered_cells(cells, size, overlap, float(p.get("cluster_tolerance", 1.0)), alpha, on)
            best = _each(simulations, cells.join(grouped, [*on, "gx", "gy"]).groupBy(*on).agg(F.countDistinct("cluster").alias("n_zones"), F.max("density").alias("best_score")), on)
        elif name == "Region_Growing_Segmentation":
            regions = region_growing(cloud, float(p.get("curvature_threshold", 0.05)), int(p.get("min_cluster_size", 50)), float(p.get("cluster_tolerance", 0.25)), alpha=alpha, smoothness=float(p.get("smoothness", 10.0)), on=on)
            best = _each(simulations, regions.groupBy(*on).agg(F.countDistinct("cluster").alias("n_zones"), F.max("size").cast("double").alias("best_score")), on)
        else:
            raise ValueError(f"unknown algorithm {name!r}")
        best = simulations.join(best, "sim", "left").select("sim", F.lit(name).alias("algorithm"), F.coalesce("n_zones", F.lit(0)).alias("n_zones"), "best_score")
        out = best if out is None else out.unionByName(best)
    return out


def _each(simulations: DataFrame, best: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return best if on else simulations.select("sim").crossJoin(F.broadcast(best))  # one row


__all__ = ["cell_zones", "clustered_cells", "clusters", "monte_carlo", "radius_zones", "region_growing", "simulated_zones"]
