"""A configured pipeline: steps folded over the cloud of inliers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelground.operators import cloud as ops
from levelground.operators.growth import detect, ranked
from levelground.operators.patch import hazard
from levelground.operators.storage import stored
from levelground.plans.config import Pipeline
from levelground.sources.pcd import load_cloud


@dataclass
class Result:
    """What a run leaves: the labelled clouds, ranked candidates and hazard metrics, all lazy but for what detection
    stored on its way."""

    inliers: DataFrame
    outliers: DataFrame
    downsampled: DataFrame
    method: str = ""
    candidates: DataFrame | None = None
    hazards: list[DataFrame] = field(default_factory=list)


def _sor(result: Result, p: dict, legacy: bool) -> None:
    classes = stored(ops.sor_classify(result.inliers, int(p.get("nb_neighbors", 20)), float(p.get("std_ratio", 2.0))), "classes")
    result.method = "SOR"
    if not legacy:
        result.outliers = classes.where(~F.col("inlier")).drop("mean_distance", "inlier")
        result.inliers = classes.where("inlier").drop("mean_distance", "inlier")


def _pca(result: Result, p: dict, legacy: bool) -> None:
    classes = stored(ops.slope_classes(result.inliers, float(p.get("angleThreshold", 20.0)), int(p.get("k", 10))), "classes")
    columns = result.inliers.columns
    result.inliers, result.outliers, result.method = classes.where("inlier").select(*columns), classes.where(~F.col("inlier")).select(*columns), "PCA"


def _neighbourhood(result: Result, p: dict, legacy: bool) -> None:
    cloud = result.inliers
    seeds = ops.sample_seeds(cloud, int(p.get("maxAttempts", 10_000)))
    more = {name: p[key] for key, name in (("radiusIncrement", "increment"), ("maxRungs", "max_rungs")) if key in p}
    found, points = detect(cloud, seeds, float(p.get("radius", 0.5)), int(p.get("k", 10)), float(p.get("angleThreshold", 25.0)), int(p.get("landingZoneNumber", -1)), **more)
    result.candidates = ranked(found)
    # a point in two patches stays twice, and the outliers are the whole cloud
    result.inliers, result.outliers, result.method = points.drop("attempt"), cloud, "SphericalNeighbourhood"


def _hazard(result: Result, p: dict, legacy: bool) -> None:
    result.hazards.append(hazard(result.inliers, str(p.get("hazard", "ALL"))))


STEPS = {"SOR": _sor, "PCA": _pca, "SphericalNeighbourhood": _neighbourhood, "HazarMetrices": _hazard, "HazardMetrics": _hazard}


def run(spark: SparkSession, config: Pipeline, cloud: DataFrame | None = None, legacy_sor_noop: bool = False) -> Result:
    """Disabled steps are passed over, whatever their name; an enabled step that is not in STEPS raises and ends the run.

    legacy_sor_noop: outlier removal changes nothing downstream, as where its result is only looked at."""
    raw = ops.valid(load_cloud(spark, config.pcd_file_path if cloud is None else cloud))
    start = raw
    if config.voxel_downsample:  # a point's number is its cube's, written once so that all steps see the same
        cubes = ops.voxel_downsample(raw, config.voxel_size, ops.cloud_keys(raw)).drop("n_points")
        start = stored(cubes.withColumn("pid", F.monotonically_increasing_id()).drop("vx", "vy", "vz"), "voxels")
    result = Result(start, raw, start)
    for step in config.steps:
        if not step.enabled:
            continue
        if step.name not in STEPS:
            raise ValueError(f"unknown step {step.name!r}")
        STEPS[step.name](result, step.parameters, legacy_sor_noop)
    return result
