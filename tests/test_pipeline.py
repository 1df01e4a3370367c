"""Sources, configurations and whole pipelines."""

import numpy as np
import pytest

from levelground.operators import cloud as ops
from levelground.operators.cloud import terrain
from levelground.plans import algorithms, config, pipeline
from levelground.sources import pcd

YAML = """
node:
  ros__parameters:
    pcd_file_path: none
    voxel_downsample_pointcloud: false
    voxel_size: 0.2
    pipeline:
      - {step: SOR, enabled: true, parameters: {nb_neighbors: 8, std_ratio: 2.0}}
      - {step: nonsense, enabled: false}
      - {step: SphericalNeighbourhood, enabled: true, parameters: {k: 10, angleThreshold: 25.0, radius: 0.5, landingZoneNumber: 3, maxAttempts: 20}}
      - {step: HazarMetrices, enabled: true, parameters: {hazard: ALL}}
"""


@pytest.mark.parametrize("how", ["ascii", "binary", "binary_compressed"])
def test_pcd_round_trip(spark, tmp_path, how):
    rng = np.random.default_rng(0)
    columns = {c: rng.random(50).astype(np.float32) for c in ("x", "y", "z", "intensity")}
    columns["x"][3] = np.nan
    (tmp_path / "a.pcd").write_bytes(pcd.encode(columns, how))
    for path in (str(tmp_path / "a.pcd"), f"file://{tmp_path}/a.pcd"):
        rows = pcd.load_cloud(spark, path).orderBy("pid").collect()
        assert np.array_equal([r.x for r in rows], columns["x"], equal_nan=True)
        assert np.array_equal([r.intensity for r in rows], columns["intensity"])


def test_lzf_back_reference():
    assert pcd.lzf_decompress(bytes([2, 97, 98, 99, 0b00100000, 2, 0b11100000, 1, 0]), 3 + 3 + 10) == b"abcabc" + b"c" * 10


def test_lzf_overlapping_references():
    """Against the format byte by byte."""
    rng = np.random.default_rng(1)
    data, want = bytearray(), bytearray()
    for _ in range(400):
        if not want or rng.random() < 0.4:
            lit = rng.integers(0, 256, rng.integers(1, 33)).astype(np.uint8).tobytes()
            data += bytes([len(lit) - 1]) + lit
            want += lit
        else:
            back, n = int(rng.integers(1, min(len(want), 8192) + 1)), int(rng.integers(3, 265))
            long = n - 2 >= 7
            data += bytes([(7 if long else n - 2) << 5 | (back - 1) >> 8]) + (bytes([n - 9]) if long else b"") + bytes([(back - 1) & 255])
            for _ in range(n):
                want.append(want[-back])
    assert pcd.lzf_decompress(bytes(data), len(want)) == want


@pytest.mark.parametrize("how", ["ascii", "binary", "binary_compressed"])
def test_ranges_of_a_file(spark, tmp_path, how):
    """A binary file is read by a task for each range of points, numbered by their place; filters leave out the same rows
    as Spark's own."""
    rng = np.random.default_rng(2)
    columns = {c: rng.normal(size=2501).astype(np.float32) for c in ("x", "y", "z", "intensity")}
    columns["z"][7] = np.nan
    (tmp_path / "a.pcd").write_bytes(pcd.encode(columns, how))
    pcd.load_cloud(spark, str(tmp_path / "a.pcd"))
    read = lambda: spark.read.format("pcd").option("pointsPerTask", 400).load(str(tmp_path / "a.pcd"))
    assert read().rdd.getNumPartitions() == (7 if how == "binary" else 1)
    for c in ("x", "intensity"):
        assert np.array_equal([r[c] for r in read().orderBy("pid").collect()], columns[c])
    asked = "x > 0.5 AND y <= 1 AND z >= -0.25 AND pid % 2 = 1 AND x < 2"
    plain = sorted(r.pid for r in read().where(asked).collect())
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = pcd.load_cloud(spark, str(tmp_path / "a.pcd")).where(asked)
        assert sorted(r.pid for r in pushed.collect()) == plain
        assert ">=" not in pushed._jdf.queryExecution().executedPlan().toString()  # the source has taken it
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    x, y, z = (columns[c] for c in "xyz")
    assert plain == [i for i in range(2501) if x[i] > 0.5 and y[i] <= 1 and not z[i] < -0.25 and i % 2 and x[i] < 2]


def test_a_file_that_ends_early(tmp_path):
    data = pcd.encode({c: np.zeros(50, np.float32) for c in ("x", "y", "z", "intensity")}, "binary")
    with pytest.raises(ValueError, match="announced"):
        pcd.parse(data[:-20])


def test_written_clouds(spark, tmp_path):
    c = terrain(spark, 5.0, 3000).repartition(3)
    pcd.save_cloud(c, str(tmp_path / "clouds"))
    files = sorted((tmp_path / "clouds").iterdir())
    assert len(files) == 3 and all(f.suffix == ".pcd" for f in files)
    back = pcd.load_cloud(spark, str(tmp_path / "clouds"))
    key = lambda df: sorted((round(r.x, 4), round(r.y, 4), round(r.z, 4), r.intensity) for r in df.collect())
    assert key(back) == key(c.withColumns({x: c[x].cast("float") for x in "xyz"}))
    with pytest.raises(Exception, match="append"):
        c.write.format("pcd").mode("overwrite").save(str(tmp_path / "clouds"))


def test_missing_file_raises(spark):
    with pytest.raises(Exception, match="nowhere"):
        pcd.load_cloud(spark, "/nowhere.pcd").count()


def test_pipeline(spark):
    c = terrain(spark, 8.0, 2400)
    result = pipeline.run(spark, config.pipeline(YAML), c)
    found = result.candidates.orderBy("rank").collect()
    assert [r.rank for r in found] == list(range(1, len(found) + 1)) and 1 <= len(found) <= 3
    assert result.hazards[0].first().metric == "ALL"
    assert result.inliers.count() >= sum(r.n for r in found)
    legacy = pipeline.run(spark, config.Pipeline("", steps=config.pipeline(YAML).steps[:1]), c, legacy_sor_noop=True)
    assert legacy.inliers.count() == 2400


def test_unknown_step(spark):
    with pytest.raises(ValueError, match="nonsense"):
        pipeline.run(spark, config.Pipeline("", steps=[config.Step("nonsense")]), terrain(spark, 2.0, 10))


def test_benchmark_config(spark):
    b = config.benchmark({"num_simulations": 2, "terrain_size": 6.0, "hazards": {"min_point_density": 20, "max_relief": 1.0}, "max_landingZones": 2, "max_Attempts": 10, "algorithms": [{"name": "kdtree_InflatingCircles", "parameters": {"k": 10, "radiusIncrement": 0.5}}, {"name": "sequentialApproach", "parameters": {"cell_size": 1.0}}]})
    assert (b.num_simulations, b.min_density, b.max_relief, b.max_landing_zones, b.max_attempts) == (2, 20, 1.0, 2, 10)
    rows = algorithms.monte_carlo(spark, b, max_rungs=2).collect()
    assert {(r.sim, r.algorithm) for r in rows} == {(i, a) for i in (0, 1) for a in ("kdtree_InflatingCircles", "sequentialApproach")}
    assert all(r.n_zones == 0 and r.best_score is None for r in rows if r.algorithm == "kdtree_InflatingCircles")  # 1 m is under the least radius


SHIPPED = """
num_simulations: 1
use_pcd_file: true
pcd_file_path: "{path}"
terrain_size: 20.0
enable_visualization: true
min_radius_threshold: 2.5
max_slope_threshold: 25
min_point_density_threshold: 30.0
max_relief_threshold: 2.0
max_roughness_threshold: 0.1
max_landingZones: 10
max_Attempts: 20
algorithms:
  - {{name: Region_Growing_Segmentation, curvature_threshold: 0.05, min_cluster_size: 50, alpha: 0.1, cluster_tolerance: 0.25}}
  - {{name: seq_overlap, cell_size: 1.0, alpha: 0.1, cluster_tolerance: 1.0}}
  - {{name: kdtree_InflatingCircles, k: 30, radiusIncrement: 0.1}}
  - {{name: sequentialApproachKdtree, cell_size: 1, alpha: 0.1, cluster_tolerance: 1.0}}
  - {{name: sequentialApproach, cell_size: 1, alpha: 0.1, cluster_tolerance: 1.0}}
"""


def test_thresholds_and_own_cloud(spark, tmp_path):
    """A flat square: every algorithm finds one zone, or one for each attempt off the edge whose circle is wide enough."""
    xy = np.stack(np.meshgrid(np.arange(0, 9, 0.15), np.arange(0, 9, 0.15)), axis=-1).reshape(-1, 2).astype(np.float32)
    zero = np.zeros(len(xy), np.float32)
    (tmp_path / "flat.pcd").write_bytes(pcd.encode({"x": xy[:, 0], "y": xy[:, 1], "z": zero, "intensity": zero}, "binary"))
    b = config.benchmark(SHIPPED.format(path=tmp_path / "flat.pcd"))
    assert (b.min_radius, b.max_slope, b.min_density, b.max_relief, b.max_roughness) == (2.5, 25, 30, 2, 0.1)
    rows = {r.algorithm: r.n_zones for r in algorithms.monte_carlo(spark, b).collect()}
    assert rows == {"Region_Growing_Segmentation": 1, "seq_overlap": 1, "kdtree_InflatingCircles": 10, "sequentialApproachKdtree": 1, "sequentialApproach": 1}
    with pytest.raises(ValueError, match="max_tilt"):
        config.benchmark({"max_tilt": 3})


def test_two_clouds_stay_apart(spark, tmp_path):
    """Normals and outliers of a folder of two files are those of each file alone; voxels get lasting numbers."""
    rng = np.random.default_rng(5)
    for name in ("a", "b"):
        columns = {c: (rng.random(80) * (5 if name == "a" else 50)).astype(np.float32) for c in ("x", "y", "z", "intensity")}
        (tmp_path / f"{name}.pcd").write_bytes(pcd.encode(columns, "binary"))
    both = pcd.load_cloud(spark, str(tmp_path))
    key = lambda df, c: {(r.cloud_id.rpartition("/")[2], r.pid): round(r[c], 6) for r in df.collect()}
    for f, c in ((lambda d: ops.sor_classify(d, 4, 1.0).where("inlier"), "mean_distance"), (lambda d: ops.normals(d, 6), "slope_deg")):
        alone = [key(f(pcd.load_cloud(spark, str(tmp_path / f"{name}.pcd"))), c) for name in ("a", "b")]
        assert key(f(both), c) == alone[0] | alone[1]
    voxels = pipeline.run(spark, config.Pipeline("", voxel_downsample=True, voxel_size=1.0, steps=[config.Step("SOR", True, {"nb_neighbors": 4, "std_ratio": 1.0})]), both)
    start = voxels.downsampled.count()
    assert start == voxels.downsampled.select("cloud_id", "pid").distinct().count() == voxels.inliers.count() + voxels.outliers.count()


def test_steps_hand_on_what_they_wrote(spark):
    """Later steps read a step's classes, and do not join them to the cloud again."""
    steps = [config.Step("SOR", True, {"nb_neighbors": 8}), config.Step("PCA", True, {"k": 8})]
    result = pipeline.run(spark, config.Pipeline("", steps=steps), terrain(spark, 4.0, 600))
    assert "Join" not in result.inliers._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < result.inliers.count() < 600
