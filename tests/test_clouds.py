"""Operators on hand fixtures with closed-form answers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from levelground.functions import geometry as g
from levelground.operators import cloud as ops
from levelground.operators import growth, patch, spatial
from levelground.plans import algorithms

CLOUD = "cloud_id string, pid long, x double, y double, z double, intensity double"


def cloud(spark, points):
    return spark.createDataFrame([("c", i, float(x), float(y), float(z), float(i % 5)) for i, (x, y, z) in enumerate(points)], CLOUD)


def grid(z=lambda x, y: 0.0, n=21):
    return [(i / 10, j / 10, z(i / 10, j / 10)) for i in range(n) for j in range(n)]


def test_flat_grid_is_flat(spark):
    c = cloud(spark, grid())
    classes = ops.slope_classes(c, 0.0).collect()
    assert all(r.inlier and r.slope_deg == 0 for r in classes)
    h = patch.hazard(c, "ALL").first()
    assert (h.relief, h.roughness) == (0, 0) and h.data_confidence == pytest.approx(441 / 4)
    p = ops.plane(c).first()
    assert (p.a, p.b, p.c, p.d) == pytest.approx((0, 0, 1, 0))


@pytest.mark.parametrize(("limit", "inliers"), [(25.0, 441), (15.0, 0)])
def test_slope_threshold(spark, limit, inliers):
    c = cloud(spark, grid(lambda x, y: math.tan(math.radians(20)) * x))
    assert ops.slope_classes(c, limit).where("inlier").count() == inliers
    assert patch.hazard(c, "RELIEF").first().relief == pytest.approx(2 * math.tan(math.radians(20)))


def test_step_edge_is_not_flat(spark):
    c = cloud(spark, grid(lambda x, y: 0.2 if x > 1 else 0.0))
    classes = {r.pid: r.inlier for r in ops.slope_classes(c, 15.0, 30).collect()}
    assert not all(classes.values()) and classes[0]


@pytest.mark.parametrize(("z0", "hit"), [(1, True), (0.005, False), (10.4, True), (10.6, False)])
def test_collision(spark, z0, hit):
    disc = spark.createDataFrame([(1, 1.0, 1.0, 0.5, 0.0)], "attempt long, cx double, cy double, reach double, max_z double")
    assert bool(patch.blocked(disc, cloud(spark, [*grid(), (1, 1, z0)]), ["attempt"]).count()) == hit


@given(st.floats(0, 12), st.floats(0, 0.6), st.floats(0.1, 3))
@settings(max_examples=200, deadline=None)
def test_nearest_sphere_decides(z, h, r):
    loop = z > 0.01 and any(h * h + (z - 0.2 * i) ** 2 < r * r for i in range(51))
    i = min(50.0, max(0.0, float(np.round(z / 0.2))))
    near = z > 0.01 and h * h + (z - 0.2 * i) ** 2 < r * r
    assert loop == near or min(abs(h * h + (z - 0.2 * j) ** 2 - r * r) for j in range(51)) < 1e-9


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_clouds(spark, n):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)][:n])
    found, points = growth.detect(c, ops.sample_seeds(c, 4))
    assert found.count() == 0 and points.count() == 0
    assert spatial.knn(c, 2).count() == min(n, 2) * n


def test_thin_strip_is_not_round(spark):
    strip = [(i / 100, j / 100, 0) for i in range(101) for j in range(3)]
    c = cloud(spark, [*strip, (6, 6, 0), (-6, 6, 0), (6, -6, 0), (-6, -6, 0)])
    seeds = ops.every_point(c).where("attempt = 150")
    ladder = growth.growth_ladder(seeds, c, 1.2, 10, 25.0, max_rungs=1).first()
    assert ladder.flat and ladder.circularity == pytest.approx(0.060392, abs=1e-5)
    assert growth.candidates(seeds, c, 1.2, 10, 25.0, max_rungs=1).count() == 0


def test_nan_points_go(spark):
    c = cloud(spark, [*grid(), (math.nan, 0, 0), (0, math.nan, 0), (0, 0, math.nan)])
    assert ops.valid(c).count() == 441
    assert ops.bounds(ops.valid(c)).first().max_x == 2


def test_equal_points_have_no_normal(spark):
    c = cloud(spark, [(1, 1, 1)] * 12)
    assert ops.slope_classes(c, 25.0).where("inlier").count() == 0
    assert patch.density2d(c, ["cloud_id"]).first().data_confidence == -1
    assert g.hull_measures(np.ones((12, 2)))[1:] == (0, 0, 0)


def test_hulls():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0), (1, 0.5), (0.3, 0.3), (0.6, 0.7)])
    n, area, around, circ = g.hull_measures(square)
    assert (n, area, around) == (4, 1, 4) and circ == pytest.approx(math.pi / 4)
    cube = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [(0.5, 0.5, 0.5)], float)
    assert g.hull3d_area(cube) == pytest.approx(6)
    assert g.hull3d_area(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], float)) == 0


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=60))
@settings(max_examples=100, deadline=None)
def test_hull_of_hull(points):
    h = g.hull2d(np.array(points, float))
    assert {*map(tuple, g.hull2d(h))} == {*map(tuple, h)}
    assert 0 <= g.hull_measures(np.array(points, float))[3] <= 1 + 1e-9


def test_growth_on_a_flat_cloud_ends(spark):
    c = cloud(spark, grid())
    ladder = growth.growth_ladder(ops.every_point(c).where("attempt = 220"), c, 0.5, 10, 25.0, max_rungs=5)
    assert growth.best_rungs(ladder).first().rung == 4


def test_voxels_floor_negatives(spark):
    c = cloud(spark, [(0, 0, 0), (0.9, 0, 0), (1.1, 0, 0), (-0.1, 0, 0)])
    assert sorted(r.x for r in ops.voxel_downsample(c, 1.0).collect()) == pytest.approx([-0.1, 0.45, 1.1])


def test_rank_ties_and_sentinels(spark):
    found = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, 5.0)], "attempt long, score double")
    assert [(r.rank, r.attempt, r.label) for r in growth.ranked(found).orderBy("rank").collect()] == [(1, 3, "Rank 1"), (2, 1, "Rank 2"), (3, 2, "Rank 3")]
    assert growth.first_n(found, 0).count() == 1 and growth.first_n(found, -1).count() == 3


def test_knn_is_exact_over_gaps(spark):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.random((150, 3)), rng.random((5, 3)) + 40, [[300, 0, 0]]])
    got = {}
    for r in spatial.knn(cloud(spark, xyz.tolist()), 7).collect():
        got.setdefault(r.pid, {})[r.rank] = r.other
    for i, p in enumerate(xyz):
        d2 = ((xyz - p) ** 2).sum(axis=1)
        assert [got[i][j] for j in range(1, 8)] == np.lexsort((np.arange(len(xyz)), d2))[:7].tolist()


def test_radius_join_is_exact(spark):
    rng = np.random.default_rng(2)
    xyz = rng.random((200, 3)) * 4 - 2
    c = cloud(spark, xyz.tolist())
    pairs = {(r.attempt, r.pid) for r in spatial.radius_join(ops.every_point(c), c, 0.7).collect()}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 < 0.49))}


def test_normals_match_eigh(spark):
    rng = np.random.default_rng(3)
    xyz = rng.random((60, 3)) * [1, 1, 0.2]
    got = {r.pid: r.slope_deg for r in patch.local_normals(cloud(spark, xyz.tolist()), ["cloud_id"], 8).collect()}
    assert np.allclose([got[i] for i in range(60)], g.local_slopes(xyz, 8))


def test_dense_index(spark):
    c = spark.createDataFrame([("c", int(p), 0.0, 0.0, 0.0, 0.0) for p in np.random.default_rng(4).permutation(5000)[:700] ** 2], CLOUD)
    assert [r["index"] for r in ops.with_index(c, 16).orderBy("pid").collect()] == list(range(700))


def test_index_of_sparse_numbers(spark):
    """Numbers as monotonically_increasing_id gives them: four far runs are cut again, none of the ranges is crowded."""
    pids = [(p << 33) + i for p in range(4) for i in range(500)] + [5 << 40]
    c = spark.createDataFrame([("c", p, 0.0, 0.0, 0.0, 0.0) for p in pids], CLOUD)
    numbered = ops.with_index(c, 16)
    assert [r["index"] for r in numbered.orderBy("pid").collect()] == list(range(len(pids)))
    wanted = spark.createDataFrame([(0,), (777,), (2000,)], "index long")
    assert sorted((r["index"], r.pid) for r in ops.with_index(c, 16, wanted=wanted).collect()) == [(i, pids[i]) for i in (0, 777, 2000)]


def test_sor(spark):
    c = cloud(spark, [*grid(), (30, 30, 0)])
    out = ops.sor_classify(c, 5, 1.0).where("NOT inlier").select("pid").collect()
    assert [r.pid for r in out] == [441]


def test_region_growing_and_cells(spark):
    c = cloud(spark, [*grid(), *[(x + 10, y, z) for x, y, z in grid()]])
    regions = algorithms.region_growing(c)
    assert sorted(r["count"] for r in regions.groupBy("cluster").count().collect()) == [441, 441]
    cells = algorithms.cell_zones(c, min_density=50)
    assert algorithms.clustered_cells(cells).select("cluster").distinct().count() == 2


def test_roles_and_circles(spark):
    c = cloud(spark, grid(n=3))
    assert ops.select_role(c, c, "both").count() == 18 and ops.select_role(c, c, "inlier_cloud").count() == 9 and ops.select_role(c, c, "other").count() == 0
    one = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.5)], "rank int, seed_x double, seed_y double, seed_z double, patch_radius double")
    ring = ops.circles(one, 8).orderBy("i").collect()
    assert (ring[2].x, ring[2].y, ring[2].z) == pytest.approx((1.0, 2.5, 3.0)) and len(ring) == 8


def test_growth_without_a_cap_ends_at_the_diagonal(spark):
    """Brute force: a flat cloud's patches grow until they hold every point, three rungs would end at 1.5."""
    points = [(i * 20 + j, i * 0.25, j * 0.25, 0.0) for i in range(20) for j in range(20)]
    c = spark.createDataFrame(points, "pid long, x double, y double, z double")
    seeds = ops.every_point(c).where("attempt = 210")
    at, diagonal = points[210], math.hypot(4.75, 4.75)
    radii = [0.5]
    while radii[-1] <= diagonal:
        radii.append(radii[-1] + 0.5)
    want = [sum(math.dist(p[1:], at[1:]) < r for p in points) for r in radii]
    ladder = growth.growth_ladder(seeds, c, 0.5, 10, 25.0).orderBy("rung").collect()
    assert [(row.radius, row.n, row.flat) for row in ladder] == [(r, n, True) for r, n in zip(radii, want)]
    assert want[-1] == len(points) and len(want) > 3
    found, inliers = growth.detect(c, seeds)
    assert found.first().patch_radius == radii[-1] and inliers.count() == len(points)


def test_simulations_stop_once_they_have_their_zones(spark, monkeypatch):
    """The first zones by attempt are those of growing all attempts; normals are made once, and batches end early."""
    c = ops.terrain(spark, 8.0, 2400)
    sims = spark.createDataFrame([(0, 13), (1, 14), (2, 5000)], "sim long, salt long")
    key = lambda df: sorted((r.sim, r.attempt, r.seed_pid, round(r.patch_radius, 6), round(r.score, 6)) for r in df.collect())
    keep = lambda found: patch.within_limits(found, 1.0, max_relief=2.0, max_roughness=0.1)
    every = key(keep(algorithms.simulated_zones(c, sims, 40, 0.5, 10, 25.0, 0.5)))
    made = {"normals": 0, "candidates": 0}
    for name in made:
        def counted(*args, _name=name, _made=getattr(growth, name), **more):
            made[_name] += 1
            return _made(*args, **more)

        monkeypatch.setattr(growth, name, counted)
    for zones in (1, 2):
        made.update(normals=0, candidates=0)
        got = key(algorithms.simulated_zones(c, sims, 10_000, 0.5, 10, 25.0, 0.5, zones=zones, keep=keep))
        assert got == [r for i in range(3) for r in [x for x in every if x[0] == i][:zones]] and len(got) == 3 * zones
        assert made == {"normals": 1, "candidates": 1}  # 64 attempts of 10,000
    seeds = ops.sample_seeds(c, 40)
    made.update(normals=0, candidates=0)
    found, _ = growth.detect(c, seeds, zones=3, batch=4)
    want = growth.first_n(growth.candidates(ops.off_edge(seeds, c, 0.5), c, 0.5, 10, 25.0), 3)
    assert sorted(r.attempt for r in found.collect()) == sorted(r.attempt for r in want.collect())
    assert made["normals"] == 2 and 1 < made["candidates"] <= 5  # one for each of both calls; attempts 4, 8, 16 ...


def test_steep_bound_holds_and_is_near(spark):
    """Brute force: never under the least of distance and reach over steep points, and at most three times that and a cell."""
    c = ops.terrain(spark, 12.0, 4000)
    ground = growth.surface(c, 10)
    seeds = ops.sample_seeds(c, 60)
    got = {r.attempt: r.ends for r in growth.steep_bound(seeds, ground, 25.0).collect()}
    steep = ground.points.where("slope_deg > 25 OR isnan(slope_deg)").toPandas()
    for s in seeds.collect():
        least = (np.sqrt((steep.x - s.seed_x) ** 2 + (steep.y - s.seed_y) ** 2 + (steep.z - s.seed_z) ** 2) + steep.reach).min()
        assert least - 1e-9 <= got[s.attempt] <= 3 * least + 8 * ground.wide
    assert not growth.steep_bound(seeds, ground, 91.0).count()


def test_steep_bound_is_drawn_closer(spark):
    """A steep half of a wide cloud: the bound is no more than a fifth and some cells beyond the least."""
    rng = np.random.default_rng(23)
    steep = np.array([(200.0 + 2 * (i % 100), 2.0 * (i // 100), 0.0) for i in range(20_000)])
    points = spark.range(20_000).selectExpr("id AS pid", "200D + 2 * (id % 100) AS x", "2D * (id div 100) AS y", "0D AS z", "60D AS slope_deg", "0.3D AS reach")
    ground = growth.Surface(points, (), 1.0, 0.3, 400.0, 566.0)
    own = [(i, i, *map(float, p)) for i, p in enumerate(rng.random((40, 3)) * [200, 400, 1])]
    seeds = spark.createDataFrame(own, "attempt long, seed_pid long, seed_x double, seed_y double, seed_z double")
    got = {r.attempt: r.ends for r in growth.steep_bound(seeds, ground, 25.0).collect()}
    for i, _, *p in own:
        least = np.sqrt(((steep - p) ** 2).sum(axis=1)).min() + 0.3
        assert least - 1e-9 <= got[i] <= 1.2 * least + 2


def test_radius_join_of_own_radii(spark):
    """Each seed with a radius of its own meets the points within it, and none twice."""
    rng = np.random.default_rng(24)
    c = cloud(spark, (rng.random((800, 3)) * [9, 9, 1] - [4, 4, 0]).tolist())
    own = [(i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(rng.random((20, 3)) * [9, 9, 1] - [4, 4, 0], [0.1, 0.7, 2.0, 9.0] * 5))]
    seeds = spark.createDataFrame(own, "attempt long, seed_x double, seed_y double, seed_z double, cap double")
    within = "sqrt(d2) < cap"
    pairs = lambda df: sorted((r.attempt, r.pid) for r in df.where(within).collect())
    finer = spatial.radius_join(seeds, c, 2.5, own="cap")
    assert pairs(finer) == pairs(spatial.radius_join(seeds, c, 2.5))


def test_neighbours_of_an_uneven_cloud(spark, monkeypatch):
    """Some 5,000 times denser in one place, lone points and equal ones: equal to brute force, and no call gets a crowd."""
    monkeypatch.setattr(spatial, "BLOCK", 2)
    monkeypatch.setattr(spatial, "MOST", 500)
    sizes = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.random((400, 3)) * [60, 60, 1], rng.random((1200, 3)) * [1.5, 1.5, 0.1] + [20, 20, 0], rng.random((3, 3)) + 300, np.ones((8, 3)) * [20.5, 20.5, 0.05]])
    most = {}

    def watched(points, of, k, *more, _nearest=spatial.nearest):
        sizes.add(len(points) > 1200)
        return _nearest(points, of, k, *more)

    monkeypatch.setattr(spatial, "nearest", watched)
    for r in spatial.knn(cloud(spark, xyz.tolist()), 5).collect():
        most.setdefault(r.pid, {})[r["rank"]] = r.other
    for i, p in enumerate(xyz):
        d2 = ((xyz - p) ** 2).sum(axis=1)
        assert [most[i][j] for j in range(1, 6)] == np.lexsort((np.arange(len(xyz)), d2))[:5].tolist()
    assert sizes.value == 0


def test_lone_points_have_all_their_neighbours(spark):
    """Points whose block holds fewer than k go on, though what they see lies close together."""
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.random((3000, 3)) * [50, 50, 1], rng.random((2, 3)) + 200])
    got = {}
    for r in spatial.knn(cloud(spark, xyz.tolist()), 6).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.other
    for i in (0, 17, 3000, 3001):
        d2 = ((xyz - xyz[i]) ** 2).sum(axis=1)
        assert [got[i][j] for j in range(1, 7)] == np.lexsort((np.arange(len(xyz)), d2))[:6].tolist()


def faces_area(xyz):
    """Surface of the hull of points in general position: triples with all others on one side."""
    from itertools import combinations

    area = 0.0
    for triple in combinations(range(len(xyz)), 3):
        a, b, c = xyz[list(triple)]
        n = np.cross(b - a, c - a)
        side = np.delete((xyz - a) @ n, list(triple))
        area += float(np.linalg.norm(n)) / 2 * bool((side > 0).all() or (side < 0).all())
    return area


@pytest.mark.parametrize("n", [4, 5, 9, 25])
def test_hull_in_space_against_all_triples(n):
    rng = np.random.default_rng(n)
    for scale in ([1, 1, 1], [10, 10, 0.01]):
        xyz = rng.random((n, 3)) * scale
        rows, area = g.hull3d(np.concatenate([xyz, xyz]))
        assert area == pytest.approx(faces_area(xyz), rel=1e-9)
        assert g.hull3d_area(np.concatenate([xyz, xyz])[rows]) == pytest.approx(area, rel=1e-12)


def test_hulls_without_volume_keep_what_spans_them():
    rng = np.random.default_rng(3)
    flat = rng.random((500, 2)) @ np.array([[1, 0, 0.5], [0, 1, -0.25]])
    rows, area = g.hull3d(flat)
    assert area == 0 and len(rows) < 40 and g.hull_measures(flat[rows][:, :2])[1] == pytest.approx(g.hull_measures(flat[:, :2])[1])
    assert sorted(g.hull3d(np.outer([3, 1, 2, 0], [1.0, 1, 1]))[0]) == [0, 3]
    assert len(g.hull3d(np.ones((5, 3)))[0]) == 1


def test_points_in_a_line_are_no_vertices():
    """0.1 and its multiples are rounded, so that lines of a grid are straight but for their last digits."""
    assert g.hull_measures(np.array(grid())[:, :2] + 1000.1)[0] == 4


@pytest.mark.parametrize("held", [20_000, 50])
def test_hulls_merge(spark, monkeypatch, held):
    """One patch over many tasks, many small ones, and one with a null key, against the hull of all points at once."""
    monkeypatch.setattr(patch, "HELD", held)
    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(y), float(z)) for k, n in (("big", 5000), ("a", 7), ("b", 3), ("one", 1), (None, 40)) for x, y, z in rng.normal(size=(n, 3))]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(6)
    of = {k: np.array([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    for r in patch.hulls(df, ["k"]).collect():
        n, area, around, _ = g.hull_measures(of[r.k][:, :2])
        assert (r.n_vertices, r.area, r.perimeter) == (n, pytest.approx(area), pytest.approx(around))
    for r in patch.hull_vertices(df, ["k"]).collect():
        assert np.array_equal([(v.x, v.y) for v in r.vertices], g.hull2d(of[r.k][:, :2]))
    density = {r.k: r.data_confidence for r in patch.density3d(df.where("k IS NOT NULL"), ["k"]).collect()}
    assert density == {k: pytest.approx(len(p) / a if (a := g.hull3d_area(p)) > 0 else -1) for k, p in of.items() if k}
    assert patch.hull_vertices(df.limit(0), ["k"]).count() == 0
    few = patch.spanning(df.where("k = 'big'"), ["k"], "xy").count()
    assert few < 5000 / 10  # what moves are vertices


def test_clusters_as_long_as_the_cloud(spark):
    """A line of cells under scrambled numbers, cut once, and a cell alone: passes do not grow with its length."""
    n = 3000
    ids = [i * 1237 % 3001 for i in range(n)]
    edges = [(ids[i], ids[i + 1], i, -i, i + 1, -i - 1) for i in range(n - 1) if i != 999]
    edges = spark.createDataFrame(edges, "a long, b long, ax long, ay long, bx long, by long")
    nodes = spark.createDataFrame([(i,) for i in [*ids, 9999]], "id long")
    found = dict(algorithms.clusters(edges, nodes).collect())
    assert found == {i: min(ids[:1000]) for i in ids[:1000]} | {i: min(ids[1000:]) for i in ids[1000:]} | {9999: 9999}


def test_first_zones_climb_little_in_vain(spark, monkeypatch):
    """Each simulation's first attempt gives a zone: what many simulations climb at first does not grow with their number."""
    c, seen = cloud(spark, grid(n=41)), []
    candidates = growth.candidates
    monkeypatch.setattr(growth, "candidates", lambda seeds, *a, **k: (seen.append(seeds.count()), candidates(seeds, *a, **k))[1])
    seeds = [(sim, i, 41 * (10 + at % 21) + 10 + at // 21, (10 + at % 21) / 10, (10 + at // 21) / 10, 0.0) for sim in range(20) for i in range(64) for at in [(sim + 20 * i) % 441]]
    seeds = spark.createDataFrame(seeds, "sim long, attempt long, seed_pid long, seed_x double, seed_y double, seed_z double")
    found = growth.first_zones(seeds, c, 1, 0.5, 10, 25.0, by=("sim",), max_rungs=1)
    assert sorted((r.sim, r.attempt) for r in found.collect()) == [(sim, 0) for sim in range(20)]
    assert sum(seen) <= 256


def test_points_above_others_are_certain_at_once(spark, monkeypatch):
    """Neighbours up to three sides of a cell away need no pass of their own."""
    rng = np.random.default_rng(7)
    xyz = np.c_[rng.random((6000, 2)) * 16, np.zeros(6000)]
    xyz[::60, 2] = np.sqrt(24 * 16 * 16 / 6000) * 1.6
    c, passes = cloud(spark, xyz.tolist()), []
    from levelground.operators import storage

    write = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: (passes.append(name), write(df, name))[1])
    found = {r.pid: r.mean_distance for r in ops.mean_distances(c, 5).collect()}
    rows, d2, _ = g.nearest(xyz, xyz, 6)
    assert all(abs(found[i] - np.sqrt(d2[i, 1:]).mean()) < 1e-9 for i in range(6000))
    assert passes.count("neighbours") == 1


@pytest.mark.parametrize("part_points", [60_000, 30])
def test_passes_in_parts_give_the_same_ladder(spark, monkeypatch, part_points):
    """Parts of a pass are looked at apart, however few points they have, and the ladder is that of each patch by itself."""
    rng = np.random.default_rng(3)
    xyz = np.column_stack([rng.random((1500, 2)) * 12, 0.01 * rng.random(1500)])
    xyz[(xyz[:, 0] > 9) & (xyz[:, 1] > 9), 2] += 3 * rng.random()
    monkeypatch.setattr(growth, "PART_POINTS", part_points)
    c = cloud(spark, xyz.tolist())
    seeds = ops.every_point(c.where("pid IN (0, 7, 20, 33, 41)"))
    got = {(r.attempt, r.rung): (r.n, r.flat) for r in growth.growth_ladder(seeds, c, 0.5, 8, 25.0, 0.5).collect()}
    want, diagonal = {}, float(np.linalg.norm(np.ptp(xyz, axis=0)))
    for s in (0, 7, 20, 33, 41):
        d = np.sqrt(((xyz - xyz[s]) ** 2).sum(axis=1))
        for m in range(growth.rungs_to(diagonal, 0.5, 0.5)):
            inside = xyz[d < 0.5 + 0.5 * m]
            flat = len(inside) > 2 and bool(np.all(g.local_slopes(inside, 8) <= 25.0))
            want[s, m] = (len(inside), flat)
            if not flat:
                break
    assert got == want


def test_nearest_looks_at_many_columns_at_once(monkeypatch):
    """20,000 points are some 3,000 columns, which a call for each would look at one by one."""
    calls, real = [], g._least
    monkeypatch.setattr(g, "_least", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(5)
    xyz = rng.random((20_000, 3)) * [20, 20, 0.1]
    of = xyz[:500]
    rows, d2, exact = g.nearest(xyz, xyz, 10, 0.8)
    assert exact.all() and len(calls) < 60
    far = ((of[:, None] - xyz[None]) ** 2).sum(axis=2)
    assert (rows[:500] == np.argsort(far, axis=1, kind="stable")[:, :10]).all()


def test_hull_of_a_ring_walks_over_few():
    """Of a ring half a metre wide and 46 m in radius, most points lie inside the polygon of 128 extremes."""
    rng = np.random.default_rng(6)
    turn, r = rng.random(6_000) * 2 * np.pi, 45.5 + 0.5 * rng.random(6_000)
    xy = np.column_stack([r * np.cos(turn), r * np.sin(turn)])
    assert g._not_inside(xy).sum() < 600
    inner = np.concatenate([xy, rng.random((500, 2))])
    assert np.array_equal(g.hull2d(inner), g.hull2d(xy))


def test_seeds_too_high_end_early(spark):
    """A gentle slope before a wall: of zones of little relief the same ones as among all, and no patch is grown far beyond."""
    rng = np.random.default_rng(8)
    xyz = np.column_stack([rng.random((9000, 2)) * 24, np.zeros(9000)])
    xyz[:, 2] = 0.1 * xyz[:, 0] + 3 * np.maximum(0, xyz[:, 0] - 16) + 0.001 * rng.random(9000)
    c = cloud(spark, xyz.tolist())
    seeds = ops.off_edge(ops.every_point(c.where("pid % 150 = 0")), c, 0.5)
    of = lambda df: sorted(df.select("attempt", "rung", "n", "relief", "score").collect())
    whole, few = growth.candidates(seeds, c, 0.5, 8, 25.0), growth.candidates(seeds, c, 0.5, 8, 25.0, max_relief=0.5)
    assert of(few) == of(whole.where("relief <= 0.5")) and 0 < few.count() < whole.count()
    ladder = growth.growth_ladder(seeds, c, 0.5, 8, 25.0, max_relief=0.5)
    assert not ladder.join(ladder.where("flat AND relief > 0.5").selectExpr("attempt", "rung AS high"), "attempt").where("rung > high").count()
    ends = {r.attempt: r.ends for r in growth.relief_bound(seeds, growth.surface(c, 8), 0.5).collect()}
    for r in seeds.collect():
        d = np.sqrt(((xyz - [r.seed_x, r.seed_y, r.seed_z]) ** 2).sum(axis=1))
        assert np.ptp(xyz[d <= ends[r.attempt] + 1e-9, 2]) > 0.5 and ends[r.attempt] < 8


def test_seeds_high_but_never_round_climb_on(spark):
    """The last round patch of a strip is low; the long ones after it are high, and do not count."""
    c = cloud(spark, [(0.02 * i, 0.02 * j, 0.006 * i) for i in range(201) for j in range(3)])
    seeds = ops.every_point(c.where("pid = 301"))
    whole = growth.candidates(seeds, c, 0.1, 6, 25.0, 0.2).select("rung", "n", "relief").collect()
    assert whole[0].relief < 0.35 and growth.candidates(seeds, c, 0.1, 6, 25.0, 0.2, max_relief=0.35).select("rung", "n", "relief").collect() == whole
