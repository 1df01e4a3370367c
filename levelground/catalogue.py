"""Every query of the engine over the orders terrain, and DuckDB SQL that gives the same rows in another way."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelground.operators import cloud as ops
from levelground.operators import growth, patch, spatial
from levelground.operators.storage import shared_dir, stored
from levelground.plans import algorithms, config
from levelground.plans.pipeline import run as run_pipeline
from levelground.sources.pcd import save_cloud
from levelground.sources.tables import orders_terrain

# Parameters of the catalogue's detector; the number of attempts is the sampling operator's own.
ATTEMPTS, RADIUS, K, LIMIT, INCREMENT = 50, 0.5, 10, 25.0, 0.5
ONE = 1.0  # the radius of queries on one patch for each seed

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None, **parameters):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_tables(oracle, **parameters)
        return f

    return add


def with_tables(select: str, **parameters) -> str:
    """The statement with those tables that it needs, as DuckDB computes materialized ones that nothing reads, too."""
    parts = re.split(r"^(\w+) AS (?=MATERIALIZED \(|\()", tables_of(**parameters), flags=re.M)
    tables = {name: body.strip().rstrip(",") for name, body in zip(parts[1::2], parts[2::2])}
    needed: dict[str, str] = {}  # each after those that it reads

    def need(text: str) -> None:
        for word in re.findall(r"\w+", text):
            if word in tables and word not in needed:
                body = tables.pop(word)
                need(body)
                needed[word] = body

    need(select)
    return "WITH " + ",\n".join(f"{name} AS {body}" for name, body in needed.items()) + "\n" + select


def r(name: str, digits: int = 4, alias: str | None = None):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(alias or name)  # no negative zero


def _eigen(src: str, keys: str, out: str) -> str:
    """CTEs from covariances in src to unit normals nx, ny, nz in out."""
    return f"""
{out}_q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {src}),
{out}_p AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM {out}_q),
{out}_l AS (SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(acos(least(1.0, greatest(-1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 + 2 * pi() / 3) END AS lam FROM {out}_p),
{out}_c AS (SELECT *, xy * yz - xz * (yy - lam) AS ax, xz * xy - (xx - lam) * yz AS ay, (xx - lam) * (yy - lam) - xy * xy AS az,
  xy * (zz - lam) - xz * yz AS bx, xz * xz - (xx - lam) * (zz - lam) AS b_y, (xx - lam) * yz - xy * xz AS bz,
  (yy - lam) * (zz - lam) - yz * yz AS cx_, yz * xz - xy * (zz - lam) AS cy_, xy * yz - (yy - lam) * xz AS cz_ FROM {out}_l),
{out}_s AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS sa, sqrt(bx * bx + b_y * b_y + bz * bz) AS sb, sqrt(cx_ * cx_ + cy_ * cy_ + cz_ * cz_) AS sc FROM {out}_c),
{out}_v AS (SELECT *, CASE WHEN sa >= sb AND sa >= sc THEN ax WHEN sb >= sc THEN bx ELSE cx_ END AS vx, CASE WHEN sa >= sb AND sa >= sc THEN ay WHEN sb >= sc THEN b_y ELSE cy_ END AS vy,
  CASE WHEN sa >= sb AND sa >= sc THEN az WHEN sb >= sc THEN bz ELSE cz_ END AS vz, greatest(sa, sb, sc) AS sv FROM {out}_s),
{out} AS (SELECT {keys}, CASE WHEN sv > 0 THEN CASE WHEN vz < 0 THEN -vx ELSE vx END / sv END AS nx, CASE WHEN sv > 0 THEN CASE WHEN vz < 0 THEN -vy ELSE vy END / sv END AS ny,
  CASE WHEN sv > 0 THEN abs(vz) / sv END AS nz, CASE WHEN sv > 0 THEN degrees(acos(least(1.0, abs(vz) / sv))) END AS slope_deg, lam, xx, yy, zz{', mx, my, mz' if 'plane' in out else ''} FROM {out}_v)"""


def _cov(p: str) -> str:
    return f"covar_pop({p}x, {p}x) AS xx, covar_pop({p}x, {p}y) AS xy, covar_pop({p}x, {p}z) AS xz, covar_pop({p}y, {p}y) AS yy, covar_pop({p}y, {p}z) AS yz, covar_pop({p}z, {p}z) AS zz, avg({p}x) AS mx, avg({p}y) AS my, avg({p}z) AS mz"


def _hull(src: str, out: str) -> str:
    """CTEs from points of patches in src to n_vertices, area and perimeter of their hulls: points inside the polygon of the
    extremes in 64 directions are left out, then edges are pairs with no point on their right."""
    return f"""{out}_e AS (SELECT sim, attempt, m, t, arg_max(kx, kx * cos(t * pi() / 32) + ky * sin(t * pi() / 32)) AS ex, arg_max(ky, kx * cos(t * pi() / 32) + ky * sin(t * pi() / 32)) AS ey FROM {src}, (SELECT unnest(range(64)) AS t) GROUP BY ALL),
{out}_b AS (SELECT a.sim, a.attempt, a.m, a.ex AS ux, a.ey AS uy, b.ex AS vx, b.ey AS vy FROM {out}_e a JOIN {out}_e b USING (sim, attempt, m) WHERE b.t = (a.t + 1) % 64 AND (a.ex <> b.ex OR a.ey <> b.ey)),
{out}_i AS (SELECT sim, attempt, m, pid FROM {src} JOIN {out}_b USING (sim, attempt, m) GROUP BY ALL HAVING bool_and((vx - ux) * (ky - uy) - (vy - uy) * (kx - ux) > 0)),
{out}_r AS MATERIALIZED (SELECT p.* FROM {src} p ANTI JOIN {out}_i USING (sim, attempt, m, pid)),
{out}_s AS (SELECT a.sim, a.attempt, a.m, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM {out}_r a JOIN {out}_r b USING (sim, attempt, m)
  WHERE (a.kx <> b.kx OR a.ky <> b.ky) AND NOT EXISTS (SELECT 1 FROM {out}_r c WHERE c.sim = a.sim AND c.attempt = a.attempt AND c.m = a.m
    AND ((b.kx - a.kx) * (c.ky - a.ky) - (b.ky - a.ky) * (c.kx - a.kx) < 0
      OR ((b.kx - a.kx) * (c.ky - a.ky) - (b.ky - a.ky) * (c.kx - a.kx) = 0 AND ((c.kx - a.kx) * (c.kx - b.kx) > 0 OR (c.ky - a.ky) * (c.ky - b.ky) > 0))))),
{out} AS MATERIALIZED (SELECT sim, attempt, m, count(*) AS n_vertices, abs(sum(ux * vy - vx * uy)) / 2 AS area, sum(sqrt((vx - ux) ** 2 + (vy - uy) ** 2)) AS perimeter FROM {out}_s GROUP BY ALL HAVING count(*) >= 3)"""


def tables_of(sims: int = 3, attempts: int = ATTEMPTS, k: int = K, increment: float = INCREMENT, cell: float = 1.0, near: int = 1) -> str:
    """cell, near: rims look for neighbours in square cells, so many to each side where the k-th in the cloud is near."""
    return f"""
side AS (SELECT sqrt(count(*) / CAST(37.5 AS DOUBLE)) AS l FROM orders),
flat_xy AS (SELECT CAST(o_orderkey AS BIGINT) AS pid, (o_orderkey * 7919) % 10007 AS kx, (o_orderkey * 3571) % 10009 AS ky, CAST(o_totalprice AS DOUBLE) AS price, l,
  l * ((o_orderkey * 7919) % 10007) / CAST(10007.0 AS DOUBLE) AS x, l * ((o_orderkey * 3571) % 10009) / CAST(10009.0 AS DOUBLE) AS y FROM orders, side),
cloud AS MATERIALIZED (SELECT pid, kx, ky, x, y, CAST(4e-8 AS DOUBLE) * price + CASE WHEN x > l / 2 THEN CAST(0.6 AS DOUBLE) * (x - l / 2) ELSE CAST(0.05 AS DOUBLE) * x END
  + CASE WHEN pid % 97 = 0 AND y > CAST(0.75 AS DOUBLE) * l THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS z, CAST(pid * 31 % 5 AS DOUBLE) AS intensity FROM flat_xy),
box AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS b_y, count(*) AS n FROM cloud),
numbered AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS i FROM cloud),
sims AS (SELECT unnest(range({sims})) AS sim),
seeds AS MATERIALIZED (SELECT sim, attempt, pid AS seed_pid, x AS sx, y AS sy, z AS sz FROM sims, (SELECT unnest(range({attempts})) AS attempt), box, numbered WHERE i = (attempt * 7919 + 13 + sim) % n),
inside AS MATERIALIZED (SELECT seeds.* FROM seeds, box WHERE sx BETWEEN ax + {RADIUS} AND bx - {RADIUS} AND sy BETWEEN ay + {RADIUS} AND b_y - {RADIUS}),
near_seed AS MATERIALIZED (SELECT sim, attempt, pid, kx, ky, x, y, z, (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) AS d2 FROM inside, cloud WHERE sim = 0 AND x BETWEEN sx - 1 AND sx + 1 AND y BETWEEN sy - 1 AND sy + 1),
patch AS MATERIALIZED (SELECT near_seed.*, m FROM near_seed, (SELECT unnest(range(2)) AS m) WHERE d2 < ({RADIUS} + {increment} * m) * ({RADIUS} + {increment} * m)),
one AS (SELECT * FROM patch WHERE m = 1),
point AS MATERIALIZED (SELECT * FROM patch WHERE m = 1 AND sim = 0),
pairs AS (SELECT a.sim, a.attempt, a.m, a.pid, b.pid AS other, b.x AS ox, b.y AS oy, b.z AS oz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM one a JOIN one b USING (sim, attempt, m)),
near AS MATERIALIZED (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY sim, attempt, m, pid ORDER BY d2, other) <= {k}),
near_cov AS (SELECT sim, attempt, m, pid, {_cov('o')} FROM near GROUP BY ALL),
{_eigen('near_cov', 'sim, attempt, m, pid', 'normal')},
classed AS MATERIALIZED (SELECT one.*, slope_deg, coalesce(slope_deg <= {LIMIT}, false) AS inlier FROM one LEFT JOIN normal USING (sim, attempt, m, pid)),
rung AS MATERIALIZED (SELECT sim, attempt, m, count(*) AS n, count(*) FILTER (NOT inlier) AS n_out FROM classed GROUP BY ALL),
patch_cov AS (SELECT sim, attempt, m, {_cov('')} FROM one GROUP BY ALL),
{_eigen('patch_cov', 'sim, attempt, m', 'plane')},
{_hull('one', 'hull')},
shape AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS circularity FROM hull),
rungs AS (SELECT unnest(range(CAST(floor((sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) - {RADIUS}) / {increment}) AS BIGINT) + 2)) AS m FROM cloud),
local AS MATERIALIZED (SELECT cloud.*, kdist, coalesce(slope_deg <= {LIMIT}, false) AS gentle, CAST(floor(x / {cell}) AS BIGINT) AS gx, CAST(floor(y / {cell}) AS BIGINT) AS gy
  FROM cloud JOIN (SELECT pid, sqrt(max(d2)) AS kdist FROM (SELECT * FROM cloud_near QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, other) <= {k}) GROUP BY pid) USING (pid) JOIN cloud_normal USING (pid)),
span AS MATERIALIZED (SELECT sim, attempt, local.*, sqrt((x - sx) ** 2 + (y - sy) ** 2 + (z - sz) ** 2) AS d FROM inside, local),
steep_at AS (SELECT sim, attempt, min(d + kdist) AS ends FROM span WHERE NOT gentle GROUP BY ALL),
open_rung AS MATERIALIZED (SELECT inside.sim, inside.attempt, m, {RADIUS} + {increment} * m AS r FROM inside LEFT JOIN steep_at USING (sim, attempt), rungs WHERE ends IS NULL OR {RADIUS} + {increment} * (m - 1) <= ends),
sure AS (SELECT o.*, ends IS NULL OR r <= ends AS calm FROM open_rung o LEFT JOIN steep_at USING (sim, attempt)),
rim_at AS MATERIALIZED (SELECT sim, attempt, m, r, pid, x, y, z, gx, gy, CASE WHEN kdist < 0.6 THEN {near} ELSE 4 * {near} END AS far FROM span JOIN open_rung USING (sim, attempt) WHERE d < r AND d + kdist >= r),
rim_around AS (SELECT a.sim, a.attempt, a.m, a.pid, min_by({{'ox': b.x, 'oy': b.y, 'oz': b.z}}, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, {k}) AS around FROM
  (SELECT *, unnest(range(gx - far, gx + far + 1)) AS bx FROM rim_at) a JOIN span b ON a.sim = b.sim AND a.attempt = b.attempt AND a.bx = b.gx AND b.gy BETWEEN a.gy - a.far AND a.gy + a.far AND b.d < a.r GROUP BY ALL),
rim_cov AS (SELECT sim, attempt, m, pid, {_cov('')} FROM (SELECT sim, attempt, m, pid, n.ox AS x, n.oy AS y, n.oz AS z FROM (SELECT *, unnest(around) AS n FROM rim_around)) GROUP BY ALL),
{_eigen('rim_cov', 'sim, attempt, m, pid', 'rim_normal')},
rim_out AS (SELECT sim, attempt, m, count(*) FILTER (slope_deg IS NULL OR slope_deg > {LIMIT}) AS n_out FROM rim_normal GROUP BY ALL),
size_at AS (SELECT o.sim, o.attempt, o.m, count(*) AS n FROM open_rung o JOIN span s ON s.sim = o.sim AND s.attempt = o.attempt AND s.d < o.r GROUP BY ALL),
climb AS MATERIALIZED (SELECT sim, attempt, m, r, n, n >= 3 AND calm AND coalesce(n_out, 0) = 0 AS flat FROM sure JOIN size_at USING (sim, attempt, m) LEFT JOIN rim_out USING (sim, attempt, m)),
stops AS (SELECT sim, attempt, coalesce(min(m) FILTER (NOT flat), max(m) + 1) AS stop FROM climb GROUP BY ALL),
best AS MATERIALIZED (SELECT sim, attempt, stop - 1 AS m, CAST({RADIUS} + {increment} * (stop - 1) AS DOUBLE) AS r FROM stops WHERE stop > 0),
best_points AS MATERIALIZED (SELECT s.sim, s.attempt, m, pid, kx, ky, x, y, z FROM span s JOIN best b ON s.sim = b.sim AND s.attempt = b.attempt AND s.d < b.r),
{_hull('best_points', 'best_hull')},
best_cov AS (SELECT sim, attempt, m, {_cov('')} FROM best_points GROUP BY ALL),
{_eigen('best_cov', 'sim, attempt, m', 'best_plane')},
centre AS (SELECT sim, attempt, m, avg(x) AS cx, avg(y) AS cy, max(z) AS top, max(z) - min(z) AS relief, count(*) AS n FROM best_points GROUP BY ALL),
disc AS MATERIALIZED (SELECT c.*, (SELECT max(sqrt((p.x - c.cx) ** 2 + (p.y - c.cy) ** 2)) FROM best_points p WHERE p.sim = c.sim AND p.attempt = c.attempt) AS r FROM centre c),
spheres AS (SELECT sim, attempt, cx, cy, top, r, top + CAST(0.2 AS DOUBLE) * k AS h FROM disc, (SELECT unnest(range(51)) AS k)),
blocked AS MATERIALIZED (SELECT DISTINCT sim, attempt FROM spheres JOIN cloud ON z > top + 0.01 AND x BETWEEN cx - r AND cx + r AND y BETWEEN cy - r AND cy + r AND (x - cx) ** 2 + (y - cy) ** 2 + (z - h) ** 2 < r * r),
rough AS (SELECT sim, attempt, slope_deg, sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)) AS roughness FROM best_points JOIN best_plane USING (sim, attempt, m) GROUP BY ALL),
zones AS MATERIALIZED (SELECT sim, attempt, seed_pid, sx, sy, sz, m, CAST({RADIUS} + {increment} * m AS DOUBLE) AS patch_radius, disc.n / area AS data_confidence, relief, roughness, slope_deg,
  disc.n / area + CAST({RADIUS} + {increment} * m AS DOUBLE) - relief - roughness AS score FROM disc JOIN rough USING (sim, attempt) JOIN best_hull USING (sim, attempt, m) JOIN inside USING (sim, attempt) ANTI JOIN blocked USING (sim, attempt)),
zone_points AS (SELECT best_points.* FROM best_points JOIN zones USING (sim, attempt)),
grid AS (SELECT *, CAST(floor(x / 1.0) AS BIGINT) AS gx, CAST(floor(y / 1.0) AS BIGINT) AS gy FROM cloud),
wide AS (SELECT *, CAST(floor(x / 2.5) AS BIGINT) AS gx, CAST(floor(y / 2.5) AS BIGINT) AS gy FROM cloud),
cell_n AS (SELECT gx + dx AS gx, gy + dy AS gy, pid, x, y, z FROM wide, (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)),
cloud_near AS MATERIALIZED (SELECT a.pid, b.pid AS other, b.x AS ox, b.y AS oy, b.z AS oz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM cell_n a JOIN wide b USING (gx, gy) QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY d2, b.pid) <= {k + 1}),
cloud_cov AS (SELECT pid, {_cov('o')} FROM (SELECT * FROM cloud_near QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, other) <= {k}) GROUP BY ALL),
{_eigen('cloud_cov', 'pid', 'cloud_normal')},
distances AS MATERIALIZED (SELECT pid, avg(sqrt(d2)) AS mean_distance FROM (SELECT * FROM cloud_near WHERE other <> pid QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d2, other) <= {k}) GROUP BY pid),
sor_limit AS (SELECT avg(mean_distance) + 1.0 * stddev_samp(mean_distance) AS lim FROM distances),
whole_cov AS (SELECT 1 AS g, {_cov('')} FROM cloud),
{_eigen('whole_cov', 'g', 'whole_plane')},
round_cell AS MATERIALIZED (SELECT s.gx, s.gy, x, y, z FROM (SELECT gx, gy, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz, unnest(range(gx - 1, gx + 2)) AS hx FROM grid GROUP BY gx, gy) s
  JOIN grid g ON s.hx = g.gx AND g.gy BETWEEN s.gy - 1 AND s.gy + 1 WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz) < 0.25),
round_cov AS (SELECT gx, gy, {_cov('')} FROM round_cell GROUP BY ALL),
{_eigen('round_cov', 'gx, gy', 'round_normal')},
cell_cov AS (SELECT gx, gy, {_cov('')} FROM grid GROUP BY ALL),
{_eigen('cell_cov', 'gx, gy', 'cell_normal')},
half_cov AS (SELECT gx, gy, {_cov('')} FROM (SELECT CAST(floor((x - 1) / 0.5) AS BIGINT) + 1 + dx AS gx, CAST(floor((y - 1) / 0.5) AS BIGINT) + 1 + dy AS gy, x, y, z FROM cloud, (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(2)) AS dy)) GROUP BY ALL),
{_eigen('half_cov', 'gx, gy', 'half_normal')}
"""


def _cloud(spark, sf_dir) -> DataFrame:
    return orders_terrain(spark, sf_dir)


def _terrain(spark, sf_dir) -> DataFrame:
    """The cloud written once, in even parts, for queries that read it many times."""
    return stored(_cloud(spark, sf_dir).repartition("pid"), "terrain")


def _seeds(spark, sf_dir) -> DataFrame:
    return ops.sample_seeds(_cloud(spark, sf_dir), ATTEMPTS)


def _inside(spark, sf_dir, cloud: DataFrame | None = None) -> DataFrame:
    cloud = _cloud(spark, sf_dir) if cloud is None else cloud
    return ops.off_edge(ops.sample_seeds(cloud, ATTEMPTS), cloud, RADIUS)


def _one(spark, sf_dir) -> DataFrame:
    return spatial.radius_join(_inside(spark, sf_dir), _cloud(spark, sf_dir), ONE)


def _patches(spark, sf_dir) -> DataFrame:
    """Patches of at least three points, as hulls need."""
    one = _one(spark, sf_dir)
    return one.join(patch.at_least(one, ["attempt"]).select("attempt"), "attempt", "left_semi")


def _found(spark, sf_dir, cloud: DataFrame | None = None) -> DataFrame:
    cloud = _terrain(spark, sf_dir) if cloud is None else cloud
    return growth.candidates(stored(_inside(spark, sf_dir, cloud), "seeds"), cloud, RADIUS, K, LIMIT, INCREMENT)


def _zones(df: DataFrame, *more: str) -> DataFrame:
    return df.select("attempt", "seed_pid", r("patch_radius"), r("data_confidence"), r("relief"), r("roughness"), r("score"), *more)


ZONE = "attempt, seed_pid, round(patch_radius, 4) AS patch_radius, round(data_confidence, 4) AS data_confidence, round(relief, 4) AS relief, round(roughness, 4) AS roughness, round(score, 4) AS score"


@query("SELECT pid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, intensity FROM cloud")
def scan_cloud(spark, d):
    return ops.valid(_cloud(spark, d)).select("pid", r("x"), r("y"), r("z"), "intensity")


@query("SELECT round(min(x), 4) AS min_x, round(max(x), 4) AS max_x, round(min(y), 4) AS min_y, round(max(y), 4) AS max_y, round(min(z), 4) AS min_z, round(max(z), 4) AS max_z FROM cloud")
def cloud_bbox(spark, d):
    return ops.bounds(_cloud(spark, d)).select(*[r(f"{m}_{c}") for c in "xyz" for m in ("min", "max")])


@query("SELECT count(*) AS n_points FROM cloud")
def cloud_count(spark, d):
    return ops.count(_cloud(spark, d))


@query("SELECT pid, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 3) AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 3) AS z, CAST(0.0 AS FLOAT) AS intensity FROM cloud")
def library_round_trip(spark, d):
    return ops.restore_intensity(ops.drop_intensity(_cloud(spark, d))).select("pid", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], "intensity")


@query("SELECT round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 3) AS y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 3) AS z, intensity FROM cloud")
def pcd_round_trip(spark, d):
    """The terrain written as PCD files, and read by tasks of a thousand points each."""
    folder = f"{shared_dir(spark)}/pcd-{uuid.uuid4().hex}"
    save_cloud(_cloud(spark, d), folder)
    back = spark.read.format("pcd").option("pointsPerTask", 1000).load(folder)
    return back.select(*[F.round(F.col(c).cast("double"), 3).alias(c) for c in "xyz"], F.col("intensity").cast("double").alias("intensity"))


@query("SELECT CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, round(avg(intensity), 4) AS intensity, count(*) AS n_points FROM cloud GROUP BY ALL")
def voxel_downsample(spark, d):
    return ops.voxel_downsample(_cloud(spark, d), 0.5).select("vx", "vy", "vz", r("x"), r("y"), r("z"), r("intensity"), "n_points")


@query("SELECT attempt, seed_pid, round(sx, 4) AS seed_x, round(sy, 4) AS seed_y, round(sz, 4) AS seed_z FROM seeds WHERE sim = 0")
def seed_sample(spark, d):
    return _seeds(spark, d).select("attempt", "seed_pid", r("seed_x"), r("seed_y"), r("seed_z"))


@query("SELECT attempt, seed_pid FROM inside WHERE sim = 0")
def seed_edge_filter(spark, d):
    return _inside(spark, d).select("attempt", "seed_pid")


@query("SELECT attempt, pid, round(d2, 4) AS d2 FROM one")
def radius_neighbours(spark, d):
    return _one(spark, d).select("attempt", "pid", r("d2"))


@query("SELECT attempt, count(*) AS n_points FROM one GROUP BY ALL")
def radius_count(spark, d):
    return _one(spark, d).groupBy("attempt").agg(F.count("*").alias("n_points"))


@query("SELECT attempt, count(*) AS n_points FROM patch WHERE sim = 0 AND m = 0 GROUP BY ALL HAVING count(*) >= 3")
def radius_min3(spark, d):
    return patch.at_least(spatial.radius_join(_inside(spark, d), _cloud(spark, d), RADIUS), ["attempt"])


@query("SELECT attempt, pid, other, round(d2, 6) AS d2 FROM near WHERE sim = 0 AND m = 1")
def knn_patch(spark, d):
    return spatial.knn_in_group(_one(spark, d), ["attempt"], K).select("attempt", "pid", "other", r("d2", 6))


@query("SELECT pid, round(mean_distance, 5) AS mean_distance FROM distances")
def knn_mean_distance(spark, d):
    return ops.mean_distances(_cloud(spark, d), K).select("pid", r("mean_distance", 5))


@query("SELECT pid, round(mean_distance, 5) AS mean_distance FROM distances, sor_limit WHERE mean_distance <= lim")
def sor_filter(spark, d):
    return ops.sor_classify(_cloud(spark, d), K, 1.0).where("inlier").select("pid", r("mean_distance", 5))


@query("SELECT pid, round(mean_distance, 5) AS mean_distance FROM distances, sor_limit WHERE mean_distance > lim")
def sor_outliers(spark, d):
    return ops.sor_classify(_cloud(spark, d), K, 1.0).where("NOT inlier").select("pid", r("mean_distance", 5))


@query("SELECT attempt, pid, round(slope_deg, 3) AS slope_deg FROM normal WHERE sim = 0 AND m = 1")
def local_normals_slope(spark, d):
    return patch.local_normals(_one(spark, d), ["attempt"], K).select("attempt", "pid", r("slope_deg", 3))


@query("SELECT attempt, pid FROM classed WHERE sim = 0 AND m = 1 AND inlier")
def slope_inliers(spark, d):
    return patch.classified(_one(spark, d), ["attempt"], LIMIT, K).where("inlier").select("attempt", "pid")


@query("SELECT attempt, pid FROM classed WHERE sim = 0 AND m = 1 AND NOT inlier")
def slope_outliers(spark, d):
    return patch.classified(_one(spark, d), ["attempt"], LIMIT, K).where("NOT inlier").select("attempt", "pid")


@query("SELECT attempt, n AS n_points, n_out AS n_outliers, n_out = 0 AS flat FROM rung WHERE sim = 0 AND m = 1")
def patch_flat(spark, d):
    return patch.flatness(patch.classified(_one(spark, d), ["attempt"], LIMIT, K), ["attempt"])


@query("SELECT round(nx, 4) + CAST(0.0 AS DOUBLE) AS a, round(ny, 4) + CAST(0.0 AS DOUBLE) AS b, round(nz, 4) AS c, round(-(nx * mx + ny * my + nz * mz), 3) AS d FROM whole_plane")
def global_plane(spark, d):
    return ops.plane(_cloud(spark, d)).select(r("a"), r("b"), r("c"), r("d", 3))


@query("SELECT attempt, round(slope_deg, 3) AS slope_deg FROM plane WHERE sim = 0 AND m = 1")
def global_slope(spark, d):
    return ops.plane(_one(spark, d), ("attempt",)).select("attempt", r("slope_deg", 3))


@query(f"SELECT cloud.pid, round(slope_deg, 3) AS slope_deg, coalesce(slope_deg <= {LIMIT}, false) AS inlier FROM cloud LEFT JOIN cloud_normal USING (pid)")
def pca_classify(spark, d):
    return ops.slope_classes(_cloud(spark, d), LIMIT, K).select("pid", r("slope_deg", 3), "inlier")


@query("SELECT attempt, round(coalesce(sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)), -1.0), 5) AS roughness FROM one JOIN plane USING (sim, attempt, m) GROUP BY ALL")
def patch_roughness(spark, d):
    one = _one(spark, d)
    return patch.roughness(one, ops.plane(one, ("attempt",)), ["attempt"]).select("attempt", r("roughness", 5))


@query("SELECT attempt, round(max(z) - min(z), 4) AS relief FROM one GROUP BY ALL")
def patch_relief(spark, d):
    return patch.relief(_one(spark, d), ["attempt"]).select("attempt", r("relief"))


@query("SELECT attempt, round(c.cx, 4) AS cx, round(c.cy, 4) AS cy, round(max(sqrt((x - c.cx) ** 2 + (y - c.cy) ** 2)), 4) AS reach, round(max(z), 4) AS max_z FROM one JOIN (SELECT attempt, avg(x) AS cx, avg(y) AS cy FROM one GROUP BY ALL) c USING (attempt) GROUP BY attempt, c.cx, c.cy")
def patch_data(spark, d):
    return patch.patch_data(_one(spark, d), ["attempt"]).select("attempt", r("cx"), r("cy"), r("reach"), r("max_z"))


@query("SELECT attempt, round(area, 4) AS area FROM hull WHERE sim = 0 AND m = 1")
def patch_hull_area(spark, d):
    return patch.hulls(_patches(spark, d), ["attempt"]).select("attempt", r("area"))


@query("SELECT attempt, round(perimeter, 4) AS perimeter FROM hull WHERE sim = 0 AND m = 1")
def patch_perimeter(spark, d):
    return patch.hulls(_patches(spark, d), ["attempt"]).select("attempt", r("perimeter"))


# Seen from the least vertex, all others lie to its right: their angles give the order.
@query("""SELECT attempt, CAST(row_number() OVER (PARTITION BY attempt ORDER BY s.ux <> o.x OR s.uy <> o.y, atan2(s.uy - o.y, s.ux - o.x)) - 1 AS INTEGER) AS place, round(s.ux, 4) AS x, round(s.uy, 4) AS y
  FROM hull_s s JOIN (SELECT attempt, min({'x': ux, 'y': uy}) AS o FROM hull_s WHERE sim = 0 AND m = 1 GROUP BY attempt) USING (attempt) WHERE s.sim = 0 AND s.m = 1""")
def patch_hull_vertices(spark, d):
    return patch.hull_vertices(_patches(spark, d), ["attempt"]).select("attempt", F.posexplode("vertices").alias("place", "v")).select("attempt", "place", r("v.x", 4, "x"), r("v.y", 4, "y"))


@query("SELECT attempt, round(circularity, 4) AS circularity, circularity >= 0.1 AS round_enough FROM shape WHERE sim = 0 AND m = 1")
def patch_circularity(spark, d):
    return patch.hulls(_patches(spark, d), ["attempt"]).select("attempt", r("circularity"), (F.col("circularity") >= 0.1).alias("round_enough"))


@query("SELECT attempt, round(n / area, 3) AS data_confidence FROM hull JOIN rung USING (sim, attempt, m) WHERE sim = 0 AND m = 1")
def data_confidence_2d(spark, d):
    return patch.density2d(_patches(spark, d), ["attempt"]).select("attempt", r("data_confidence", 3))


# Faces of the hull in space are triples with all others on one side; extremes in some directions rule most triples out first.
# Points in a line on the ground (kx, ky are whole numbers) make walls of more than three points, which are hulls of their own.
@query("""SELECT attempt, round(count(*) / any_value(area), 3) AS data_confidence FROM point JOIN (WITH
  far AS (SELECT DISTINCT attempt, unnest([arg_max(pid, x * a + y * b + c * 50 * z), arg_min(pid, x * a + y * b + c * 50 * z)]) AS pid FROM point, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b), (SELECT unnest(range(0, 3)) AS c) GROUP BY attempt, a, b, c),
  face AS MATERIALIZED (SELECT u.attempt, u.pid AS i, v.pid AS j, w.pid AS k, u.x, u.y, u.z, (v.y - u.y) * (w.z - u.z) - (v.z - u.z) * (w.y - u.y) AS nx, (v.z - u.z) * (w.x - u.x) - (v.x - u.x) * (w.z - u.z) AS ny, (v.x - u.x) * (w.y - u.y) - (v.y - u.y) * (w.x - u.x) AS nz
    FROM point u JOIN point v ON u.attempt = v.attempt AND u.pid < v.pid JOIN point w ON v.attempt = w.attempt AND v.pid < w.pid WHERE (v.kx - u.kx) * (w.ky - u.ky) <> (v.ky - u.ky) * (w.kx - u.kx)),
  likely AS MATERIALIZED (SELECT face.* FROM face JOIN (SELECT point.* FROM far JOIN point USING (attempt, pid)) o ON face.attempt = o.attempt GROUP BY ALL
    HAVING bool_and(o.pid IN (i, j, k) OR nx * (o.x - face.x) + ny * (o.y - face.y) + nz * (o.z - face.z) > 0) OR bool_and(o.pid IN (i, j, k) OR nx * (o.x - face.x) + ny * (o.y - face.y) + nz * (o.z - face.z) < 0)),
  sure AS (SELECT likely.* FROM likely JOIN point o ON likely.attempt = o.attempt GROUP BY ALL
    HAVING bool_and(o.pid IN (i, j, k) OR nx * (o.x - likely.x) + ny * (o.y - likely.y) + nz * (o.z - likely.z) > 0) OR bool_and(o.pid IN (i, j, k) OR nx * (o.x - likely.x) + ny * (o.y - likely.y) + nz * (o.z - likely.z) < 0)),
  side AS (SELECT s.attempt, a.pid AS edge, a.kx AS ax, a.ky AS ay, b.kx AS bx, b.ky AS b_y, ux, uy FROM hull_s s JOIN point a ON s.attempt = a.attempt AND s.ux = a.x AND s.uy = a.y JOIN point b ON s.attempt = b.attempt AND s.vx = b.x AND s.vy = b.y WHERE s.sim = 0 AND s.m = 1),
  wall AS (SELECT attempt, edge, pid, sqrt((x - ux) ** 2 + (y - uy) ** 2) AS t, z FROM side JOIN point USING (attempt) WHERE (bx - ax) * (ky - ay) = (b_y - ay) * (kx - ax)),
  wall_edge AS (SELECT a.attempt, a.edge, a.t AS ut, a.z AS uz, b.t AS vt, b.z AS vz FROM wall a JOIN wall b USING (attempt, edge) WHERE a.pid <> b.pid
    AND NOT EXISTS (SELECT 1 FROM wall c WHERE c.attempt = a.attempt AND c.edge = a.edge AND c.pid <> a.pid AND c.pid <> b.pid AND (b.t - a.t) * (c.z - a.z) - (b.z - a.z) * (c.t - a.t) < 0))
  SELECT attempt, sum(area) AS area FROM (SELECT attempt, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area FROM sure UNION ALL SELECT attempt, abs(sum(ut * vz - vt * uz)) / 2 FROM wall_edge GROUP BY attempt, edge) GROUP BY attempt) h USING (attempt) GROUP BY attempt""")
def data_confidence_3d(spark, d):
    return patch.density3d(_patches(spark, d), ["attempt"]).select("attempt", r("data_confidence", 3))


def _discs(spark, d, cloud: DataFrame | None = None) -> DataFrame:
    cloud = _terrain(spark, d) if cloud is None else cloud
    ladder = growth.growth_ladder(stored(_inside(spark, d, cloud), "seeds"), cloud, RADIUS, K, LIMIT, INCREMENT)
    return stored(growth.best_rungs(ladder), "best")


@query("SELECT attempt FROM blocked WHERE sim = 0")
def patch_collision(spark, d):
    cloud = _terrain(spark, d)
    return patch.blocked(_discs(spark, d, cloud), cloud, ["attempt"])


@query("SELECT attempt FROM disc ANTI JOIN blocked USING (sim, attempt) WHERE sim = 0")
def patch_collision_free(spark, d):
    cloud = _terrain(spark, d)
    return patch.clear(_discs(spark, d, cloud), cloud, ["attempt"]).select("attempt")


@query("SELECT attempt, CAST(m AS INTEGER) AS rung, n, flat FROM climb JOIN stops USING (sim, attempt) WHERE sim = 0 AND m <= stop")
def growth_ladder(spark, d):
    cloud = _terrain(spark, d)
    return growth.growth_ladder(stored(_inside(spark, d, cloud), "seeds"), cloud, RADIUS, K, LIMIT, INCREMENT).select("attempt", "rung", "n", "flat")


@query(f"SELECT attempt, CAST(m AS INTEGER) AS rung, round(CAST({RADIUS} + {INCREMENT} * m AS DOUBLE), 4) AS radius FROM best WHERE sim = 0")
def growth_best_radius(spark, d):
    return _discs(spark, d).select("attempt", "rung", r("radius"))


@query(f"SELECT {ZONE} FROM zones WHERE sim = 0")
def candidate_score(spark, d):
    return _zones(_found(spark, d))


@query(f"SELECT {ZONE}, CAST(row_number() OVER (ORDER BY score DESC, attempt) AS INTEGER) AS rank FROM zones WHERE sim = 0")
def candidate_rank(spark, d):
    return _zones(growth.ranked(_found(spark, d)), "rank")


@query(f"SELECT {ZONE} FROM zones WHERE sim = 0 ORDER BY attempt LIMIT 5")
def landing_zones_first_n(spark, d):
    return _zones(growth.first_n(_found(spark, d), 5))



@query("SELECT attempt, 'ALL' AS metric, round(n / area, 3) AS data_confidence, round(rel, 4) AS relief, round(ro, 4) AS roughness, round(n / area - rel - ro, 3) AS score FROM (SELECT sim, attempt, m, max(z) - min(z) AS rel, sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)) AS ro FROM one JOIN plane USING (sim, attempt, m) GROUP BY ALL) JOIN hull USING (sim, attempt, m) JOIN rung USING (sim, attempt, m)")
def hazard_all(spark, d):
    h = patch.hazard(_patches(spark, d), "ALL", by=("attempt",))
    return h.select("attempt", "metric", r("data_confidence", 3), r("relief"), r("roughness"), r("score", 3))


@query("SELECT 'RELIEF' AS metric, 0.0::DOUBLE AS data_confidence, round(max(z) - min(z), 4) AS relief, 0.0::DOUBLE AS roughness, round(-(max(z) - min(z)), 4) AS score FROM cloud")
def hazard_relief(spark, d):
    return patch.hazard(_cloud(spark, d), "RELIEF").select("metric", "data_confidence", r("relief"), "roughness", r("score"))


@query("SELECT 'ROUGHNESS' AS metric, 0.0::DOUBLE AS data_confidence, 0.0::DOUBLE AS relief, round(sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)), 4) AS roughness, round(-sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)), 4) AS score FROM cloud, whole_plane")
def hazard_roughness(spark, d):
    return patch.hazard(_cloud(spark, d), "ROUGHNESS").select("metric", "data_confidence", "relief", r("roughness"), r("score"))


@query("SELECT attempt, 'DATA_CONFIDENCE' AS metric, round(n / area, 3) AS data_confidence, 0.0::DOUBLE AS relief, 0.0::DOUBLE AS roughness, round(n / area, 3) AS score FROM hull JOIN rung USING (sim, attempt, m) WHERE sim = 0 AND m = 1")
def hazard_density(spark, d):
    return patch.hazard(_patches(spark, d), "DATA_CONFIDENCE", by=("attempt",)).select("attempt", "metric", r("data_confidence", 3), "relief", "roughness", r("score", 3))


@query(f"SELECT {ZONE} FROM zones WHERE sim = 0 AND patch_radius >= 2.5 AND slope_deg <= 25 AND data_confidence >= 30 AND relief <= 2.0 AND roughness <= 0.1")
def hazard_threshold_filter(spark, d):
    return _zones(patch.within_limits(_found(spark, d), max_relief=2.0, max_roughness=0.1))


@query("SELECT attempt, pid FROM zone_points WHERE sim = 0")
def detected_inliers_union_all(spark, d):
    cloud = _terrain(spark, d)
    return growth.detected_points(stored(_found(spark, d, cloud), "found"), cloud, RADIUS, INCREMENT).select("attempt", "pid")


@query("SELECT pid FROM cloud")
def outliers_full_cloud(spark, d):
    return _cloud(spark, d).select("pid")


@query("SELECT pid FROM cloud ANTI JOIN (SELECT pid FROM zone_points WHERE sim = 0) USING (pid)")
def unassigned_points(spark, d):
    cloud = _terrain(spark, d)
    return ops.unassigned(cloud, growth.detected_points(stored(_found(spark, d, cloud), "found"), cloud, RADIUS, INCREMENT)).select("pid")


RANKED = "(SELECT *, CAST(row_number() OVER (ORDER BY score DESC, attempt) AS INTEGER) AS rank FROM zones WHERE sim = 0)"


@query(f"SELECT rank, CAST(i AS INTEGER) AS i, round(sx + patch_radius * cos(2 * pi() * i / 10000), 3) + CAST(0.0 AS DOUBLE) AS x, round(sy + patch_radius * sin(2 * pi() * i / 10000), 3) + CAST(0.0 AS DOUBLE) AS y, round(sz, 3) AS z FROM {RANKED}, (SELECT unnest(range(10000)) AS i)")
def circle_boundary(spark, d):
    return ops.circles(growth.ranked(_found(spark, d))).select("rank", "i", r("x", 3), r("y", 3), r("z", 3))


@query(f"SELECT attempt, rank, concat('Rank ', rank) AS label FROM {RANKED}")
def rank_labels(spark, d):
    return growth.ranked(_found(spark, d)).select("attempt", "rank", "label")


@query(f"SELECT pid, CASE WHEN coalesce(slope_deg <= {LIMIT}, false) THEN 'inlier_cloud' ELSE 'outlier_cloud' END AS role, CASE WHEN coalesce(slope_deg <= {LIMIT}, false) THEN 0 ELSE 255 END AS r, CASE WHEN coalesce(slope_deg <= {LIMIT}, false) THEN 255 ELSE 0 END AS g, 0 AS b FROM cloud LEFT JOIN cloud_normal USING (pid)")
def role_select(spark, d):
    classes = stored(ops.slope_classes(_cloud(spark, d), LIMIT, K), "classes")
    return ops.select_role(classes.where("inlier"), classes.where("NOT inlier"), "both").select("pid", "role", "r", "g", "b")


@query(f"SELECT {ZONE}, rank, concat('Rank ', rank) AS label FROM {RANKED}")
def landing_zone_pipeline(spark, d):
    steps = [config.Step("SphericalNeighbourhood", True, {"k": K, "angleThreshold": LIMIT, "radius": RADIUS, "maxAttempts": ATTEMPTS}), config.Step("anything", False), config.Step("HazarMetrices", True, {"hazard": "RELIEF"})]
    return _zones(run_pipeline(spark, config.Pipeline(d, steps=steps), _cloud(spark, d)).candidates, "rank", "label")


@query("SELECT sim, count(*) AS n_zones, round(max(score), 4) AS best_score FROM zones GROUP BY ALL")
def monte_carlo_summary(spark, d):
    cloud = _terrain(spark, d)
    sims = spark.range(3).select(F.col("id").alias("sim"), (F.col("id") + 13).alias("salt"))
    zones = algorithms.simulated_zones(cloud, sims, ATTEMPTS, RADIUS, K, LIMIT, INCREMENT)
    return zones.groupBy("sim").agg(F.count("*").alias("n_zones"), F.round(F.max("score"), 4).alias("best_score"))


#: Of the benchmark's configuration, with the limits of the one for own clouds.
SIMULATIONS, MOST_ATTEMPTS, LIMITS = 20, 10_000, {"min_radius": 2.5, "max_slope": 25.0, "min_density": 30.0, "max_relief": 2.0, "max_roughness": 0.1}


# The SQL looks at 25 attempts of each simulation, and at the first zone among them; on these tables each has one.
FIRST = f"SELECT sim, {ZONE} FROM zones WHERE patch_radius >= 2.5 AND slope_deg <= 25 AND data_confidence >= 30 AND relief <= 2.0 AND roughness <= 0.1 QUALIFY row_number() OVER (PARTITION BY sim ORDER BY attempt) = 1"


@query(FIRST, sims=SIMULATIONS, attempts=25)
def monte_carlo_first_zones(spark, d):
    sims = spark.range(SIMULATIONS).select(F.col("id").alias("sim"), (F.col("id") + 13).alias("salt"))
    zones = algorithms.simulated_zones(_terrain(spark, d), sims, MOST_ATTEMPTS, RADIUS, K, LIMIT, INCREMENT, zones=1, keep=lambda found: patch.within_limits(found, **LIMITS), max_relief=LIMITS["max_relief"])
    return zones.select("sim", "attempt", "seed_pid", r("patch_radius"), r("data_confidence"), r("relief"), r("roughness"), r("score"))


@query("""SELECT 50 AS attempts, 50 - (SELECT count(*) FROM inside WHERE sim = 0) AS edge_skipped, (SELECT count(*) FROM climb WHERE sim = 0 AND m = 0 AND n < 3) AS under_three,
  (SELECT count(*) FROM climb WHERE sim = 0 AND m = 0 AND n >= 3 AND NOT flat) AS not_flat, 0::BIGINT AS low_circularity, (SELECT count(*) FROM blocked WHERE sim = 0) AS blocked, (SELECT count(*) FROM zones WHERE sim = 0) AS zones""".replace("50", f"{ATTEMPTS}::BIGINT"))
def run_report(spark, d):
    cloud = _terrain(spark, d)
    seeds = stored(ops.sample_seeds(cloud, ATTEMPTS), "seeds")
    inside = stored(ops.off_edge(seeds, cloud, RADIUS), "inside")
    ladder = growth.growth_ladder(inside, cloud, RADIUS, K, LIMIT, INCREMENT)
    return growth.report(seeds, inside, ladder, growth.zones_of(ladder, inside, cloud))


@query("""SELECT pid, cluster, size FROM (WITH RECURSIVE smooth AS MATERIALIZED (SELECT pid, x, y, z, nx, ny, nz, greatest(lam, 0) / (xx + yy + zz) AS bend, CAST(floor(x / 0.25) AS BIGINT) AS gx, CAST(floor(y / 0.25) AS BIGINT) AS gy FROM cloud JOIN cloud_normal USING (pid) WHERE xx + yy + zz > 0),
  linked AS MATERIALIZED (SELECT a.pid AS a, b.pid AS b, b.bend <= 0.05 AS flat FROM (SELECT *, unnest(range(gx - 1, gx + 2)) AS hx FROM smooth WHERE bend <= 0.05) a JOIN smooth b ON a.hx = b.gx AND b.gy BETWEEN a.gy - 1 AND a.gy + 1
    WHERE a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.0625 AND abs(a.z - b.z) <= 0.1 AND a.nx * b.nx + a.ny * b.ny + a.nz * b.nz >= cos(radians(10))),
  grown(id, label) USING KEY (id) AS (SELECT pid, pid FROM smooth WHERE bend <= 0.05 UNION
    SELECT linked.b, min(grown.label) FROM grown JOIN linked ON grown.id = linked.a JOIN recurring.grown AS known ON known.id = linked.b WHERE flat AND grown.label < known.label GROUP BY linked.b),
  seed AS (SELECT label, min(bend) AS least FROM grown JOIN smooth ON id = pid GROUP BY label),
  edge AS (SELECT b AS id, arg_min(label, (least, label)) AS label FROM linked JOIN grown ON a = id JOIN seed USING (label) WHERE NOT flat GROUP BY b),
  part AS (SELECT id AS pid, label AS cluster FROM grown UNION ALL SELECT id, label FROM edge)
  SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM part) WHERE size >= 50""")
def region_growing(spark, d):
    return algorithms.region_growing(_terrain(spark, d))


@query(f"""SELECT gx, gy, n, round(n / (pi() / 4), 3) AS density, round(relief, 4) AS relief, round(slope_deg, 3) AS slope_deg, min(other) AS cluster FROM (WITH RECURSIVE
  kept AS MATERIALIZED (SELECT *, gx * 2147483648 + gy AS id FROM (SELECT gx, gy, avg(z) AS z, count(*) AS n, max(z) - min(z) AS relief FROM round_cell GROUP BY ALL) JOIN round_normal USING (gx, gy) WHERE slope_deg <= 25 AND n / (pi() / 4) >= 30 AND relief <= 0.25 AND lam <= 0.0004),
  linked AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM kept a, kept b WHERE (a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2 <= 1 AND abs(a.z - b.z) <= 0.1),
  reached AS (SELECT id, id AS other FROM kept UNION SELECT reached.id, b FROM reached JOIN linked ON other = a)
  SELECT kept.*, other FROM kept JOIN reached USING (id)) GROUP BY ALL""")
def radius_zones(spark, d):
    zones = stored(algorithms.radius_zones(_cloud(spark, d)), "zones")
    grouped = algorithms.clustered_cells(zones, cell_size=1.0, tolerance=1.0, alpha=0.1)
    return zones.join(grouped, ["gx", "gy"]).select("gx", "gy", "n", r("density", 3), r("relief"), r("slope_deg", 3), "cluster")


@query("SELECT gx, gy, n, round(n / 1.0, 3) AS density, round(relief, 4) AS relief, round(slope_deg, 3) AS slope_deg FROM (SELECT gx, gy, count(*) AS n, max(z) - min(z) AS relief FROM grid GROUP BY ALL) JOIN cell_normal USING (gx, gy) WHERE slope_deg <= 25 AND n >= 30 AND relief <= 0.25 AND lam <= 0.0004")
def cell_zones(spark, d):
    return algorithms.cell_zones(_cloud(spark, d)).select("gx", "gy", "n", r("density", 3), r("relief"), r("slope_deg", 3))


@query("""SELECT gx, gy, min(other) AS cluster FROM (WITH RECURSIVE half AS (SELECT CAST(floor((x - 1) / 0.5) AS BIGINT) + 1 + dx AS gx, CAST(floor((y - 1) / 0.5) AS BIGINT) + 1 + dy AS gy, x, y, z FROM cloud, (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(2)) AS dy)),
  kept AS MATERIALIZED (SELECT gx, gy, gx * 2147483648 + gy AS id, z FROM (SELECT gx, gy, avg(z) AS z, count(*) AS n, max(z) - min(z) AS relief FROM half GROUP BY ALL) JOIN half_normal USING (gx, gy) WHERE slope_deg <= 25 AND n >= 30 AND relief <= 0.25 AND lam <= 0.0004),
  linked AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM kept a, kept b WHERE (a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2 <= 4 AND abs(a.z - b.z) <= 0.1),
  reached AS (SELECT id, id AS other FROM kept UNION SELECT reached.id, b FROM reached JOIN linked ON other = a)
  SELECT gx, gy, other FROM kept JOIN reached USING (id)) GROUP BY ALL""")
def overlapping_cells(spark, d):
    return algorithms.clustered_cells(algorithms.cell_zones(_cloud(spark, d), overlap=2), cell_size=1.0, overlap=2, tolerance=1.0, alpha=0.1).select("gx", "gy", "cluster")


# Queries that configurations drive.

#: The benchmark's configuration for own clouds: its keys and values, but for fewer simulations and attempts, and circles of 10
#: neighbours and 0.5 m rungs as in all of the catalogue.
OWN_CLOUD = """
enable_visualization: true
terrain_size: 20.0
num_simulations: 3
use_pcd_file: true
pcd_file_path: orders
min_radius_threshold: 2.5
max_slope_threshold: 25
min_point_density_threshold: 30.0
max_relief_threshold: 2.0
max_roughness_threshold: 0.1
max_landingZones: 10
max_Attempts: 50
algorithms:
  - {name: Region_Growing_Segmentation, curvature_threshold: 0.05, min_cluster_size: 50, alpha: 0.1, cluster_tolerance: 0.25}
  - {name: seq_overlap, cell_size: 1.0, alpha: 0.1, cluster_tolerance: 1.0}
  - {name: kdtree_InflatingCircles, k: 10, radiusIncrement: 0.5}
  - {name: sequentialApproachKdtree, cell_size: 1, alpha: 0.1, cluster_tolerance: 1.0}
  - {name: sequentialApproach, cell_size: 1, alpha: 0.1, cluster_tolerance: 1.0}
"""
#: The Monte-Carlo configuration in the same way, with one zone for each simulation and its closer limits.
MONTE_CARLO = OWN_CLOUD.replace("max_landingZones: 10", "max_landingZones: 1").replace("relief_threshold: 2.0", "relief_threshold: 0.25").replace("roughness_threshold: 0.1", "roughness_threshold: 0.02")


def _clusters_sql(name: str, cells: str, pitch: float) -> str:
    """Zones and best density of one cell algorithm: labels spread over cells at most a metre apart and 0.1 m in height."""
    reach = round(1 / pitch) ** 2
    return f"""{name} AS (SELECT count(DISTINCT label) AS n_zones, max(density) AS best_score FROM (WITH RECURSIVE
  kept AS MATERIALIZED (SELECT *, gx * 2147483648 + gy AS id FROM ({cells})),
  linked AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM kept a, kept b WHERE a.id <> b.id AND (a.gx - b.gx) ** 2 + (a.gy - b.gy) ** 2 <= {reach} AND abs(a.z - b.z) <= 0.1),
  grown(id, label) USING KEY (id) AS (SELECT id, id FROM kept UNION
    SELECT linked.b, min(grown.label) FROM grown JOIN linked ON grown.id = linked.a JOIN recurring.grown AS known ON known.id = linked.b WHERE grown.label < known.label GROUP BY linked.b)
  SELECT label, density FROM grown JOIN kept USING (id)))"""


def _benchmark_sql(zones: int, relief: float, rough: float) -> str:
    def cells(groups: str, normal: str, area: str) -> str:
        return f"SELECT gx, gy, z, n / {area} AS density FROM (SELECT gx, gy, avg(z) AS z, count(*) AS n, max(z) - min(z) AS relief FROM {groups} GROUP BY ALL) JOIN {normal} USING (gx, gy) WHERE slope_deg <= 25 AND n / {area} >= 30 AND relief <= {relief} AND lam <= {rough} * {rough}"

    half = "(SELECT CAST(floor((x - 1) / 0.5) AS BIGINT) + 1 + dx AS gx, CAST(floor((y - 1) / 0.5) AS BIGINT) + 1 + dy AS gy, z FROM cloud, (SELECT unnest(range(2)) AS dx), (SELECT unnest(range(2)) AS dy))"
    region = ORACLES["region_growing"]
    region = region[region.index("SELECT pid, cluster, size FROM (WITH RECURSIVE") :]
    return f"""SELECT sim, algorithm, CAST(n_zones AS BIGINT) AS n_zones, round(best_score, 3) AS best_score FROM (WITH
{_clusters_sql('of_half', cells(half, 'half_normal', '1.0'), 0.5)},
{_clusters_sql('of_round', cells('round_cell', 'round_normal', '(pi() / 4)'), 1)},
{_clusters_sql('of_cell', cells('grid', 'cell_normal', '1.0'), 1)},
of_region AS (SELECT count(DISTINCT cluster) AS n_zones, CAST(max(size) AS DOUBLE) AS best_score FROM ({region})),
of_circle AS (SELECT sim, count(*) AS n_zones, max(score) AS best_score FROM (SELECT sim, score FROM zones WHERE patch_radius >= 2.5 AND slope_deg <= 25 AND data_confidence >= 30 AND relief <= {relief} AND roughness <= {rough}
  QUALIFY row_number() OVER (PARTITION BY sim ORDER BY attempt) <= {zones}) GROUP BY sim)
SELECT sim, 'Region_Growing_Segmentation' AS algorithm, n_zones, best_score FROM sims, of_region UNION ALL SELECT sim, 'seq_overlap', of_half.* FROM sims, of_half
UNION ALL SELECT sims.sim, 'kdtree_InflatingCircles', coalesce(n_zones, 0), best_score FROM sims LEFT JOIN of_circle ON sims.sim = of_circle.sim
UNION ALL SELECT sim, 'sequentialApproachKdtree', of_round.* FROM sims, of_round UNION ALL SELECT sim, 'sequentialApproach', of_cell.* FROM sims, of_cell)"""


def _benchmark(spark, d, text: str) -> DataFrame:
    found = algorithms.monte_carlo(spark, config.benchmark(text), radius=RADIUS, cloud=_cloud(spark, d))
    return found.select("sim", "algorithm", "n_zones", r("best_score", 3))


@query(_benchmark_sql(10, 2.0, 0.1))
def configured_benchmark(spark, d):
    return _benchmark(spark, d, OWN_CLOUD)


@query(_benchmark_sql(1, 0.25, 0.02))
def configured_monte_carlo(spark, d):
    return _benchmark(spark, d, MONTE_CARLO)


STEPS = """
pipeline_node:
  ros__parameters:
    pcd_file_path: orders
    voxel_downsample_pointcloud: false
    voxel_size: 0.1
    visualize: false
    final_visualize: false
    pipeline:
      - {step: SOR, enabled: true, parameters: {nb_neighbors: 10, std_ratio: 1.0}}
      - {step: SphericalNeighbourhood, enabled: false, parameters: {k: 10}}
      - {step: PCA, enabled: true, parameters: {angleThreshold: 25.0, k: 10}}
      - {step: HazarMetrices, enabled: true, parameters: {hazard: RELIEF}}
      - {step: HazarMetrices, enabled: true, parameters: {hazard: ROUGHNESS}}
      - {step: HazarMetrices, enabled: true, parameters: {hazard: ALL}}
"""


@query(f"""SELECT metric, round(data_confidence, 3) AS data_confidence, round(relief, 4) AS relief, round(roughness, 4) AS roughness, round(data_confidence - relief - roughness, 3) AS score FROM (WITH
  calm AS MATERIALIZED (SELECT wide.* FROM wide JOIN distances USING (pid), sor_limit WHERE mean_distance <= lim),
  calm_near AS (SELECT a.pid, b.x AS ox, b.y AS oy, b.z AS oz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
    FROM (SELECT *, unnest(range(gx - 1, gx + 2)) AS hx FROM calm) a JOIN calm b ON a.hx = b.gx AND b.gy BETWEEN a.gy - 1 AND a.gy + 1 QUALIFY row_number() OVER (PARTITION BY a.pid ORDER BY d2, b.pid) <= {K}),
  calm_cov AS (SELECT pid, {_cov('o')} FROM calm_near GROUP BY ALL),
  {_eigen('calm_cov', 'pid', 'calm_normal')},
  kept AS MATERIALIZED (SELECT 0 AS sim, 0 AS attempt, 0 AS m, calm.* FROM calm JOIN calm_normal USING (pid) WHERE slope_deg <= {LIMIT}),
  {_hull('kept', 'kept_hull')},
  kept_cov AS (SELECT 1 AS g, {_cov('')} FROM kept),
  {_eigen('kept_cov', 'g', 'kept_plane')},
  measured AS (SELECT count(*) / any_value(area) AS density, max(z) - min(z) AS rel, sqrt(avg((nx * x + ny * y + nz * z - (nx * mx + ny * my + nz * mz)) ** 2)) AS rough FROM kept, kept_plane, kept_hull)
  SELECT 'RELIEF' AS metric, CAST(0 AS DOUBLE) AS data_confidence, rel AS relief, CAST(0 AS DOUBLE) AS roughness FROM measured UNION ALL SELECT 'ROUGHNESS', 0, 0, rough FROM measured UNION ALL SELECT 'ALL', density, rel, rough FROM measured)""")
def configured_pipeline(spark, d):
    """Outlier removal, slopes of what is left, and three metrics of the flat part, as the text says."""
    hazards = run_pipeline(spark, config.pipeline(STEPS), _terrain(spark, d)).hazards
    every = hazards[0].unionByName(hazards[1]).unionByName(hazards[2])
    return every.select("metric", r("data_confidence", 3), r("relief"), r("roughness"), r("score", 3))
