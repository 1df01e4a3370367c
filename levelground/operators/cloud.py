"""Whole-cloud operators: bounds, counts, roles, voxels, sampling, outlier removal, slope classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.functions.geometry import covariance, planes_at, slope, with_normal
from levelground.operators.spatial import by_neighbours, cloud_keys, same_point


def valid(cloud: DataFrame) -> DataFrame:
    """Without points that have a null or NaN coordinate, which Spark's max would return and comparisons would keep."""
    ok = F.lit(True)
    for c in "xyz":
        ok &= F.col(c).isNotNull() & ~F.isnan(c)
    return cloud.where(ok)


def drop_intensity(cloud: DataFrame) -> DataFrame:
    """The lossy conversion: x, y and z as double, no intensity."""
    return cloud.drop("intensity").withColumns({c: F.col(c).cast("double") for c in "xyz"})


def restore_intensity(cloud: DataFrame) -> DataFrame:
    """The way back: x, y and z as float, intensity 0 as nothing assigns it."""
    return cloud.withColumns({c: F.col(c).cast("float") for c in "xyz"} | {"intensity": F.lit(0.0).cast("float")})


def bounds(cloud: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cloud.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def count(cloud: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cloud.groupBy(*by).agg(F.count("*").alias("n_points"))


def voxel_downsample(cloud: DataFrame, leaf: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The centroid of the points in each occupied cube of side leaf, intensity averaged too."""
    cells = [F.floor(F.col(c) / leaf).alias(f"v{c}") for c in "xyz"]
    return cloud.groupBy(*by, *cells).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")], F.count("*").alias("n_points"))


def with_index(cloud: DataFrame, parts: int = 256, on: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """Adds index, 0 to n - 1 in the order of pid (within each of `on`), without one task that sorts all: pids fall into
    ranges of equal width, are numbered within, and each range adds the number of points before it.  A range with more than
    four times its share of the points is cut again, into ranges of equal width of its own, as pids may be sparse, such as
    those of monotonically_increasing_id.  pids must be distinct.
    wanted: the only indexes (on, index) that are looked for; ranges without one are counted, but not numbered."""
    width = lambda low, high: F.floor((F.col("pid") - F.col(low)) * F.lit(float(parts)) / (F.col(high) - F.col(low) + 1))
    ends = cloud.groupBy(*on).agg(F.min("pid").alias("_low"), F.max("pid").alias("_high"), F.count("*").alias("_n"))
    ranged = cloud.join(F.broadcast(ends), list(on)) if on else cloud.crossJoin(F.broadcast(ends))  # one row for each cloud
    ranged = ranged.withColumn("_part", width("_low", "_high"))
    full = ranged.groupBy(*on, "_part").agg(F.min("pid").alias("_from"), F.max("pid").alias("_to"), F.count("*").alias("_own"), F.first("_n").alias("_n"))
    full = full.where(F.col("_own") * parts > 4 * F.col("_n")).select(*on, "_part", "_from", "_to")  # at most `parts` / 4 rows for each cloud
    ranged = ranged.join(F.broadcast(full), [*on, "_part"], "left").withColumn("_sub", F.coalesce(width("_from", "_to"), F.lit(0))).drop("_low", "_high", "_n", "_from", "_to")
    before = Window.partitionBy(*on).orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*on, "_part", "_sub").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # `parts` squared rows for each cloud at most
    if wanted is not None:
        asked = wanted.withColumnsRenamed({c: f"_{c}" for c in on})
        holds = [F.col("index") >= F.col("_before"), F.col("index") < F.col("_before") + F.col("count"), *[F.col(c) == F.col(f"_{c}") for c in on]]
        sizes = sizes.join(F.broadcast(asked) if not on else asked, holds, "left_semi")
    own = F.row_number().over(Window.partitionBy(*on, "_part", "_sub").orderBy("pid")) - 1
    numbered = ranged.join(F.broadcast(sizes.drop("count")), [*on, "_part", "_sub"]).withColumn("_own", own)
    numbered = numbered.withColumn("index", F.col("_before") + F.col("_own")).drop("_part", "_sub", "_own", "_before")
    return numbered if wanted is None else numbered.join(wanted, [*on, "index"], "left_semi")


#: Of the seed sequence: index = (attempt * STEP + salt) % n.
STEP = 7919


def sample_seeds(cloud: DataFrame, max_attempts: int, salt: int = 13) -> DataFrame:
    """One seed for each attempt, drawn with replacement by a fixed sequence: attempt, seed_pid, seed_x, seed_y, seed_z."""
    spark = cloud.sparkSession
    n = cloud.agg(F.count("*").alias("n"))
    attempts = spark.range(max_attempts).select(F.col("id").alias("attempt")).crossJoin(F.broadcast(n)).where("n > 0")  # one row
    attempts = attempts.select("attempt", ((F.col("attempt") * STEP + salt) % F.col("n")).alias("index"))
    return with_index(cloud, wanted=attempts.select("index").distinct()).join(attempts, "index").select("attempt", F.col("pid").alias("seed_pid"), *[F.col(c).alias(f"seed_{c}") for c in "xyz"])


def every_point(cloud: DataFrame) -> DataFrame:
    """Exhaustive mode: each point is a seed, its pid the attempt."""
    return cloud.select(F.col("pid").alias("attempt"), F.col("pid").alias("seed_pid"), *[F.col(c).alias(f"seed_{c}") for c in "xyz"])


def off_edge(seeds: DataFrame, cloud: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Seeds at least radius away from the cloud's bounds in x and y; those on the line stay."""
    box = bounds(cloud, on).select(*on, "min_x", "max_x", "min_y", "max_y")
    inside = F.col("seed_x").between(F.col("min_x") + radius, F.col("max_x") - radius) & F.col("seed_y").between(F.col("min_y") + radius, F.col("max_y") - radius)
    both = seeds.join(box, list(on)) if on else seeds.crossJoin(F.broadcast(box))  # one row
    return both.where(inside).drop("min_x", "max_x", "min_y", "max_y")


def mean_distances(cloud: DataFrame, neighbours: int, on: tuple[str, ...] | None = None) -> DataFrame:
    """on, pid and its mean distance to that many nearest other points (null in a cloud of one point)."""

    def mean(group, rows, d2):
        own = group["_i"].to_numpy()[group["_core"].to_numpy(bool)]
        others = np.sqrt(d2[:, 1:]) if d2.shape[1] > 1 else np.full((len(d2), 1), np.nan)
        return {"mean_distance": [float(m) if m == m else None for m in others.mean(axis=1)]} if len(own) else {"mean_distance": []}

    return by_neighbours(cloud, neighbours + 1, mean, "mean_distance double", cloud_keys(cloud) if on is None else on)


def sor_classify(cloud: DataFrame, neighbours: int, std_ratio: float, on: tuple[str, ...] | None = None) -> DataFrame:
    """Statistical outlier removal (Rusu et al. 2008): adds mean_distance and inlier, true where the mean distance is at
    most its cloud's mean plus std_ratio standard deviations."""
    on = cloud_keys(cloud) if on is None else on
    d = mean_distances(cloud, neighbours, on)
    limit = d.groupBy(*on).agg((F.avg("mean_distance") + std_ratio * F.coalesce(F.stddev_samp("mean_distance"), F.lit(0.0))).alias("limit"))
    limit = limit.withColumnsRenamed({c: f"_{c}" for c in on})
    d = d.join(limit, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]).drop(*[f"_{c}" for c in on]) if on else d.crossJoin(F.broadcast(limit))  # one row
    inlier = F.coalesce(F.col("mean_distance") <= F.col("limit"), F.lit(True))
    return same_point(cloud, d, on).withColumn("inlier", inlier).drop("limit")


#: What is known of the plane at a point.
LOCAL = ("nx", "ny", "nz", "lam", "xx", "yy", "zz", "slope_deg", "reach")


def normals(cloud: DataFrame, k: int, on: tuple[str, ...] | None = None, along: str = "", columns: tuple[str, ...] = LOCAL) -> DataFrame:
    """on, pid, along (coordinates that come along, "xyz" say, so that no join has to bring them back), nx, ny, nz (null where its neighbours coincide), the least eigenvalue lam and variances of the local plane at
    each point, slope_deg, and reach, the distance to its k-th nearest (infinite if the cloud has fewer).  columns: those of
    them that are asked for, as only these are written."""

    def plane_of(group, rows, d2):
        n, cov, lam = planes_at(group[["x", "y", "z"]].to_numpy(float), rows)
        of = {"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "lam": lam, "xx": cov[:, 0, 0], "yy": cov[:, 1, 1], "zz": cov[:, 2, 2], "slope_deg": np.degrees(np.arccos(np.minimum(1.0, n[:, 2])))}
        own = {c: group[c].to_numpy()[group["_core"].to_numpy(bool)] for c in along}
        of |= {"reach": np.sqrt(d2[:, -1]) if d2.shape[1] == k else np.full(len(d2), np.inf)}
        return own | {c: of[c] for c in columns}

    on = cloud_keys(cloud) if on is None else on
    found = by_neighbours(cloud, k, plane_of, ", ".join(f"{c} double" for c in (*along, *columns)), on)
    return found.select(*on, "pid", *[F.col(c).cast(cloud.schema[c].dataType).alias(c) for c in along], *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])


def classify(slope_deg: Column, limit: float) -> Column:
    """Whether a point is an inlier: its slope is valid and at most the limit."""
    return F.coalesce(~F.isnan(slope_deg) & (slope_deg <= limit), F.lit(False))


def slope_classes(cloud: DataFrame, limit: float = 20.0, k: int = 10) -> DataFrame:
    """The whole cloud as one patch: its points with normals, slope_deg and inlier."""
    on = cloud_keys(cloud)
    return same_point(cloud, normals(cloud, k, on).drop("reach"), on).withColumn("inlier", classify(F.col("slope_deg"), limit))


def plane(cloud: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, c >= 0, d of the plane through all points of a group, and slope_deg."""
    fit = with_normal(cloud.groupBy(*by).agg(*covariance()))
    d = -(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))
    return fit.select(*by, F.col("nx").alias("a"), F.col("ny").alias("b"), F.col("nz").alias("c"), d.alias("d"), slope().alias("slope_deg"))


ROLE_COLOURS = {"inlier_cloud": (0, 255, 0), "outlier_cloud": (255, 0, 0)}


def select_role(inliers: DataFrame, outliers: DataFrame, which: str = "both") -> DataFrame:
    """What a viewer would be given: inliers in green, outliers in red, by the name of the cloud; another name, nothing."""
    parts = [df.withColumns({"role": F.lit(name), **{c: F.lit(v) for c, v in zip(("r", "g", "b"), ROLE_COLOURS[name])}}).where(F.lit(which in (name, "both"))) for name, df in (("inlier_cloud", inliers), ("outlier_cloud", outliers))]
    return parts[0].unionByName(parts[1])


def unassigned(cloud: DataFrame, inliers: DataFrame) -> DataFrame:
    """Points of the cloud in no patch."""
    on = tuple(c for c in cloud_keys(cloud) if c in inliers.columns)
    return same_point(cloud, inliers.select(*on, "pid"), on, "left_anti")


def circles(ranked: DataFrame, vertices: int = 10_000) -> DataFrame:
    """The ring drawn around each candidate: rank, i, x, y, z."""
    angle = 2 * F.pi() * F.col("i") / vertices
    points = ranked.select("rank", "seed_x", "seed_y", "seed_z", "patch_radius", F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))).alias("i"))
    return points.select("rank", "i", (F.col("seed_x") + F.col("patch_radius") * F.cos(angle)).alias("x"), (F.col("seed_y") + F.col("patch_radius") * F.sin(angle)).alias("y"), F.col("seed_z").alias("z"))


def terrain(spark: SparkSession, side: float, points: int, salt: int = 0) -> DataFrame:
    """A made-up square of gentle slope, a ramp and overhead obstacles, the same for the same salt."""
    return terrains(spark.range(1).select(F.lit("terrain").alias("cloud_id"), F.lit(salt).alias("salt")), side, points)


def terrains(of: DataFrame, side: float, points: int) -> DataFrame:
    """A made-up terrain for each row of `of`, whose salt (int or long) makes it; its other columns come along."""
    i = F.col("pid")
    noise = lambda k: F.pmod(F.xxhash64(i, F.col("salt").cast("int"), F.lit(k)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    x, y = noise(1) * side, noise(2) * side
    z = 0.02 * noise(3) + F.when(x > side / 2, 0.6 * (x - side / 2)).otherwise(0.05 * x) + F.when((i % 97 == 0) & (y > 0.75 * side), 2.0).otherwise(0.0)
    every = of.sparkSession.range(points).withColumnRenamed("id", "pid").crossJoin(F.broadcast(of))  # a row for each terrain
    return every.select(*[c for c in of.columns if c != "salt"], "pid", x.alias("x"), y.alias("y"), z.alias("z"), (i * 31 % 5).cast("double").alias("intensity"))
