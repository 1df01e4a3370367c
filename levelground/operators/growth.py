"""Growth of flat patches around seeds, and the detector made of it."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from levelground.functions.geometry import hull2d, measured_hull, nearest, slopes_at
from levelground.operators.cloud import normals, off_edge
from levelground.operators.patch import clear
from levelground.operators.spatial import radius_join
from levelground.operators.storage import stored
from levelground.schema import EMPTY_METRIC, GROWTH

#: Points, by the cloud's mean density, that a seed's first pass and the annulus of a later one may hand to it; pairs of seeds and
#: points up to which a later pass may climb beyond four times the radius; points of a part of a pass, which one call handles.
FIRST_POINTS, PASS_POINTS, PASS_PAIRS, PART_POINTS = 2_000, 2_000_000, 20_000_000, 60_000
#: Seeds of a task of a pass, by and large, as each takes some time however few points it meets.
TASK_SEEDS = 16
#: Seeds that the first batch of attempts of all simulations climbs from.
FIRST_SEEDS = 256
#: Cells on each side of a seed's own in which, at every size of cells, a bound is looked for; and about how many fit between
#: a seed and the bound so found when it is drawn closer.
AROUND, CLOSER = 2, 16
#: Points that a cell holds on average in which heights are summed up.
HEIGHTS = 32


class Surface(NamedTuple):
    """What growth has to know of a cloud, made once for however many seeds: its points with slope_deg (NaN where there is none)
    and reach, what tells clouds apart, and of the largest of them points per square metre, the reach that all but a thousandth
    keep to, the longest side on the ground and the diagonal; and cells of bounds where they are made once for several calls."""

    points: DataFrame
    on: tuple[str, ...]
    density: float
    wide: float
    side: float
    diagonal: float
    steep: Cells | None = None
    heights: Cells | None = None


class Cells(NamedTuple):
    """Bounds of points in cells, of sides that double up to the cloud's: on, _size, _cx, _cy, low_ and high_ x, y and z, reach."""

    bounds: DataFrame
    side: float
    sizes: int


def surface(cloud: DataFrame, k: int, on: tuple[str, ...] = ()) -> Surface:
    local = normals(cloud, k, on, "xyz", ("slope_deg", "reach"))  # which wrote them
    local = local.withColumns({"slope_deg": F.coalesce("slope_deg", F.lit(float("nan"))), "reach": F.coalesce("reach", F.lit(float("inf")))})
    sides = {c: F.max(c) - F.min(c) for c in "xyz"}
    usual = F.percentile_approx(F.when(F.col("reach") < float("inf"), F.col("reach")), 0.999)
    each = local.groupBy(*on).agg(F.count("*").alias("n"), *[v.alias(c) for c, v in sides.items()], usual.alias("wide"))
    most = each.agg(F.max(F.col("n") / F.greatest(F.col("x") * F.col("y"), F.lit(1e-9))).alias("density"), *[F.max(c).alias(c) for c in ("x", "y", "z", "wide")]).first()
    x, y, z = (most[c] or 0.0 for c in "xyz")
    return Surface(local, on, most["density"] or 1.0, most["wide"] or 0.0, max(x, y), math.hypot(x, y, z))


def rungs_to(diagonal: float, radius: float, increment: float) -> int:
    """Rungs up to the first whose radius is more than the diagonal of a cloud's bounds, so that it holds every point."""
    return max(0, math.floor((diagonal - radius) / increment) + 1) + 1


def steep_bound(seeds: DataFrame, ground: Surface, limit: float, keys: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """keys and ends: a radius beyond which no patch of the seed is flat, no less than the least of distance and reach together
    over all points steeper than the limit; seeds of a cloud without any are left out.

    Steep points are summed up as the bounds of cells, of sides that double from a point's reach to the cloud's; each seed looks
    at the cells around its own at every size.  So the nearest ones are seen in cells about half as wide as they are far.  The
    bound is then drawn closer by a second look, at all cells within it that are a CLOSER-th as wide.  Either way a seed meets a
    number of rows that does not depend on how many points are steep."""
    cells = steep_cells(ground, limit) if ground.steep is None else ground.steep
    return _bound(seeds, ground, cells, keys, lambda near: near.groupBy(*keys).agg(F.min(F.col("_far") + F.col("reach")).alias("ends")))


def relief_bound(seeds: DataFrame, ground: Surface, most: float, keys: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """keys and ends: a radius within which heights differ by more than `most`; seeds of a cloud that is not so high are left out.

    All points are summed up as steep_bound does with steep ones, and the nearest cells that are so far apart in height are
    looked for."""
    cells = height_cells(ground) if ground.heights is None else ground.heights
    so_far = Window.partitionBy(*keys).orderBy("_far")

    def first_apart(near: DataFrame) -> DataFrame:
        near = near.select(*keys, "_far", F.min("low_z").over(so_far).alias("_low"), F.max("high_z").over(so_far).alias("_high"))
        rounding = (F.abs("_low") + F.abs("_high")) * 1e-12
        return near.where(F.col("_high") - F.col("_low") > F.lit(most) + rounding).groupBy(*keys).agg(F.min("_far").alias("ends"))

    return _bound(seeds, ground, cells, keys, first_apart)


def steep_cells(ground: Surface, limit: float) -> Cells:
    steep = ground.points.where((F.isnan("slope_deg") | (F.col("slope_deg") > limit)) & (F.col("reach") < float("inf")))
    return _cells(steep, ground, 2 * ground.wide)


def height_cells(ground: Surface) -> Cells:
    return _cells(ground.points, ground, math.sqrt(HEIGHTS / ground.density))


def _cells(points: DataFrame, ground: Surface, side: float) -> Cells:
    on, side = ground.on, max(side, ground.side / (1 << 24), 1e-6)
    sizes = max(0, math.ceil(math.log2(max(ground.side, side) / side))) + 1
    cell = lambda c: F.floor(F.col(c) / side)
    cells = points.withColumns({"_cx": cell("x"), "_cy": cell("y")}).groupBy(*on, "_cx", "_cy").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))], F.max("reach").alias("reach"))
    wider = lambda c: F.expr(f"shiftright({c}, _size)").alias(c)
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(sizes))).alias("_size")).select(*on, "_size", wider("_cx"), wider("_cy"), *[c for c in cells.columns if c not in (*on, "_cx", "_cy")])
    cells = cells.groupBy(*on, "_size", "_cx", "_cy").agg(*[f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))], F.max("reach").alias("reach"))
    return Cells(stored(cells, "cells"), side, sizes)


def _bound(seeds: DataFrame, ground: Surface, cells: Cells, keys: tuple[str, ...], ends_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys and ends, the least that ends_of says of the cells (with _far, the most that a point of theirs may be away) that each
    seed looks at, in two looks."""
    on, (bounds, side, sizes) = ground.on, cells
    cell = lambda c: F.floor(F.col(c) / side)
    around = [F.struct(F.lit(i).alias("_dx"), F.lit(j).alias("_dy")) for i in range(-AROUND, AROUND + 1) for j in range(-AROUND, AROUND + 1)]
    far = [F.greatest(F.abs(F.col(f"seed_{c}") - F.col(f"low_{c}")), F.abs(F.col(f"seed_{c}") - F.col(f"high_{c}"))) for c in "xyz"]
    farthest = F.sqrt(sum((d * d for d in far[1:]), far[0] * far[0]))

    def looked(looks: DataFrame) -> DataFrame:
        return ends_of(looks.join(bounds, [*on, "_size", "_cx", "_cy"]).withColumn("_far", farthest))

    own = seeds.select(*dict.fromkeys((*keys, *on)), *[f"seed_{c}" for c in "xyz"])
    looks = own.select("*", cell("seed_x").alias("_cx"), cell("seed_y").alias("_cy"), F.explode(F.sequence(F.lit(0), F.lit(sizes))).alias("_size"))
    looks = looks.withColumns({c: F.expr(f"shiftright({c}, _size)") for c in ("_cx", "_cy")}).select("*", F.inline(F.array(*around)))
    first = stored(looked(looks.withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")})), "bound")
    # cells of the largest side that fits CLOSER times, of which some 2 to 4 CLOSER squared lie within the bound
    closer = own.join(first, list(keys)).withColumn("_size", F.least(F.lit(sizes), F.greatest(F.lit(0), F.floor(F.log2(F.col("ends") / (side * CLOSER))))).cast("int"))
    wide = F.lit(side) * F.pow(F.lit(2.0), F.col("_size"))
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("ends")) / wide), F.floor((F.col(c) + F.col("ends")) / wide)))
    closer = closer.withColumn("_cx", reach("seed_x")).withColumn("_cy", reach("seed_y")).drop("ends")
    return first.unionByName(looked(closer)).groupBy(*keys).agg(F.min("ends").alias("ends"))


class _Patch:
    """What is known of a patch without its points: their number, moments about the seed, heights and hull."""

    def __init__(self, state: np.ndarray | None) -> None:
        if state is None:
            self.n, self.first, self.second, self.low, self.high, self.hull = 0, np.zeros(3), np.zeros((3, 3)), np.inf, -np.inf, np.zeros((0, 2))
        else:
            self.n, self.first, self.second = int(state[0]), state[1:4], state[4:13].reshape(3, 3)
            self.low, self.high, self.hull = state[13], state[14], state[15:].reshape(-1, 2)

    def add(self, xyz: np.ndarray) -> None:
        if len(xyz):
            self.n += len(xyz)
            self.first = self.first + xyz.sum(axis=0)
            self.second = self.second + xyz.T @ xyz
            self.low, self.high = min(self.low, xyz[:, 2].min()), max(self.high, xyz[:, 2].max())
            self.hull = hull2d(np.concatenate([self.hull, xyz[:, :2]]))

    def join(self, other: _Patch) -> None:
        if other.n:
            self.n, self.first, self.second = self.n + other.n, self.first + other.first, self.second + other.second
            self.low, self.high = min(self.low, other.low), max(self.high, other.high)
            self.hull = hull2d(np.concatenate([self.hull, other.hull]))

    def state(self) -> list[float]:
        return [float(self.n), *self.first.tolist(), *self.second.ravel().tolist(), float(self.low), float(self.high), *self.hull.ravel().tolist()]

    def measures(self, seed: np.ndarray) -> dict:
        mean = self.first / self.n
        values, vectors = np.linalg.eigh(self.second / self.n - np.outer(mean, mean))
        up = vectors[:, 0] * (-1.0 if vectors[2, 0] < 0 else 1.0)
        vertices, area, around, circularity = measured_hull(self.hull)
        a, b, c = up.tolist()
        return {
            "circularity": circularity, "area": area, "perimeter": around, "a": a, "b": b, "c": c, "d": float(-up @ (mean + seed)),
            "relief": float(self.high - self.low), "roughness": math.sqrt(max(0.0, values[0])), "cx": float(mean[0] + seed[0]), "cy": float(mean[1] + seed[1]),
            # the point farthest from any place is a vertex of the hull
            "reach": float(np.hypot(*(self.hull - mean[:2]).T).max()), "max_z": float(self.high + seed[2]),
        }


_NOTHING = dict.fromkeys(("circularity", "area", "perimeter", "a", "b", "c", "d", "relief", "roughness", "cx", "cy", "reach", "max_z"))
_STATE = "more boolean, state array<double>"
_RING = "rung int, flat boolean, more boolean, state array<double>"


def _looker(parts: list[tuple[float, list[tuple[int, float]]]], band: float, keys: tuple[str, ...], limit: float, k: int):
    """What rungs of one part of one seed's pass add to its patch, and whether they leave it flat, up to the first that does not.

    A point whose k nearest in the cloud all lie in the patch has its slope in the cloud; it is settled, as it will be in
    all larger patches.  Other points, near the rim, look for neighbours among the patch's points of the band, which
    begins `band` inside of where the part begins; if one may have nearer ones farther in, the rung asks for more."""

    def look(key: tuple, seed: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        before, rungs = parts[int(key[-1])]
        own = seed[["seed_x", "seed_y", "seed_z"]].to_numpy(float)[0]
        group = group.sort_values("pid", kind="stable")
        xyz = group[["x", "y", "z"]].to_numpy(float) - own
        d, reach, slope = np.sqrt(group["d2"].to_numpy(float)), group["reach"].to_numpy(float), group["slope_deg"].to_numpy(float)
        inner, last, top, out = max(0.0, before - band), before, int(seed["top"].iloc[0]), []
        by_d, ends, widest = np.argsort(d, kind="stable"), d + reach, float(reach.max(initial=0.0))
        from_seed = d[by_d]
        steep = float(ends[~(slope <= limit)].min(initial=math.inf))  # in patches wider than this a steep point is settled

        def between(low: float, high: float) -> np.ndarray:
            return np.sort(by_d[slice(*np.searchsorted(from_seed, (low, high)))])

        for m, r in rungs:
            if m > top:
                break
            ring = _Patch(None)
            ring.add(xyz[between(last, r)])
            row = dict(zip(keys, key)) | {"rung": m, "flat": False, "more": False, "state": ring.state()}
            out.append(row)
            if steep < r:
                break
            rim = between(r - 1.001 * widest - 1e-9, r) if widest < math.inf else between(-1.0, r)
            rim = rim[~(ends[rim] < r)]
            if len(rim):
                of = k if inner else min(k, int(np.searchsorted(from_seed, r)))
                todo, steeper = rim, False
                # a ring just below the rim first, a wider one and all of the part for the few points that look farther in
                lows = {max(inner, r - 2 * band, float(np.quantile(d[rim] - 2 * reach[rim], 0.05, method="lower"))), max(inner, r - 2 * band), inner}
                for low in sorted(lows, reverse=True):
                    there = np.zeros(len(d), bool)
                    there[todo] = there[between(low, r)] = True
                    there = np.flatnonzero(there)
                    if len(there) < of:
                        continue
                    rows, d2, _ = nearest(xyz[there], xyz[todo], of)
                    farther = d[todo] - np.sqrt(d2[:, -1]) <= low if low else np.zeros(len(todo), bool)
                    steeper = not np.all(slopes_at(xyz[there], rows[~farther]) <= limit)
                    todo = todo[farther]
                    if steeper or not len(todo):
                        break
                if steeper or len(todo):
                    row["more"] = not steeper
                    break
            row["flat"], last = True, r
        return pd.DataFrame(out, columns=[*keys, "rung", "flat", "more", "state"])

    return look


def _climber(radius_of: dict[int, float], keys: tuple[str, ...], most: float, circularity: float):
    """One seed's climb over the rungs of a pass, of all its parts, or up to a round patch whose relief is more than `most`."""

    def climb(key: tuple, seed: pd.DataFrame, rings: pd.DataFrame) -> pd.DataFrame:
        own = seed[["seed_x", "seed_y", "seed_z"]].to_numpy(float)[0]
        state = seed["state"].iloc[0] if "state" in seed else None
        patch, out, high = _Patch(None if state is None else np.asarray(state, float)), [], False
        rings = rings.sort_values("rung")
        for m, flat, more, ring in zip(rings["rung"].tolist(), rings["flat"].tolist(), rings["more"].tolist(), rings["state"]):
            patch.join(_Patch(np.asarray(ring, float)))
            row = dict(zip(keys, key)) | {"rung": m, "radius": radius_of[m], "n": patch.n, "flat": False} | _NOTHING | {"more": False, "state": None}
            out.append(row)
            if patch.n < 3:
                break
            if not flat:
                row["more"] = more
                break
            row |= {"flat": True} | patch.measures(own)
            high = row["relief"] > most and row["circularity"] >= circularity
            if high:
                break
        if out and out[-1]["flat"] and not high:
            out[-1]["state"] = patch.state()
        # a rung that needs a wider band is climbed again, with all of its pass
        return pd.DataFrame(out[-1:] if out and out[-1]["more"] else out)

    return climb


def _parts(rungs: list[tuple[int, float]], before: float, ground: Surface) -> list[tuple[float, list[tuple[int, float]]]]:
    """A pass cut at rungs into parts of some PART_POINTS, each with the radius where it begins."""
    parts = [(before, rungs[:1])]
    for last, (m, r) in zip(rungs, rungs[1:]):
        if math.pi * (r * r - parts[-1][0] ** 2) * ground.density > PART_POINTS:
            parts.append((last[1], []))
        parts[-1][1].append((m, r))
    return parts


def _tasks(seeds: int, r: float, before: float, ground: Surface) -> int:
    """Tasks of a pass: for each seed, one for every two parts or so, that small and large ones even out, and enough for all seeds."""
    return min(2_000, max(1, math.ceil(seeds / TASK_SEEDS), math.ceil(seeds * math.pi * (r * r - before * before) * ground.density / (2 * PART_POINTS))))


def _next_rungs(start: int, before: float, highest: int, seeds: int, ground: Surface, radius: float, increment: float) -> list[tuple[int, float]]:
    """Rungs of a pass from rung start on, whose patches grew to radius `before` so far: one at least."""
    rungs = [(start, radius + start * increment)]
    while rungs[-1][0] < highest:
        m = rungs[-1][0] + 1
        r = radius + m * increment
        points = math.pi * (r * r - before * before) * ground.density
        if points > (PASS_POINTS if before else FIRST_POINTS) or before and r > 4 * before and seeds * points > PASS_PAIRS:
            break
        rungs.append((m, r))
    return rungs


def growth_ladder(seeds: DataFrame, cloud: DataFrame, radius: float, k: int, limit: float, increment: float = 0.5, max_rungs: int | None = None, keys: tuple[str, ...] = ("attempt",), on: tuple[str, ...] = (), ground: Surface | None = None, max_relief: float | None = None, circularity: float = 0.1) -> DataFrame:
    """Each rung that each seed climbs, its last and failed one included: keys, rung, radius, n, flat, and the measures
    of flat patches.

    A patch of fewer than three points or with an outlier stops a seed.  max_rungs ends what would not end on a flat
    cloud; without it, the rung that holds every point does.  max_relief: a seed also ends at the first flat patch of that
    circularity at least whose relief is more, as all larger patches have at least its relief; its last round one is then no lower.

    Slopes are taken in the cloud once, for all seeds (ground: handed in, once for all calls).  A bound by the nearest steep
    points tells each seed the rung that it cannot pass, so no point beyond that meets it.  Then seeds climb in passes, of which
    small clouds need two; a pass meets each seed with the annulus of points that the patch grows by, in parts that are looked at
    apart, and the rim of the patch before, while the patch itself goes on as its moments and hull.  So no patch is ever held
    whole, and each point meets a seed about once.
    """
    ground = surface(cloud, k, on) if ground is None else ground
    local = ground.points
    max_rungs = rungs_to(ground.diagonal, radius, increment) if max_rungs is None else max_rungs
    wide = ground.wide or radius
    kinds = ", ".join(f"{c} {seeds.schema[c].dataType.simpleString()}" for c in keys)
    highest = F.when(F.col("ends").isNull(), max_rungs - 1).otherwise(F.least(F.lit(max_rungs - 1), F.greatest(F.lit(0), F.floor((F.col("ends") - radius) / increment + 1e-9) + 1)))
    own = seeds.select(*dict.fromkeys((*keys, *on)), "seed_x", "seed_y", "seed_z")
    open_ = own.join(steep_bound(seeds, ground, limit, keys), list(keys), "left").withColumn("top", highest.cast("int")).drop("ends")
    if max_relief is not None:
        open_ = open_.withColumnRenamed("top", "_beyond").join(relief_bound(seeds, ground, max_relief, keys), list(keys), "left")
        open_ = open_.withColumn("top", F.least("_beyond", highest.cast("int"))).drop("ends")
    done, start, before, bounded = None, 0, 0.0, None
    while start < max_rungs:
        open_ = stored(open_.withColumn("cap", F.lit(radius) + F.lit(increment) * F.col("top")), "growing")
        bounded = open_ if bounded is None else bounded
        left, top = open_.agg(F.count("*"), F.max("top")).first()
        if not left and done is not None:
            break
        rungs = _next_rungs(start, before, top or 0, left, ground, radius, increment)
        asking, band, whole, parts = open_, 2 * wide, None, _parts(rungs, before, ground)
        part_of = F.array(*[F.lit(i) for i, (_, some) in enumerate(parts) for _ in some])
        begun = lambda rung: F.get(part_of, F.least(F.greatest(rung - start, F.lit(0)), F.lit(len(rungs) - 1)).cast("int"))
        rung_at = lambda far: F.floor((F.least(far, F.lit(rungs[-1][1])) - radius) / increment) + 1
        while True:
            near = radius_join(asking.drop("state"), local, rungs[-1][1], on, own="cap")
            far = F.sqrt("d2")
            near = near.where(((far >= before - band) | (far + F.col("reach") >= before)) & (far < F.col("cap")))
            # a point counts in the part that it lies in, and is looked at in those that begin within the band or its reach; one rung
            # more on each side, as rounding may be off by one
            last = F.least(begun(rung_at(far + F.greatest(F.lit(band), F.col("reach"))) + 1), begun(F.col("top")))
            near = near.withColumn("_part", F.explode(F.sequence(F.least(begun(rung_at(far) - 1), last), last)))
            near = near.select(*[F.col(c).alias(f"_{c}") for c in keys], "_part", "pid", "x", "y", "z", "d2", "slope_deg", "reach")
            looks = asking.select(*keys, "seed_x", "seed_y", "seed_z", "top", F.explode(F.sequence(F.lit(0), begun(F.col("top")))).alias("part"))
            many = _tasks(left, rungs[-1][1], before, ground)
            looks, near = looks.repartition(many, *keys, "part"), near.repartition(many, *[f"_{c}" for c in keys], "_part")
            rings = looks.groupBy(*keys, "part").cogroup(near.groupBy(*[f"_{c}" for c in keys], "_part")).applyInPandas(_looker(parts, band, keys, limit, k), f"{kinds}, {_RING}")
            rings = stored(rings, "rings").withColumnsRenamed({c: f"_{c}" for c in keys})
            # tasks by number, as adaptive execution would join these few rows to one
            some = math.ceil(max(left, 1) / TASK_SEEDS)
            climbed = asking.repartition(some, *keys).groupBy(*keys).cogroup(rings.repartition(some, *[f"_{c}" for c in keys]).groupBy(*[f"_{c}" for c in keys])).applyInPandas(_climber(dict(rungs), keys, math.inf if max_relief is None else max_relief, circularity), f"{kinds}, {GROWTH}, {_STATE}")
            climbed = stored(climbed, "growth")
            whole = climbed.where("NOT more") if whole is None else whole.unionByName(climbed.where("NOT more"))
            again = climbed.where("more").select(*keys)
            if not again.limit(1).count():
                break
            asking, band = stored(asking.join(again, list(keys), "left_semi"), "asking"), 2 * band
        done = whole if done is None else done.unionByName(whole)
        start, before = rungs[-1][0] + 1, rungs[-1][1]
        open_ = open_.drop("state", "cap").where(F.col("top") >= start).join(whole.where((F.col("rung") == start - 1) & F.col("state").isNotNull()).select(*keys, "state"), list(keys))
    done = done.drop("more", "state")
    if max_relief is None:
        return done
    # the bound by heights ends a seed whose patch is high and round there; one that is not climbs without it
    at = done.join(bounded.where("top < _beyond").select(*keys, "top"), list(keys)).where((F.col("rung") == F.col("top")) & F.col("flat"))
    more = stored(at.where((F.col("relief") <= max_relief) | (F.col("circularity") < circularity)).select(*keys), "flatter")
    if not more.limit(1).count():
        return done
    again = growth_ladder(own.join(more, list(keys), "left_semi"), cloud, radius, k, limit, increment, max_rungs, keys, on, ground)
    return done.join(more, list(keys), "left_anti").unionByName(again)


def best_rungs(ladder: DataFrame, keys: tuple[str, ...] = ("attempt",), circularity: float = 0.1) -> DataFrame:
    """The last flat rung of each seed that is round enough, be others before it rounder or not."""
    good = ladder.where(F.col("flat") & (F.col("circularity") >= circularity))
    last = Window.partitionBy(*keys).orderBy(F.desc("rung"))
    return good.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def candidates(seeds: DataFrame, cloud: DataFrame, radius: float, k: int, limit: float, increment: float = 0.5, max_rungs: int | None = None, circularity: float = 0.1, clearance: float = 10.0, margin: float = 0.01, step: float = 0.2, keys: tuple[str, ...] = ("attempt",), on: tuple[str, ...] = (), ground: Surface | None = None, max_relief: float | None = None) -> DataFrame:
    """Patches of off-edge seeds that grew flat and round and have nothing above them, with metrics and score.  max_relief:
    those of more relief are left out, and need not be grown to their end."""
    ladder = growth_ladder(seeds, cloud, radius, k, limit, increment, max_rungs, keys, on, ground, max_relief, circularity)
    return zones_of(ladder, seeds, cloud, circularity, clearance, margin, step, keys, on, max_relief)


def zones_of(ladder: DataFrame, seeds: DataFrame, cloud: DataFrame, circularity: float = 0.1, clearance: float = 10.0, margin: float = 0.01, step: float = 0.2, keys: tuple[str, ...] = ("attempt",), on: tuple[str, ...] = (), max_relief: float | None = None) -> DataFrame:
    """Candidates of a ladder that was grown from seeds; max_relief as it was there."""
    best = best_rungs(ladder, keys, circularity)
    best = stored(best if max_relief is None else best.where(F.col("relief") <= max_relief), "best")
    free = clear(best, cloud, list(keys), margin=margin, clearance=clearance, step=step, on=on)
    confidence = F.when(F.col("area") > 0, F.col("n") / F.col("area")).otherwise(EMPTY_METRIC)
    out = free.join(seeds, list(keys)).withColumn("data_confidence", confidence).withColumn("patch_radius", F.col("radius"))
    out = out.withColumn("slope_deg", F.degrees(F.acos(F.least(F.abs("c"), F.lit(1.0)))))
    return out.withColumn("score", F.col("data_confidence") + F.col("patch_radius") - F.col("relief") - F.col("roughness"))


def first_zones(seeds: DataFrame, cloud: DataFrame, zones: int, radius: float, k: int, limit: float, by: tuple[str, ...] = (), on: tuple[str, ...] = (), batch: int = 64, keep: Callable[[DataFrame], DataFrame] | None = None, ground: Surface | None = None, **growth) -> DataFrame:
    """Of each of `by` (a simulation, say; without, of all) the first candidates by attempt, `zones` of them and one at least:
    not the best.  seeds: by, on, attempt, seed_pid, seed_x, seed_y, seed_z, off the edge.  keep: what a candidate must pass
    before it counts.

    Attempts go in batches that double, the first of which has FIRST_SEEDS seeds at most if `by` is given; those of which enough was found drop out, so what is climbed in vain is at most about
    what was needed.  Attempts that drew one point climb once.  The cloud's surface and bounds are made once for all batches."""
    ground = surface(cloud, k, on) if ground is None else ground
    ground = ground._replace(steep=steep_cells(ground, limit), heights=None if growth.get("max_relief") is None else height_cells(ground))
    seeds = stored(seeds, "attempts")
    zones, start, found, climbed = max(zones, 1), 0, None, [*on, "seed_pid"]
    short = seeds.groupBy(*by).agg(F.max("attempt").alias("_last")).where("_last IS NOT NULL")
    batch = max(1, min(batch, FIRST_SEEDS // max(1, short.count()))) if by else batch
    while found is None or short.limit(1).count():
        part = seeds.where(F.col("attempt").between(start, start + batch - 1))
        part = stored(part.join(short.select(*by), list(by), "left_semi") if by else part, "batch")
        grown = candidates(part.select(*climbed, "seed_x", "seed_y", "seed_z").distinct(), cloud, radius, k, limit, keys=tuple(climbed), on=on, ground=ground, **growth)
        grown = stored((keep(grown) if keep else grown).join(part.select(*dict.fromkeys((*by, *climbed)), "attempt"), climbed), "zones")
        found = grown if found is None else found.unionByName(grown)
        start, batch = start + batch, 2 * batch
        enough = found.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= zones)
        short = stored((short.join(enough, list(by), "left_anti") if by else short.where(F.lit(not enough.count()))).where(F.col("_last") >= start), "short")
    if not by:
        return first_n(found, zones)
    order = F.row_number().over(Window.partitionBy(*by).orderBy("attempt"))
    return found.withColumn("_n", order).where(F.col("_n") <= zones).drop("_n")


def first_n(found: DataFrame, n: int, keys: tuple[str, ...] = ("attempt",)) -> DataFrame:
    """The first n candidates by attempt, at least one; a negative n takes all.  Not the best n."""
    return found if n < 0 else found.orderBy(*keys).limit(max(n, 1))


def detect(cloud: DataFrame, seeds: DataFrame, radius: float = 0.5, k: int = 10, limit: float = 25.0, zones: int = -1, batch: int = 256, **growth) -> tuple[DataFrame, DataFrame]:
    """Candidates, and their patches' points (attempt, pid, x, y, z): a point in two patches comes twice.

    With a number of zones, seeds go in batches by attempt until enough are found; an empty cloud gives empty tables."""
    inside = stored(off_edge(seeds, cloud, radius), "seeds")
    found = candidates(inside, cloud, radius, k, limit, **growth) if zones < 0 else first_zones(inside, cloud, zones, radius, k, limit, batch=batch, **growth)
    found = stored(found, "candidates")
    return found, detected_points(found, cloud, radius, growth.get("increment", 0.5), growth.get("max_rungs"))


def detected_points(found: DataFrame, cloud: DataFrame, radius: float, increment: float, max_rungs: int | None = None) -> DataFrame:
    """Points of the candidates' patches; without max_rungs the widest patch is looked up first."""
    reach = radius + increment * (max_rungs - 1) if max_rungs is not None else found.agg(F.max("patch_radius")).first()[0] or radius
    near = radius_join(found.select("attempt", "seed_x", "seed_y", "seed_z", "patch_radius"), cloud, reach)
    return near.where(F.col("d2") < F.col("patch_radius") * F.col("patch_radius")).select("attempt", "pid", "x", "y", "z")


def report(seeds: DataFrame, inside: DataFrame, ladder: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("attempt",), circularity: float = 0.1) -> DataFrame:
    """One row that says what became of all attempts: attempts, edge_skipped, under_three (points on the first rung), not_flat
    (on it), low_circularity (on every flat rung), blocked (by what stands above) and zones."""
    first = F.col("rung") == 0
    each = ladder.groupBy(*keys).agg(F.bool_or(first & (F.col("n") < 3)).alias("few"), F.bool_or(F.col("flat")).alias("flat"), F.bool_or(F.col("flat") & (F.col("circularity") >= circularity)).alias("round"))
    counts = [F.count("*").alias("inside"), F.count_if("few").alias("under_three"), F.count_if(~F.col("few") & ~F.col("flat")).alias("not_flat"), F.count_if(F.col("flat") & ~F.col("round")).alias("low_circularity"), F.count_if("round").alias("round")]
    one = each.agg(*counts).crossJoin(seeds.agg(F.count("*").alias("attempts"))).crossJoin(inside.agg(F.count("*").alias("off_edge"))).crossJoin(found.agg(F.count("*").alias("zones")))  # one row each
    return one.select("attempts", (F.col("attempts") - F.col("off_edge")).alias("edge_skipped"), "under_three", "not_flat", "low_circularity", (F.col("round") - F.col("zones")).alias("blocked"), "zones")


def ranked(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank (1 is the highest score; ties by attempt) and label."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "attempt")
    return found.withColumn("rank", F.row_number().over(best)).withColumn("label", F.concat(F.lit("Rank "), F.col("rank")))
