"""Radius and nearest-neighbour joins: distance predicates rewritten as equi-joins on grid cells.

Cells are columns in x and y whatever the height: what is near in space is near on the ground.  Catalyst would plan the
bare predicate as a nested loop over all pairs; on cells it hash-partitions both sides, and adaptive execution splits
crowded cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelground.functions.geometry import nearest


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size)


def with_cells(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"_cx": _cell(F.col(x), size), "_cy": _cell(F.col(y), size)})


def in_neighbour_cells(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    """Each row once for each of the nine cells around it."""
    around = F.array(*[F.struct((_cell(F.col(x), size) + i).alias("_cx"), (_cell(F.col(y), size) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.select("*", F.inline(around))


def distance2(*pairs: tuple[str, str]) -> Column:
    return sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in pairs[1:]), (F.col(pairs[0][0]) - F.col(pairs[0][1])) * (F.col(pairs[0][0]) - F.col(pairs[0][1])))


#: Cells that fit in the radius where seeds have radii of their own.
FINER = 4


def radius_join(seeds: DataFrame, cloud: DataFrame, radius: float, on: tuple[str, ...] = (), inclusive: bool = False, own: str | None = None) -> DataFrame:
    """Points of cloud closer than radius to a seed (seed_x, seed_y, seed_z), the seed's own point included: seed columns,
    point columns and d2.  on: columns that both share, such as a cloud's or a simulation's id.  inclusive: points at
    exactly radius count too.  own: a column of seeds with a radius of its own, beyond which no point is asked for; the seed then
    meets only cells, of a quarter of the side, that its circle touches."""
    if own:
        size, r = radius / FINER, F.least(F.lit(radius), F.col(own)) * (1 + 1e-9) + 1e-9
        touched = lambda c: F.explode(F.sequence(_cell(F.col(c) - r, F.lit(size)), _cell(F.col(c) + r, F.lit(size))))
        off = lambda c, i: F.greatest(F.lit(0.0), F.col(i) * size - F.col(c), F.col(c) - (F.col(i) + 1) * size)
        seeds = seeds.withColumn("_cx", touched("seed_x")).withColumn("_cy", touched("seed_y"))
        seeds = seeds.where(off("seed_x", "_cx") * off("seed_x", "_cx") + off("seed_y", "_cy") * off("seed_y", "_cy") <= r * r)
    else:
        size, seeds = radius, in_neighbour_cells(seeds, radius, "seed_x", "seed_y")
    near = seeds.join(with_cells(cloud, size), [*on, "_cx", "_cy"]).drop("_cx", "_cy")
    near = near.withColumn("d2", distance2(("x", "seed_x"), ("y", "seed_y"), ("z", "seed_z")))
    return near.where(F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius)


def knn_in_group(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k nearest points within a group for each of its points, itself included: by, pid, other (pid), d2, rank."""
    return knn(points, k, tuple(by)).select(*by, "pid", "other", "d2", "rank")


def cloud_keys(cloud: DataFrame) -> tuple[str, ...]:
    """What tells points of several clouds apart beside pid, where the table has it."""
    return ("cloud_id",) if "cloud_id" in cloud.columns else ()


def same_point(left: DataFrame, right: DataFrame, on: tuple[str, ...], how: str = "left") -> DataFrame:
    """Join by point, clouds without an id being one cloud."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in (*on, "pid")})
    same = [F.col("pid") == F.col("_pid"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]]
    return left.join(right, same, how).drop(*[f"_{c}" for c in (*on, "pid")])


#: Cells along the side of a block, which one call handles, cells around it that it looks into, and points that a cell holds on
#: average.
BLOCK, RIM, PER_CELL = 24, 3, 24
#: Points of a block, by and large, beyond which it is cut up.
MOST = 50_000
#: Points of a task of the first look.
TASK_POINTS = 200_000


def by_neighbours(cloud: DataFrame, k: int, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], schema: str, on: tuple[str, ...] = (), rounds: int = 64) -> DataFrame:
    """on, pid and what `measure` says of the k nearest points of the whole cloud for each point, itself included (fewer if
    the cloud is smaller).  measure gets all points in reach (x, y, z), rows of the k nearest for each point, equal
    distances by pid, and their squared distances, and gives columns.

    Points fall into cells, and blocks of cells meet with the cells around them in one call, so each point moves about
    once and no pair of points does.  A neighbour within RIM sides of a cell is certain; points whose k-th is farther go on
    with doubled cells, and only the blocks around them.

    Clouds may be denser in places by any factor.  Points of a block with more than MOST points go on in cells of a quarter of
    the side, and so on, as in a quadtree; their own neighbours are near.  The few points of sparse places beside dense ones,
    which are not certain there, meet wider blocks in parts of some MOST points, and the best of all parts are taken.
    """
    from levelground.operators.storage import stored

    points, done = cloud.select(*on, "pid", "x", "y", "z"), None
    box = points.groupBy(*on).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    box = box.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("w").alias("w"), F.max("h").alias("h")).first()
    most, width, height = box.most or 0, box.w or 0.0, box.h or 0.0
    area = max(width, height * 1e-3, 1e-9) * max(height, width * 1e-3, 1e-9)
    side = math.sqrt(area * max(PER_CELL, k) / max(most, 1))
    kinds = "".join(f"{c} {cloud.schema[c].dataType.simpleString()}, " for c in on)
    pid = cloud.schema["pid"].dataType.simpleString()
    out, block = f"{kinds}pid {pid}, _sure boolean, {schema}", ["_bx", "_by"]

    def measured(key: tuple, group: pd.DataFrame, core: np.ndarray, exact: np.ndarray, rows: np.ndarray, d2: np.ndarray) -> pd.DataFrame:
        """What is known of the core points that are exact, and only the pid of the others"""
        own = {c: v for c, v in zip(on, key)}
        sure = np.isin(np.arange(len(group)), core[exact])
        found = pd.DataFrame(columns=[*own, "pid", "_sure", *(c.split()[0] for c in schema.split(", "))])
        if exact.any():
            found = pd.DataFrame(own | {"pid": group["pid"].to_numpy()[sure], "_sure": True} | measure(group.assign(_core=sure, _i=range(len(group))), rows[exact], d2[exact]))
        if exact.all():
            return found
        rest = pd.DataFrame(own | {"pid": group["pid"].to_numpy()[core[~exact]], "_sure": False})
        for c in schema.split(", "):
            rest[c.split()[0]] = pd.Series([None] * len(rest), dtype=object if "array" in c else float)
        return pd.concat([found, rest], ignore_index=True) if len(found) else rest[list(found.columns)]

    def search(side: float, whole: bool):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("pid", kind="stable")
            xyz, core = group[["x", "y", "z"]].to_numpy(float), np.flatnonzero(group["_core"].to_numpy(bool))
            rows, d2, _ = nearest(xyz, xyz[core], k, side, math.inf if whole else RIM * side)
            exact = np.full(len(core), whole) if whole or rows.shape[1] < k else d2[:, -1] <= (RIM * side) ** 2
            return measured(key, group, core, exact, rows, d2)

        return run

    def part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The k nearest in a part of a block for each of the block's points that are looked for"""
        there = group[~group["_asks"]].sort_values("pid", kind="stable")
        asks = group[group["_asks"]]
        rows, d2, _ = nearest(there[["x", "y", "z"]].to_numpy(float), asks[["x", "y", "z"]].to_numpy(float), k)
        own = {c: np.repeat(asks[c].to_numpy(), rows.shape[1]) for c in ("pid", "x", "y", "z")}
        columns = dict(zip((*on, *block), key)) | {f"own_{c}": v for c, v in own.items()} | {"d2": d2.ravel()}
        return pd.DataFrame(columns | {c: there[c].to_numpy()[rows].ravel() for c in ("pid", "x", "y", "z")})

    def best(side: float, whole: bool):
        """Of all parts of a block, which holds more than k points."""

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            near = group.sort_values(["own_pid", "d2", "pid"], kind="stable")
            near = near[near.groupby("own_pid").cumcount() < k]
            exact = np.full(len(near) // k, True) if whole else near["d2"].to_numpy().reshape(-1, k)[:, -1] <= (RIM * side) ** 2
            asks = near.iloc[::k][["own_pid", "own_x", "own_y", "own_z"]].rename(columns=lambda c: c.removeprefix("own_"))
            there = pd.concat([near[["pid", "x", "y", "z"]], asks]).drop_duplicates("pid").sort_values("pid", ignore_index=True)
            rows = np.searchsorted(there["pid"].to_numpy(), near["pid"].to_numpy()).reshape(-1, k)
            return measured(key, there, np.flatnonzero(there["pid"].isin(asks["pid"]).to_numpy()), exact, rows, near["d2"].to_numpy().reshape(-1, k))

        return run

    keyed = lambda run: (lambda key, group: run(key[: len(on)], group))
    same = lambda left, right: [F.col(left[0]) == F.col(right[0]), F.col(left[1]) == F.col(right[1]), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]]
    # which points are looked at with cells of side * 2 ** size, by size; True: for the first time, and all if None
    waiting: dict[tuple[int, bool], DataFrame | None] = {(0, True): None}
    for _ in range(rounds):
        size, fresh = at = min(waiting)
        open_ = waiting.pop(at)
        s = side * 2.0**size
        whole = s * (BLOCK - 2 * RIM) > max(width, height)  # one block and its rim then hold every point of a cloud
        cell = {c: F.lit(0) if whole else F.floor(F.col(c) / s) for c in "xy"}
        blocks = [F.explode(F.sequence(F.floor((cell[c] - RIM) / BLOCK), F.floor((cell[c] + RIM) / BLOCK))) if not whole else F.lit(0) for c in "xy"]
        marked = points if open_ is None else same_point(points, open_.withColumn("_open", F.lit(True)), on)
        near = marked.withColumn("_bx", blocks[0]).withColumn("_by", blocks[1])
        core = (F.col("_bx") == F.floor(cell["x"] / BLOCK)) & (F.col("_by") == F.floor(cell["y"] / BLOCK)) & (F.lit(True) if open_ is None else F.coalesce("_open", F.lit(False)))
        near = near.withColumn("_core", core)
        if open_ is not None:
            wanted = near.where("_core").select(*[F.col(c).alias(f"_{c}") for c in on], F.col("_bx").alias("_wx"), F.col("_by").alias("_wy")).distinct()
            near = near.join(wanted, same(block, ["_wx", "_wy"]), "left_semi")
        near = near.select(*on, "_bx", "_by", "pid", "x", "y", "z", "_core")
        crowded = near.groupBy(*on, *block).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST)
        some = bool(crowded.limit(1).count())
        if some:
            crowded = stored(crowded, "crowded").withColumnsRenamed({c: f"_{c}" for c in on} | {"_bx": "_wx", "_by": "_wy"})
            apart = near.join(crowded, same(block, ["_wx", "_wy"])).drop("_wx", "_wy", *[f"_{c}" for c in on])
            near = near.join(crowded, same(block, ["_wx", "_wy"]), "left_anti")
        if open_ is None:
            near = near.repartition(max(1, (box.n or 0) // TASK_POINTS), *on, *block)  # even tasks, which adaptive execution would join to few
        found = stored(near.groupBy(*on, *block).applyInPandas(keyed(search(s, whole)), out), "neighbours")
        looked = [found]
        if some and fresh:
            deeper = stored(apart.where("_core").select(*on, "pid"), "deeper")
            waiting[size - 2, True] = deeper
        elif some:
            parts = F.greatest(F.lit(1), F.floor(F.col("_n") / MOST)).cast("int")
            asks = apart.where("_core").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("_asks", F.lit(True))
            there = apart.withColumn("_part", F.pmod(F.xxhash64("pid"), parts).cast("int")).withColumn("_asks", F.lit(False))
            near = asks.unionByName(there).drop("_n", "_core").groupBy(*on, *block, "_part").applyInPandas(part, f"{kinds}_bx long, _by long, own_pid {pid}, own_x double, own_y double, own_z double, d2 double, pid {pid}, x double, y double, z double")
            looked.append(stored(near.groupBy(*on, *block).applyInPandas(keyed(best(s, whole)), out), "neighbours"))
        left = None
        for x in looked:
            sure, more = x.where("_sure").drop("_sure"), x.where("NOT _sure").select(*on, "pid")
            done = sure if done is None else done.unionByName(sure)
            left = more if left is None else left.unionByName(more)
        if not whole:
            known = waiting.pop((size + 1, False), None)
            left = stored(left if known is None else left.unionByName(known), "open")
            if left.limit(1).count():
                waiting[size + 1, False] = left
        if not waiting:
            return done
    raise RuntimeError(f"points are left after {rounds} rounds")


def knn(cloud: DataFrame, k: int, on: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest points of the whole cloud for each point, itself included: on, pid, other, d2, rank, and the other's
    ox, oy, oz; fewer if the cloud is smaller.  Equal distances rank by pid."""

    def listed(group, rows, d2):
        of = {c: group[n].to_numpy()[rows] for c, n in (("other", "pid"), ("ox", "x"), ("oy", "y"), ("oz", "z"))}
        return {c: list(v) for c, v in (of | {"d2": d2}).items()}

    pid = cloud.schema["pid"].dataType.simpleString()
    found = by_neighbours(cloud, k, listed, f"other array<{pid}>, ox array<double>, oy array<double>, oz array<double>, d2 array<double>", on)
    at = F.posexplode(F.arrays_zip("other", "ox", "oy", "oz", "d2")).alias("_at", "_n")
    return found.select(*on, "pid", at).select(*on, "pid", "_n.*", (F.col("_at") + 1).alias("rank"))
