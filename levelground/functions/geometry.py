"""Planes and hulls: closed-form eigenvectors as Catalyst expressions, and NumPy forms for grouped Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = [("xx", "x", "x"), ("xy", "x", "y"), ("xz", "x", "z"), ("yy", "y", "y"), ("yz", "y", "z"), ("zz", "z", "z")]


def covariance(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """The six population covariances and three means of a group of points: partial aggregation, one pass."""
    of = {"x": x, "y": y, "z": z}
    return [F.covar_pop(of[a], of[b]).alias(n) for n, a, b in AXES] + [F.avg(of[a]).alias(f"m{a}") for a in "xyz"]


def let(value: Column, of) -> Column:
    """of(value) with value computed once: bound in a lambda, so that no rule of the optimizer that puts expressions in
    for names, such as the pushing down of filters, multiplies what it puts in."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def with_normal(df: DataFrame) -> DataFrame:
    """Adds nx, ny, nz (nz >= 0) and lam: unit eigenvector and value of the least eigenvalue of the covariance.

    Trigonometric solution for symmetric 3x3 matrices (Smith 1961), then the longest cross product of two rows of
    M - lam I.  Null where all points coincide, as no direction is least then.
    """
    xx, xy, xz, yy, yz, zz = map(F.col, ("xx", "xy", "xz", "yy", "yz", "zz"))

    def spread(q):
        return F.struct(q.alias("q"), F.sqrt((F.pow(xx - q, 2) + F.pow(yy - q, 2) + F.pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6).alias("p"))

    def least(qp):
        q, p = qp["q"], qp["p"]
        a, d, f = xx - q, yy - q, zz - q
        det = a * (d * f - yz * yz) - xy * (xy * f - yz * xz) + xz * (xy * yz - d * xz)
        r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * F.pow(p, 3))))
        return F.when(p > 0, q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3))

    def cross(u, v):
        return F.struct((u[1] * v[2] - u[2] * v[1]).alias("x"), (u[2] * v[0] - u[0] * v[2]).alias("y"), (u[0] * v[1] - u[1] * v[0]).alias("z"))

    def sized(v):
        return F.struct(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]).alias("s"), v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))

    def normal(lam):
        rows = [(xx - lam, xy, xz), (xy, yy - lam, yz), (xz, yz, zz - lam)]
        # ordered by size first, so the greatest is the longest
        longest = F.array_max(F.array(*[let(cross(rows[u], rows[v]), sized) for u, v in ((0, 1), (0, 2), (1, 2))]))
        return let(longest, lambda v: F.when(v["s"] > 0, F.struct(*[(F.when(v["z"] < 0, -v[c]).otherwise(v[c]) / v["s"]).alias(f"n{c}") for c in "xyz"], lam.alias("lam"))))

    n = let(let(let((xx + yy + zz) / 3, spread), least), lambda lam: F.when(lam.isNotNull(), normal(lam)))
    return df.withColumn("_n", n).select("*", "_n.*").drop("_n")


def slope(nz: Column | str = "nz", strict_nan: bool = False) -> Column:
    """Degrees between a normal and the vertical, null without one.  Rounding above 1 is clamped; strict_nan leaves it
    NaN, which then counts as not flat."""
    up = F.abs(F.col(nz) if isinstance(nz, str) else nz)
    return F.when(up.isNotNull(), F.degrees(F.acos(up if strict_nan else F.least(up, F.lit(1.0)))))


def hull2d_rows(xy: np.ndarray) -> np.ndarray:
    """Rows of the convex hull's vertices in order, counterclockwise from the least (x, y), by monotone chain (Andrew
    1979); collinear points and repeated ones are left out.  Points well inside the polygon of the extremes in 32 or more directions
    (Akl and Toussaint 1978) are dropped before, so that the chain walks over few."""
    pts, rows = np.unique(xy, axis=0, return_index=True)
    if len(pts) < 3:
        return rows
    if len(pts) > 64:
        outer = _not_inside(pts)
        pts, rows = pts[outer], rows[outer]
    p, ulps = pts.tolist(), 1e-15 * float(np.abs(pts).max())  # what rounding of coordinates can make of points in a line

    def half(order):
        out: list[int] = []
        for i in order:
            while len(out) > 1:
                (x, y), ux, uy = p[out[-2]], p[out[-1]][0] - p[out[-2]][0], p[out[-1]][1] - p[out[-2]][1]
                vx, vy = p[i][0] - x, p[i][1] - y
                if ux * vy - uy * vx > ulps * (abs(ux) + abs(uy) + abs(vx) + abs(vy)):
                    break
                out.pop()
            out.append(i)
        return out

    lower, upper = half(range(len(p))), half(range(len(p) - 1, -1, -1))
    return rows[lower[:-1] + upper[:-1]]


def _not_inside(pts: np.ndarray) -> np.ndarray:
    """Points that are not well inside the polygon of the extremes: each is compared with the edge that it sees beside it from
    the polygon's middle."""
    turns = 32 if len(pts) < 1_000 else 128
    turn = np.arange(turns) * (2 * math.pi / turns)
    at = pts[np.argmax(pts @ np.stack([np.cos(turn), np.sin(turn)]), axis=0)]
    at = at[(at != np.roll(at, 1, axis=0)).any(axis=1)]
    if len(at) < 3:
        return np.ones(len(pts), bool)
    middle = at.mean(axis=0)
    angle = np.arctan2(*(at - middle).T[::-1])
    first = int(angle.argmin())
    at, angle = np.roll(at, -first, axis=0), np.roll(angle, -first)
    edge = np.searchsorted(angle, np.arctan2(*(pts - middle).T[::-1]), side="right") - 1
    u, v = at[edge], at[(edge + 1) % len(at)]
    margin = 1e-9 * float(np.ptp(pts, axis=0).max()) ** 2
    return ~((v[:, 0] - u[:, 0]) * (pts[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (pts[:, 0] - u[:, 0]) > margin)


def hull2d(xy: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull in order."""
    return xy[hull2d_rows(xy)]


def hull_measures(xy: np.ndarray) -> tuple[int, float, float, float]:
    """(vertices, area, perimeter, circularity 4 pi area / perimeter^2); the last three 0 under three vertices."""
    return measured_hull(hull2d(xy))


def measured_hull(h: np.ndarray) -> tuple[int, float, float, float]:
    """hull_measures of a hull's vertices in order."""
    if len(h) < 3:
        return len(h), 0.0, 0.0, 0.0
    nxt = np.roll(h, -1, axis=0)
    area = abs(float(np.sum(h[:, 0] * nxt[:, 1] - nxt[:, 0] * h[:, 1]))) / 2
    around = float(np.sum(np.hypot(*(nxt - h).T)))
    return len(h), area, around, 4 * math.pi * area / around**2 if around > 0 else 0.0


def hull3d(xyz: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows, area) of the convex hull in space: rows that have the same hull as all, and its surface, by quickhull (Barber
    et al. 1996).  Every face keeps the points outside it; the farthest of one face is added, and the points of the faces
    that it sees are dealt out among the new ones at once.  Points in a plane have no surface, and their hull in that plane."""
    pts, rows = np.unique(xyz, axis=0, return_index=True)
    if len(pts) < 3:
        return rows, 0.0
    scale = float(np.ptp(pts, axis=0).max())
    eps = 1e-10 * scale
    a = 0
    b = int(np.argmax(np.linalg.norm(pts - pts[a], axis=1)))
    away = np.linalg.norm(np.cross(pts - pts[a], pts[b] - pts[a]), axis=1)
    c = int(np.argmax(away))
    if away[c] <= eps * scale:
        along = (pts - pts[a]) @ (pts[b] - pts[a])
        return rows[[int(along.argmin()), int(along.argmax())]], 0.0
    normal = np.cross(pts[b] - pts[a], pts[c] - pts[a])
    height = (pts - pts[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= eps * np.linalg.norm(normal):
        return rows[hull2d_rows(np.delete(pts, int(np.argmax(np.abs(normal))), axis=1))], 0.0
    corners: dict[int, tuple[int, int, int]] = {}
    normals: dict[int, np.ndarray] = {}
    outside: dict[int, np.ndarray] = {}
    beside: dict[tuple[int, int], int] = {}  # the face that has an edge in this direction
    made = 0

    def add(faces: list[tuple[int, int, int]], of: np.ndarray) -> None:
        """Faces, counterclockwise seen from outside, with those of `of` that lie outside, each with the face that it is
        farthest from."""
        nonlocal made
        f = np.array(faces)
        n = np.cross(pts[f[:, 1]] - pts[f[:, 0]], pts[f[:, 2]] - pts[f[:, 0]])
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        far = pts[of] @ n.T - (pts[f[:, 0]] * n).sum(axis=1)
        of, far = of[(out := far.max(axis=1, initial=-math.inf) > eps)], far[out]
        whose = far.argmax(axis=1) if len(of) else of
        for i, (u, v, w) in enumerate(faces):
            corners[made], normals[made], outside[made] = (u, v, w), n[i], of[whose == i]
            beside[u, v] = beside[v, w] = beside[w, u] = made
            made += 1

    if height[d] > 0:  # d behind the first face
        b, c = c, b
    add([(a, b, c), (a, d, b), (b, d, c), (c, d, a)], np.delete(np.arange(len(pts)), [a, b, c, d]))
    todo = list(outside)
    while todo:
        face = todo.pop()
        if face not in outside or not len(outside[face]):
            continue
        p = int(outside[face][((pts[outside[face]] - pts[corners[face][0]]) @ normals[face]).argmax()])
        seen, edges, look = {face}, [], [face]
        while look:
            u, v, w = corners[look.pop()]
            for e in ((u, v), (v, w), (w, u)):
                other = beside[e[::-1]]
                if other not in seen and (pts[p] - pts[corners[other][0]]) @ normals[other] > eps:
                    seen.add(other)
                    look.append(other)
        for i in seen:
            u, v, w = corners[i]
            edges += [e for e in ((u, v), (v, w), (w, u)) if beside[e[::-1]] not in seen]
        rest = np.concatenate([outside[i] for i in sorted(seen)])
        for i in seen:
            u, v, w = corners.pop(i)
            del normals[i], outside[i], beside[u, v], beside[v, w], beside[w, u]
        start = made
        add([(u, v, p) for u, v in edges], rest[rest != p])
        todo += range(start, made)
    f = np.array(list(corners.values()))
    area = float(np.linalg.norm(np.cross(pts[f[:, 1]] - pts[f[:, 0]], pts[f[:, 2]] - pts[f[:, 0]]), axis=1).sum()) / 2
    return rows[np.unique(f)], area


def hull3d_area(xyz: np.ndarray) -> float:
    """Surface of the convex hull in space; 0 if all points lie in a plane."""
    return hull3d(xyz)[1]


#: Distances held at once while neighbours are looked for, and the share of k that a column of the first search holds on average.
AT_ONCE, SHARE = 250_000, 0.6


def _narrowed(own: Callable[[float], np.ndarray], n: int, side: float, least: float, aim: float) -> float:
    """A side, at most the given one, of which occupied columns hold about `aim` of n points; own: columns of a side."""
    for _ in range(3):
        held = n / (1 + np.count_nonzero(np.diff(np.sort(own(side)))))
        if held <= 1.5 * aim or side <= least:
            break
        side = max(least, side * math.sqrt(aim / held))
    return side


def nearest(xyz: np.ndarray, of: np.ndarray, k: int, side: float | None = None, certain: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of xyz, squared distances, exact) of the k nearest of xyz to each row of `of`, nearest first, equal distances by
    row; k is at most len(xyz).

    Points are sorted into square columns of a side that holds few of them; a target looks at the nine around it, and
    again with doubled sides while its k-th may be farther than one side.  A search ends at `certain`, where targets
    with a farther k-th are not exact.  Targets whose nine hold about as many points are looked at together."""
    m, k = len(of), min(k, len(xyz))
    at, d2, exact = np.zeros((m, k), np.int64), np.full((m, k), np.inf), np.zeros(m, bool)
    if not m or not k:
        return at, d2, ~exact
    low = np.minimum(xyz[:, :2].min(axis=0), of[:, :2].min(axis=0))
    extent = float((np.maximum(xyz[:, :2].max(axis=0), of[:, :2].max(axis=0)) - low).max())
    least = max(extent / 30_000, 1e-9)
    side = max(side or extent * math.sqrt(max(k, 16) / max(len(xyz), 1)), least)

    def columns(p: np.ndarray, side: float) -> np.ndarray:
        return (np.floor((p[:, :2] - low) / side).astype(np.int64) + 1) @ (int(extent / side) + 4, 1)

    side = _narrowed(lambda side: columns(xyz, side), len(xyz), min(side, certain), least, max(2.0, SHARE * k))
    axes = [np.append(xyz[:, c], np.inf) for c in range(3)]  # and a place that is far from all
    todo = np.arange(m)
    while len(todo):
        side = min(side, certain)
        width = int(extent / side) + 4
        own = columns(xyz, side)
        order = np.argsort(own, kind="stable")
        own, order = own[order], np.append(order, len(xyz))
        targets = columns(of[todo], side)
        by = np.argsort(targets, kind="stable")
        first = np.r_[True, np.diff(targets[by]) > 0]
        column, which = targets[by][first], np.cumsum(first) - 1
        begins = np.stack([np.searchsorted(own, column + step) for step in (-width - 1, -1, width - 1)])
        sizes = np.stack([np.searchsorted(own, column + step) for step in (-width + 2, 2, width + 2)]) - begins
        total = sizes.sum(axis=0)
        alike = np.argsort(total[which], kind="stable")
        by, which = by[alike], which[alike]
        many = total[which]
        i = int(np.searchsorted(many, k))
        while i < len(by):
            e = min(len(by), i + max(1, AT_ONCE // int(many[i])))
            e = min(e, i + max(1, AT_ONCE // int(many[e - 1])))
            new = np.r_[True, np.diff(which[i:e]) != 0]
            of_column, of_target, j = which[i:e][new], np.cumsum(new) - 1, np.arange(int(many[e - 1]))
            start, size = begins[:, of_column, None], sizes[:, of_column, None]
            place = np.where(j < size[0], start[0] + j, np.where(j < size[0] + size[1], start[1] + j - size[0], start[2] + j - size[0] - size[1]))
            near = np.sort(order[np.where(j < total[of_column, None], place, len(xyz))], axis=1)
            rows = todo[by[i:e]]
            far = _squares(of[rows], [axis[near] for axis in axes], of_target)
            some = _least(far, k)
            at[rows], d2[rows] = near[of_target[:, None], some], np.take_along_axis(far, some, 1)
            i = e
        exact[todo] = (d2[todo, -1] <= side * side) | (side > extent)
        if side >= certain:
            break
        todo = todo[~exact[todo]]
        side *= 2
    return at, d2, exact


def _squares(own: np.ndarray, near: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    """Squared distances of each row of own to all in its row of near, axis by axis in place."""
    d2 = near[0][which]
    d2 -= own[:, 0, None]
    d2 *= d2
    for c in (1, 2):
        more = near[c][which]
        more -= own[:, c, None]
        more *= more
        d2 += more
    return d2


def _least(d2: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each row, ties by place."""
    wide = min(k + 6, d2.shape[1])
    if wide == d2.shape[1]:
        return np.argsort(d2, axis=1, kind="stable")[:, :k]
    some = np.sort(np.argpartition(d2, wide - 1, axis=1)[:, :wide], axis=1)
    part = np.take_along_axis(d2, some, 1)
    first = np.argsort(part, axis=1, kind="stable")
    tied = part[np.arange(len(part)), first[:, k - 1]] == part[np.arange(len(part)), first[:, -1]]
    rows = np.take_along_axis(some, first[:, :k], 1)
    if tied.any():
        rows[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
    return rows


def planes_at(xyz: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit normals with nz >= 0, covariances, least eigenvalues) of the planes through the points of each row of rows;
    NaN normals where they coincide."""
    near = np.take(xyz, rows, axis=0)
    near -= near.mean(axis=1, keepdims=True)
    cov = near.transpose(0, 2, 1) @ near / rows.shape[1]
    values, vectors = np.linalg.eigh(cov)
    up = vectors[:, :, 0] * np.where(vectors[:, 2, :1] < 0, -1.0, 1.0)
    return np.where(values[:, 2:] > 0, up, np.nan), cov, values[:, 0]


def slopes_at(xyz: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Degrees of the local plane through the points of each row of rows; NaN where they coincide."""
    return np.degrees(np.arccos(np.minimum(1.0, planes_at(xyz, rows)[0][:, 2])))


def local_slopes(xyz: np.ndarray, k: int) -> np.ndarray:
    """Degrees of the local plane through each point's k nearest (itself one of them); NaN where they coincide."""
    return slopes_at(xyz, nearest(xyz, xyz, k)[0])


def fitted_plane(xyz: np.ndarray) -> tuple[float, float, float, float]:
    """a, b, c >= 0, d of the total least squares plane a x + b y + c z + d = 0 with unit normal."""
    centre = xyz.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((xyz - centre).T, bias=True))
    n = vectors[:, 0] * (-1.0 if vectors[2, 0] < 0 else 1.0)
    return float(n[0]), float(n[1]), float(n[2]), float(-n @ centre)
