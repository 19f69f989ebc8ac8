"""Geometry of boxes and polygons: columns where arrays of points will do, numpy in Arrow batches where not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<array<double>>"


def points_range(points: Column, axis: int) -> Column:
    """[least, greatest] coordinate; axis 0 is x, 1 is y."""
    values = F.transform(points, lambda p: p[axis])
    return F.array(F.array_min(values), F.array_max(values))


def points_center(points: Column) -> Column:
    return F.array(_mean(points, 0), _mean(points, 1))


def _mean(points: Column, axis: int) -> Column:
    return F.aggregate(F.transform(points, lambda p: p[axis]), F.lit(0.0), lambda s, v: s + v) / F.size(points)


def overlap(a: Column, b: Column) -> Column:
    """Whether two open ranges meet; a null range meets nothing."""
    return F.coalesce((a[0] < b[1]) & (b[0] < a[1]), F.lit(False))


def touches(a: Column, b: Column) -> Column:
    """Whether two closed ranges meet."""
    return (a[1] >= b[0]) & (b[1] >= a[0])


def shift_y(box: Column, dy: Column) -> Column:
    """A box moved down: bbox, center and y_range."""
    return (
        box.withField("bbox", F.transform(box["bbox"], lambda p: F.array(p[0], p[1] + dy)))
        .withField("center", F.array(box["center"][0], box["center"][1] + dy))
        .withField("y_range", F.transform(box["y_range"], lambda y: y + dy))
    )


def _edges(points: Column, f) -> Column:
    n = F.size(points)
    terms = F.transform(points, lambda p, i: f(p, F.element_at(points, (i + 1) % n + 1)))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def polygon_area(points: Column) -> Column:
    return F.abs(_edges(points, lambda p, q: p[0] * q[1] - q[0] * p[1])) * 0.5


def polygon_length(points: Column) -> Column:
    return _edges(points, lambda p, q: F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])))


def detector_size(width: Column, height: Column, shortest: int = 736) -> Column:
    """Struct of w, h: the shorter side raised to shortest, both cut to multiples of 32, 32 at least."""
    ratio = F.when(F.least(width, height) < shortest, F.lit(float(shortest)) / F.least(width, height)).otherwise(F.lit(1.0))

    def cut(side: Column) -> Column:
        return F.greatest((F.floor(F.floor(side * ratio) / 32) * 32).cast("int"), F.lit(32))

    return F.struct(cut(width).alias("w"), cut(height).alias("h"))


def recognizer_width(width: Column, height: Column) -> Column:
    """Struct of img_w, resized_w for lines scaled to a height of 48."""
    ratio = width / height
    full = F.round(48 * F.greatest(F.lit(320 / 48), ratio)).cast("int")
    return F.struct(full.alias("img_w"), F.greatest(F.least(F.ceil(48 * ratio).cast("int"), full), F.lit(1)).alias("resized_w"))


def region_offset(height: Column) -> Column:
    """First row of the lower 40 % of an image."""
    return F.floor(height * 0.6).cast("int")


def clamped_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Struct of x, y, w, h inside the image; the whole image where nothing would be left."""
    x0, y0 = F.least(x, width), F.least(y, height)
    cw, ch = F.least(w, width - x0), F.least(h, height - y0)
    empty = (cw <= 0) | (ch <= 0)
    zero = F.lit(0)
    return F.struct(F.when(empty, zero).otherwise(x0).alias("x"), F.when(empty, zero).otherwise(y0).alias("y"), F.when(empty, width).otherwise(cw).alias("w"), F.when(empty, height).otherwise(ch).alias("h"))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains, anticlockwise; three points or fewer as they are."""
    if len(points) <= 3:
        return points
    ordered = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(seq) -> list:
        kept: list = []
        for p in seq:
            while len(kept) > 1:
                (ox, oy), (ax, ay) = kept[-2], kept[-1]
                if (ax - ox) * (p[1] - oy) - (ay - oy) * (p[0] - ox) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]))


def tightest_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, width, height, angle) of the rectangle of least area along a hull edge; width is the longer side."""
    h = hull(points)
    if len(h) <= 2:
        return (0.0, 0.0, 0.0, 0.0, 0.0)
    d = np.roll(h, -1, axis=0) - h
    angles = np.arctan2(d[:, 1], d[:, 0])
    c, s = np.cos(angles)[:, None], np.sin(angles)[:, None]
    along, across = h[:, 0] * c + h[:, 1] * s, h[:, 1] * c - h[:, 0] * s
    lo, hi, below, above = along.min(1), along.max(1), across.min(1), across.max(1)
    k = int(np.argmin((hi - lo) * (above - below)))
    w, t, a = float(hi[k] - lo[k]), float(above[k] - below[k]), float(angles[k])
    u, v = (lo[k] + hi[k]) / 2, (below[k] + above[k]) / 2
    cx, cy = float(u * c[k, 0] - v * s[k, 0]), float(u * s[k, 0] + v * c[k, 0])
    return (cx, cy, t, w, a + math.pi / 2) if t > w else (cx, cy, w, t, a)


def corners(cx: float, cy: float, width: float, height: float, angle: float) -> np.ndarray:
    """Corners: top left, top right, bottom right, bottom left."""
    ca, sa, hw, hh = math.cos(angle), math.sin(angle), width / 2, height / 2
    at = np.array([(cx + x * ca - y * sa, cy + x * sa + y * ca) for x, y in ((-hw, -hh), (hw, -hh), (hw, hh), (-hw, hh))])
    by_x = at[np.argsort(at[:, 0], kind="stable")]
    left, right = (side[np.argsort(side[:, 1], kind="stable")] for side in (by_x[:2], by_x[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def grown(points: np.ndarray, distance: float) -> np.ndarray:
    """The polygon with each vertex moved by distance along the sum of its edges' outer normals; vertices of edges without length go."""
    if not len(points):
        return points
    after, before = np.roll(points, -1, axis=0), np.roll(points, 1, axis=0)
    turn = 1.0 if (points[:, 0] * after[:, 1] - after[:, 0] * points[:, 1]).sum() >= 0 else -1.0
    out = []
    for p, a, b in zip(points, before, after):
        e, f = p - a, b - p
        le, lf = math.hypot(*e), math.hypot(*f)
        if min(le, lf) < 1e-6:
            continue
        first = turn * np.array([e[1], -e[0]]) / le
        both = first + turn * np.array([f[1], -f[0]]) / lf
        size = math.hypot(*both)
        out.append(p + (both * distance / size if size >= 1e-6 else first * distance))
    return np.array(out)


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def _on_points(f, kind: str):
    @F.pandas_udf(kind)
    def run(points: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f(np.array([list(q) for q in p], float).reshape(-1, 2)) for p in points])

    return run


def convex_hull(points: Column) -> Column:
    return _on_points(lambda p: hull(p).tolist(), POINTS)(points)


def min_area_rect(points: Column) -> Column:
    """[cx, cy, width, height, angle]."""
    return _on_points(lambda p: list(tightest_rect(p)), "array<double>")(points)


def box_points(points: Column) -> Column:
    return _on_points(lambda p: corners(*tightest_rect(p)).tolist(), POINTS)(points)


def offset_polygon(points: Column, distance: float) -> Column:
    return _on_points(lambda p: grown(p, distance).tolist(), POINTS)(points)
