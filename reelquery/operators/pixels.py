"""Images as arrays: masks as column expressions, stencils and components in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union(a: Column, b: Column) -> Column:
    """a, with 255 where b is 255."""
    return F.zip_with(a, b, lambda x, y: F.when(y == 255, 255).otherwise(x))


def combine(a: Column, b: Column, white: int = 255) -> Column:
    """a, with white where a is 0 and b isn't."""
    return F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y != 0), white).otherwise(x))


def intersect(a: Column, b: Column, zero: int = 0) -> Column:
    """a, with zero where b is 0."""
    return F.zip_with(a, b, lambda x, y: F.when(y == 0, zero).otherwise(x))


def intersect_levels(a: Column, b: Column, down: int = 20, up: int = 40) -> Column:
    """a, with 0 where b is more than down below it or up above it."""
    return F.zip_with(a, b, lambda x, y: F.when((x != 0) & ((y < x - down) | (y > x + up)), 0).otherwise(x))


def intersect_window(frames: DataFrame, n: int, key: str = "video_id", order: str = "timestamp", value: str = "v") -> DataFrame:
    """frames with common, the intersection of a frame's image with those of the n - 1 after it, and seen, how many these are."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, n - 1)
    images = F.collect_list(value).over(ahead)
    rows = frames.withColumn("images", images)
    common = F.aggregate(F.slice("images", 2, n), F.element_at("images", 1), lambda s, v: intersect(s, v))
    return rows.withColumn("common", common).withColumn("seen", F.size("images")).drop("images")


def moderate_threshold(v: Column, share: float) -> Column:
    """255 where v is at least share of its maximum (cut to an integer), else 0. An image of zeros becomes all 255."""
    limit = F.floor(F.array_max(v) * share)
    return F.transform(v, lambda x: F.when(x < limit, 0).otherwise(255))


def zero_below(v: Column, limit: int) -> Column:
    return F.transform(v, lambda x: F.when(x < limit, 0).otherwise(x))


def border_clear(v: Column, width: int, height: int, d: int = 1) -> Column:
    """Zeros in the outer d rows and columns."""
    inside = lambda i: (i % width >= d) & (i % width < width - d) & (F.floor(i / width) >= d) & (F.floor(i / width) < height - d)
    return F.transform(v, lambda x, i: F.when(inside(i), x).otherwise(0))


def on_images(f: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "array<int>") -> Callable[[Column], Column]:
    """f on images given as arrays by rows of width values."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(f(np.asarray(x).reshape(-1, width))).ravel().tolist() for x in v])

    return run


def dilated(im: np.ndarray, times: int = 1) -> np.ndarray:
    """255 within times steps (diagonal ones too) of what isn't 0."""
    for _ in range(times):
        p = np.pad(im != 0, 1)
        h, w = im.shape
        near = np.zeros((h, w), bool)
        for dy in range(3):
            for dx in range(3):
                near |= p[dy : dy + h, dx : dx + w]
        im = np.where(near, 255, im)
    return im


def _shifted(im: np.ndarray, r: int) -> dict[tuple[int, int], np.ndarray]:
    """The inner pixels' neighbours, by row and column."""
    h, w = im.shape
    im = im.astype(np.int64)
    span = range(-r, r + 1)
    return {(y, x): im[r + y : h - r + y, r + x : w - r + x] for y in span for x in span}


def _inner(im: np.ndarray, r: int, value: np.ndarray) -> np.ndarray:
    out = np.zeros(im.shape, np.int64)
    if min(im.shape) > 2 * r:
        out[r:-r, r:-r] = value
    return out


def sobel_max(im: np.ndarray) -> np.ndarray:
    """The greatest of the absolute gradients in four directions; 0 at the border."""
    n = _shifted(im, 1)
    falling, rising, down, across = n[-1, -1] - n[1, 1], n[-1, 1] - n[1, -1], n[-1, 0] - n[1, 0], n[0, -1] - n[0, 1]
    pairs = ((falling, rising, down), (falling, -rising, across), (down, across, falling), (down, -across, rising))
    return _inner(im, 1, np.max([np.abs(3 * (a + b) + 10 * c) for a, b, c in pairs], axis=0))


def sobel_diagonal(im: np.ndarray) -> np.ndarray:
    n = _shifted(im, 1)
    return _inner(im, 1, np.abs(3 * (n[-1, 0] + n[0, -1] - n[0, 1] - n[1, 0]) + 10 * (n[-1, -1] - n[1, 1])))


def sobel_vertical(im: np.ndarray) -> np.ndarray:
    n = _shifted(im, 1)
    return _inner(im, 1, np.abs(3 * (n[-1, -1] + n[-1, 1] - n[1, -1] - n[1, 1]) + 10 * (n[-1, 0] - n[1, 0])))


SMOOTH = ((2, 4, 5, 4, 2), (4, 10, 20, 10, 4), (5, 20, 40, 20, 5))
SPREAD = ((8, 5, 4, 5, 8), (5, 2, 1, 2, 5), (4, 1, 0, 1, 4))


def _weighted(im: np.ndarray, rows: tuple[tuple[int, ...], ...], by: int) -> np.ndarray:
    weights = rows + rows[1::-1]
    return _inner(im, 2, sum(weights[y + 2][x + 2] * v for (y, x), v in _shifted(im, 2).items()) // by)


def smoothed(im: np.ndarray) -> np.ndarray:
    """Weighted mean over 5 by 5; 0 in the outer two rows and columns."""
    return _weighted(im, SMOOTH, 220)


def spread(im: np.ndarray) -> np.ndarray:
    """Weighted mean of the 24 pixels around, 0 where the pixel is 0 and in the outer two rows and columns."""
    return np.where(im == 0, 0, _weighted(im, SPREAD, 100))


def component_labels(im: np.ndarray) -> np.ndarray:
    """1, 2, ... for the 8-connected components of what isn't 0, in the order of their first pixel by rows; 0 elsewhere.

    The least index spreads through each component until nothing changes.
    """
    h, w = im.shape
    far = h * w
    label = np.where(im != 0, np.arange(far).reshape(h, w), far)
    while True:
        p = np.pad(label, 1, constant_values=far)
        least = np.min([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        new = np.where(im != 0, least, far)
        # A pixel's label is a pixel itself: jump to its label.
        new = np.where(im != 0, np.append(new.ravel(), far)[new], far)
        if (new == label).all():
            break
        label = new
    names, index = np.unique(np.append(label.ravel(), far), return_inverse=True)
    return np.where(im != 0, index[:-1].reshape(h, w) + 1, 0)


def components(images: DataFrame, width: int) -> DataFrame:
    """img_id, component (from 1), pixels and the bounding box x0, y0, x1, y1 of images (img_id, v)."""
    rows = images.select("img_id", F.posexplode(on_images(component_labels, width)(F.col("v"))).alias("i", "component")).filter("component > 0")
    x, y = F.col("i") % width, F.floor(F.col("i") / width).cast("int")
    return rows.groupBy("img_id", "component").agg(F.count("*").alias("pixels"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def components_in_mask(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels (img_id, y, x, component) of the components with at least one pixel in mask (img_id, y, x)."""
    hit = labels.join(mask.select("img_id", "y", "x"), ["img_id", "y", "x"], "left_semi").select("img_id", "component").distinct()
    return labels.join(hit, ["img_id", "component"], "left_semi")


def small_symbols(parts: DataFrame, image_height: int, share: float, side: int) -> DataFrame:
    """Components too low or too narrow to be letters."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    return parts.filter((h < int(share * image_height)) | (w <= side) | (h <= side))


def row_bands(rows: DataFrame, pad: int = 12, least: int = 0) -> DataFrame:
    """img_id, lb, le: bands of consecutive rows (img_id, y), joined where fewer than 2 pad rows lie between, then padded.

    A band, with the padding above, must reach least rows to stay; the image's height bounds it below.
    """
    w = Window.partitionBy("img_id").orderBy("y")
    near = F.coalesce(F.col("y") - F.lag("y").over(w) - 1 >= 2 * pad, F.lit(True))
    band = rows.withColumn("band", F.sum(F.when(near, 1).otherwise(0)).over(w))
    b = band.groupBy("img_id", "band", "height").agg(F.greatest(F.min("y") - pad, F.lit(0)).alias("lb"), F.max("y").alias("last"))
    return b.filter(F.col("last") - F.col("lb") >= least).select("img_id", "lb", F.least(F.col("last") + pad, F.col("height") - 1).alias("le"))


def text_rows(bgr: np.ndarray, segment: int = 8, least: int = 800, together: int = 2) -> np.ndarray:
    """Rows in which so many neighbouring segments change colour by least or more in all."""
    h, w, _ = bgr.shape
    n = (w - 1) // segment
    change = np.abs(np.diff(bgr.astype(np.int64), axis=1)).sum(2)[:, : n * segment].reshape(h, n, segment).sum(2) >= least
    runs = np.ones((h, max(n - together + 1, 0)), bool)
    for k in range(together):
        runs &= change[:, k : k + runs.shape[1]]
    return np.flatnonzero(runs.any(axis=1))


def near_text_rows(pixels: DataFrame, reach: int) -> DataFrame:
    """Pixels (img_id, y, x, v, is_text) on rows within reach rows of a row with text, by a range window."""
    w = Window.partitionBy("img_id").orderBy("y").rangeBetween(-reach, reach)
    rows = pixels.groupBy("img_id", "y").agg(F.max(F.col("is_text").cast("int")).alias("any"))
    return pixels.join(rows.withColumn("near", F.max("any").over(w)).filter("near = 1").select("img_id", "y"), ["img_id", "y"], "left_semi")


def gray_small(pixels: DataFrame, factor: int = 8) -> DataFrame:
    """Every factor-th pixel (img_id, y, x, r, g, b) as grey v."""
    small = pixels.filter((F.pmod("y", F.lit(factor)) == 0) & (F.pmod("x", F.lit(factor)) == 0))
    return small.select("img_id", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x"), F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int").alias("v"))


def resized(im: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres at halves and the edge repeated."""
    h, w = im.shape[:2]

    def side(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, m - 1), at - lo

    y0, y1, fy = side(height, h)
    x0, x1, fx = side(width, w)
    fy, fx = (f.reshape(s + (1,) * (im.ndim - 2)) for f, s in ((fy, (-1, 1)), (fx, (1, -1))))
    im = im.astype(np.float64)
    top, bottom = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx, im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return top * (1 - fy) + bottom * fy


def resized_nearest(im: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = im.shape[:2]
    return im[np.minimum(np.arange(height) * h // height, h - 1)][:, np.minimum(np.arange(width) * w // width, w - 1)]


def channels_first(im: np.ndarray, mean: list[float], std: list[float]) -> np.ndarray:
    """(v / 255 - mean) / std, channels before rows."""
    return ((im / 255.0 - np.array(mean)) / np.array(std)).transpose(2, 0, 1)
