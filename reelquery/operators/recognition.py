"""From an image to boxes with text, around three models that are given: where text is, whether a line is upside down, what it says."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.geometry import perspective
from reelquery.operators.decode import boxes_of
from reelquery.operators.pixels import channels_first, resized

HALF = [0.5, 0.5, 0.5]
LINE_HEIGHT, LINE_WIDTH, SHORTEST = 48, 320, 736


class Models(Protocol):
    """Arrays in, arrays out. detect: channels by rows to a score map. turned: a line to class probabilities. read: a line to logits, steps by classes."""

    def detect(self, image: np.ndarray) -> np.ndarray: ...

    def turned(self, line: np.ndarray) -> np.ndarray: ...

    def read(self, line: np.ndarray) -> np.ndarray: ...


def upright_crop(image: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """The pixels of the upright rectangle around a polygon; one black pixel if that is outside."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(np.maximum(polygon.min(0), 0)).astype(int)
    x1, y1 = np.ceil(np.minimum(polygon.max(0) + 1, (w, h))).astype(int)
    return image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else np.zeros((1, 1, *image.shape[2:]), image.dtype)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return np.where(t <= 1, near, np.where(t < 2, far, 0.0))


def warped_crop(image: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """The quadrilateral (corners from the top left on) drawn straight, bicubically, with the edge repeated; on its side if it is 1.5 times as high as wide."""
    side = [math.dist(polygon[i], polygon[(i + 1) % 4]) for i in range(4)]
    w, h = (max(4, int(max(a, b) + 0.5)) for a, b in ((side[0], side[2]), (side[3], side[1])))
    back = perspective(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float), polygon)
    ys, xs = np.mgrid[:h, :w]
    at = np.tensordot(back, np.stack([xs, ys, np.ones_like(xs)]), 1)
    x, y = at[0] / at[2], at[1] / at[2]
    fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
    total = np.zeros((h, w, *image.shape[2:]))
    lift = (..., *[None] * (image.ndim - 2))
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            pixel = image[np.clip(fy + dy, 0, image.shape[0] - 1), np.clip(fx + dx, 0, image.shape[1] - 1)]
            total += (_cubic(x - fx - dx) * _cubic(y - fy - dy))[lift] * pixel
    out = np.clip(np.round(total), 0, 255).astype(image.dtype)
    return np.rot90(out, -1).copy() if h / w >= 1.5 else out


def detector_input(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    ratio = SHORTEST / min(h, w) if min(h, w) < SHORTEST else 1.0
    th, tw = (max(int(s * ratio) // 32 * 32, 32) for s in (h, w))
    return channels_first(resized(image, th, tw), HALF, HALF)


def line_input(line: np.ndarray) -> np.ndarray:
    """Scaled to a height of 48, zeros to the right."""
    ratio = line.shape[1] / line.shape[0]
    width = int(LINE_HEIGHT * max(LINE_WIDTH / LINE_HEIGHT, ratio) + 0.5)
    own = max(1, min(math.ceil(LINE_HEIGHT * ratio), width))
    out = np.zeros((3, LINE_HEIGHT, width))
    out[:, :, :own] = channels_first(resized(line, LINE_HEIGHT, own), HALF, HALF)
    return out


def greedy_text(logits: np.ndarray, vocabulary: Sequence[str]) -> tuple[str, float]:
    """The same as decode.ctc_decode, of one line."""
    best = logits.argmax(axis=1)
    new = (best != 0) & (best != np.append(-1, best[:-1])) & (best < len(vocabulary))
    return "".join(vocabulary[i] for i in best[new]), float(logits.max(axis=1)[new].mean()) if new.any() else 0.0


def read_image(image: np.ndarray, models: Models, vocabulary: Sequence[str], straight: bool = True, lower: float = 0.0) -> list[dict]:
    """Boxes with text of an image of rows, columns, BGR. lower: share of the height above which nothing is looked for."""
    top = int(image.shape[0] * lower)
    part = image[top:]
    out = []
    for polygon, score in boxes_of(models.detect(detector_input(part)), *part.shape[:2]):
        corners = np.array(polygon)
        line = (warped_crop if straight else upright_crop)(part, corners)
        p = models.turned(line_input(line))
        if len(p) >= 2 and p[1] > 0.9:
            line = line[::-1, ::-1]
        text, confidence = greedy_text(models.read(line_input(line)), vocabulary)
        if text:
            corners = corners + (0, top)
            out.append(
                {
                    "text": text,
                    "text_confidence": confidence,
                    "box_confidence": score,
                    "bbox": corners.tolist(),
                    "x_range": [float(corners[:, 0].min()), float(corners[:, 0].max())],
                    "y_range": [float(corners[:, 1].min()), float(corners[:, 1].max())],
                    "center": corners.mean(0).tolist(),
                }
            )
    return out


def reader(load: Callable[[], Models], decode: Callable[[bytes], np.ndarray], vocabulary: Sequence[str], lower: float = 0.0) -> Callable[[], Callable[[bytes], list[dict]]]:
    """What decode.recognise takes: the models are loaded once a worker; decode makes an image of a file's bytes."""

    def start() -> Callable[[bytes], list[dict]]:
        models = load()
        return lambda content: read_image(decode(content), models, vocabulary, lower=lower)

    return start


def without_alpha(rgba: Column) -> Column:
    """Red, green, blue of an array of four values a pixel."""
    return F.filter(rgba, lambda v, i: i % 4 != 3)


def speed(frames: DataFrame, seconds_of_video: Column, milliseconds: Column) -> DataFrame:
    """A row a video: frames, seconds of reading, milliseconds a frame, and reading time by the video's time, of frames (video_id, ...)."""
    spent = F.sum(milliseconds)
    return frames.groupBy("video_id").agg(F.count("*").alias("frames"), (spent / 1000).alias("seconds"), (spent / F.count("*")).alias("ms_a_frame"), F.try_divide(spent / 1000, F.max(seconds_of_video)).alias("rate"))
