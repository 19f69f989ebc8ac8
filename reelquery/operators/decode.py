"""Model output: characters from class scores by step, and boxes from probability maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelquery.functions.geometry import corners, grown, tightest_rect
from reelquery.operators.pixels import component_labels
from reelquery.sources.adapters import BOX

MASK, SCORE, UNCLIP, MOST = 0.3, 0.6, 1.6, 1000


def ctc_decode(steps: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, text, confidence from steps (id, step, logits) and vocabulary (token_id, token).

    Of each step the highest class, the first of equals; class 0 is blank and separates equal
    classes; repeats without a blank between count once; classes outside the vocabulary are
    left out. confidence is the mean score of what is kept, 0 if that is nothing.
    """
    best = steps.select("id", "step", F.array_max("logits").alias("score"), (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("cls"))
    before = F.lag("cls").over(Window.partitionBy("id").orderBy("step"))
    kept = best.withColumn("kept", (F.col("cls") != 0) & (before.isNull() | (before != F.col("cls"))))
    named = kept.join(vocabulary.select(F.col("token_id").alias("cls"), "token"), "cls", "left")
    use = F.col("kept") & F.col("token").isNotNull()
    tokens = F.array_sort(F.collect_list(F.when(use, F.struct("step", "token"))))
    return named.groupBy("id").agg(F.array_join(F.transform(tokens, lambda t: t["token"]), "").alias("text"), F.coalesce(F.avg(F.when(use, F.col("score"))), F.lit(0.0)).alias("confidence"))


def needs_turn(p: Column) -> Column:
    """Whether the second class, upside down, has a probability over 0.9."""
    return F.coalesce((F.size(p) >= 2) & (F.get(p, F.lit(1)) > 0.9), F.lit(False))


def inside(polygon: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixels in or on a convex polygon with whole-number corners."""
    y, x = np.mgrid[:h, :w]
    turn = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(polygon, np.roll(polygon, -1, axis=0))]
    return np.all([t >= 0 for t in turn], axis=0) | np.all([t <= 0 for t in turn], axis=0)


def mean_inside(prob: np.ndarray, polygon: np.ndarray) -> float:
    h, w = prob.shape
    x0, y0 = np.clip(np.floor(polygon.min(0)).astype(int), 0, (w - 1, h - 1))
    x1, y1 = np.clip(np.ceil(polygon.max(0)).astype(int), 0, (w - 1, h - 1))
    moved = np.floor(polygon - (x0, y0) + 0.5)
    part = prob[y0 : y1 + 1, x0 : x1 + 1]
    mask = inside(moved, *part.shape)
    return float(part[mask].mean()) if mask.any() else 0.0


def boxes_of(scores: np.ndarray, height: int, width: int, least: float = SCORE) -> list[tuple[list[list[float]], float]]:
    """(corners, score) of the text boxes in a probability map, the best first and 1000 at most.

    Maps with a value over 1 are logits. Pixels over 0.3, widened by one to the right and
    below, make components; each component's tightest rectangle must have sides of at least 3
    and a mean of at least least, and is then grown by its area over its length. Corners are
    those of an image of the given size.
    """
    prob = 1 / (1 + np.exp(-scores)) if (scores > 1).any() else scores
    mask = prob > MASK
    wide = mask.copy()
    wide[1:] |= mask[:-1]
    wide[:, 1:] |= wide[:, :-1].copy()
    label = component_labels(wide.astype(int))
    out = []
    order = np.argsort(label.ravel(), kind="stable")
    each = np.split(order, np.flatnonzero(np.diff(label.ravel()[order])) + 1)
    for pixels in each:
        ys, xs = np.divmod(pixels, label.shape[1])
        if len(ys) < 3 or not label[ys[0], xs[0]]:
            continue
        box = corners(*tightest_rect(np.stack([xs, ys], axis=1).astype(float)))
        sides = [math.dist(box[0], box[1]), math.dist(box[1], box[2])]
        if min(sides) < 3:
            continue
        score = mean_inside(prob, box)
        if score < least:
            continue
        final = corners(*tightest_rect(grown(box, max(3.0, sides[0] * sides[1] * UNCLIP / (2 * sum(sides))))))
        if min(math.dist(final[0], final[1]), math.dist(final[1], final[2])) < 5:
            continue
        scaled = np.floor(final * (width / scores.shape[1], height / scores.shape[0]) + 0.5)
        out.append((np.clip(scaled, 0, (width - 1, height - 1)).tolist(), score))
    return sorted(out, key=lambda b: -b[1])[:MOST]


def text_boxes(maps: DataFrame) -> DataFrame:
    """img_id, box_idx, polygon, score from maps (img_id, map_height, map_width, scores, height, width)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                found = boxes_of(np.asarray(t.scores, float).reshape(t.map_height, t.map_width), t.height, t.width)
                rows += [(t.img_id, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["img_id", "box_idx", "polygon", "score"])

    cols = ("img_id", "map_height", "map_width", "scores", "height", "width")
    return maps.select(*cols).mapInPandas(run, "img_id bigint, box_idx int, polygon array<array<double>>, score double")


def score_histogram(maps: DataFrame) -> DataFrame:
    """img_id, bin (0 to 10, tenths), n of the values of scores."""
    return maps.select("img_id", F.explode("scores").alias("p")).groupBy("img_id", F.least(F.floor(F.col("p") * 10), F.lit(10)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recognise(images: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]], bottom_only: bool = False) -> DataFrame:
    """path, times, boxes of images (path, times, content). load gives the model; a worker loads it once.

    The model takes an image's bytes and gives boxes as dicts of the fields of a box; boxes with blank text are left out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            boxes = [[b for b in model(bytes(c)) if b["text"].strip()] for c in pdf["content"]]
            yield pdf[["path", "times"]].assign(boxes=boxes)

    return images.select("path", "times", "content").mapInPandas(run, f"path string, times array<bigint>, boxes array<{BOX}>")
