"""Boxes: filters, suppression of covered boxes, frames from boxes, and scores of how usual a box's place is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.geometry import touches
from reelquery.sources.adapters import frames_of

BAND, BAND_WEIGHT, HEIGHT_WEIGHT, TEXT_WEIGHT, BOX_WEIGHT, OUTLIER = 0.05, 0.8, 0.3, 0.3, 0.7, 0.5


def readable(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes with text that isn't blank and a text confidence of at least threshold."""
    return boxes.filter((F.trim("text") != "") & (F.col("text_confidence") >= threshold))


def in_subtitle_band(boxes: DataFrame, height: float, low: float = 0.85, high: float = 0.99) -> DataFrame:
    return boxes.filter((F.col("center")[1] / height).between(low, high))


def suppressed(boxes: Column, share: float = 0.7) -> Column:
    """The boxes of a frame without those that a kept larger box covers by more than share of them, by centre y.

    A box that is itself suppressed doesn't suppress, so this is a fold over the boxes from the
    largest to the smallest. Equal areas keep their order.
    """

    def low(b: Column, axis: int) -> Column:
        return F.array_min(F.transform(b["bbox"], lambda p: p[axis]))

    def high(b: Column, axis: int) -> Column:
        return F.array_max(F.transform(b["bbox"], lambda p: p[axis]))

    def measured(b: Column, i: Column) -> Column:
        x0, y0, x1, y1 = low(b, 0), low(b, 1), high(b, 0), high(b, 1)
        area = F.greatest(x1 - x0, F.lit(1.0)) * F.greatest(y1 - y0, F.lit(1.0))
        return F.struct((-area).alias("order"), i.alias("i"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), b.alias("box"))

    rects = F.array_sort(F.transform(boxes, measured), lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(F.signum(a["i"] - b["i"]).cast("int")))

    def step(kept: Column, r: Column) -> Column:
        def covers(k: Column) -> Column:
            w, h = F.least(k["x1"], r["x1"]) - F.greatest(k["x0"], r["x0"]), F.least(k["y1"], r["y1"]) - F.greatest(k["y0"], r["y0"])
            return (w > 0) & (h > 0) & (w * h / -r["order"] > share)

        return F.when(F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate(rects, F.slice(rects, 1, 0), step)
    in_order = F.array_sort(F.transform(kept, lambda r: F.struct((r["box"]["center"][1] * 1000).cast("bigint").alias("y"), r["i"].alias("i"), r["box"].alias("box"))), lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).otherwise(F.signum(a["i"] - b["i"]).cast("int")))
    return F.transform(in_order, lambda r: r["box"])


def reading_order(boxes: Column, row: float = 20.0) -> Column:
    """Boxes by rows of row pixels of their centre, then by the x of the first corner.

    Rows are bands of fixed height: comparing pairs ("same row if the centres are at most 20
    apart") isn't transitive and so defines no order.
    """
    keyed = F.transform(boxes, lambda b, i: F.struct(F.floor(b["center"][1] / row).alias("row"), b["bbox"][0][0].alias("x"), i.alias("i"), b.alias("box")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["row"] != b["row"], F.signum(a["row"] - b["row"]).cast("int")).when(a["x"] != b["x"], F.signum(a["x"] - b["x"]).cast("int")).otherwise(F.signum(a["i"] - b["i"]).cast("int"))), lambda r: r["box"])


def frame_fields(boxes: Column) -> list[Column]:
    """text, text_confidence, x_range, y_range of a frame with these boxes, in their order.

    Texts are joined by spaces if any two boxes share a line, else by newlines. No boxes: '', 0 and [0, 0].
    """
    pairs = F.exists(F.transform(boxes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda p: F.exists(F.slice(boxes, p["i"] + 2, F.size(boxes)), lambda q: touches(p["b"]["y_range"], q["y_range"])))
    texts = F.transform(boxes, lambda b: b["text"])
    n = F.size(boxes)
    mean = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + b["text_confidence"]) / n
    points = F.flatten(F.transform(boxes, lambda b: b["bbox"]))
    zero = F.array(F.lit(0.0), F.lit(0.0))

    def around(axis: int) -> Column:
        values = F.transform(points, lambda p: p[axis])
        return F.when(n == 0, zero).otherwise(F.array(F.array_min(values), F.array_max(values)))

    return [
        F.when(pairs, F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n")).alias("text"),
        F.when(n == 0, F.lit(0.0)).otherwise(mean).alias("text_confidence"),
        around(0).alias("x_range"),
        around(1).alias("y_range"),
    ]


def aggregate_boxes(frames: DataFrame) -> DataFrame:
    """Frames (video_id, timestamp, boxes) with their text, confidence and ranges."""
    return frames.select("video_id", "timestamp", *frame_fields(F.col("boxes")), "boxes")


def _saturated(raw: Column) -> Column:
    return F.greatest(raw, F.lit(0.0)) / (F.greatest(raw, F.lit(0.0)) + 1.0)


def adjusted(boxes: DataFrame, stats: DataFrame, threshold: float = OUTLIER) -> DataFrame:
    """boxes with how far each is from its video's usual place and height, and the confidence less the penalty for it.

    stats is the result of box_stats, a row a video: small, and broadcast where the planner
    finds it small enough. Boxes with blank text have zeros, and are no outliers.
    """
    s = stats.select(F.col("video_id").alias("v"), F.col("median_height").alias("mh"), ((F.col("mode_top") + F.col("mode_bottom")) / 2).alias("my"), F.col("mode_x").alias("mx"))
    b = boxes.join(s, F.col("video_id") == F.col("v"), "left").drop("v")
    blank = F.trim("text") == ""
    tall = F.coalesce(F.col("mh"), F.lit(0.0)) > 0
    zero = F.lit(0.0)

    def part(value: Column) -> Column:
        return F.when(blank | ~tall, zero).otherwise(value)

    b = b.withColumn("height", F.when(blank, zero).otherwise(F.col("y_range")[1] - F.col("y_range")[0]))
    b = b.withColumns(
        {
            "height_ratio": part(F.col("height") / F.col("mh")),
            "y_center_offset_ratio": part((F.col("center")[1] - F.col("my")) / F.col("mh")),
            "x_center_offset_ratio": part((F.col("center")[0] - F.col("mx")) / F.col("mh")),
        }
    )
    y, x = (F.greatest(F.abs(f"{a}_center_offset_ratio") - BAND, zero) * BAND_WEIGHT for a in "yx")
    h = F.when(F.col("height_ratio") > 0, F.abs(F.log2("height_ratio")) * HEIGHT_WEIGHT).otherwise(F.lit(1.0))
    clear = lambda c: F.when(blank, zero).otherwise(c)
    b = b.withColumns({"y_penalty": clear(_saturated(y)), "x_penalty": clear(_saturated(x)), "height_penalty": clear(_saturated(h)), "total_penalty": clear(_saturated(y + x + h))})
    score = (F.col("text_confidence") * TEXT_WEIGHT + F.col("box_confidence") * BOX_WEIGHT) * (1 - F.col("total_penalty"))
    b = b.withColumn("adjusted_confidence", F.when(blank, F.col("box_confidence")).otherwise(score))
    return b.withColumn("is_outlier", ~blank & (F.col("adjusted_confidence") < threshold)).drop("mh", "my", "mx")


def filtered_frames(adjusted_boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of the boxes that aren't outliers; a frame without such boxes is gone. Time stays.

    frames has text, text_confidence, x_range and y_range of each frame: one without outliers
    keeps them, and of one with some they are made from the boxes that are left.
    """
    fields = ("text", "text_confidence", "x_range", "y_range")
    left = frames_of(adjusted_boxes, ~F.col("is_outlier"), F.max("is_outlier").alias("touched")).filter(F.size("boxes") > 0)
    given = frames.select("video_id", "timestamp", F.struct(*fields).alias("given"))
    rows = left.select("video_id", "timestamp", *frame_fields(F.col("boxes")), "boxes", "touched").join(given, ["video_id", "timestamp"], "left")
    whole = ~F.col("touched") & F.col("given").isNotNull()
    return rows.select("video_id", "timestamp", *[F.when(whole, F.col(f"given.{c}")).otherwise(F.col(c)).alias(c) for c in fields], "boxes")


def expand_times(frames: DataFrame) -> DataFrame:
    """Frames read from images, with times [], [t] or [start, end]: a row for each time, and time 0 without any."""
    return frames.withColumn("timestamp", F.explode(F.when(F.size("times") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("times")))).drop("times")
