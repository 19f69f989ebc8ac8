"""Segments: confidence less the penalties for odd places and isolation, and the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Y_FACTOR, ISO_MS, Y_WEIGHT, ISO_WEIGHT = 0.08, 1500, 0.8, 0.2


def nearest_gap(points: DataFrame, times: DataFrame) -> DataFrame:
    """points (video_id, mid, ...) with gap, the time to the nearest of times (video_id, timestamp) that isn't mid itself; null if there is none.

    An as-of join both ways by one sort: points, with all they have, and times are put on one
    axis, and the last time before and the first after are carried along.
    """
    point = F.struct(*points.columns)
    none = F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType)
    both = points.select("video_id", F.col("mid").alias("at"), point.alias("p"), F.lit(None).cast("bigint").alias("t")).unionByName(
        times.select("video_id", F.col("timestamp").alias("at"), none.alias("p"), F.col("timestamp").alias("t"))
    )
    w = Window.partitionBy("video_id").orderBy("at")
    # Ranges, not rows: a time equal to mid is on neither side.
    before = F.max("t").over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("t").over(w.rangeBetween(1, Window.unboundedFollowing))
    return both.select("p", F.least(F.col("at") - before, after - F.col("at")).alias("gap")).filter(F.col("p").isNotNull()).select("p.*", "gap")


def non_empty(frames: DataFrame) -> DataFrame:
    zero = F.array(F.lit(0.0), F.lit(0.0))
    return frames.filter((F.col("text") != "") & (F.col("x_range") != zero) & (F.col("y_range") != zero))


def adjusted(segments: DataFrame, frames: DataFrame, stats: DataFrame, video_height: float) -> DataFrame:
    """segments (video_id, seg_idx, ...) with y_penalty, iso_penalty and adjusted_confidence.

    stats has avg_top and avg_bottom a video; without them, or with zeros, and for segments
    without frame_count, all three are null. Nothing is rounded.
    """
    # All segments take part, not only those of one frame, so that none has to be found again by a join.
    gaps = nearest_gap(segments.withColumn("mid", F.expr("(start_ms + end_ms) div 2")), non_empty(frames).select("video_id", "timestamp"))
    s = stats.select("video_id", ((F.col("avg_top") + F.col("avg_bottom")) / 2).alias("usual"), (F.coalesce((F.col("avg_top") != 0) | (F.col("avg_bottom") != 0), F.lit(False))).alias("known"))
    rows = gaps.join(s, "video_id", "left")
    given = F.coalesce("known", F.lit(False)) & F.col("frame_count").isNotNull()
    scale = video_height * Y_FACTOR
    off = F.abs((F.col("y_range")[0] + F.col("y_range")[1]) / 2 - F.col("usual"))
    y = F.when(F.col("y_range").isNull() | F.lit(scale <= 0), F.lit(0.0)).otherwise(F.least(off / (scale or 1.0), F.lit(1.0)))
    iso = F.when(F.col("frame_count") != 1, F.lit(0.0)).otherwise(F.least(F.coalesce(F.col("gap") / ISO_MS, F.lit(1.0)), F.lit(1.0)))
    rows = rows.withColumn("y_penalty", F.when(given, y)).withColumn("iso_penalty", F.when(given, iso))
    score = F.col("text_confidence") * F.greatest(1 - (Y_WEIGHT * F.col("y_penalty") + ISO_WEIGHT * F.col("iso_penalty")), F.lit(0.0))
    return rows.withColumn("adjusted_confidence", F.when(given, score)).drop("usual", "known", "gap", "mid")


def confident(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Segments whose adjusted confidence, or else text confidence, is at least threshold; all if that is 0 or less."""
    return segments if threshold <= 0 else segments.filter(F.coalesce("adjusted_confidence", "text_confidence") >= threshold)


def confident_summary(segments: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row a video: segment_count and text of what stays, dropped and threshold."""
    stays = F.lit(True) if threshold <= 0 else F.coalesce("adjusted_confidence", "text_confidence") >= threshold
    kept = F.array_sort(F.collect_list(F.when(stays, F.struct("seg_idx", "text"))))
    return segments.groupBy("video_id").agg(
        F.count_if(stays).alias("segment_count"),
        (F.count("*") - F.count_if(stays)).alias("dropped"),
        F.lit(float(threshold)).alias("threshold"),
        F.array_join(F.transform(kept, lambda r: r["text"]), " ").alias("text"),
    )
