"""Statistics of where boxes usually are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_stats(boxes: DataFrame) -> DataFrame:
    """One row a video of the boxes whose text isn't blank: averages, medians and modes of top, bottom, height and centre x.

    A mode is the raw value where a rounded one (half away from zero) first reaches the highest
    count, in order of time and box, heights in order of themselves. The built-in mode()
    doesn't say which of equals it returns. Of the rounded values with the highest count,
    the first to reach it is the one whose last occurrence comes first. The boxes are read
    once, and counted by raw value before the shuffle; all else comes from the counts.
    """
    top, bottom, x = F.col("y_range")[0], F.col("y_range")[1], F.col("center")[0]
    none = F.lit(0.0)

    def fact(kind: str, u: Column, v: Column, first: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), u.alias("u"), v.alias("v"), F.struct(first.alias("first"), "timestamp", "box_idx").alias("at"))

    facts = F.explode(F.array(fact("place", top, bottom, none), fact("height", bottom - top, none, bottom - top), fact("x", x, none, none)))
    raw = boxes.filter(F.trim("text") != "").select("video_id", facts.alias("f")).groupBy("video_id", "f.kind", "f.u", "f.v").agg(F.count("*").alias("n"), F.max("f.at").alias("last"))
    share = [F.struct((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias("avg"), F.expr(f"percentile({c}, 0.5, n)").alias("median")).alias(c) for c in "uv"]
    usual = raw.groupBy("video_id", "kind").agg(*share)
    rounded = raw.groupBy("video_id", "kind", F.round("u").alias("ru"), F.round("v").alias("rv")).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max_by(F.struct("u", "v"), "last").alias("mode"))
    modes = rounded.groupBy("video_id", "kind").agg(F.min_by("mode", F.struct(-F.col("n"), F.col("last"))).alias("mode"))
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    places = (("top", "place", "u"), ("bottom", "place", "v"), ("height", "height", "u"), ("x", "x", "u"))
    return usual.join(modes, ["video_id", "kind"]).groupBy("video_id").agg(*[of(kind, F.col(path.format(c))).alias(f"{a}_{name}") for a, path in (("avg", "{}.avg"), ("median", "{}.median"), ("mode", "mode.{}")) for name, kind, c in places])


def merge_confidence(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b, F.lit(0.0))


def p95_abs(column: str) -> Column:
    """The value at 95 % of the sorted absolute values, never between two."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY abs({column}))").cast("double")
