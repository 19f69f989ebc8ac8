"""Queries over boxes and their geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.functions import geometry as geo
from reelquery.operators import boxes as ops
from reelquery.operators.stats import box_stats as stats_of
from reelquery.plans.registry import registry
from reelquery.sources.adapters import BOXES_SQL, boxes, frames_of, table

QUERIES, ORACLES, query = registry()

STATS_SQL = f"""
{BOXES_SQL},
t AS (SELECT *, y1 - y0 AS h FROM boxes WHERE trim(text) <> ''),
plain AS (SELECT video_id, avg(y0) AS avg_top, avg(y1) AS avg_bottom, avg(h) AS avg_height, avg(cx) AS avg_x, median(y0) AS median_top, median(y1) AS median_bottom, median(h) AS median_height, median(cx) AS median_x FROM t GROUP BY video_id),
place AS (SELECT video_id, y0 AS mode_top, y1 AS mode_bottom FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(y0), round(y1) ORDER BY timestamp, box_idx) AS nth FROM t)
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY nth DESC, timestamp, box_idx) = 1),
tall AS (SELECT video_id, h AS mode_height FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(h) ORDER BY h, timestamp, box_idx) AS nth FROM t)
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY nth DESC, h, timestamp, box_idx) = 1),
across AS (SELECT video_id, cx AS mode_x FROM (SELECT *, row_number() OVER (PARTITION BY video_id, round(cx) ORDER BY timestamp, box_idx) AS nth FROM t)
  QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY nth DESC, timestamp, box_idx) = 1),
stats AS (SELECT * FROM plain JOIN place USING (video_id) JOIN tall USING (video_id) JOIN across USING (video_id))"""


@query(f"WITH {STATS_SQL} SELECT video_id, " + ", ".join(f"round({a}_{b}, 9) AS {a}_{b}" for a in ("avg", "median", "mode") for b in ("top", "bottom", "height", "x")) + " FROM stats")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_of(boxes(spark, sf_dir)).select("video_id", *[F.round(f"{a}_{b}", 9).alias(f"{a}_{b}") for a in ("avg", "median", "mode") for b in ("top", "bottom", "height", "x")])


_sat = "({0}) / (({0}) + 1)"
_Y, _X = "greatest(abs(yo) - 0.05, 0) * 0.8", "greatest(abs(xo) - 0.05, 0) * 0.8"
_H = "CASE WHEN hr > 0 THEN abs(log2(hr)) * 0.3 ELSE 1.0 END"
ADJUSTED_SQL = f"""
{STATS_SQL},
off AS (SELECT b.*, trim(text) = '' AS blank, (y1 - y0) / median_height AS hr, (cy - (mode_top + mode_bottom) / 2) / median_height AS yo, (cx - mode_x) / median_height AS xo FROM boxes b JOIN stats USING (video_id)),
pen AS (SELECT *, {_sat.format(_Y)} AS yp, {_sat.format(_X)} AS xp, {_sat.format(_H)} AS hp, {_sat.format(f"{_Y} + {_X} + {_H}")} AS tp FROM off),
adj AS (SELECT *, CASE WHEN blank THEN box_confidence ELSE (text_confidence * 0.3 + box_confidence * 0.7) * (1 - tp) END AS ac FROM pen)"""


@query(f"WITH {ADJUSTED_SQL} SELECT video_id, timestamp, box_idx, " + ", ".join(f"CASE WHEN blank THEN 0.0 ELSE round({a}, 6) END::DOUBLE AS {b}" for a, b in (("y1 - y0", "height"), ("hr", "height_ratio"), ("yo", "y_center_offset_ratio"), ("xo", "x_center_offset_ratio"), ("yp", "y_penalty"), ("xp", "x_penalty"), ("hp", "height_penalty"), ("tp", "total_penalty"))) + ", round(ac, 6) AS adjusted_confidence, NOT blank AND ac < 0.5 AS is_outlier FROM adj")
def box_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    a = ops.adjusted(b, stats_of(b))
    names = ("height", "height_ratio", "y_center_offset_ratio", "x_center_offset_ratio", "y_penalty", "x_penalty", "height_penalty", "total_penalty", "adjusted_confidence")
    return a.select("video_id", "timestamp", "box_idx", *[F.round(c, 6).alias(c) for c in names], "is_outlier")


def _frames_sql(where: str) -> str:
    return f"""agg AS (SELECT video_id, timestamp, list(struct_pack(a := y0, b := y1) ORDER BY box_idx) AS ys, string_agg(text, ' ' ORDER BY box_idx) AS spaced, string_agg(text, chr(10) ORDER BY box_idx) AS lines,
  avg(text_confidence) AS text_confidence, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*)::INT AS n FROM {where} GROUP BY ALL)
SELECT video_id, timestamp, CASE WHEN len(list_filter(range(1, n + 1), lambda i: len(list_filter(range(i + 1, n + 1), lambda j: ys[i].b >= ys[j].a AND ys[j].b >= ys[i].a)) > 0)) > 0 THEN spaced ELSE lines END AS text,
  round(text_confidence, 9) AS text_confidence, x0, x1, y0, y1, n FROM agg"""


def _frames(df: DataFrame) -> DataFrame:
    return df.select("video_id", "timestamp", "text", F.round("text_confidence", 9).alias("text_confidence"), F.col("x_range")[0].alias("x0"), F.col("x_range")[1].alias("x1"), F.col("y_range")[0].alias("y0"), F.col("y_range")[1].alias("y1"), F.size("boxes").alias("n"))


@query(f"WITH {BOXES_SQL}, {_frames_sql('boxes')}")
def frame_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(ops.aggregate_boxes(frames_of(boxes(spark, sf_dir))))


# Frames without outliers keep what they were read with, here a made-up text, confidence and place.
@query(f"""WITH {ADJUSTED_SQL}, flags AS (SELECT video_id, timestamp, bool_or(NOT blank AND ac < 0.5) AS touched FROM adj GROUP BY ALL),
rebuilt AS (WITH {_frames_sql('(SELECT * FROM adj WHERE blank OR ac >= 0.5)')})
SELECT video_id, timestamp, CASE WHEN touched THEN text ELSE 'frame ' || timestamp END AS text, CASE WHEN touched THEN text_confidence ELSE 0.25 END AS text_confidence,
  CASE WHEN touched THEN x0 ELSE 0 END AS x0, CASE WHEN touched THEN x1 ELSE 1280 END AS x1, CASE WHEN touched THEN y0 ELSE 600 END AS y0, CASE WHEN touched THEN y1 ELSE 720 END AS y1, n
FROM rebuilt JOIN flags USING (video_id, timestamp)""")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    place = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    k = F.col("l_orderkey")
    read = table(spark, sf_dir, "lineitem").select((k % 20).alias("video_id"), (k * 500).alias("timestamp")).distinct()
    read = read.select("*", F.concat(F.lit("frame "), F.col("timestamp").cast("string")).alias("text"), F.lit(0.25).alias("text_confidence"), place(0, 1280).alias("x_range"), place(600, 720).alias("y_range"))
    # There are 20 videos, so the boxes needn't move to their statistics.
    return _frames(ops.filtered_frames(ops.adjusted(b, F.broadcast(stats_of(b))), read))


@query(f"WITH {BOXES_SQL} SELECT video_id, timestamp, box_idx, text, text_confidence FROM boxes WHERE trim(text) <> '' AND text_confidence >= 0.8 AND cy / 720 BETWEEN 0.85 AND 0.99")
def box_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.in_subtitle_band(ops.readable(boxes(spark, sf_dir), 0.8), 720).select("video_id", "timestamp", "box_idx", "text", "text_confidence")


@query(
    f"""WITH RECURSIVE {BOXES_SQL},
rects AS (SELECT *, greatest(x1 - x0, 1) * greatest(y1 - y0, 1) AS area FROM boxes),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, timestamp ORDER BY area DESC, box_idx) AS r FROM rects),
f(video_id, timestamp, r, kept) AS (
  SELECT video_id, timestamp, r, [struct_pack(i := box_idx, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] FROM n WHERE r = 1
  UNION ALL
  SELECT n.video_id, n.timestamp, n.r, CASE WHEN len(list_filter(f.kept, lambda k: least(k.x1, n.x1) > greatest(k.x0, n.x0) AND least(k.y1, n.y1) > greatest(k.y0, n.y0)
      AND (least(k.x1, n.x1) - greatest(k.x0, n.x0)) * (least(k.y1, n.y1) - greatest(k.y0, n.y0)) / n.area > 0.7)) > 0 THEN f.kept
    ELSE list_append(f.kept, struct_pack(i := n.box_idx, x0 := n.x0, y0 := n.y0, x1 := n.x1, y1 := n.y1)) END
  FROM f JOIN n USING (video_id, timestamp) WHERE n.r = f.r + 1
), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_id, timestamp ORDER BY r DESC) = 1),
k AS (SELECT video_id, timestamp, unnest(list_transform(kept, lambda b: b.i)) AS box_idx FROM l)
SELECT k.video_id, k.timestamp, (row_number() OVER (PARTITION BY k.video_id, k.timestamp ORDER BY (b.cy * 1000)::BIGINT, k.box_idx) - 1)::INT AS pos, b.text, b.x0, b.y0 FROM k JOIN boxes b USING (video_id, timestamp, box_idx)"""
)
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames_of(boxes(spark, sf_dir)).select("video_id", "timestamp", F.posexplode(ops.suppressed(F.col("boxes"))).alias("pos", "b"))
    return f.select("video_id", "timestamp", "pos", "b.text", F.col("b.x_range")[0].alias("x0"), F.col("b.y_range")[0].alias("y0"))


@query(f"WITH {BOXES_SQL} SELECT video_id, timestamp, (row_number() OVER (PARTITION BY video_id, timestamp ORDER BY floor(cy / 20), x0, box_idx) - 1)::INT AS pos, text, x0, y0 FROM boxes")
def box_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames_of(boxes(spark, sf_dir)).select("video_id", "timestamp", F.posexplode(ops.reading_order(F.col("boxes"))).alias("pos", "b"))
    return f.select("video_id", "timestamp", "pos", "b.text", F.col("b.x_range")[0].alias("x0"), F.col("b.y_range")[0].alias("y0"))


@query(f"""WITH {BOXES_SQL} SELECT timestamp, box_idx, x0, x1, y0, y1, cx, (y0 + y1) / 2 AS cy, width * height AS area, 2 * (width + height) AS perimeter, y0 + 432 AS shifted_y0, (y0 + y1) / 2 + 432 AS shifted_cy FROM boxes""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    p, moved = F.col("bbox"), geo.shift_y(F.struct(*[F.col(c) for c in ("bbox", "center", "y_range")]), geo.region_offset(F.lit(720)))
    x, y, c = geo.points_range(p, 0), geo.points_range(p, 1), geo.points_center(p)
    return b.select("timestamp", "box_idx", x[0].alias("x0"), x[1].alias("x1"), y[0].alias("y0"), y[1].alias("y1"), c[0].alias("cx"), c[1].alias("cy"), geo.polygon_area(p).alias("area"), geo.polygon_length(p).alias("perimeter"), moved["y_range"][0].alias("shifted_y0"), moved["center"][1].alias("shifted_cy"))


# The tightest rectangle of a box that stands upright is the box.
@query(f"WITH {BOXES_SQL} SELECT timestamp, box_idx, cx, (y0 + y1) / 2 AS cy, width, height, x0 - 5.0 / sqrt(2) AS grown_x0, 4 AS hull_size FROM boxes WHERE timestamp < 1000000".replace("x0 - 5.0 / sqrt(2)", "round(x0 - 5.0 / sqrt(2), 6)"))
def box_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).filter("timestamp < 1000000")
    r = geo.min_area_rect(F.col("bbox"))
    b = b.select("timestamp", "box_idx", r.alias("r"), geo.offset_polygon(F.col("bbox"), 5.0).alias("g"), F.size(geo.convex_hull(F.col("bbox"))).alias("hull_size"))
    return b.select("timestamp", "box_idx", *[F.round(F.col("r")[i], 6).alias(n) for i, n in enumerate(("cx", "cy", "width", "height"))], F.round(geo.points_range(F.col("g"), 0)[0], 6).alias("grown_x0"), "hull_size")


@query("""WITH s AS (SELECT p_partkey, 200 + p_partkey % 2000 AS w, 100 + p_size * 30 AS h FROM part)
SELECT p_partkey, greatest((floor(floor(w * CASE WHEN least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) ELSE 1.0 END) / 32) * 32)::INT, 32) AS dw, greatest((floor(floor(h * CASE WHEN least(w, h) < 736 THEN 736.0::DOUBLE / least(w, h) ELSE 1.0 END) / 32) * 32)::INT, 32) AS dh,
round(48 * greatest(320.0::DOUBLE / 48, w::DOUBLE / h))::INT AS img_w, greatest(least(ceil(48 * (w::DOUBLE / h))::INT, round(48 * greatest(320.0::DOUBLE / 48, w::DOUBLE / h))::INT), 1) AS resized_w, floor(h * 0.6)::INT AS roi,
CASE WHEN least(100, w - least(p_size * 40, w)) <= 0 OR least(50, h - least(p_size * 40, h)) <= 0 THEN w ELSE least(100, w - least(p_size * 40, w)) END::INT AS crop_w FROM s JOIN part USING (p_partkey)""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (200 + F.col("p_partkey") % 2000).cast("int"), (100 + F.col("p_size") * 30).cast("int")
    d, r = geo.detector_size(w, h), geo.recognizer_width(w, h)
    at = (F.col("p_size") * 40).cast("int")
    crop = geo.clamped_crop(at, at, F.lit(100), F.lit(50), w, h)
    return table(spark, sf_dir, "part").select("p_partkey", d["w"].alias("dw"), d["h"].alias("dh"), r["img_w"].alias("img_w"), r["resized_w"].alias("resized_w"), geo.region_offset(h).alias("roi"), crop["w"].alias("crop_w"))
