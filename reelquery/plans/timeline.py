"""Queries from frames to segments, and two timelines held against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators import align, merge, segments
from reelquery.plans.registry import registry
from reelquery.session import spool_to
from reelquery.sources.adapters import FRAMES_SQL, TIMELINES_SQL, frames, timelines

QUERIES, ORACLES, query = registry()
HEIGHT = 720.0

RUNS_SQL = f"""
{FRAMES_SQL},
marked AS (SELECT *, count(*) FILTER (WHERE text <> '') OVER (PARTITION BY video_id ORDER BY timestamp) AS texts FROM frames),
gaps AS (SELECT *, min(CASE WHEN text = '' THEN timestamp END) OVER (PARTITION BY video_id, texts) AS gap FROM marked),
said AS (SELECT *, lag(text) OVER w AS p, lag(gap) OVER w AS pg FROM gaps WHERE text <> '' WINDOW w AS (PARTITION BY video_id ORDER BY timestamp)),
runs AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> text OR coalesce(timestamp - pg > 1500, false) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY timestamp) - 1 AS seg_idx FROM said),
segs AS (SELECT video_id, seg_idx::BIGINT AS seg_idx, min_by(text, timestamp) AS text, min(timestamp) AS start_ms, max_by(coalesce(gap, timestamp), timestamp) AS end_ms,
         min_by(y0, timestamp) AS y0, min_by(y1, timestamp) AS y1, avg(text_confidence) AS text_confidence, count(*)::INT AS frame_count FROM runs GROUP BY ALL)"""


def _flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select("video_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", "start_ms", "end_ms", F.col("y_range")[0].alias("y0"), F.col("y_range")[1].alias("y1"), F.round("text_confidence", 9).alias("text_confidence"), "frame_count", *[F.round(c, 9).alias(c) for c in more])


SEGS = "video_id, seg_idx, text, start_ms, end_ms, y0, y1, round(text_confidence, 9) AS text_confidence, frame_count"


@query(f"WITH {RUNS_SQL} SELECT {SEGS} FROM segs")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(merge.runs(frames(spark, sf_dir)))


@query(f"WITH {RUNS_SQL} SELECT {SEGS} FROM segs")
def timeline_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(merge.flat(merge.fold_runs(frames(spark, sf_dir))))


@query(f"WITH {RUNS_SQL} SELECT video_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM segs GROUP BY video_id")
def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.full_text(merge.runs(frames(spark, sf_dir)))


# Without blank frames, as after the box filter, equal text goes on over any gap.
@query(
    f"""WITH {FRAMES_SQL}, said AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY timestamp) AS p FROM frames WHERE text <> ''),
runs AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> text THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY timestamp) - 1 AS seg_idx FROM said)
SELECT video_id, seg_idx::BIGINT AS seg_idx, min(text) AS text, min(timestamp) AS start_ms, max(timestamp) AS end_ms, min_by(y0, timestamp) AS y0, min_by(y1, timestamp) AS y1,
round(avg(text_confidence), 9) AS text_confidence, count(*)::INT AS frame_count FROM runs GROUP BY ALL"""
)
def timeline_without_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(merge.runs(frames(spark, sf_dir).filter("text <> ''")))


# Folds, as recursion over the segments of a video.
def _fold_sql(order: str, joins: str, text: str, start: str, end: str, y: str) -> str:
    return f"""
WITH RECURSIVE {RUNS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx {order}) AS r FROM segs),
f(video_id, r, g, text, s, e, y0, y1, conf, cnt) AS (
  SELECT video_id, r, 1::BIGINT, text, start_ms, end_ms, y0, y1, text_confidence, frame_count FROM n WHERE r = 1
  UNION ALL
  SELECT n.video_id, n.r, f.g + CASE WHEN {joins} THEN 0 ELSE 1 END,
    CASE WHEN {joins} THEN {text} ELSE n.text END, CASE WHEN {joins} THEN {start} ELSE n.start_ms END, CASE WHEN {joins} THEN {end} ELSE n.end_ms END,
    CASE WHEN {joins} THEN {y}.y0 ELSE n.y0 END, CASE WHEN {joins} THEN {y}.y1 ELSE n.y1 END,
    CASE WHEN {joins} THEN (f.conf + n.text_confidence) / 2 ELSE n.text_confidence END, CASE WHEN {joins} THEN f.cnt + n.frame_count ELSE n.frame_count END
  FROM f JOIN n ON f.video_id = n.video_id AND n.r = f.r + 1
), l AS (SELECT *, row_number() OVER (PARTITION BY video_id, g ORDER BY r DESC) AS last, max(g) OVER (PARTITION BY video_id) AS gs FROM f)
SELECT video_id, (CASE WHEN '{order}' = 'DESC' THEN gs - g ELSE g - 1 END)::BIGINT AS seg_idx, text, s AS start_ms, e AS end_ms, y0, y1, round(conf, 9) AS text_confidence, cnt AS frame_count FROM l WHERE last = 1"""


@query(_fold_sql("DESC", "(f.text = n.text AND f.s - n.end_ms <= 2000)", "n.text", "n.start_ms", "f.e", "n"))
def timeline_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = merge.fold_runs(frames(spark, sf_dir))
    return _flat(merge.flat(v.withColumn("segments", merge.merge_pauses(F.col("segments").cast(f"array<{merge.SEGMENT}>")))))


_NEAR = "(((f.s < n.end_ms AND n.start_ms < f.e) OR greatest(f.s, n.start_ms) - least(f.e, n.end_ms) <= 500) AND levenshtein(f.text, n.text) <= 5)"


@query(_fold_sql("ASC", _NEAR, "CASE WHEN length(f.text) >= length(n.text) THEN f.text ELSE n.text END", "least(f.s, n.start_ms)", "greatest(f.e, n.end_ms)", "f"))
def timeline_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = merge.fold_runs(frames(spark, sf_dir))
    return _flat(merge.flat(v.withColumn("segments", merge.dedup_overlaps(F.col("segments").cast(f"array<{merge.SEGMENT}>"), 5))))


@query()
def timeline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All merge passes; the cursor of the noise pass moves back, so the tests hold it against a plain loop."""
    return _flat(merge.flat(merge.merge_frames(frames(spark, sf_dir), substrings=True)))


ADJUSTED_SQL = f"""
{RUNS_SQL},
usual AS (SELECT video_id, avg(y0) AS t, avg(y1) AS b FROM frames WHERE text <> '' GROUP BY video_id),
near AS (SELECT s.*, (u.t + u.b) / 2 AS c,
  (SELECT min(abs(f.timestamp - (s.start_ms + s.end_ms) // 2)) FROM frames f WHERE f.video_id = s.video_id AND f.text <> '' AND f.timestamp <> (s.start_ms + s.end_ms) // 2) AS gap
  FROM segs s JOIN usual u USING (video_id)),
scored AS (SELECT *, least(abs((y0 + y1) / 2 - c) / ({HEIGHT} * 0.08), 1.0) AS yp, CASE WHEN frame_count <> 1 THEN 0.0 ELSE least(coalesce(gap / 1500, 1.0), 1.0) END AS ip FROM near),
adj AS (SELECT *, text_confidence * greatest(1 - (0.8 * yp + 0.2 * ip), 0.0) AS ac FROM scored)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    usual = f.filter("text <> ''").groupBy("video_id").agg(F.avg(F.col("y_range")[0]).alias("avg_top"), F.avg(F.col("y_range")[1]).alias("avg_bottom"))
    return segments.adjusted(merge.runs(f), f, usual, HEIGHT)


@query(f"WITH {ADJUSTED_SQL} SELECT {SEGS}, round(yp, 9) AS y_penalty, round(ip, 9) AS iso_penalty, round(ac, 9) AS adjusted_confidence FROM adj")
def segment_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_adjusted(spark, sf_dir), "y_penalty", "iso_penalty", "adjusted_confidence")


@query(f"WITH {ADJUSTED_SQL} SELECT video_id, seg_idx, text, round(ac, 9) AS adjusted_confidence FROM adj WHERE ac >= 0.3")
def segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.confident(_adjusted(spark, sf_dir), 0.3).select("video_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", F.round("adjusted_confidence", 9).alias("adjusted_confidence"))


@query(f"""WITH {ADJUSTED_SQL} SELECT video_id, count(*) FILTER (WHERE ac >= 0.3) AS segment_count, count(*) FILTER (WHERE ac < 0.3) AS dropped, 0.3::DOUBLE AS threshold,
coalesce(string_agg(text, ' ' ORDER BY seg_idx) FILTER (WHERE ac >= 0.3), '') AS text FROM adj GROUP BY video_id""")
def segment_filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.confident_summary(_adjusted(spark, sf_dir), 0.3)


CANDIDATES_SQL = f"""
{TIMELINES_SQL},
rel AS (SELECT g.video_id, g.idx AS gt_idx, h.idx AS hyp_idx, g.s AS gs, g.e AS ge, h.s AS hs, h.e AS he, g.text AS gt, h.text AS ht FROM ref g JOIN hyp h ON g.video_id = h.video_id
  AND CASE WHEN g.e <= g.s AND h.e <= h.s THEN g.s = h.s WHEN g.e <= g.s THEN g.s BETWEEN h.s AND h.e WHEN h.e <= h.s THEN h.s BETWEEN g.s AND g.e ELSE least(g.e, h.e) > greatest(g.s, h.s) END),
cand AS (SELECT *, CASE WHEN ge <= gs THEN 1 / (greatest(he - hs, 1) + 1.0) WHEN he <= hs THEN 1 / (greatest(ge - gs, 1) + 1.0)
  ELSE (least(ge, he) - greatest(gs, hs)) / ((ge - gs) + (he - hs) - (least(ge, he) - greatest(gs, hs))) END::DOUBLE AS iou FROM rel)"""


@query(f"WITH {CANDIDATES_SQL} SELECT video_id, gt_idx::INT AS gt_idx, hyp_idx::INT AS hyp_idx, round(iou, 12) AS iou FROM cand")
def align_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.candidates(*timelines(spark, sf_dir)).select("video_id", "gt_idx", "hyp_idx", F.round("iou", 12).alias("iou"))


MATCHED_SQL = f"""
{CANDIDATES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY iou DESC, gt_idx, hyp_idx) AS r FROM cand),
walk(video_id, r, ug, uh, take) AS (
  SELECT video_id, r, [gt_idx], [hyp_idx], true FROM ranked WHERE r = 1
  UNION ALL
  SELECT n.video_id, n.r, CASE WHEN list_contains(w.ug, n.gt_idx) OR list_contains(w.uh, n.hyp_idx) THEN w.ug ELSE list_append(w.ug, n.gt_idx) END,
    CASE WHEN list_contains(w.ug, n.gt_idx) OR list_contains(w.uh, n.hyp_idx) THEN w.uh ELSE list_append(w.uh, n.hyp_idx) END,
    NOT (list_contains(w.ug, n.gt_idx) OR list_contains(w.uh, n.hyp_idx))
  FROM walk w JOIN ranked n ON w.video_id = n.video_id AND n.r = w.r + 1
), matched AS (SELECT k.*, length(replace(replace(regexp_replace(regexp_replace(gt, '\\s', '', 'g'), '[0-9]+', '#', 'g'), '-', ''), '.', '')) AS w,
  levenshtein(replace(replace(regexp_replace(regexp_replace(gt, '\\s', '', 'g'), '[0-9]+', '#', 'g'), '-', ''), '.', ''), replace(replace(regexp_replace(regexp_replace(ht, '\\s', '', 'g'), '[0-9]+', '#', 'g'), '-', ''), '.', '')) AS lev
  FROM ranked k JOIN walk USING (video_id, r) WHERE take)"""


@query(f"WITH RECURSIVE {MATCHED_SQL} SELECT video_id, gt_idx::INT AS gt_idx, hyp_idx::INT AS hyp_idx, round(iou, 12) AS iou, hs - gs AS start_delta, he - ge AS end_delta, lev / greatest(w, 1) AS cer FROM matched")
def align_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.pairs(align.matched(align.candidates(*timelines(spark, sf_dir)), spool_to(spark))).withColumn("iou", F.round("iou", 12))


@query(f"""WITH RECURSIVE {MATCHED_SQL},
per AS (SELECT video_id, count(*) AS pairs, avg(iou) AS iou_mean, avg(hs - gs) AS sm, median(hs - gs) AS sd, quantile_disc(abs(hs - gs), 0.95) AS sp, avg(he - ge) AS em, median(he - ge) AS ed, quantile_disc(abs(he - ge), 0.95) AS ep FROM matched GROUP BY video_id),
base AS (SELECT r.video_id, count(*) AS refs, sum(CASE WHEN m.gt_idx IS NULL THEN 1.0 ELSE m.lev / greatest(m.w, 1) END * length(replace(replace(regexp_replace(regexp_replace(r.text, '\\s', '', 'g'), '[0-9]+', '#', 'g'), '-', ''), '.', '')))
  / sum(length(replace(replace(regexp_replace(regexp_replace(r.text, '\\s', '', 'g'), '[0-9]+', '#', 'g'), '-', ''), '.', ''))) AS cer FROM ref r LEFT JOIN matched m ON r.video_id = m.video_id AND r.idx = m.gt_idx GROUP BY r.video_id),
hy AS (SELECT video_id, count(*) AS hyps, count(*) FILTER (WHERE e <= s) AS zd FROM hyp GROUP BY video_id),
sp AS (SELECT video_id, sum(n - 1)::BIGINT AS split FROM (SELECT video_id, gt_idx, count(*) AS n FROM cand GROUP BY ALL) GROUP BY video_id),
mg AS (SELECT video_id, sum(n - 1)::BIGINT AS merged FROM (SELECT video_id, hyp_idx, count(*) AS n FROM cand GROUP BY ALL) GROUP BY video_id)
SELECT video_id, pairs, refs - pairs AS missed, round(iou_mean, 9) AS iou_mean, sm AS start_delta_mean, sd::DOUBLE AS start_delta_median, sp::DOUBLE AS start_delta_p95_abs, em AS end_delta_mean, ed::DOUBLE AS end_delta_median, ep::DOUBLE AS end_delta_p95_abs,
round(cer, 9) AS paired_cer, hyps - pairs AS spurious, zd AS zero_duration, split, merged FROM base JOIN per USING (video_id) JOIN hy USING (video_id) JOIN sp USING (video_id) JOIN mg USING (video_id)""".replace("sp::DOUBLE", "per.sp::DOUBLE"))
def align_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(*timelines(spark, sf_dir), spool_to(spark)).withColumns({"iou_mean": F.round("iou_mean", 9), "paired_cer": F.round("paired_cer", 9)})


@query(f"""WITH {TIMELINES_SQL}, a AS (SELECT video_id, string_agg(text, '' ORDER BY idx) AS r FROM ref GROUP BY 1), b AS (SELECT video_id, string_agg(text, '' ORDER BY idx) AS h FROM hyp GROUP BY 1)
SELECT video_id, levenshtein(r, h) / greatest(length(r), 1) AS raw,
levenshtein(regexp_replace(regexp_replace(r, '[\\s.-]', '', 'g'), '[0-9]+', '#', 'g'), regexp_replace(regexp_replace(h, '[\\s.-]', '', 'g'), '[0-9]+', '#', 'g')) / greatest(length(regexp_replace(regexp_replace(r, '[\\s.-]', '', 'g'), '[0-9]+', '#', 'g')), 1) AS norm,
length(h)::INT AS hyp_chars, length(r)::INT AS ref_chars FROM a JOIN b USING (video_id)""")
def timeline_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.text_error(*timelines(spark, sf_dir))
