"""Two timelines held against each other: interval join, one-to-one matching, character error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.functions.text import character_error_rate, edit_distance_long, normalize_for_cer
from reelquery.operators.stats import p95_abs

#: Width of the time buckets of the interval join. A segment is in as many buckets as it touches.
BUCKET_MS = 10_000


def _clip(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def related(gs: Column, ge: Column, hs: Column, he: Column) -> Column:
    """Whether two intervals have time in common; one without length is a point of the other's closed interval."""
    g0, h0 = ge <= gs, he <= hs
    return (
        F.when(g0 & h0, gs == hs)
        .when(g0, (gs >= hs) & (gs <= he))
        .when(h0, (hs >= gs) & (hs <= ge))
        .otherwise(F.least(ge, he) > F.greatest(gs, hs))
    )


def temporal_iou(gs: Column, ge: Column, hs: Column, he: Column) -> Column:
    """Common time by all time; for a related interval without length, 1 by the other's milliseconds and one."""
    inter = _clip(F.least(ge, he) - F.greatest(gs, hs))
    union = _clip(ge - gs) + _clip(he - hs) - inter
    other = F.when(ge <= gs, _clip(he - hs)).otherwise(_clip(ge - gs))
    point = F.when(related(gs, ge, hs, he), 1 / (F.greatest(other, F.lit(1)) + 1.0)).otherwise(F.lit(0.0))
    return F.when((ge <= gs) | (he <= hs), point).when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def candidates(ref: DataFrame, hyp: DataFrame, bucket: int = BUCKET_MS) -> DataFrame:
    """All related pairs of a video, with iou. Equi-joined on video and time bucket; a pair comes from the first bucket both touch."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        last = F.greatest(F.col("start"), F.col("end"))
        out = df.select("video_id", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.floor(last / bucket))).alias("slot"), *[F.col(c).alias(f"{p}_{c}") for c in ("idx", "text", "start", "end")])
        return out

    g, h = dealt(ref, "gt"), dealt(hyp, "hyp")
    times = [F.col(c) for c in ("gt_start", "gt_end", "hyp_start", "hyp_end")]
    first = F.floor(F.greatest("gt_start", "hyp_start") / bucket)
    return g.join(h, ["video_id", "slot"]).filter(related(*times) & (F.col("slot") == first)).withColumn("iou", temporal_iou(*times)).drop("slot")


def matched(cands: DataFrame, spool) -> DataFrame:
    """The greedy one-to-one matching by iou; ties: the earlier reference, then hypothesis.

    A pair that is the best of both its ends is in the greedy matching; take all such pairs,
    drop what they rule out, and repeat. Rounds are as many as the longest chain of better
    neighbours, a few in practice. spool(df) cuts the lineage between rounds.
    """
    rank = F.struct(F.col("iou"), -F.col("gt_idx"), -F.col("hyp_idx"))
    left, out = spool(cands), None
    while True:
        ranked = left.withColumn("rank", rank)
        g = ranked.groupBy("video_id", "gt_idx").agg(F.max("rank").alias("best_g"))
        h = ranked.groupBy("video_id", "hyp_idx").agg(F.max("rank").alias("best_h"))
        now = spool(ranked.join(g, ["video_id", "gt_idx"]).join(h, ["video_id", "hyp_idx"]).filter((F.col("rank") == F.col("best_g")) & (F.col("rank") == F.col("best_h"))).select(*cands.columns))
        if now.isEmpty():
            return now if out is None else out
        out = now if out is None else out.unionByName(now)
        left = spool(left.join(now.select("video_id", "gt_idx"), ["video_id", "gt_idx"], "left_anti").join(now.select("video_id", "hyp_idx"), ["video_id", "hyp_idx"], "left_anti"))


def pairs(match: DataFrame) -> DataFrame:
    return match.select(
        "video_id",
        "gt_idx",
        "hyp_idx",
        "iou",
        (F.col("hyp_start") - F.col("gt_start")).alias("start_delta"),
        (F.col("hyp_end") - F.col("gt_end")).alias("end_delta"),
        character_error_rate(normalize_for_cer(F.col("gt_text")), normalize_for_cer(F.col("hyp_text"))).alias("cer"),
    )


def report(ref: DataFrame, hyp: DataFrame, spool) -> DataFrame:
    """A row a video that ref has: pairs, missed, spurious, zero_duration, split, merged, means, medians and 95 % values of the shifts, paired_cer."""
    cands = spool(candidates(ref, hyp))
    match = pairs(matched(cands, spool))
    weight = F.length(normalize_for_cer(F.col("text")))
    rows = ref.select("video_id", F.col("idx").alias("gt_idx"), weight.alias("w")).join(match, ["video_id", "gt_idx"], "left")
    shift = lambda c: [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.median(c), F.lit(0.0)).alias(f"{c}_median"), F.coalesce(p95_abs(c), F.lit(0.0)).alias(f"{c}_p95_abs")]
    main = rows.groupBy("video_id").agg(
        F.count("iou").alias("pairs"),
        (F.count("*") - F.count("iou")).alias("missed"),
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("iou_mean"),
        *shift("start_delta"),
        *shift("end_delta"),
        F.coalesce(F.try_divide(F.sum(F.coalesce("cer", F.lit(1.0)) * F.col("w")), F.sum("w")), F.lit(0.0)).alias("paired_cer"),
    )
    per = lambda k, name: cands.groupBy("video_id", k).agg((F.count("*") - 1).alias("n")).groupBy("video_id").agg(F.sum("n").alias(name))
    h = hyp.groupBy("video_id").agg(F.count("*").alias("hyps"), F.count_if(F.col("end") <= F.col("start")).alias("zero_duration"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = main.join(h, "video_id", "left").join(per("gt_idx", "split"), "video_id", "left").join(per("hyp_idx", "merged"), "video_id", "left")
    return out.select(*main.columns, (zero("hyps") - F.col("pairs")).alias("spurious"), *[zero(c).alias(c) for c in ("zero_duration", "split", "merged")])


def text_error(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """A row a video: raw and norm error rates of the texts joined in order without separators, and their lengths."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("idx", "text")))
        return df.groupBy("video_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias(name))

    both = whole(ref, "r").join(whole(hyp, "h"), "video_id", "full").fillna("", ["r", "h"])
    # One row a video, each worth seconds of work: spread, over a given number, as few bytes would be put into few tasks again.
    spread = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumns({f"n{c}": normalize_for_cer(F.col(c)) for c in "rh"}).repartition(spread, "video_id")
    rate = lambda r, h: (edit_distance_long(F.col(r), F.col(h)) / F.greatest(F.length(r), F.lit(1))).cast("double")
    return both.select("video_id", rate("r", "h").alias("raw"), rate("nr", "nh").alias("norm"), F.length("h").alias("hyp_chars"), F.length("r").alias("ref_chars"))
