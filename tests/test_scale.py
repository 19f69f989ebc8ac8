"""Work that must not grow faster than what is given."""

import random
import time

from reelquery.functions.text import bit_distance, long_distance


def _dialogue(n, seed):
    """A text of n sentences, and it without some of them and with other marks."""
    r = random.Random(seed)
    said = [(r.choice(("5-LOW", "4-NOT SPECIFIED", "2-HIGH", "弱者", "这小子也真是敢说")), r.choice("OFP")) for _ in range(n)]
    return "".join(f"{a} {b}" for a, b in said), "".join(f"{a}.{b}" for a, b in said if r.random() < 0.9)


def test_long_distance_is_exact():
    r = random.Random(3)
    for n, share in ((1200, 0.0), (1500, 0.05), (4000, 0.3), (3000, 1.0)):
        a = "".join(r.choice("abcdefg 的") for _ in range(n))
        b = "".join(r.choice(("", "x", c + "y")) if r.random() < share else c for c in a)
        for x, y in ((a, b), (b, a), (a, b[len(b) // 2 :] + b[: len(b) // 2]), (a[2000:], b)):
            assert long_distance(x, y) == bit_distance(x, y)
    a, b = _dialogue(400, 1)
    assert long_distance(a, b) == bit_distance(a, b)


def test_long_distance_of_like_texts_grows_with_their_length():
    a, b = _dialogue(60_000, 2)
    began = time.process_time()
    assert len(a) - len(b) <= long_distance(a, b) < len(a) - len(b) + 60_000
    assert time.process_time() - began < 30


def _joined_by(df):
    """The keys of the joins of a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_and_regions_meet_in_cells(spark):
    from pyspark.sql import functions as F

    from reelquery.operators import layout

    regions = spark.range(400).select((F.col("id") % 2).alias("img_id"), "id", (F.col("id") * 37 % 900 - 60).alias("x"), (F.col("id") * 53 % 500).alias("y"), F.element_at(F.array(*map(F.lit, (0, 1, 31, 32, 33, 700))), (F.col("id") % 6 + 1).cast("int")).cast("bigint").alias("w"), (2 + F.col("id") % 90).alias("h"))
    texts = spark.range(300).select((F.col("id") % 3).alias("img_id"), F.col("id").alias("idx"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), *[(F.col("id") * a % n + b).cast("double").alias(c) for c, a, n, b in (("x0", 41, 900, -40), ("x1", 41, 900, -30), ("y0", 29, 50, 0), ("y1", 29, 50, 9), ("cx", 41, 900, -35), ("cy", 29, 50, 4))])
    r, t = regions.collect(), texts.collect()
    inside = lambda p, q: p.img_id == q.img_id and p.x <= q.cx < p.x + p.w and p.y <= q.cy < p.y + p.h
    got = layout.labelled(regions, texts)
    assert {(x.img_id, x.id): x.label for x in got.collect()} == {(p.img_id, p.id): " ".join(q.text for q in sorted((q for q in t if inside(p, q)), key=lambda q: (q.cx, q.idx))) for p in r}
    free = layout.unabsorbed(regions, texts)
    assert {x.idx for x in free.collect()} == {q.idx for q in t if not any(inside(p, q) for p in r)}
    for df in (got, free):
        assert "x_cell" in _joined_by(df)


def test_containers_are_found_without_a_look_at_all_of_them(spark):
    from pyspark.sql import functions as F

    from reelquery.operators import layout

    # Equal regions: none fits in another, so all stay.
    n = 40_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("img_id"), "id", (F.col("id") * 7 % 900).alias("x"), (F.col("id") % 500).alias("y"), *[F.lit(9).cast("bigint").alias(c) for c in "whrgb"], F.lit(81).cast("bigint").alias("pixel_count"))
    began = time.time()
    assert layout.into_containers(df).count() == n
    assert time.time() - began < 20


def test_noise_pass_holds_one_video_at_a_time(spark):
    from pyspark.sql import functions as F

    from reelquery.operators import merge

    frames = spark.range(3000).select((F.col("id") % 1000).alias("video_id"), (F.col("id") + 1).alias("timestamp"), F.lit("x").alias("text"), F.lit(0.9).alias("text_confidence"), F.array(F.lit(0.0), F.lit(9.0)).alias("y_range"))
    sizes = merge.remove_triplet_noise(merge.fold_runs(frames)).mapInArrow(lambda bs: bs, "video_id bigint, segments array<%s>" % merge.SEGMENT)
    assert sizes.count() == 1000
    assert "MapInArrow" in _joined_by(merge.remove_triplet_noise(merge.fold_runs(frames))) and "MapInPandas" not in _joined_by(sizes)


def test_segments_are_scored_without_a_join_to_themselves(spark):
    from reelquery.operators import merge, segments

    frames = spark.createDataFrame([(1, 500, "a", 0.9, [0.0, 9.0], [1.0, 2.0]), (1, 1000, "", 0.0, [0.0, 0.0], [0.0, 0.0]), (1, 1500, "", 0.0, [0.0, 0.0], [0.0, 0.0]), (1, 2000, "b", 0.8, [0.0, 9.0], [1.0, 2.0])], "video_id long, timestamp long, text string, text_confidence double, x_range array<double>, y_range array<double>")
    runs = merge.runs(frames)
    assert [(r.text, r.end_ms) for r in runs.orderBy("seg_idx").collect()] == [("a", 1000), ("b", 2000)]
    assert _joined_by(runs).count("Window [") <= 4
    stats = spark.createDataFrame([(1, 1.0, 2.0)], "video_id long, avg_top double, avg_bottom double")
    out = segments.adjusted(runs, frames, stats, 720.0)
    assert out.columns == [*runs.columns, "y_penalty", "iso_penalty", "adjusted_confidence"]
    # The middle of the first is at 750, with frames at 500 and 2000.
    assert [r.iso_penalty for r in out.orderBy("seg_idx").collect()] == [250 / 1500, 1.0]
    assert _joined_by(out).count("Join ") == 1


def test_boxes_become_frames_where_they_are(spark):
    from reelquery.plans import catalog

    # The shuffles of a plan that isn't adapted: one of narrow rows makes the frames.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, most in (("frame_aggregate", 1), ("box_filter", 10)):
            plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(") <= most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
