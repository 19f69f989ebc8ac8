"""Cases of the other operators, with expected results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.functions import geometry, text
from reelquery.operators import align, boxes, decode, layout, pixels, recognition, segments, stats
from reelquery.session import spool_to
from reelquery.sources.adapters import BOX


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(t="x", tc=0.9, bc=0.9, x=(0.0, 100.0), y=(100.0, 120.0)):
    return (t, tc, bc, [[x[0], y[0]], [x[1], y[0]], [x[1], y[1]], [x[0], y[1]]], list(x), list(y), [sum(x) / 2, sum(y) / 2])


def frame_of(spark, *bs):
    return spark.createDataFrame([(list(bs),)], f"boxes array<{BOX}>")


def flat_boxes(spark, *bs):
    rows = [(1, 500, i, *b) for i, b in enumerate(bs)]
    return spark.createDataFrame(rows, "video_id bigint, timestamp bigint, box_idx int, text string, text_confidence double, box_confidence double, bbox array<array<double>>, x_range array<double>, y_range array<double>, center array<double>")


@pytest.mark.parametrize("a, b, d", [("陆", "陆执巡", 2), ("陆", "这其中是不是有什么误会", 11), ("a", "b", 1)])
def test_edit_distance(spark, a, b, d):
    assert one(spark, text.edit_distance(F.lit(a), F.lit(b))) == d


@pytest.mark.parametrize("a, b, want", [("abc", "xxabcxx", True), ("xxabcxx", "abc", True), ("abc", "abc", False), ("", "abc", False)])
def test_substring(spark, a, b, want):
    assert one(spark, text.is_substring_of(F.lit(a), F.lit(b))) is want


def test_texts(spark):
    assert one(spark, text.normalize(F.lit(" a　b c\n"))) == "abc"
    assert one(spark, text.normalize_for_cer(F.lit("师父，三 百 5 个（人）-好"))) == "师傅#个人好"
    assert one(spark, text.url_decode(F.lit("a+b%20c"))) == "a+b c"
    assert one(spark, text.url_decode(F.lit("100%zz"))) == "100%zz"
    assert one(spark, text.url_decode(F.lit("a%20b%zz%4"))) == "a b%zz%4"
    assert one(spark, text.url_decode(F.lit("%E5%9B%BE%ff%"))) == "图\ufffd%"
    for s, want in (("Load -12 of 3", -12), ("Re-load 5", None), ("Load - 5", None), ("a5-3", 5), ("--7", None), ("", None), ("99999999999", None)):
        assert one(spark, text.first_int(F.lit(s))) == want
    assert one(spark, text.character_error_rate(F.lit(""), F.lit(""))) == 0


@pytest.mark.parametrize("a, b, want", [([0.0, 10.0], [5.0, 15.0], True), ([0.0, 10.0], [10.0, 20.0], False), (None, [0.0, 1.0], False)])
def test_overlap(spark, a, b, want):
    lit = lambda v: F.lit(None).cast("array<double>") if v is None else F.array(*map(F.lit, v))
    assert one(spark, geometry.overlap(lit(a), lit(b))) is want


def test_stats(spark):
    s = stats.box_stats(flat_boxes(spark, box(y=(10.0, 20.0), x=(50.0, 150.0)), box(y=(40.0, 60.0), x=(150.0, 250.0)), box(y=(100.0, 110.0), x=(50.0, 150.0)), box(t=" ", y=(0.0, 999.0)))).first()
    assert (s.median_height, s.mode_height, s.median_top, s.median_bottom) == (10, 10, 40, 60)
    assert (s.mode_x, s.median_x) == (100, 100)
    assert s.avg_x == pytest.approx(400 / 3)


def test_mode_is_the_first_to_reach_the_most(spark):
    seen = [box(x=(v - 1, v + 1)) for v in (1.0, 2.0, 2.4, 1.2, 0.6)]
    assert stats.box_stats(flat_boxes(spark, *seen)).first().mode_x == pytest.approx(0.6)
    assert stats.box_stats(flat_boxes(spark, *seen[:4])).first().mode_x == pytest.approx(2.4)


def scored(spark, b, mode=(100.0, 120.0), height=20.0, x=50.0):
    s = spark.createDataFrame([(1, height, *mode, x)], "video_id bigint, median_height double, mode_top double, mode_bottom double, mode_x double")
    return boxes.adjusted(flat_boxes(spark, b), s).first()


def test_adjusted(spark):
    assert scored(spark, box(y=(400.0, 420.0))).is_outlier
    low = scored(spark, box(y=(100.0, 102.0)))
    assert low.is_outlier and low.adjusted_confidence < 0.5
    usual = scored(spark, box())
    assert not usual.is_outlier and usual.adjusted_confidence == pytest.approx(0.9)
    real = scored(spark, box(tc=0.99626046, bc=0.87568265, x=(540.5, 740.5), y=(606.0, 640.0)), (625.0, 672.0), 46.0, 639.5)
    want = {"y_center_offset_ratio": -0.5543, "x_center_offset_ratio": 0.0217, "height_ratio": 0.7391, "y_penalty": 0.28748, "height_penalty": 0.11569, "total_penalty": 0.34824, "adjusted_confidence": 0.59431}
    for k, v in want.items():
        assert real[k] == pytest.approx(v, abs=1e-4)
    blank = scored(spark, box(t=" "))
    assert (blank.height, blank.total_penalty, blank.is_outlier, blank.adjusted_confidence) == (0, 0, False, 0.9)


def test_suppression(spark):
    big, inner = box("big", x=(0.0, 100.0), y=(0.0, 100.0)), box("inner", x=(10.0, 20.0), y=(10.0, 20.0))
    kept = frame_of(spark, inner, big).select(boxes.suppressed(F.col("boxes")).alias("k")).first()["k"]
    assert [k["text"] for k in kept] == ["big"]
    apart = frame_of(spark, big, box("far", x=(300.0, 400.0), y=(0.0, 90.0))).select(boxes.suppressed(F.col("boxes")).alias("k")).first()["k"]
    assert [k["text"] for k in apart] == ["far", "big"]
    assert frame_of(spark).select(boxes.suppressed(F.col("boxes")).alias("k")).first()["k"] == []


def test_frame_fields(spark):
    f = lambda *b: frame_of(spark, *b).select(*boxes.frame_fields(F.col("boxes"))).first()
    assert f(box("a", y=(0.0, 10.0)), box("b", y=(5.0, 15.0))).text == "a b"
    assert f(box("a", y=(0.0, 10.0)), box("b", y=(50.0, 60.0))).text == "a\nb"
    empty = f()
    assert (empty.text, empty.text_confidence, empty.y_range) == ("", 0, [0, 0])


def test_penalties(spark):
    seg = lambda i, s, e, n, y=(50.0, 70.0): (1, i, "x", s, e, list(y), 0.9, n)
    df = spark.createDataFrame([seg(0, 400, 600, 1), seg(1, 14000, 16000, 1), seg(2, 0, 10, None), seg(3, 0, 10, 2)], "video_id bigint, seg_idx int, text string, start_ms bigint, end_ms bigint, y_range array<double>, text_confidence double, frame_count int")
    frames = spark.createDataFrame([(1, t, "x", [1.0, 2.0], [1.0, 2.0]) for t in (400, 600)] + [(1, 15000, "x", [1.0, 2.0], [1.0, 2.0])], "video_id bigint, timestamp bigint, text string, x_range array<double>, y_range array<double>")
    stats_ = spark.createDataFrame([(1, 10.0, 30.0)], "video_id bigint, avg_top double, avg_bottom double")
    out = {r.seg_idx: r for r in segments.adjusted(df, frames, stats_, 1080.0).collect()}
    assert out[0].iso_penalty == pytest.approx(100 / 1500)
    assert out[0].y_penalty == pytest.approx(40 / 86.4)
    assert out[1].iso_penalty == 1
    assert out[2].adjusted_confidence is None and out[2].y_penalty is None
    assert out[3].iso_penalty == 0
    none = segments.adjusted(df, frames, stats_.withColumns({"avg_top": F.lit(0.0), "avg_bottom": F.lit(0.0)}), 1080.0)
    assert none.filter("adjusted_confidence is not null").isEmpty()
    assert segments.confident(none, 0).count() == 4 and segments.confident(none, 0.95).count() == 0
    s = segments.confident_summary(none, 0.5).first()
    assert (s.segment_count, s.dropped, s.text) == (4, 0, "x x x x")


def timed(spark, rows):
    return spark.createDataFrame([(1, i, t, s, e) for i, (t, s, e) in enumerate(rows)], "video_id bigint, idx int, text string, start bigint, end bigint")


def test_alignment_with_itself_and_shifted(spark):
    rows = [(f"line {i}", 3000 * i, 3000 * i + 1000) for i in range(20)] + [("point", 70000, 70000)]
    r = align.report(timed(spark, rows), timed(spark, rows), spool_to(spark)).first()
    assert (r.pairs, r.missed, r.spurious, r.split, r.merged, r.zero_duration, r.paired_cer) == (21, 0, 0, 0, 0, 1, 0)
    late = [(t, s + 200, e + 300) for t, s, e in rows[:19]]
    r = align.report(timed(spark, rows), timed(spark, late), spool_to(spark)).first()
    assert (r.pairs, r.missed, r.start_delta_mean, r.end_delta_median, r.end_delta_p95_abs) == (19, 2, 200, 300, 300)
    assert r.iou_mean == pytest.approx(800 / 1300)


def test_alignment_is_the_greedy_one(spark):
    rng = np.random.default_rng(3)
    make = lambda n: [("t", int(s), int(s + d)) for s, d in zip(rng.integers(0, 30000, n), rng.choice([0, 500, 2000, 12000], n))]
    g, h = make(40), make(40)
    got = {(p.gt_idx, p.hyp_idx) for p in align.matched(align.candidates(timed(spark, g), timed(spark, h)), spool_to(spark)).collect()}

    def rel(a, b):
        (s, e), (u, v) = a, b
        if e <= s or v <= u:
            return s == u if e <= s and v <= u else u <= s <= v if e <= s else s <= u <= e
        return min(e, v) > max(s, u)

    def iou(a, b):
        (s, e), (u, v) = a, b
        if e <= s or v <= u:
            return 1 / (max((v - u) if e <= s else (e - s), 1) + 1)
        i = min(e, v) - max(s, u)
        return i / (e - s + v - u - i)

    cands = sorted(((-iou(a[1:], b[1:]), i, j) for i, a in enumerate(g) for j, b in enumerate(h) if rel(a[1:], b[1:])))
    want, ug, uh = set(), set(), set()
    for _, i, j in cands:
        if i not in ug and j not in uh:
            want.add((i, j))
            ug.add(i)
            uh.add(j)
    assert got == want


def test_geometry():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]], float)
    assert len(geometry.hull(square)) == 4
    cx, cy, w, h, a = geometry.tightest_rect(np.array([[0, 0], [6, 0], [6, 2], [0, 2]], float))
    assert (cx, cy, w, h) == pytest.approx((3, 1, 6, 2))
    turned = np.array([[0, 0], [3, 3], [2, 4], [-1, 1]], float)
    assert geometry.tightest_rect(turned)[2:4] == pytest.approx((math.sqrt(18), math.sqrt(2)))
    assert geometry.corners(3, 1, 6, 2, 0).tolist() == [[0, 0], [6, 0], [6, 2], [0, 2]]
    assert geometry.tightest_rect(np.array([[0, 0], [1, 1]], float)) == (0, 0, 0, 0, 0)
    out = geometry.grown(square[:4], math.sqrt(2))
    assert out == pytest.approx(np.array([[-1, -1], [5, -1], [5, 5], [-1, 5]]))
    m = geometry.perspective(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[2, 3], [4, 3], [4, 5], [2, 5]]))
    p = m @ np.array([0.5, 0.5, 1])
    assert (p / p[2])[:2] == pytest.approx((3, 4))


def test_masks(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, pixels.union(arr(255, 0, 0, 255), arr(0, 255, 0, 255))) == [255, 255, 0, 255]
    assert one(spark, pixels.combine(arr(255, 0, 0), arr(0, 0, 7))) == [255, 0, 255]
    assert one(spark, pixels.intersect(arr(9, 100, 5, 255), arr(0, 1, 0, 255))) == [0, 100, 0, 255]
    assert one(spark, pixels.intersect_levels(arr(5, 20, 0), arr(50, 30, 99))) == [0, 20, 0]
    assert one(spark, pixels.moderate_threshold(arr(0, 0), 0.5)) == [255, 255]


def test_components_by_flood():
    rng = np.random.default_rng(1)
    for _ in range(20):
        im = (rng.random((9, 13)) < 0.4) * 255
        want, n = np.zeros(im.shape, int), 0
        for y in range(9):
            for x in range(13):
                if im[y, x] and not want[y, x]:
                    n += 1
                    todo = [(y, x)]
                    want[y, x] = n
                    while todo:
                        a, b = todo.pop()
                        for c in range(max(a - 1, 0), min(a + 2, 9)):
                            for d in range(max(b - 1, 0), min(b + 2, 13)):
                                if im[c, d] and not want[c, d]:
                                    want[c, d] = n
                                    todo.append((c, d))
        assert (pixels.component_labels(im) == want).all()


def test_images():
    im = np.zeros((5, 5), int)
    im[2, 2] = 255
    assert pixels.dilated(im).sum() == 9 * 255 and pixels.dilated(im, 0).sum() == 255
    assert pixels.sobel_max(im)[1, 1] == 2550
    assert (pixels.smoothed(np.full((5, 5), 100)) == np.pad([[100]], 2)).all()
    assert pixels.spread(np.full((5, 5), 100))[2, 2] == 100
    ramp = np.arange(16.0).reshape(4, 4)
    assert pixels.resized(ramp, 4, 4) == pytest.approx(ramp)
    assert pixels.resized(ramp, 2, 2) == pytest.approx(np.array([[2.5, 4.5], [10.5, 12.5]]))
    assert pixels.resized_nearest(ramp, 2, 2).tolist() == [[0, 2], [8, 10]]
    assert pixels.channels_first(np.full((1, 2, 3), 255), [0.5] * 3, [0.5] * 3).tolist() == [[[1, 1]]] * 3
    rows = np.zeros((3, 33, 3), np.uint8)
    rows[1, ::2] = 255
    assert pixels.text_rows(rows).tolist() == [1]


def test_color_regions():
    whole = np.full((10, 20, 3), 200, np.uint8)
    assert len(layout.regions_of(whole)) == 1
    half = whole.copy()
    half[:, 10:] = (0, 0, 200)
    assert [r[:4] for r in layout.regions_of(half)] == [(0, 0, 10, 10), (10, 0, 10, 10)]
    noise = np.full((100, 100, 3), 200, np.uint8)
    noise[50:52, 50:52] = 0
    assert len(layout.regions_of(noise)) == 1


def test_containers(spark):
    rows = [(1, 0, 10, 10, 100, 50, 200, 200, 200, 5000), (1, 1, 20, 20, 3, 20, 0, 0, 0, 60), (1, 2, 300, 300, 5, 5, 9, 9, 9, 25), (1, 3, 108, 20, 6, 5, 0, 0, 0, 30)]
    df = spark.createDataFrame(rows, "img_id bigint, id bigint, x bigint, y bigint, w bigint, h bigint, r bigint, g bigint, b bigint, pixel_count bigint")
    got = {tuple(r)[2:6] + (r.pixel_count,) for r in layout.into_containers(df).collect()}
    assert got == {(10, 10, 104, 50, 5090), (300, 300, 5, 5, 25)}


def test_labels(spark):
    rows = [(1, 0, "Reload all", 0.5), (1, 1, "Load", 0.9), (1, 2, "the Load x", 0.1), (1, 3, "big load here", 0.2)]
    df = spark.createDataFrame(rows, "img_id bigint, id bigint, label string, area_ratio double")
    assert layout.find_by_label(df, "load").first()["id"] == 1
    assert layout.find_by_label(df.filter("id <> 1"), "LOAD").first()["id"] == 2
    assert layout.find_by_label(df.filter("id = 0"), "load").first()["id"] == 0
    assert layout.find_by_label(df, "none").isEmpty()
    n = spark.createDataFrame([(1, 0, "Load 5 x", 0.1), (1, 1, "count: 7", 0.3), (2, 0, "load", 0.1), (3, 0, "load 1", 0.5), (3, 1, " 12 ", 0.1)], df.schema)
    assert {r.img_id: r.value for r in layout.read_count(n).collect()} == {1: 7, 2: None, 3: 12}


def test_turn(spark):
    for p, want in (([0.347, 0.652], False), ([0.05, 0.95], True), ([0.1, 0.9], False), ([0.09, 0.91], True), ([1.0], False)):
        assert one(spark, decode.needs_turn(F.array(*map(F.lit, p)))) is want


def test_ctc(spark):
    steps = [[0, 1], [1, 0], [0, 1], [0, 1], [0.2, 0.8]]
    df = spark.createDataFrame([(1, i, [float(x) for x in s]) for i, s in enumerate(steps)], "id bigint, step int, logits array<double>")
    v = spark.createDataFrame([(0, "_"), (1, "a")], "token_id int, token string")
    r = decode.ctc_decode(df, v).first()
    assert (r.text, r.confidence) == ("aa", 1.0)
    r = decode.ctc_decode(df, v.filter("token_id = 0")).first()
    assert (r.text, r.confidence) == ("", 0.0)


def test_text_boxes(spark):
    prob = np.zeros((40, 60))
    prob[10:20, 10:40] = 0.9
    ((polygon, score),) = decode.boxes_of(prob, 80, 120)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    assert score > 0.75 and min(xs) < 20 and max(xs) > 78 and min(ys) < 20 and max(ys) > 38
    assert decode.boxes_of(np.zeros((8, 8)), 8, 8) == []
    df = spark.createDataFrame([(1, 40, 60, prob.ravel().tolist(), 80, 120)], "img_id bigint, map_height int, map_width int, scores array<double>, height int, width int")
    assert decode.text_boxes(df).count() == 1


def test_bands(spark):
    rows = spark.createDataFrame([(1, y, 200) for y in [*range(30, 50), *range(60, 70), 150]], "img_id bigint, y int, height int")
    assert [(r.lb, r.le) for r in pixels.row_bands(rows, 12, 20).collect()] == [(18, 81)]


def test_crops():
    im = np.arange(20 * 30 * 3).reshape(20, 30, 3).astype(np.uint8)
    square = np.array([[5, 4], [14, 4], [14, 9], [5, 9]], float)
    assert (recognition.upright_crop(im, square) == im[4:10, 5:15]).all()
    assert recognition.upright_crop(im, square + 100).shape == (1, 1, 3)
    straight = recognition.warped_crop(im, square)
    assert straight.shape == (5, 9, 3) and (straight[0, 0] == im[4, 5]).all() and (straight[-1, -1] == im[9, 14]).all()
    high = recognition.warped_crop(im, np.array([[5, 2], [10, 2], [10, 18], [5, 18]], float))
    assert high.shape == (5, 16, 3) and (high[0, 0] == im[18, 5]).all()


def test_reading_with_given_models(spark):
    class Fake:
        def detect(self, image):
            assert image.shape[0] == 3 and image.shape[1] % 32 == image.shape[2] % 32 == 0
            out = np.zeros(image.shape[1:])
            h, w = out.shape
            out[h // 4 : h // 2, w // 4 : w // 2] = 0.95
            return out

        def turned(self, line):
            return np.array([0.05, 0.95])

        def read(self, line):
            assert line.shape[:2] == (3, 48)
            return np.array([[0.1, 0.9, 0.0], [0.9, 0.1, 0.0], [0.1, 0.8, 0.0], [0.0, 0.1, 0.7]])

    (b,) = recognition.read_image(np.zeros((200, 400, 3), np.uint8), Fake(), ["", "x", "y"], lower=0.5)
    assert (b["text"], b["text_confidence"]) == ("xxy", pytest.approx(0.8)) and b["y_range"][0] >= 100
    start = recognition.reader(Fake, lambda c: np.zeros((100, 100, 3), np.uint8), ["", "x"])
    assert start()(b"")[0]["text"] == "xx"
    assert one(spark, recognition.without_alpha(F.array(*map(F.lit, range(8))))) == [0, 1, 2, 4, 5, 6]
    df = spark.createDataFrame([(1, 300.0, 10.0), (1, 500.0, 10.0)], "video_id int, ms double, s double")
    assert tuple(recognition.speed(df, F.col("s"), F.col("ms")).first()) == (1, 2, 0.8, 400.0, 0.08)


def test_long_edit_distance(spark):
    r = np.random.default_rng(9)
    rows = [("".join(r.choice(list("abc師"), r.integers(0, 90))), "".join(r.choice(list("abc師"), r.integers(0, 90)))) for _ in range(200)] + [("", "ab"), ("ab", ""), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.levenshtein("a", "b").alias("x"), text.edit_distance_long(F.col("a"), F.col("b")).alias("y"))
    assert all(p.x == p.y for p in df.collect())
