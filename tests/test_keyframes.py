"""Finding text in drawn frames, and following it."""

import numpy as np
import pytest

from reelquery.operators import finder, keyframes

H, W = 120, 320


def frame(text=None, seed=0):
    """A dull picture, with letters of bars about the centre below."""
    im = np.full((H, W, 3), 90, np.uint8)
    if text is not None:
        r = np.random.default_rng(text)
        for x in range(80, 240, 10):
            im[88:104, x : x + 6] = 250
            y = 88 + int(r.integers(2, 12))
            im[y : y + 2, x : x + 9] = 250
            if r.random() < 0.5:
                im[88:104, x + 2 : x + 4] = 90
    return im


def test_text_is_found():
    mask, edges, levels, found = finder.transformed(frame(1))
    assert found and mask[85:107, 80:240].any() and not mask[:70].any()
    assert edges.any() and levels.max() > 255
    assert not finder.transformed(frame())[3]


def test_same_and_other_text():
    p = finder.Params()
    views = {}
    for t in (1, 2):
        m, e, lv, _ = finder.transformed(frame(t))
        views[t] = finder.View(m, e, lv)
    assert finder.same_after_all(views[1], views[1], None, p)
    assert not finder.same_after_all(views[1], views[2], None, p)


def drawn(*parts):
    """Frames of (text, number of frames) at 25 a second."""
    out = []
    for text, n in parts:
        out += [frame(text)] * n
    return out


def tracked(images):
    def made():
        for n, im in enumerate(images):
            yield keyframes.Frame(n, n * 40, *finder.transformed(im))

    return [(s, e) for s, e, _, _ in keyframes.Tracker(made()).run()]


def test_one_text():
    ((start, end),) = tracked(drawn((None, 15), (1, 25), (None, 20)))
    assert abs(start - 15 * 40) <= 40 and abs(end - 39 * 40) <= 80


def test_two_texts_and_the_end():
    got = tracked(drawn((None, 10), (1, 20), (2, 20), (None, 12), (3, 20)))
    assert len(got) == 3
    assert abs(got[0][1] - 30 * 40) <= 120 and abs(got[1][0] - 30 * 40) <= 120
    assert got[2][1] == 81 * 40


def test_too_short_and_none():
    assert tracked(drawn((None, 20), (1, 3), (None, 20))) == []
    assert tracked([]) == tracked([frame()] * 3) == []


def test_videos_in_parallel(spark):
    rows = []
    for video, parts in ((1, ((None, 15), (1, 25), (None, 15))), (2, ((2, 20), (None, 10)))):
        rows += [(video, n, n * 40, H, W, bytearray(im.tobytes())) for n, im in enumerate(drawn(*parts))]
    df = spark.createDataFrame(rows[::-1], "video_id bigint, n bigint, pos bigint, height int, width int, bgr binary")
    got = keyframes.keyframes(df).orderBy("video_id").collect()
    assert [r.video_id for r in got] == [1, 2]
    assert abs(got[0].start_ms - 600) <= 40 and got[1].start_ms == 0
    assert np.unpackbits(np.frombuffer(got[0].mask, np.uint8), count=H * W).any()


@pytest.mark.parametrize("lines, want", [([(0, 5), (9, 10), (20, 30)], [(0, 10), (20, 30)]), ([(0, 1)], [(0, 1)]), ([], []), ([(0, 1), (40, 50)], [(0, 50)])])
def test_lines(lines, want):
    im = np.zeros((60, 10), int)
    for a, b in lines:
        im[a : b + 1, 3] = 255
    assert finder.lines_of(im, 3) == want


def test_valley():
    assert finder.valley(np.array([1, 1, 1, 2, 3, 3, 9, 9, 9, 9])) == 4
    assert finder.valley(np.array([5, 5])) == 5


def test_dense_line():
    p = finder.Params()
    im = np.zeros((6, 100), int)
    assert not finder.dense_line(im, p)
    im[0:3, 30:70] = 255
    assert finder.dense_line(im, p)
    right = np.zeros((6, 100), int)
    right[0:3, 60:70] = 255
    assert not finder.dense_line(right, p)
