"""Keyframes of a video: when a text appears and when it goes, by a state machine over its frames in order.

Finding text in a frame needs nothing but the frame, and is nearly all of the work, so it runs
over all frames of all videos in parallel. What it leaves, masks of single bits, is streamed by
video through the state machine, which holds some twenty frames at a time.
"""

from __future__ import annotations

import itertools
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from reelquery.operators.finder import Params, View, dense_line, same_after_all, same_level, still_text, transformed, within

FOUND = "video_id bigint, n bigint, pos bigint, height int, width int, has_text boolean, im binary, edges binary, levels binary"
KEYFRAME = "video_id bigint, start_ms bigint, end_ms bigint, n bigint, height int, width int, mask binary"


@dataclass
class Frame:
    n: int
    pos: int
    im: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    has_text: bool


class Ahead:
    """The frames from some before the last asked for to some after it."""

    def __init__(self, frames: Iterable[Frame], forward: int):
        self.source, self.forward = iter(frames), forward
        self.held: deque[Frame] = deque()
        self.first = self.count = 0

    def reach(self, target: int) -> None:
        while self.count <= target + self.forward:
            frame = next(self.source, None)
            if frame is None:
                break
            self.held.append(frame)
            self.count += 1
        while self.held and self.first < target - 2:
            self.held.popleft()
            self.first += 1

    def get(self, k: int) -> Frame | None:
        return self.held[k - self.first] if self.first <= k < self.first + len(self.held) else None


@dataclass
class Span:
    """A text on screen: the view it is known by, the frame that shows it, its first frame and time, and its last time."""

    view: View
    shown: int
    begin: int
    start: int
    end: int = -2

    def copy(self) -> Span:
        return Span(View(self.view.im, self.view.edges, self.view.levels), self.shown, self.begin, self.start, self.end)


class Tracker:
    """Detects a text that stands for a window of frames, follows it until it changes or goes, and joins it to the one before if they are the same."""

    def __init__(self, frames: Iterable[Frame], p: Params = Params()):
        self.p, self.frames = p, Ahead(frames, 3 * p.window)
        self.out: list[tuple[int, int, int, np.ndarray]] = []

    def same(self, a: View, b: View, before: np.ndarray | None) -> bool:
        return same_after_all(a, b, before, self.p)

    def save(self, s: Span, end: int) -> None:
        """Keep a span if it still looks like text by itself."""
        s.view.im, found = still_text(s.view.im, s.view.edges, s.view.levels, self.p)
        if found:
            self.out.append((max(s.start, 0), max(end, 0), s.shown, s.view.im))

    def common(self, frames: list[Frame]) -> tuple[np.ndarray, np.ndarray]:
        im, levels = frames[0].im, frames[0].levels
        for f in frames[1:]:
            im, levels = within(im, f.im), same_level(levels, f.levels, self.p)
        return im, levels

    def stands(self, im: np.ndarray, levels: np.ndarray) -> bool:
        return dense_line(within(im, levels), self.p)

    def detect(self, at: int) -> int | None:
        """The first window from at on in which a text stands; strides of half a window, or a whole one where its end has no text."""
        half = self.p.window // 2
        while True:
            self.frames.reach(at)
            a = self.frames.get(at + half - 1)
            if a is None:
                return None
            step = half
            if a.has_text:
                b = self.frames.get(at + 2 * half - 1)
                if b is None:
                    return None
                step = half if b.has_text else 2 * half
                if b.has_text and self.stands(*self.common([a, b])):
                    between = [self.frames.get(at + k) for k in range(half, 2 * half - 1)]
                    if self.stands(*self.common([a, b, *between])):
                        return at
            at += step
            if at >= self.frames.count:
                return None

    def window(self, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """(mask, levels, whether a text stands) over the window that begins with frame k; at the end of the video, over what there is."""
        frames = [f for f in (self.frames.get(k + i) for i in range(self.p.window)) if f is not None]
        if not all(f.has_text for f in frames):
            return frames[0].im, frames[0].levels, False
        im, levels = self.common(frames)
        return im, levels, self.stands(im, levels)

    def change(self, k: int, view: View, before: np.ndarray) -> int | None:
        """How many frames from k on the new text begins; None where the video ends first."""
        last = self.p.window - 1
        for off in range(last):
            f = self.frames.get(k + off)
            prior = before if off == 0 else getattr(self.frames.get(k + off - 1), "edges", None)
            if f is None or prior is None:
                return None
            if not self.same(view, View(f.im, f.edges), prior):
                rest = [f, *(self.frames.get(k + i) for i in range(off + 1, last))]
                if any(r is None for r in rest):
                    return None
                im, levels = self.common(rest)
                if not self.same(view, View(im, f.edges, levels), prior):
                    return off
        return last

    def vanish(self, k: int, view: View, before: np.ndarray) -> int:
        """How many frames from k on the text is gone, by its edges."""
        for off in range(self.p.window - 1):
            f = self.frames.get(k + off)
            if f is None:
                return off
            if not any(self.same(view, View(view.im, e, view.levels), before) for e in (f.edges, within(f.edges, view.edges))):
                return off
            before = f.edges
        return self.p.window - 1

    def time_before(self, k: int, otherwise: int) -> int:
        before, here = self.frames.get(k - 1), self.frames.get(k)
        return before.pos if before else here.pos - 1 if here else otherwise

    def run(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(start, end, frame that shows it, mask) of each text."""
        p, frames = self.p, self.frames
        cur: Span | None = None
        prev: Span | None = None  # the span before, not yet saved
        origin = (-2, -2)  # first frame and time of the span before, saved or not
        edges_before, closed = None, -2
        begin = k = 0
        tracking = False
        while True:
            yield from self.taken()
            if not tracking:
                found = self.detect(begin)
                if found is None:
                    break
                begin = k = found
                tracking = True
            frames.reach(k)
            f = frames.get(k)
            if f is None:
                self.at_end(cur)
                cur = None
                break
            back = frames.get(k - 1)
            pos_before = back.pos if k > 0 and back else -1
            im, levels, stands = self.window(k)
            here = View(im, f.edges, levels)
            moved = f.pos != pos_before
            if cur and cur.begin == k:
                cur.view, cur.shown = here, k
            if k > closed:
                if stands and moved:
                    if cur is None:
                        cur, closed = Span(here, k, k, f.pos), k
                    elif self.same(cur.view, here, edges_before):
                        if k - cur.begin == 2:
                            cur.view, cur.shown = here, k
                        cur.view = View(cur.view.im, cur.view.edges, same_level(cur.view.levels, f.levels, p))
                    else:
                        joined = False
                        if prev:
                            joined = self.same(prev.view, cur.view, None)
                            if not joined:
                                self.save(prev, prev.end)
                                origin = (cur.begin, cur.start)
                        else:
                            origin = (cur.begin, cur.start)
                        off, last, end = 0, k - 1, f.pos - 1
                        if k > cur.begin + 1:
                            off = self.change(k, cur.view, edges_before)
                            if off is None:
                                self.at_end(cur)
                                cur = None
                                break
                            last, end = k + off - 1, self.time_before(k + off, f.pos)
                        if last - origin[0] + 1 >= p.window:
                            kept = prev if prev and joined else cur.copy()
                            kept.begin, kept.start = origin
                            kept.end, prev = end, kept
                        else:
                            prev = None
                        g = frames.get(k + off)
                        if g is None:
                            break
                        # A later frame stands for itself; its levels are shifted as the levels of a window of one.
                        view = here if off == 0 else View(g.im, g.edges, g.levels + 255)
                        cur, closed = Span(View(view.im, g.edges, view.levels), k + off, k + off, f.pos + off * 1000 // 30), k + off
                elif moved or stands:
                    if prev and cur and self.same(prev.view, cur.view, None):
                        cur.begin, cur.start = origin
                        closed = cur.begin
                        known, prev = prev, None
                    else:
                        known = prev
                    if cur:
                        if moved:
                            off = self.vanish(k, cur.view, edges_before)
                            closed, end = k + off - 1, self.time_before(k + off, f.pos)
                        else:
                            closed, end = k - 1, f.pos
                        if closed - cur.begin + 1 < p.window and prev and self.same_edges(cur.view, prev.view):
                            cur.begin, cur.start = origin
                        if prev and cur.begin != origin[0]:
                            self.save(prev, prev.end)
                        if closed - cur.begin + 1 >= p.window:
                            if cur.begin == origin[0] and known:
                                known.start = cur.start
                                self.save(known, end)
                            else:
                                self.save(cur, end)
                    prev = cur = None
                    if k > closed and k - begin >= p.window:
                        tracking, begin = False, k
            if tracking:
                edges_before = f.edges
                k += 1
                frames.reach(k)
                if k >= frames.count:
                    self.at_end(cur)
                    break
        if prev:
            self.save(prev, prev.end)
        yield from self.taken()

    def same_edges(self, cur: View, prev: View) -> bool:
        """Whether a short span's edges are those of the span before, or one's are among the other's."""
        among = within(prev.edges, cur.edges)
        tries = ((prev.edges, cur.edges), (prev.edges, within(cur.edges, prev.edges)), (among, cur.edges))
        return any(self.same(View(cur.im, a, cur.levels), View(cur.im, b, cur.levels), None) for a, b in tries)

    def at_end(self, cur: Span | None) -> None:
        last = self.frames.count - 1
        f = self.frames.get(last)
        if cur and f and last - cur.begin + 1 >= self.p.window:
            self.save(cur.copy(), f.pos)

    def taken(self) -> list[tuple[int, int, int, np.ndarray]]:
        out, self.out = self.out, []
        return out


def _pack(mask: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(mask != 0).tobytes(), 1)


def _unpack(data: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=h * w).reshape(h, w).astype(np.int64) * 255


def find_text(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """video_id, n, pos, height, width, has_text and packed masks of frames (video_id, n, pos in ms, height, width, bgr). Each frame by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                im, edges, levels, found = transformed(np.frombuffer(t.bgr, np.uint8).reshape(t.height, t.width, 3), p)
                grey = zlib.compress((levels - 255).astype(np.uint8).tobytes(), 1) if found else b""
                rows.append((t.video_id, t.n, t.pos, t.height, t.width, found, _pack(im), _pack(edges), grey))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FOUND.split(", ")])

    return frames.select("video_id", "n", "pos", "height", "width", "bgr").mapInPandas(run, FOUND)


def track(found: DataFrame, p: Params = Params()) -> DataFrame:
    """Keyframes of the result of find_text: video_id, start_ms, end_ms, n (the frame that shows the text), height, width, mask (packed bits).

    A partition's videos come one after the other, each in the order of its frames.
    """

    def frame(t) -> Frame:
        h, w = t.height, t.width
        none = np.zeros((h, w), np.int64)
        levels = np.frombuffer(zlib.decompress(t.levels), np.uint8).reshape(h, w).astype(np.int64) + 255 if t.has_text else none
        return Frame(t.n, t.pos, _unpack(t.im, h, w), _unpack(t.edges, h, w), levels, t.has_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (t for pdf in batches for t in pdf.itertuples())
        for video, of in itertools.groupby(rows, key=lambda t: t.video_id):
            first = next(of)
            shape = (first.height, first.width)
            numbers: list[int] = []

            def numbered(of=of, first=first, numbers=numbers):
                for t in itertools.chain([first], of):
                    numbers.append(t.n)
                    yield frame(t)

            kept = [(video, s, e, numbers[k], *shape, np.packbits(m != 0).tobytes()) for s, e, k, m in Tracker(numbered(), p).run()]
            if kept:
                yield pd.DataFrame(kept, columns=[c.split(" ")[0] for c in KEYFRAME.split(", ")])
            for _ in of:  # what the tracker left
                pass

    return found.repartition("video_id").sortWithinPartitions("video_id", "n").mapInPandas(run, KEYFRAME)


def keyframes(frames: DataFrame, p: Params = Params()) -> DataFrame:
    return track(find_text(frames, p), p)
