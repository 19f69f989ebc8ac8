"""Finding text in frames: edge images, what of them looks like lines of text, and whether two frames show the same.

Images are arrays of rows; masks hold 0 and 255. Everything here is about one or two frames,
so frames are worked on in parallel; keyframes.py follows them through a video.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from reelquery.operators.pixels import component_labels, dilated, smoothed, sobel_diagonal, sobel_max, sobel_vertical, spread, text_rows


@dataclass(frozen=True)
class Params:
    """window: frames in which a text must stand. strip: rows looked at together. density, shortest: of text in a strip. edge_change, level_change:
    shares that may differ. down, up: reach of a level. color_change, segment, together: of a text row. line: least height. strong, fair: edge
    thresholds. gap, aside: greatest distance between parts and from the centre. edges, filled, edge_share: least in a strip. symbol: least height."""

    window: int = 6
    strip: int = 3
    density: float = 0.3
    shortest: float = 0.022
    edge_change: float = 0.30
    level_change: float = 0.30
    down: int = 20
    up: int = 40
    color_change: int = 800
    segment: int = 8
    together: int = 2
    line: float = 12 / 720
    strong: float = 0.4
    fair: float = 0.3
    gap: float = 0.05
    aside: float = 0.1
    edges: int = 50
    filled: float = 0.3
    edge_share: float = 0.3
    symbol: float = 0.01


Spans = list[tuple[int, int]]


def runs(on: np.ndarray) -> Spans:
    """First and last index of each run of True."""
    step = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist()))


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a where b isn't 0."""
    return np.where(b != 0, a, 0)


def same_level(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """a where b is near its level."""
    return np.where((b >= a - p.down) & (b <= a + p.up), a, 0)


def to_yuv(bgr: np.ndarray) -> list[np.ndarray]:
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    half, middle = 1 << 13, 128 << 14
    y = (r * 4899 + g * 9617 + b * 1868 + half) >> 14
    return [np.clip(c, 0, 255) for c in (y, ((b - y) * 8061 + middle + half) >> 14, ((r - y) * 14369 + middle + half) >> 14)]


def color_bands(bgr: np.ndarray, p: Params, pad: int = 12) -> Spans:
    """Bands of rows in which colours change as often as in text, near ones joined, with pad rows around."""
    h = bgr.shape[0]
    on = np.zeros(h, bool)
    on[text_rows(bgr, p.segment, p.color_change, p.together)] = True
    joined: list[list[int]] = []
    for a, b in runs(on):
        if joined and a - joined[-1][1] - 1 < 2 * pad:
            joined[-1][1] = b
        else:
            joined.append([max(a - pad, 0), b])
    return [(a, min(b + pad, h - 1)) for a, b in joined if b - a >= int(p.line * h)]


def valley(values: np.ndarray) -> int:
    """The least frequent value between the two most frequent ones below and above the middle of the range."""
    low, high = int(values.min()), int(values.max())
    n = np.bincount(values, minlength=high + 1)
    mid = (low + high) // 2
    left = low + int(n[low : max(mid, low + 1)].argmax())
    right = mid + int(n[mid : high + 1].argmax())
    at, least = (left, n[left]) if n[left] < n[right] else (right, n[right])
    between = n[left + 1 : right]
    return left + 1 + int(between.argmin()) if len(between) and between.min() < least else at


def locally_cut(im: np.ndarray, rows: int = 32) -> np.ndarray:
    """0 for what is under the valley of its block of rows; an image of fewer rows stays."""
    out = im.copy()
    if im.shape[0] >= rows:
        for a in range(0, im.shape[0], rows):
            block = out[a : a + rows]
            if block.any():
                block[block < valley(block[block > 0])] = 0
    return out


def over_share(im: np.ndarray, share: float) -> np.ndarray:
    """Where im reaches share of its maximum; everywhere if it is 0."""
    return im >= int(im.max() * share)


def strong_edges(yuv: list[np.ndarray], bands: Spans, p: Params) -> np.ndarray:
    """Edges within the bands, from brightness and colour."""
    parts = [np.concatenate([c[a : b + 1] for a, b in bands]) for c in yuv]
    y, u, v = (sobel_max(c) for c in parts)
    at = np.cumsum([0] + [b - a + 1 for a, b in bands])
    out = np.zeros(yuv[0].shape, np.int64)
    for mixed in (y + u + v, y + (u + v) * 5):
        s = smoothed(locally_cut(mixed))
        s = (s + spread(s)) // 2
        for (a, b), i, j in zip(bands, at, at[1:]):
            out[a : b + 1][over_share(s[i:j], p.strong)] = 255
    return out


def fair_edges(yuv: list[np.ndarray], gradient, p: Params) -> np.ndarray:
    y, u, v = (gradient(c) for c in yuv)
    hit = over_share(y + u + v, p.fair) | over_share(y + (u + v) * 5, p.fair)
    out = np.zeros(hit.shape, np.int64)
    out[1:-1, 1:-1][hit[1:-1, 1:-1]] = 255
    return out


class _Strip:
    """Rows of a mask with the parts of its lines of text; parts are erased from the mask as they are dropped."""

    def __init__(self, rows: np.ndarray, p: Params):
        self.rows, self.p = rows, p
        w = rows.shape[1]
        self.ends, self.middle, self.reach = w - 1, (w - 1) // 2, 2 * int(p.aside * w)
        self.parts = runs((rows == 255).any(axis=0))

    def off_centre(self, a: int, b: int) -> int:
        return abs(a + b - self.ends)

    def drop(self, k: int) -> None:
        a, b = self.parts.pop(k)
        self.rows[:, a : b + 1] = 0

    def clear(self) -> None:
        if self.parts:
            self.rows[:, self.parts[0][0] : self.parts[-1][1] + 1] = 0
            self.parts = []

    def worse(self, near: int, far: int) -> bool:
        """Whether the part far, to the right of near, is the one to drop."""
        (a, b), (c, d) = self.parts[near], self.parts[far]
        too_right = (c + d - 2 * self.middle) * 2 >= self.reach or c >= self.middle
        return too_right or (self.off_centre(a, b) <= self.reach and d - c < b - a)

    def outermost(self) -> int:
        last = len(self.parts) - 1
        return last if self.worse(0, last) or self.off_centre(*self.parts[last]) > self.off_centre(*self.parts[0]) else 0

    def close_up(self) -> None:
        limit = int(self.p.gap * self.rows.shape[1])
        while True:
            before, k = len(self.parts), len(self.parts) - 2
            while 0 <= k < len(self.parts) - 1:
                if self.parts[k + 1][0] - self.parts[k][1] > limit:
                    right = self.worse(k, k + 1) or self.off_centre(*self.parts[k]) <= self.off_centre(*self.parts[k + 1])
                    self.drop(k + 1 if right else k)
                    if k == len(self.parts) - 1:
                        k -= 1
                else:
                    k -= 1
            if len(self.parts) == before:
                return

    def centre(self) -> bool:
        """Drop outer parts until the rest is about the centre; whether it is."""
        while self.off_centre(self.parts[0][0], self.parts[-1][1]) > self.reach:
            if len(self.parts) == 1:
                return False
            left = self.off_centre(self.parts[-2][1], self.parts[0][0]) > self.off_centre(self.parts[-1][1], self.parts[1][0])
            self.drop(0 if left else -1)
            if self.parts[0][0] >= self.middle or self.parts[-1][1] <= self.middle:
                return False
        return True

    def covered(self) -> int:
        return sum(b - a + 1 for a, b in self.parts)

    def once(self, edges: np.ndarray) -> bool:
        """One pass; whether text is left."""
        p = self.p
        self.close_up()
        if not self.parts or not self.centre():
            return False
        if len(self.parts) == 2 and self.parts[1][0] - self.parts[0][1] - 1 > max(b - a + 1 for a, b in self.parts):
            return False
        while len(self.parts) > 1 and self.covered() < p.filled * (self.parts[-1][1] - self.parts[0][0] + 1):
            self.drop(self.outermost())
        while self.parts:
            n = sum(int((edges[:, a : b + 1] == 255).sum()) for a, b in self.parts)
            if n < p.edges:
                return False
            if n >= p.edge_share * self.covered() * len(self.rows):
                break
            self.drop(self.outermost())
        return bool(self.parts) and self.parts[0][0] < self.middle


def keep_lines(im: np.ndarray, edges: np.ndarray, bands: Spans, p: Params) -> bool:
    """Erase from im what doesn't look like a line of text about the centre, strip by strip; whether any is left."""
    h, found = im.shape[0], False
    for first, last in bands:
        count = max((min(last + p.strip, h - 1) - first) // p.strip, 0)
        for k in range(count):
            y = first + k * p.strip
            rows, near = im[y : y + p.strip], edges[y : y + p.strip]
            while True:
                strip = _Strip(rows, p)
                before = len(strip.parts)
                if not before:
                    break
                if not strip.once(near):
                    strip.clear()
                    break
                if len(strip.parts) == before:
                    found = True
                    break
        im[first + count * p.strip : last + 1] = 0
    return found


def drop_small(im: np.ndarray, p: Params) -> bool:
    """Erase components that are too small for letters; whether any is left."""
    label = component_labels(im)
    n = int(label.max())
    if not n:
        return False
    ys, xs = np.nonzero(label)
    k = label[ys, xs] - 1
    box = [np.full(n, im.size), np.zeros(n, int), np.full(n, im.size), np.zeros(n, int)]
    for f, out, at in ((np.minimum, box[0], ys), (np.maximum, box[1], ys), (np.minimum, box[2], xs), (np.maximum, box[3], xs)):
        f.at(out, k, at)
    tall, wide = box[1] - box[0] + 1, box[3] - box[2] + 1
    keep = (tall >= int(p.symbol * im.shape[0])) & (wide > p.strip) & (tall > p.strip)
    gone = ~keep[k]
    im[ys[gone], xs[gone]] = 0
    return bool(keep.any())


def restore_rows(im: np.ndarray, whole: np.ndarray, p: Params) -> None:
    """The rows of whole on and about rows of im that aren't empty."""
    reach = int(p.symbol * im.shape[0]) + 1
    on = np.flatnonzero(im.any(axis=1))
    near = np.zeros(im.shape[0] + 2 * reach, bool)
    for d in range(2 * reach + 1):
        near[on + d] = True
    rows = near[reach : reach + im.shape[0]]
    im[rows] = whole[rows]


def keep_touched(im: np.ndarray, mask: np.ndarray) -> None:
    """Erase components without a pixel in mask."""
    label = component_labels(im)
    im[~np.isin(label, np.unique(label[(mask != 0) & (label > 0)]))] = 0


def fill_lines(im: np.ndarray, whole: np.ndarray) -> None:
    """What whole has inside the boxes around the lines of im; lines that are nearer than they are high and wide share a box."""
    boxes = []
    for a, b in runs(im.any(axis=1)):
        x = np.flatnonzero(im[a : b + 1].any(axis=0))
        boxes.append([a, b, int(x[0]), int(x[-1])])
    k = len(boxes) - 2
    while k >= 0:
        s, t = boxes[k], boxes[k + 1]
        gap = t[0] - s[1] - 1
        if gap <= min(s[1] - s[0] + 1, t[1] - t[0] + 1, s[3] - s[2] + 1, t[3] - t[2] + 1):
            boxes[k : k + 2] = [[s[0], t[1], min(s[2], t[2]), max(s[3], t[3])]]
            k -= k == len(boxes) - 1
        else:
            k -= 1
    for a, b, left, right in boxes:
        part = im[a : b + 1, left : right + 1]
        part[whole[a : b + 1, left : right + 1] != 0] = 255


def text_mask(edges_strong: np.ndarray, edges: np.ndarray, bands: Spans, p: Params) -> tuple[np.ndarray, bool]:
    """(mask of what looks like text, whether there is any)."""
    first = within(edges_strong, dilated(edges, int(p.line * edges.shape[0]) // 2))
    kept = first.copy()
    if not keep_lines(kept, edges, bands, p):
        return np.zeros_like(first), False
    out = kept.copy()
    restore_rows(out, first, p)
    keep_touched(out, kept)
    whole = out.copy()
    if not drop_small(out, p):
        return out, False
    restore_rows(out, whole, p)
    fill_lines(out, first)
    return out, True


def transformed(bgr: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(text mask, edges, levels, whether there is text) of a frame; levels are brightness and 255, 0 without text."""
    bands = color_bands(bgr, p)
    h, w, _ = bgr.shape
    none = np.zeros((h, w), np.int64)
    if not bands:
        return none, none, none, False
    yuv = to_yuv(bgr)
    strong = strong_edges(yuv, bands, p)
    edges = fair_edges(yuv, sobel_diagonal, p)
    edges = np.where(edges == 0, fair_edges(yuv, sobel_vertical, p), edges)
    even = []
    for a, b in bands:
        up = -b % p.strip
        even.append([a - a % p.strip, b + up if b + up < h else b])
    if even[-1][1] + p.strip > h:
        even[-1][1] = h - p.strip
        strong[even[-1][1] + 1 :] = 0
    mask, found = text_mask(strong, edges, [(a, b) for a, b in even], p)
    return mask, edges, yuv[0] + 255 if found else none, found


def still_text(im: np.ndarray, edges: np.ndarray, levels: np.ndarray, p: Params) -> tuple[np.ndarray, bool]:
    """text_mask of what the levels leave of im, over the whole frame."""
    return text_mask(within(im, levels), edges, [(0, im.shape[0] - 1)], p)


def dense_line(im: np.ndarray, p: Params) -> bool:
    """Whether the fullest strip of im is a line of text: long and dense enough once parts far from the centre are peeled off."""
    h, w = im.shape
    n = h // p.strip
    if not n:
        return False
    strips = (im[: n * p.strip] == 255).reshape(n, p.strip, w)
    fill = strips.sum(axis=(1, 2))
    k = int(fill.argmax())
    if not fill[k]:
        return False
    parts = runs(strips[k].any(axis=0))
    shortest = int(p.shortest * w)
    length = sum(b - a + 1 for a, b in parts)
    while len(parts) > 1:
        if length < shortest:
            return False
        if length / (parts[-1][1] - parts[0][0] + 1) >= p.density:
            return True
        if parts[0][0] * 2 >= w:
            return False
        right = abs(parts[-2][1] + parts[0][0] + 1 - w) <= abs(parts[-1][1] + parts[1][0] + 1 - w)
        a, b = parts.pop(-1 if right else 0)
        length -= b - a + 1
    return length > shortest and parts[0][0] * 2 < w


def lines_of(im: np.ndarray, strip: int, near: int = 8) -> Spans:
    """Lines of rows with text; flat ones go to the nearer neighbour (the lower of equals), and lines at most near rows apart are one."""
    lines = [list(r) for r in runs((im == 255).any(axis=1))]
    k = 0
    while k < len(lines) and len(lines) > 1:
        a, b = lines[k]
        if b - a + 1 > strip:
            k += 1
            continue
        down = k == 0 or (k < len(lines) - 1 and lines[k + 1][0] - b <= a - lines[k - 1][1])
        if down:
            lines[k + 1][0] = a
        else:
            lines[k - 1][1] = b
        del lines[k]
    out: list[list[int]] = []
    for a, b in lines:
        if out and a - out[-1][1] - 1 <= near:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def alike(a: np.ndarray, b: np.ndarray, lines: Spans, share: float, mask: np.ndarray | None = None) -> bool:
    """Whether in each line, without its outer rows, a and b have pixels in common and at most share of that number apart."""
    for first, last in lines:
        rows = slice(first + 1, max(last - 1, first + 1))
        x, y = a[rows] == 255, b[rows] == 255
        if mask is not None:
            on = mask[rows] == 255
            x, y = x & on, y & on
        common = int((x & y).sum())
        if not common or max(int((x & ~y).sum()), int((y & ~x).sum())) / common > share:
            return False
    return True


@dataclass
class View:
    """What is compared of a frame, or of several: text mask, edges, levels (None: any)."""

    im: np.ndarray
    edges: np.ndarray
    levels: np.ndarray | None = None

    def masked(self) -> np.ndarray:
        return self.im if self.levels is None else within(self.im, self.levels)


def same_text(a: View, b: View, before: np.ndarray | None, p: Params) -> bool:
    """Whether two views show the same text: edges alike (a's, or those before), and levels alike where both have them."""
    both = np.where(b.masked() == 255, 255, a.masked())
    lines = lines_of(both, p.strip)
    if not lines:
        return False
    own = before is None or before is a.edges
    if not alike(a.edges, b.edges, lines, p.edge_change, both) and (own or not alike(before, b.edges, lines, p.edge_change, both)):
        return False
    if a.levels is None or b.levels is None:
        return True
    one = within(a.masked(), a.edges)
    if not own:
        one = within(one, before)
    two = dilated(within(one, same_level(a.levels, b.levels, p)), 1)
    return alike(within(within(two, one), b.edges), one, lines, p.level_change)


def only_lines(im: np.ndarray, edges: np.ndarray, lines: Spans, p: Params) -> np.ndarray:
    im = im.copy()
    while lines:
        before = im.copy()
        if keep_lines(im, edges, lines, p):
            drop_small(im, p)
        if (im == before).all():
            break
    for a, b in lines_of(im, p.strip):
        if not dense_line(im[a : b + 1], p):
            im[a : b + 1] = 0
    return im


def same_after_all(a: View, b: View, before: np.ndarray | None, p: Params) -> bool:
    """same_text, and if not, once more with what isn't clearly text left out."""
    if same_text(a, b, before, p):
        return True
    lines = lines_of(np.where(b.im == 255, 255, a.im), p.strip)
    return same_text(View(only_lines(a.masked(), a.edges, lines, p), a.edges, a.levels), View(only_lines(b.masked(), b.edges, lines, p), b.edges, b.levels), before, p)
