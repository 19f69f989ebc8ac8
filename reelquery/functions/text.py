"""Text functions as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "。，！？、；：“”‘’「」【】《》（）.,!?;:'\"()[]{}　…—～~-"
DIGITS = "0-9零一二两三四五六七八九十百千万亿"


def normalize(s: Column) -> Column:
    """s without white space, of Unicode's kinds too."""
    return F.regexp_replace(s, r"(?U)\s", "")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: a column of the table is two integers of len(a) bits, and a step to the next a few operations on them."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        equal = at.get(c, 0)
        kept = (((equal & up) + up) ^ up) | equal | down
        more, less = down | full & ~(kept | up), kept & up
        score += bool(more & top) - bool(less & top)
        more = more << 1 | 1
        up, down = full & (less << 1 | ~(kept | more)), full & more & kept
    return score


#: Columns of the table that are taken at once, and classes of characters that are counted.
BLOCK, CLASSES = 512, 32


def _at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the distance of texts with these counts of characters: what one has too many of goes by a step each."""
    d = a - b
    over = np.maximum(d, 0).sum(-1)
    return np.maximum(over, over - d.sum(-1))


def long_distance(a: str, b: str) -> int:
    """bit_distance for texts of millions of characters that are much alike.

    The cells about the best one of each column give a way. If it is as short as the counts
    of characters allow, it is the distance. Else only those cells of the table are filled
    whose way there and least way on, by the counts of characters that are left, are within a
    limit; what it has above the least distance is doubled until the end is within it or the
    way is known to be the shortest. So the result is exact, but where the way is longer than
    the counts allow, the cost is at worst the square of the length, as with bit_distance.
    """
    if min(len(a), len(b)) <= 2 * BLOCK:
        return bit_distance(a, b)
    codes = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b)]
    counts = sum(np.bincount(c, minlength=0x110000) for c in codes)
    kind = np.full(len(counts), CLASSES - 1, np.uint8)
    common = np.argsort(-counts, kind="stable")[: CLASSES - 1]
    kind[common] = np.arange(len(common))
    kinds = [kind[c] for c in codes]
    least = int(_at_least(*[np.bincount(k, minlength=CLASSES) for k in kinds]))
    way, more = _distance_within(a, b, codes[0], *kinds, None), 0
    while least + more < way:
        found = _distance_within(a, b, codes[0], *kinds, least + more)
        if found is not None:
            return found
        more = more * 2 or 32
    found = _distance_within(a, b, codes[0], *kinds, way - 1) if way > least else None
    return way if found is None else found


def _distance_within(a: str, b: str, code: np.ndarray, ka: np.ndarray, kb: np.ndarray, limit: int | None) -> int | None:
    """The distance, or None if it's over limit. The rows of a from low to high are kept, as the value at low and the steps from there.

    A way that leaves the rows of a block passes its last row; if that has a cell within the
    limit, the block is done again with more rows. Without limit, the length of a way in the
    rows about the best ones, of equals the first.
    """
    one = np.eye(CLASSES, dtype=np.int32)
    left_a, left_b = np.bincount(ka, minlength=CLASSES), np.bincount(kb, minlength=CLASSES)
    low = high = base = up = down = 0
    for i in range(0, len(b), BLOCK):
        part = b[i : i + BLOCK]
        rest_b = left_b - np.cumsum(one[kb[i : i + BLOCK]], 0)
        rows_b = np.vstack([left_b, rest_b])
        reach = BLOCK
        while True:
            reach *= 2
            last = min(len(a), high + reach)
            n = last - low
            u, d = up | ((1 << n) - (1 << high - low)), down
            window = code[low:last]
            at = {c: int.from_bytes(np.packbits(window == ord(c), bitorder="little").tobytes(), "little") for c in set(part)}
            full, top = (1 << n) - 1, 1 << n >> 1
            score = base + u.bit_count() - d.bit_count()
            bottom = [score]
            for c in part:
                equal = at[c]
                kept = (((equal & u) + u) ^ u) | equal | d
                more, less = d | full & ~(kept | u), kept & u
                score += bool(more & top) - bool(less & top) if n else 1
                bottom.append(score)
                more = more << 1 | 1
                u, d = full & (less << 1 | ~(kept | more)), full & more & kept
            rows_a = np.vstack([left_a, left_a - np.cumsum(one[ka[low:last]], 0)])
            if limit is None or last == len(a) or (np.array(bottom) + _at_least(rows_a[-1], rows_b)).min() > limit:
                break
        bits = [np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64) for x in (u, d)]
        value = base + len(part) + np.append(0, np.cumsum(bits[0] - bits[1]))
        whole = value + _at_least(rows_a, rows_b[-1])
        if limit is None:
            best = int(whole.argmin())
            first, final = max(0, best - BLOCK), min(n, best + BLOCK)
        else:
            within = np.flatnonzero(whole <= limit)
            if not len(within):
                return None
            first, final = int(within[0]), int(within[-1])
        base, left_a, left_b = int(value[first]), rows_a[first], rows_b[-1]
        mask = (1 << final - first) - 1
        up, down = u >> first & mask, d >> first & mask
        low, high = low + first, low + final
    end = base + up.bit_count() - down.bit_count()
    return end + len(a) - high if limit is None else end if high == len(a) else None


def edit_distance_long(a: Column, b: Column) -> Column:
    """edit_distance for texts of thousands of characters and more; the built-in one takes a step for each pair of characters."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else long_distance(x, y) for x, y in zip(a, b)], dtype="Int32")

    return run(a, b)


def is_substring_of(a: Column, b: Column) -> Column:
    """Whether the shorter, in bytes, is in the longer; false for empty texts or equal lengths."""
    la, lb = F.octet_length(a), F.octet_length(b)
    return F.when((la == 0) | (lb == 0) | (la == lb), F.lit(False)).when(la < lb, F.contains(b, a)).otherwise(F.contains(a, b))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by the length of the reference, counted as 1 at least."""
    return (F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))).cast("double")


def normalize_for_cer(s: Column) -> Column:
    """One spelling of the word for master, no white space or punctuation, each run of digits as #."""
    unified = normalize(F.replace(s, F.lit("师父"), F.lit("师傅")))
    bare = F.translate(unified, PUNCTUATION, "")
    return F.regexp_replace(bare, f"[{DIGITS}]+", "#")


def url_decode(s: Column) -> Column:
    """Percent escapes decoded, + and bad escapes kept; bytes that aren't UTF-8 become U+FFFD."""
    return F.url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def contains_word(text: Column, word: Column) -> Column:
    """Whether word stands in text with no ASCII letter, digit or _ beside it."""
    quoted = F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), word, F.lit(r"\E(?![0-9A-Za-z_])"))
    return F.rlike(text, quoted)


def first_int(s: Column) -> Column:
    """The number at the first digit or minus sign; null if there is none, if no digit follows the sign, or if it's too large."""
    return F.regexp_extract(s, "(-[0-9]*|[0-9]+)", 1).try_cast("int")
