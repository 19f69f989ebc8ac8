"""Digests one triplet at a time."""

from reelquery.llm import digests


def plain_digest(text):
    b = text.encode()
    counts = [0] * digests.BUCKETS
    for w in range(len(b) - 4):
        for k, (i, j, m) in enumerate(digests.TRIPLETS):
            h = ((b[w + i] << 16 | b[w + j] << 8 | b[w + m]) * 0x9E3779B1 + k * 0x61C88647) % 2**32
            h ^= h >> 15
            counts[(h * 0x85EBCA6B) % 2**32 >> 25] += 1
    return counts


def plain_difference(a, b):
    steps = lambda d: d if d <= 1 else (d - 1) * 12
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    total = steps(abs(x[0] - y[0]))
    for s in (4, 0):
        d = abs((x[1] >> s & 15) - (y[1] >> s & 15))
        total += steps(min(d, 16 - d))
    code = lambda z: [(z[2 + i // 8] >> 7 - i % 8 & 1) * 2 + (z[18 + i // 8] >> 7 - i % 8 & 1) for i in range(128)]
    total += sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(code(x), code(y)))
    return min(total, digests.BOUND)
