"""Fingerprints by quartile bucket digests, and their bounded difference."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import spool, table
from reelquery.llm.pieces import chunks

BUCKETS = 128
#: Offsets of the byte triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
WINDOW = 5
#: The greatest difference score.
BOUND = 300
#: The greatest score of near digests; one block of codes more than that.
NEAR = 10


def bucket_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the hashed triplets by text and bucket, UTF-8 bytes of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    n = len(b) - WINDOW + 1
    if n <= 0:
        return counts.reshape(-1, BUCKETS), size
    text = np.repeat(np.arange(len(texts)), size)
    whole = text[:n] == text[WINDOW - 1 :]
    at = text[:n] * BUCKETS
    for k, (i, j, m) in enumerate(TRIPLETS):
        h = ((b[i : i + n] << np.uint32(16)) | (b[j : j + n] << np.uint32(8)) | b[m : m + n]) * np.uint32(0x9E3779B1)
        h += np.uint32(k * 0x61C88647 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        counts += np.bincount((at + (h >> np.uint32(25)))[whole], minlength=len(counts))
    return counts.reshape(-1, BUCKETS), size


def encode(counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes 0 to 3 by text and bucket, header bytes length and ratios).

    A bucket's code is the number of the quartiles of the text's own counts below its
    count. length is the logarithm of the bytes to base 1.1, 255 at most; ratios holds 15
    times the first and the second quartile over the third, each in four bits.
    """
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
    length = np.minimum(255, np.round(np.log(np.maximum(size, 1)) / math.log(1.1))).astype(np.int64)
    third = np.maximum(q[:, 2], 1)
    ratios = (15 * q[:, 0] // third) * 16 + 15 * q[:, 1] // third
    return codes, np.stack([length, ratios], axis=1)


def to_text(codes: np.ndarray, header: np.ndarray) -> list[str]:
    """68 hexadecimal digits: length, ratios, the high bits of the 128 codes, the low bits."""
    planes = np.packbits(np.stack([codes >> 1, codes & 1], axis=1), axis=2).reshape(len(codes), -1)
    return [bytes(r).hex() for r in np.concatenate([header.astype(np.uint8), planes], axis=1)]


def _number(digest: Column, at: int, digits: int) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("int")


def _plane(digest: Column, at: int) -> list[Column]:
    """64 of a plane's bits as a signed number, twice."""
    return [F.conv(F.substring(digest, at + 16 * k, 16), 16, -10).cast("bigint") for k in range(2)]


def difference(a: Column, b: Column, bound: int = BOUND) -> Column:
    """The difference score of two digests, from 0 (equal) to bound; null if either is null.

    A bucket adds the difference of its codes, but 6 for codes 0 and 3. The lengths add
    their difference up to 1, and 12 for each step beyond; each ratio (on a circle of 16) the
    same. Whatever exceeds bound is bound.
    """

    def steps(d: Column) -> Column:
        return F.when(d <= 1, d).otherwise((d - 1) * 12)

    def circle(d: Column) -> Column:
        return F.least(d, F.lit(16) - d)

    total = steps(F.abs(_number(a, 1, 2) - _number(b, 1, 2)))
    for at in (3, 4):
        total = total + steps(circle(F.abs(_number(a, at, 1) - _number(b, at, 1))))
    for ah, bh, al, bl in zip(_plane(a, 5), _plane(b, 5), _plane(a, 37), _plane(b, 37)):
        x, y = ah.bitwiseXOR(bh), al.bitwiseXOR(bl)
        both, crossed = x.bitwiseAND(y), ah.bitwiseXOR(al)
        ones = F.bit_count(y) - F.bit_count(both) + F.bit_count(both.bitwiseAND(crossed))
        total = total + ones + 2 * (F.bit_count(x) - F.bit_count(both)) + 6 * F.bit_count(both.bitwiseAND(F.bitwise_not(crossed)))
    return F.least(total, F.lit(bound)).cast("int")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, digest, profile_score for every row of docs.

    The digest is of the whole text. profile_score is its difference from the digest of all
    texts of the same lang together: small for usual texts, large for odd ones; two documents'
    digests are compared by difference(). Null texts have null n_bytes, digest and score;
    texts under five bytes have no triplet and so no digest. A null lang is a language.
    Equal texts have equal digests; repeated rows give repeated results.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            langs = batch.column(1).to_pylist()
            for a, b, texts in chunks(batch.column(2)):
                counts, size = bucket_counts([t or "" for t in texts])
                out = to_text(*encode(counts, size))
                for i in range(a, b):
                    if langs[i] not in sums:
                        sums[langs[i]] = np.zeros(BUCKETS + 1, np.int64)
                    sums[langs[i]][:BUCKETS] += counts[i - a]
                    sums[langs[i]][BUCKETS] += size[i - a]
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n),
                        batch.column(1).slice(a, n).cast(pa.string()),
                        pa.array([None if texts[i] is None else int(size[i]) for i in range(n)], pa.int64()),
                        pa.array([out[i] if size[i] >= WINDOW else None for i in range(n)], pa.string()),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "lang", "n_bytes", "digest", "counts"],
                )
        if sums:
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array(list(sums), pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["doc_id", "lang", "n_bytes", "digest", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = spool(docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, n_bytes bigint, digest string, counts array<bigint>"), "digests")
    # As many rows as there are languages and buckets.
    sums = both.filter(F.col("counts").isNotNull()).select("lang", F.posexplode("counts").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    profiles: dict[str | None, np.ndarray] = {}
    for r in sums:
        profiles.setdefault(r["lang"], np.zeros(BUCKETS + 1, np.int64))[r["bucket"]] = r["n"]
    rows = [(lang, to_text(*encode(c[None, :BUCKETS], c[BUCKETS:]))[0]) for lang, c in profiles.items() if c[:BUCKETS].any()]
    profile = spool(spark.createDataFrame(rows, "name string, profile string"), "profiles")
    # A language's length says nothing of a text's, so the profile takes on the text's.
    mine = F.concat(F.substring("digest", 1, 2), F.substring("profile", 3, 66))
    return (
        both.filter(F.col("counts").isNull())
        .join(profile, F.col("lang").eqNullSafe(F.col("name")), "left")
        .select("doc_id", "lang", "n_bytes", "digest", difference(F.col("digest"), mine).alias("profile_score"))
    )


def _parts(bound: int) -> np.ndarray:
    """Masks (bytes of a plane) of bound + 1 blocks of codes: two digests with a score of at most bound are equal in one."""
    of = np.arange(BUCKETS) % (bound + 1)
    return np.packbits(of[None, :] == np.arange(bound + 1)[:, None], axis=1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """difference() of digests as rows of 34 bytes, without its bound."""

    def steps(d: np.ndarray) -> np.ndarray:
        return np.where(d <= 1, d, (d - 1) * 12)

    def circle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = np.abs(x.astype(np.int64) - y)
        return np.minimum(d, 16 - d)

    total = steps(np.abs(a[:, 0].astype(np.int64) - b[:, 0]))
    total += steps(circle(a[:, 1] >> 4, b[:, 1] >> 4)) + steps(circle(a[:, 1] & 15, b[:, 1] & 15))
    x, y = a[:, 2:18] ^ b[:, 2:18], a[:, 18:] ^ b[:, 18:]
    both, crossed = x & y, a[:, 2:18] ^ a[:, 18:]
    # Both bits differ: 0 and 3 (6), or 1 and 2 (1).
    count = lambda z: np.bitwise_count(z).sum(1, dtype=np.int64)
    return total + count(y & ~both) + 2 * count(x & ~both) + count(both & crossed) + 6 * count(both & ~crossed)


def near_pairs(digests_: DataFrame, bound: int = NEAR) -> DataFrame:
    """a < b, score: the pairs of different digests with a score of at most bound, exact.

    A score of at most bound leaves one of bound + 1 blocks of codes equal, so digests are
    compared within a block's value, and there only where their lengths are near. A pair is
    given by the first block in which it is equal.
    """
    masks = _parts(bound)
    # A length further away than this scores more than bound.
    apart = bound // 12 + 1 if bound else 0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [bytes.fromhex(x) for x in batch.column(0).to_pylist()]
            if not raw:
                continue
            d = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            for part, m in enumerate(masks):
                own = np.concatenate([d[:, 2:18] & m, d[:, 18:] & m], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), part, np.int32)), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(raw, pa.binary())], ["part", "own", "digest"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() != key[0]:
                yield from compare(held)
                held = []
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from compare([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from compare(held)

    def compare(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([h.column(0).to_numpy() for h in held])
        part = np.concatenate([h.column(1).to_numpy() for h in held])
        d = np.frombuffer(b"".join(x for h in held for x in h.column(2).to_pylist()), np.uint8).reshape(len(key), -1)
        i, o = np.arange(len(key)), 0
        while len(i):
            o += 1
            i = i[i + o < len(key)]
            # Rows are sorted by key and digest, and so by length: what is too far once stays so.
            i = i[(key[i] == key[i + o]) & (d[i + o, 0].astype(np.int64) - d[i, 0] <= apart)]
            for at in range(0, len(i), 50_000):
                u = i[at : at + 50_000]
                v = u + o
                score = scores(d[u], d[v])
                hit = np.flatnonzero((score <= bound) & (score > 0) & (part[u] == part[v]))
                if not len(hit):
                    continue
                u, v, score = u[hit], v[hit], score[hit]
                differs = (d[u, 2:18] ^ d[v, 2:18]) | (d[u, 18:] ^ d[v, 18:])
                first = (~(differs[:, None, :] & masks[None]).any(2)).argmax(1)
                one = np.flatnonzero(first == part[u])
                yield pa.RecordBatch.from_arrays([pa.array([d[x].tobytes().hex() for x in u[one]], pa.string()), pa.array([d[x].tobytes().hex() for x in v[one]], pa.string()), pa.array(score[one].astype(np.int32))], ["a", "b", "score"])

    rows = digests_.filter(F.col("digest").isNotNull()).select("digest").distinct()
    rows = rows.mapInArrow(keys, "part int, own binary, digest binary").select(F.xxhash64("part", "own").alias("key"), "part", "digest")
    return rows.repartition("key").sortWithinPartitions("key", "part", "digest").mapInArrow(search, "a string, b string, score int")


def with_copies(rows: DataFrame, bound: int = NEAR) -> DataFrame:
    """The result of digests, and copies and near at the document with the least doc_id of each digest (elsewhere null).

    copies: the doc_ids with this digest, where there are several. near: the greater digests
    with a score of at most bound, and the score; their documents are in their own copies.
    """
    rows = spool(rows, "digests")
    same = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"), F.array_sort(F.collect_set("doc_id")).alias("ids"))
    near = near_pairs(rows, bound).groupBy(F.col("a").alias("digest")).agg(F.array_sort(F.collect_list(F.struct(F.col("b").alias("digest"), "score"))).alias("near"))
    lists = same.join(near, "digest", "left").select(F.col("digest").alias("d"), "rep", F.when(F.size("ids") > 1, F.col("ids")).alias("copies"), "near")
    lists = lists.filter(F.col("copies").isNotNull() | F.col("near").isNotNull())
    return rows.join(lists, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left").drop("d", "rep")


def op6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_copies(digests(table(spark, sf_dir, "documents")))
