"""Shards of balanced bytes for indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import spool, table

SHARDS = 64
#: Groups that one task differences, and partial partitions that one later task combines.
LEAF = 10_000
FAN_IN = 1_000


def differencing(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) for partial partitions, given as rows of sums in descending order.

    The two with the largest spread (maximum less minimum; ties: the earlier row, then the
    earlier made) are combined again and again, the largest sum of one with the smallest of
    the other. places[i, j] is the final shard of sum j of row i; sums are in descending order.
    """
    n, k = parts.shape
    sums = list(parts)
    heap = [(-int(r[0] - r[-1]), i) for i, r in enumerate(parts)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        made.append((a, b, order))
        sums[a] = sums[b] = None
        sums.append(both)
        heapq.heapreplace(heap, (-int(both[0] - both[-1]), len(sums) - 1))
    places = [None] * len(sums)
    places[-1] = np.arange(k)
    for m in range(len(made) - 1, -1, -1):
        a, b, order = made[m]
        at = np.empty(k, np.int64)
        at[order] = places[n + m]
        places[n + m] = None
        places[a], places[b] = at, at[::-1]
    return np.stack(places[:n]) if n else np.empty((0, k), np.int64), sums[-1]


def _combine(fan_in: int, shards: int):
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        places, sums = differencing(np.stack(pdf["sums"].to_numpy()))
        n = len(pdf)
        return pd.DataFrame({"node": pdf["node"], "parent": pdf["node"] // fan_in, "places": list(places.astype(np.int32)), "sums": [sums] * n})

    return combine


def _leaf(shards: int):
    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "a", "b"], ascending=[False, True, True])
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        places, sums = differencing(parts)
        out = pdf[["a", "b", "node"]].assign(bin=places[:, 0].astype(np.int32), sums=None)
        out["sums"] = [sums if i == 0 else None for i in range(len(out))]
        return out

    return leaf


def assign_shards(docs: DataFrame, shards: int = SHARDS, group: str | None = None, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, bytes, group_key, shard (0 to shards - 1) for every row of docs; no group is split.

    A group is all rows with the same value of the column group, or, without one, the same
    text; its size is its UTF-8 bytes. Groups are hashed into leaves of about leaf groups;
    each is differenced to one partial partition, and those are differenced fan_in at a time
    until one is left. A null group, or null text, is a group too; null texts have 0 bytes.
    Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    value = F.col("text" if group is None else group)
    rows = spool(
        docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b")),
        "rows",
    )
    groups = spool(rows.groupBy("a", "b").agg(F.sum("bytes").alias("bytes")), "groups")
    nodes = max(1, -(-groups.count() // leaf))
    done = spool(
        groups.withColumn("node", F.pmod("a", F.lit(nodes)))
        .groupBy("node")
        .applyInPandas(_leaf(shards), "a bigint, b bigint, node bigint, bin int, sums array<bigint>"),
        "leaves",
    )
    levels, level = [], done.filter(F.col("sums").isNotNull()).select("node", "sums")
    while True:
        up = level.withColumn("parent", F.expr(f"node div {fan_in}")).groupBy("parent").applyInPandas(_combine(fan_in, shards), "node bigint, parent bigint, places array<int>, sums array<bigint>")
        up = spool(up, "level")
        levels.append(up)
        nodes = -(-nodes // fan_in)
        if nodes == 1:
            break
        level = up.groupBy("parent").agg(F.first("sums").alias("sums")).select(F.col("parent").alias("node"), "sums")
    # From the root down: places of a node's sums among the shards.
    final = levels[-1].select("node", "places")
    for lower in reversed(levels[:-1]):
        top = final.select(F.col("node").alias("parent"), F.col("places").alias("above"))
        final = lower.join(top, "parent").select("node", F.transform("places", lambda p: F.element_at("above", p + 1)).alias("places"))
    final = spool(final, "places")
    placed = done.join(final, "node").select("a", "b", F.element_at("places", F.col("bin") + 1).alias("shard"))
    return rows.join(placed, ["a", "b"]).select("doc_id", "bytes", F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")).alias("group_key"), "shard")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
