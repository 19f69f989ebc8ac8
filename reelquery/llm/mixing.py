"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import fresh, id_text, spool, table, unit

#: Target weight of a source: its bytes to this power, scaled to a sum of 1.
ALPHA = 0.5
#: Bytes of the mixture against bytes of the input.
SIZE = 1.0
SEED = "mix-1"


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = SIZE, alpha: float = ALPHA) -> DataFrame:
    """source, rate (mean repetitions of a document) and cdf (Poisson probabilities of at most 0, 1, ... repetitions).

    Bytes are summed over all documents. A source without bytes, or without a target weight, has rate 0.
    A null source is a source of its own; in weights its name is ''.
    """
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*[F.lit(x) for kv in (weights or {"": 0.0}).items() for x in kv])
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("w", weight)
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("w"))).alias("all_w"))
    rate = F.when((F.col("bytes") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_bytes") * F.lit(size) / F.col("bytes")).otherwise(F.lit(0.0))
    # Far enough into the tail that no number below 1 - 2^-52 lies beyond it.
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    start = F.struct((-F.col("rate")).alias("logp"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(s, k):
        logp = s["logp"] + F.log(F.col("rate")) - F.log(k.cast("double"))
        return F.struct(logp.alias("logp"), (s["sum"] + F.exp(logp)).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + F.exp(logp))).alias("cdf"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["cdf"])).otherwise(F.array(F.lit(1.0)))
    return sizes.crossJoin(total).withColumn("rate", rate).select("source", "rate", cdf.alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, size: float = SIZE, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """Each document as often as a Poisson number says, in a global random order.

    The number comes from inverting the Poisson distribution of the source's rate at a number
    hashed from seed and doc_id. Columns: those of docs, mix_copy (1, 2, ...) and mix_key, a
    random 52-bit position; the result is range-partitioned and sorted by mix_key. A document
    with number 0 doesn't appear. Rows with equal doc_id get equal numbers; a null doc_id counts
    as the text 'null'. Null and empty texts have no bytes but repeat at their source's rate.
    Ties in mix_key are in no defined order. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    r = spool(rates(docs, weights, size, alpha), "rates")
    src, rate, cdf, copy, key = (fresh(docs, c) for c in ("mix_source", "mix_rate", "mix_cdf", "mix_copy", "mix_key"))
    r = r.toDF(src, rate, cdf)
    ident = id_text(F.col("doc_id"))
    u = unit(F.concat(F.lit(f"{seed}:"), ident))
    n = F.size(F.filter(F.col(cdf), lambda c: c <= u))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = (
        docs.join(r, docs["source"].eqNullSafe(r[src]))
        .withColumn(copy, n)
        .filter(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
        .withColumn(key, F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.col(copy).cast("string"))), 1, 13), 16, 10).cast("bigint"))
        .drop(src, rate, cdf)
    )
    return out.repartitionById(parts, F.floor(F.col(key) / float(1 << 52) * parts).cast("int")).sortWithinPartitions(key)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH sizes AS (
  SELECT source, sum(strlen(text))::DOUBLE AS bytes, pow(sum(strlen(text))::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source
), rates AS (
  SELECT source, w / sum(w) OVER () * sum(bytes) OVER () * {SIZE} / bytes AS rate FROM sizes
), probs AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM rates, range(0, 200) AS r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM probs
), lists AS (
  SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), counted AS (
  SELECT d.*, len(list_filter(l.cs, lambda c: c <= ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT / {float(1 << 52)})) AS n
  FROM documents d JOIN lists l USING (source)
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS mix_copy FROM counted
)
SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || mix_copy), 1, 13))::BIGINT AS mix_key FROM copies
"""
