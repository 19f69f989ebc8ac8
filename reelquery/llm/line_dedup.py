"""Lines that many sites share, found by distinct-site spread, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm.common import fresh, spool, table

#: Number of distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch; its standard error is 1.04 / sqrt(2^LG_K).
LG_K = 12
#: Estimates within this share of MIN_SITES are counted exactly; over 6 standard errors.
MARGIN = 0.1


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(lines, flagged). lines has one row for each document and line that isn't blank: id, site, k (128-bit key).
    flagged has the keys that occur on at least min_sites distinct sites, with keeper, the smallest id.

    HyperLogLog sketches of the sites are merged by aggregation. An estimate clear of the
    threshold decides by itself; a near one is replaced by an exact distinct count.
    """
    lines = spool(
        docs.select(F.col("doc_id").alias("id"), F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.trim("line") != "")
        .select("id", "site", _key(F.col("line")).alias("k")),
        "lines",
    )
    spread = spool(
        lines.groupBy("k")
        .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("id").alias("keeper"))
        .select("k", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN)),
        "spread",
    )
    near = F.col("sites") <= min_sites * (1 + MARGIN)
    exact = (
        lines.join(spread.filter(near).select("k"), "k", "left_semi")
        .groupBy("k")
        .agg(F.countDistinct("site").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    flagged = spread.filter(~near).select("k", "keeper").unionByName(spread.filter(near).join(exact, "k").select("k", "keeper"))
    return lines, spool(flagged, "flagged")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs without the lines that occur on at least min_sites distinct sources.

    Such a line stays in the document with the smallest doc_id that has it, so nothing is
    lost from the corpus. Columns: those of docs, text and n_chars without the lines, and
    lines_removed (with _ after it while docs has such a column). Null text stays null with 0 removed, and so do empty texts. A null source
    counts as no site. Blank lines are never removed. Rows with equal doc_id, or none, are
    one document for the rule of what stays. A text whose lines all go becomes ''.
    """
    lines, flagged = spread_lines(docs, min_sites)
    drop, ident = fresh(docs, "drop"), fresh(docs, "ident")
    gone = (
        lines.join(flagged, "k")
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id")
        .agg(F.collect_set("k").alias(drop))
        .withColumnRenamed("id", ident)
    )
    gone = spool(gone, "gone")
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone[ident]), "left").drop(ident)
    old = F.split("text", "\n")
    new = F.filter(old, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _key(x)))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(new, "\n"))
    removed = F.when(F.col(drop).isNull() | F.col("text").isNull(), F.lit(0)).otherwise(F.size(old) - F.size(new)).cast("bigint")
    out = joined.withColumns({fresh(docs, "lines_removed"): removed, "text": text})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return out.drop(drop)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), flagged AS (
  SELECT line, min(doc_id) AS keeper FROM lines WHERE trim(line) <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), gone AS (
  SELECT doc_id, list(DISTINCT line) AS drop FROM lines JOIN flagged USING (line) WHERE doc_id <> keeper GROUP BY doc_id
), cleaned AS (
  SELECT d.doc_id, d.lang, d.source, string_split(d.text, chr(10)) AS old, coalesce(g.drop, []) AS drop
  FROM documents d LEFT JOIN gone g USING (doc_id)
), texts AS (
  SELECT *, list_filter(old, lambda x: NOT list_contains(drop, x)) AS kept FROM cleaned
)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, lang, source,
       length(array_to_string(kept, chr(10)))::BIGINT AS n_chars, (len(old) - len(kept))::BIGINT AS lines_removed
FROM texts
"""
