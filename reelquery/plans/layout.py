"""Queries over regions, texts in them, and widgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators import layout
from reelquery.plans.registry import registry
from reelquery.sources.adapters import IMAGES_SQL, images, table

QUERIES, ORACLES, query = registry()
TOTAL = 100_000.0

LAYOUT_SQL = """
regions AS (SELECT p_partkey % 20 AS img_id, p_partkey AS id, (p_partkey * 37) % 900 AS x, (p_partkey * 53) % 500 AS y, 2 + p_size * 4 AS w, 2 + p_partkey % 60 AS h, (2 + p_size * 4) * (2 + p_partkey % 60) AS pixel_count, p_name AS label,
            ((2 + p_size * 4) * (2 + p_partkey % 60))::DOUBLE / 100000 AS area_ratio FROM part),
texts AS (SELECT c_custkey % 20 AS img_id, c_custkey AS idx, c_mktsegment AS text, (c_custkey * 41 % 1000)::DOUBLE AS x0, (c_custkey * 41 % 1000)::DOUBLE + c_custkey % 7 AS x1, (c_custkey * 29 % 560) + 0.5::DOUBLE AS y0, (c_custkey * 29 % 560) + 12.25::DOUBLE AS y1,
          (c_custkey * 41 % 1000) + (c_custkey % 7) / 2.0::DOUBLE AS cx, (c_custkey * 29 % 560) + 6.375::DOUBLE AS cy FROM customer)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = 2 + F.col("p_size") * 4, 2 + k % 60
    return table(spark, sf_dir, "part").select((k % 20).alias("img_id"), k.alias("id"), (k * 37 % 900).alias("x"), (k * 53 % 500).alias("y"), w.cast("bigint").alias("w"), h.alias("h"), (w * h).cast("bigint").alias("pixel_count"), F.col("p_name").alias("label"), ((w * h).cast("double") / TOTAL).alias("area_ratio"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 41 % 1000).cast("double"), (k * 29 % 560).cast("double")
    return table(spark, sf_dir, "customer").select((k % 20).alias("img_id"), k.alias("idx"), F.col("c_mktsegment").alias("text"), x.alias("x0"), (x + k % 7).alias("x1"), (y + 0.5).alias("y0"), (y + 12.25).alias("y1"), (x + (k % 7) / 2).alias("cx"), (y + 6.375).alias("cy"))


_IN = "t.img_id = r.img_id AND t.cx >= r.x AND t.cx < r.x + r.w AND t.cy >= r.y AND t.cy < r.y + r.h"


@query(f"WITH {LAYOUT_SQL} SELECT img_id, id, pixel_count FROM regions WHERE pixel_count < 3000 * 0.9 AND w >= 3 AND h >= 3")
def layout_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.foreground(regions(spark, sf_dir), 3000.0).select("img_id", "id", "pixel_count")


@query(f"WITH {LAYOUT_SQL} SELECT r.img_id, r.id, coalesce(string_agg(t.text, ' ' ORDER BY t.cx, t.idx) FILTER (WHERE t.idx IS NOT NULL), '') AS label FROM regions r LEFT JOIN texts t ON {_IN} GROUP BY r.img_id, r.id")
def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.labelled(regions(spark, sf_dir).drop("label"), texts(spark, sf_dir)).select("img_id", "id", "label")


@query(f"WITH {LAYOUT_SQL} SELECT img_id, idx, text AS label, floor(x0)::BIGINT AS x, floor(y0)::BIGINT AS y, ceil(x1 - x0)::BIGINT AS w, ceil(y1 - y0)::BIGINT AS h FROM texts t WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE {_IN}) AND ceil(x1 - x0) > 0 AND ceil(y1 - y0) > 0")
def layout_free_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unabsorbed(regions(spark, sf_dir), texts(spark, sf_dir))


@query(f"WITH {LAYOUT_SQL} SELECT img_id, label, area_ratio, (row_number() OVER (PARTITION BY img_id ORDER BY area_ratio DESC, id) - 1)::INT AS id FROM regions")
def layout_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.numbered(regions(spark, sf_dir)).select("img_id", "label", "area_ratio", "id")


@query(f"WITH {LAYOUT_SQL} SELECT img_id, id, row_number() OVER (PARTITION BY img_id ORDER BY pixel_count DESC, id)::INT AS rank FROM regions QUALIFY rank <= 5")
def layout_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant_colors(regions(spark, sf_dir), 5).select("img_id", "id", "rank")


@query(rf"""WITH {LAYOUT_SQL}, t AS (SELECT *, CASE WHEN lower(label) = 'ring' THEN 0 WHEN regexp_matches(lower(label), '(^|[^0-9a-z_])ring($|[^0-9a-z_])') THEN 1 WHEN contains(lower(label), 'ring') THEN 2 END AS tier FROM regions)
SELECT img_id, id, label FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY tier, CASE WHEN tier = 0 THEN 0.0 ELSE area_ratio END, id) = 1""")
def widget_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.find_by_label(regions(spark, sf_dir), "Ring").select("img_id", "id", "label")


@query(f"""WITH {LAYOUT_SQL}, l AS (SELECT img_id, id, area_ratio, CASE WHEN id % 7 = 3 THEN 'Re-load ' || id WHEN id % 3 = 0 THEN 'Load ' || (id * 7) || ' x' WHEN id % 3 = 1 THEN 'none' ELSE 'Count: -' || id END AS label FROM regions),
w AS (SELECT *, CASE WHEN contains(lower(label), 'load') OR contains(lower(label), 'count') THEN try_cast(regexp_extract(label, '(-[0-9]*|[0-9]+)', 1) AS INT) END AS part FROM l)
SELECT img_id, arg_max(part, area_ratio * 1000000 - id / 1000000) FILTER (WHERE part IS NOT NULL) AS value FROM w GROUP BY img_id""")
def widget_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    label = F.when(i % 7 == 3, F.concat(F.lit("Re-load "), i.cast("string"))).when(i % 3 == 0, F.concat(F.lit("Load "), (i * 7).cast("string"), F.lit(" x"))).when(i % 3 == 1, "none").otherwise(F.concat(F.lit("Count: -"), i.cast("string")))
    return layout.read_count(regions(spark, sf_dir).withColumn("label", label))


@query(f"WITH {LAYOUT_SQL} SELECT img_id, id, x + w // 2 AS cx, y + h // 2 AS cy, (pixel_count % 256 >> 4 << 4)::INT AS q FROM regions")
def widget_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = layout.center_of(*[F.col(n) for n in "xywh"])
    return regions(spark, sf_dir).select("img_id", "id", c["x"].alias("cx"), c["y"].alias("cy"), layout.quantized((F.col("pixel_count") % 256).cast("int")).alias("q"))


@query()
def layout_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy, with containers that grow; the tests hold it against a plain loop."""
    r = regions(spark, sf_dir)
    return layout.into_containers(r.withColumns({c: F.pmod("id", F.lit(251)) for c in "rgb"}))


@query(f"""WITH {IMAGES_SQL}, px AS (SELECT img_id, unnest(range(0, 64)) AS i, unnest(v) AS v FROM images), t AS (SELECT i // 8 - 2 AS ty, i % 8 - 3 AS tx, v AS tv FROM px WHERE img_id = 7 AND i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN 3 AND 5),
s AS (SELECT img_id, i // 8 - ty AS oy, i % 8 - tx AS ox, sum((v - tv) * (v - tv)) AS ssd, count(*) AS n FROM px, t GROUP BY img_id, i // 8 - ty, i % 8 - tx)
SELECT img_id, (ox * 8)::BIGINT AS x, (oy * 8)::BIGINT AS y FROM s WHERE n = 9 AND oy BETWEEN 0 AND 5 AND ox BETWEEN 0 AND 5 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY ssd, oy, ox) = 1""")
def window_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images(spark, sf_dir).select("img_id", F.posexplode("v").alias("i", "v")).select("img_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")
    t = p.filter("img_id = 7 and y between 2 and 4 and x between 3 and 5").select((F.col("y") - 2).alias("y"), (F.col("x") - 3).alias("x"), "v")
    return layout.window_offset(p, t).select("img_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
