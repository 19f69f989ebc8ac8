"""Queries over small images, and decoding of class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators import decode, pixels
from reelquery.plans.registry import registry
from reelquery.sources.adapters import IMAGES_SQL, images, table

QUERIES, ORACLES, query = registry()
W = 8

PAIRS_SQL = f"""
{IMAGES_SQL},
masks AS (SELECT img_id, v, list_transform(v, lambda x: CASE WHEN x > 140 THEN 255 WHEN x > 120 THEN x ELSE 0 END) AS m FROM images),
pairs AS (SELECT a.img_id, a.v AS av, b.v AS bv, a.m AS am, b.m AS bm FROM masks a JOIN masks b ON b.img_id = a.img_id + 1)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumn("m", F.transform("v", lambda x: F.when(x > 140, 255).when(x > 120, x).otherwise(0)))


def _flat(df: DataFrame, *names: str) -> DataFrame:
    return df.select("img_id", *[F.array_join(n, ",").alias(n) for n in names])


def _sql(source: str, **lists: str) -> str:
    return f"WITH {source} SELECT img_id, " + ", ".join(f"array_to_string({x}, ',') AS {n}" for n, x in lists.items())


_zip = "list_transform(range(1, 65), lambda i: {})"


@query(
    _sql(
        PAIRS_SQL,
        either=_zip.format("CASE WHEN bm[i] = 255 THEN 255 ELSE am[i] END"),
        filled=_zip.format("CASE WHEN am[i] = 0 AND bm[i] <> 0 THEN 255 ELSE am[i] END"),
        both=_zip.format("CASE WHEN bm[i] = 0 THEN 0 ELSE am[i] END"),
        level=_zip.format("CASE WHEN av[i] <> 0 AND (bv[i] < av[i] - 20 OR bv[i] > av[i] + 40) THEN 0 ELSE av[i] END"),
    )
    + " FROM pairs"
)
def mask_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir)
    a, b = m.select("img_id", F.col("v").alias("av"), F.col("m").alias("am")), m.select((F.col("img_id") - 1).alias("img_id"), F.col("v").alias("bv"), F.col("m").alias("bm"))
    p = a.join(b, "img_id")
    out = p.select("img_id", pixels.union(F.col("am"), F.col("bm")).alias("either"), pixels.combine(F.col("am"), F.col("bm")).alias("filled"), pixels.intersect(F.col("am"), F.col("bm")).alias("both"), pixels.intersect_levels(F.col("av"), F.col("bv")).alias("level"))
    return _flat(out, "either", "filled", "both", "level")


@query(
    f"""WITH {PAIRS_SQL}, px AS (SELECT img_id, unnest(range(1, 65)) AS i, unnest(m) AS x FROM masks),
w AS (SELECT img_id, i, x, min(CASE WHEN x = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY img_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS all_on, count(*) OVER (PARTITION BY i ORDER BY img_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS seen FROM px)
SELECT img_id, string_agg(CASE WHEN all_on = 0 THEN 0 ELSE x END, ',' ORDER BY i) AS common, min(seen)::INT AS seen FROM w GROUP BY img_id"""
)
def mask_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks(spark, sf_dir).withColumn("video_id", F.lit(0))
    return pixels.intersect_window(m, 6, order="img_id", value="m").select("img_id", F.array_join("common", ",").alias("common"), "seen")


@query(
    _sql(
        IMAGES_SQL,
        binary="list_transform(v, lambda x: CASE WHEN x < floor(list_max(v) * 0.6) THEN 0 ELSE 255 END)",
        cut="list_transform(v, lambda x: CASE WHEN x < 130 THEN 0 ELSE x END)",
        framed=_zip.format("CASE WHEN (i - 1) % 8 BETWEEN 1 AND 6 AND (i - 1) // 8 BETWEEN 1 AND 6 THEN v[i] ELSE 0 END"),
    ).replace("binary", '"binary"')
    + " FROM images"
)
def image_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    out = images(spark, sf_dir).select("img_id", pixels.moderate_threshold(v, 0.6).alias("binary"), pixels.zero_below(v, 130).alias("cut"), pixels.border_clear(v, W, W).alias("framed"))
    return _flat(out, "binary", "cut", "framed")


def _stencil(r: int, inner: str) -> str:
    lo, hi = r, 7 - r
    return _zip.format(f"CASE WHEN (i - 1) % 8 BETWEEN {lo} AND {hi} AND (i - 1) // 8 BETWEEN {lo} AND {hi} THEN {inner} ELSE 0 END")


def _kernel(rows: tuple, by: int) -> str:
    full = rows + rows[1::-1]
    terms = [f"{full[y + 2][x + 2]} * v[i + {8 * y + x}]" for y in range(-2, 3) for x in range(-2, 3) if full[y + 2][x + 2]]
    return f"({' + '.join(terms)}) // {by}"


_MAX = "greatest(abs(3 * (v[i-9] - v[i+9] + v[i-7] - v[i+7]) + 10 * (v[i-8] - v[i+8])), abs(3 * (v[i-9] - v[i+9] - v[i-7] + v[i+7]) + 10 * (v[i-1] - v[i+1])), abs(3 * (v[i-8] - v[i+8] + v[i-1] - v[i+1]) + 10 * (v[i-9] - v[i+9])), abs(3 * (v[i-8] - v[i+8] - v[i-1] + v[i+1]) + 10 * (v[i-7] - v[i+7])))"


@query(
    _sql(
        IMAGES_SQL,
        strongest=_stencil(1, _MAX),
        diagonal=_stencil(1, "abs(3 * (v[i-8] + v[i-1] - v[i+1] - v[i+8]) + 10 * (v[i-9] - v[i+9]))"),
        vertical=_stencil(1, "abs(3 * (v[i-9] + v[i-7] - v[i+7] - v[i+9]) + 10 * (v[i-8] - v[i+8]))"),
        smoothed=_stencil(2, _kernel(pixels.SMOOTH, 220)),
        spread=_stencil(2, f"CASE WHEN v[i] = 0 THEN 0 ELSE {_kernel(pixels.SPREAD, 100)} END"),
    )
    + " FROM images"
)
def image_stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    fs = {"strongest": pixels.sobel_max, "diagonal": pixels.sobel_diagonal, "vertical": pixels.sobel_vertical, "smoothed": pixels.smoothed, "spread": pixels.spread}
    return _flat(images(spark, sf_dir).select("img_id", *[pixels.on_images(f, W)(v).alias(n) for n, f in fs.items()]), *fs)


ON_SQL = f"{IMAGES_SQL}, bits AS (SELECT img_id, list_transform(v, lambda x: CASE WHEN x > 150 THEN 255 ELSE 0 END) AS m FROM images)"


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("img_id", F.transform("v", lambda x: F.when(x > 150, 255).otherwise(0)).alias("v"))


_NEAR = " OR ".join(f"((i - 1) % 8 + {x} BETWEEN 0 AND 7 AND (i - 1) // 8 + {y} BETWEEN 0 AND 7 AND m[i + {8 * y + x}] <> 0)" for y in (-1, 0, 1) for x in (-1, 0, 1))


@query(_sql(ON_SQL, wide=_zip.format(f"CASE WHEN {_NEAR} THEN 255 ELSE 0 END")) + " FROM bits")
def image_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_bits(spark, sf_dir).select("img_id", pixels.on_images(pixels.dilated, W)(F.col("v")).alias("wide")), "wide")


COMPONENTS_SQL = f"""
{ON_SQL}, px AS (SELECT img_id, i, (i // 8)::INT AS y, (i % 8)::INT AS x FROM (SELECT img_id, unnest(range(0, 64)) AS i, unnest(m) AS b FROM bits) WHERE b <> 0),
reach(img_id, i, o) AS (SELECT img_id, i, i FROM px UNION SELECT r.img_id, r.i, q.i FROM reach r JOIN px p ON p.img_id = r.img_id AND p.i = r.o JOIN px q ON q.img_id = p.img_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1),
roots AS (SELECT img_id, i, min(o) AS root FROM reach GROUP BY ALL),
labels AS (SELECT r.img_id, i, dense_rank() OVER (PARTITION BY r.img_id ORDER BY root)::INT AS component, y, x FROM roots r JOIN px USING (img_id, i)),
comp AS (SELECT img_id, component, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM labels GROUP BY ALL)"""


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT * FROM comp")
def image_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pixels.components(_bits(spark, sf_dir), W)
    return c.select("img_id", "component", "pixels", *[F.col(n).cast("int").alias(n) for n in ("x0", "y0", "x1", "y1")])


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT img_id, component FROM comp WHERE y1 - y0 + 1 < 2 OR x1 - x0 + 1 <= 1 OR y1 - y0 + 1 <= 1")
def image_small_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.small_symbols(pixels.components(_bits(spark, sf_dir), W), W, 0.25, 1).select("img_id", "component")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bits(spark, sf_dir).select("img_id", F.posexplode(pixels.on_images(pixels.component_labels, W)(F.col("v"))).alias("i", "component"))
    return rows.filter("component > 0").select("img_id", F.floor(F.col("i") / W).cast("int").alias("y"), (F.col("i") % W).alias("x"), "component")


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT img_id, y, x, component FROM labels WHERE (img_id, component) IN (SELECT img_id, component FROM labels WHERE (y + x) % 5 = 0)")
def image_components_in_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _labels(spark, sf_dir)
    return pixels.components_in_mask(p, p.filter((F.col("y") + F.col("x")) % 5 == 0)).select("img_id", "y", "x", "component")


@query(f"""WITH {ON_SQL}, px AS (SELECT img_id, unnest(range(0, 64)) AS i, unnest(m) AS v FROM bits), p AS (SELECT img_id, (i // 8)::INT AS y, (i % 8)::INT AS x, v, i % 8 = 3 AND v > 0 AS t FROM px),
r AS (SELECT DISTINCT img_id, y FROM p WHERE t) SELECT img_id, y, x, v FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.img_id = p.img_id AND abs(r.y - p.y) <= 1)""")
def image_rows_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bits(spark, sf_dir).select("img_id", F.posexplode("v").alias("i", "v")).select("img_id", F.floor(F.col("i") / W).cast("int").alias("y"), (F.col("i") % W).alias("x"), "v", ((F.col("i") % W == 3) & (F.col("v") > 0)).alias("is_text"))
    return pixels.near_text_rows(p, 1).select("img_id", "y", "x", "v")


@query(f"""WITH {ON_SQL}, rows AS (SELECT img_id, y, 8 AS height FROM (SELECT img_id, unnest(range(0, 64)) // 8 AS y, unnest(m) AS v FROM bits) GROUP BY img_id, y HAVING sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) >= 2),
g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY img_id ORDER BY y) - 1 >= 2 OR lag(y) OVER (PARTITION BY img_id ORDER BY y) IS NULL THEN 1 ELSE 0 END AS n FROM rows),
b AS (SELECT img_id, y, sum(n) OVER (PARTITION BY img_id ORDER BY y) AS band FROM g), s AS (SELECT img_id, band, greatest(min(y) - 1, 0)::INT AS lb, max(y) AS last FROM b GROUP BY ALL)
SELECT img_id, lb, least(last + 1, 7)::INT AS le FROM s WHERE last - lb >= 1""")
def image_row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _bits(spark, sf_dir).select("img_id", F.posexplode("v").alias("i", "v")).groupBy("img_id", F.floor(F.col("i") / W).cast("int").alias("y")).agg(F.count_if(F.col("v") > 0).alias("n"))
    return pixels.row_bands(p.filter("n >= 2").select("img_id", "y", F.lit(W).alias("height")), 1, 1)


@query(f"""WITH {IMAGES_SQL}, px AS (SELECT img_id, unnest(range(0, 64)) AS i, unnest(v) AS v FROM images)
SELECT img_id, (i // 8 // 2)::INT AS y, (i % 8 // 2)::INT AS x, floor(0.299::DOUBLE * v + 0.587::DOUBLE * (255 - v) + 0.114::DOUBLE * (v // 2))::INT AS v FROM px WHERE (i // 8) % 2 = 0 AND (i % 8) % 2 = 0""")
def image_gray_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = images(spark, sf_dir).select("img_id", F.posexplode("v").alias("i", "r"))
    return pixels.gray_small(p.select("img_id", F.floor(F.col("i") / W).cast("int").alias("y"), (F.col("i") % W).alias("x"), "r", (255 - F.col("r")).alias("g"), F.floor(F.col("r") / 2).alias("b")), 2)


_VOCAB = ["<blank>", "a", "b", "c", "d", "e"]


@query(
    "WITH s AS (SELECT vec_id AS id, i AS step, embedding[i * 8 + 1 : i * 8 + 8] AS l FROM embeddings, range(0, 8) r(i)), b AS (SELECT id, step, list_max(l)::DOUBLE AS score, list_position(l, list_max(l)) - 1 AS cls FROM s), "
    "k AS (SELECT *, lag(cls) OVER (PARTITION BY id ORDER BY step) AS p FROM b), n AS (SELECT *, cls <> 0 AND (p IS NULL OR p <> cls) AND cls < 6 AS keep FROM k) "
    f"SELECT id, coalesce(string_agg({_VOCAB}[cls + 1], '' ORDER BY step) FILTER (WHERE keep), '') AS text, round(coalesce(avg(score) FILTER (WHERE keep), 0.0), 7) AS confidence FROM n GROUP BY id"
)
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))).alias("step", "logits"))
    vocabulary = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in _VOCAB])).alias("token_id", "token"))
    return decode.ctc_decode(e.withColumn("logits", F.col("logits").cast("array<double>")), vocabulary).select("id", "text", F.round("confidence", 7).alias("confidence"))


@query("WITH p AS (SELECT vec_id AS img_id, unnest(list_transform(embedding, lambda x: least(abs(x::DOUBLE) * 4, 1.0))) AS p FROM embeddings) SELECT img_id, least(floor(p * 10), 10)::INT AS bin, count(*) AS n FROM p GROUP BY ALL")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.transform("embedding", lambda x: F.least(F.abs(x.cast("double")) * 4, F.lit(1.0))).alias("scores"))
    return decode.score_histogram(m)


@query("SELECT vec_id AS img_id, 0.5 + embedding[2]::DOUBLE * 3 > 0.9 AS turn FROM embeddings")
def turned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(F.slice("embedding", 1, 2), lambda x: 0.5 + x.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), decode.needs_turn(p).alias("turn"))
