"""The engine's records from general tables: frames from events, boxes from lineitem, timelines from orders, images from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOX = "struct<text:string,text_confidence:double,box_confidence:double,bbox:array<array<double>>,x_range:array<double>,y_range:array<double>,center:array<double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, timestamp, text, text_confidence, x_range, y_range: a user's events, two a second; errors are frames without text."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    blank = F.col("event_type") == "error"
    zero = F.array(F.lit(0.0), F.lit(0.0))
    return e.select(
        F.col("user_id").alias("video_id"),
        (n * 500).cast("bigint").alias("timestamp"),
        F.when(blank, "").otherwise(F.col("event_type")).alias("text"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("text_confidence"),
        F.when(blank, zero).otherwise(F.array(F.lit(100.0), F.lit(300.0))).alias("x_range"),
        F.when(blank, zero).otherwise(F.array(600 + k, 630 + k)).alias("y_range"),
    )


FRAMES_SQL = """
frames AS (
  SELECT user_id AS video_id, 500 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS timestamp,
         CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS text, least(value / 500, 1.0) AS text_confidence,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE 600 + coalesce((props->>'$.k')::DOUBLE, 0) END AS y0,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE 630 + coalesce((props->>'$.k')::DOUBLE, 0) END AS y1
  FROM events)"""


#: An order of the line items of an order; line numbers repeat.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def box_columns() -> dict[str, Column]:
    """Box geometry of a line item, in multiples of a half."""
    low = F.col("l_linenumber") == 6
    return {
        "video_id": F.col("l_orderkey") % 20,
        "timestamp": F.col("l_orderkey") * 500,
        # By the columns that name a frame, so that frames can be made of boxes where these are.
        "box_idx": F.row_number().over(Window.partitionBy("video_id", "timestamp").orderBy(*LINE)),
        "text": F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat("l_returnflag", "l_linestatus")),
        "text_confidence": 1 - F.col("l_discount") * 3,
        "box_confidence": 1 - F.col("l_tax") * 4,
        "cx": (600 + F.col("l_partkey") % 80).cast("double"),
        "top": (640 - F.when(low, 200).otherwise(0) + F.col("l_suppkey") % 7).cast("double"),
        "height": (30 + F.col("l_quantity").cast("bigint") % 12).cast("double"),
        "width": (200 + F.col("l_partkey") % 50 * 2).cast("double"),
    }


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, timestamp, box_idx and the columns of a box."""
    columns = box_columns()
    named = {n: columns.pop(n) for n in ("video_id", "timestamp")}
    flat = table(spark, sf_dir, "lineitem").withColumns(named).select(*named, *[c.alias(n) for n, c in columns.items()])
    left, right, top, bottom = F.col("cx") - F.col("width") / 2, F.col("cx") + F.col("width") / 2, F.col("top"), F.col("top") + F.col("height")
    return flat.select(
        "video_id",
        "timestamp",
        "box_idx",
        "text",
        "text_confidence",
        "box_confidence",
        F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom)).alias("bbox"),
        F.array(left, right).alias("x_range"),
        F.array(top, bottom).alias("y_range"),
        F.array(F.col("cx"), (top + bottom) / 2).alias("center"),
    )


BOXES_SQL = f"""
boxes AS (
  SELECT *, cx - width / 2 AS x0, cx + width / 2 AS x1, top AS y0, top + height AS y1, (top + top + height) / 2 AS cy FROM (
    SELECT l_orderkey % 20 AS video_id, l_orderkey * 500 AS timestamp, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}))::INT AS box_idx,
           CASE WHEN l_linenumber = 7 THEN ' ' ELSE l_returnflag || l_linestatus END AS text,
           1 - l_discount * 3 AS text_confidence, 1 - l_tax * 4 AS box_confidence,
           (600 + l_partkey % 80)::DOUBLE AS cx,
           (640 - CASE WHEN l_linenumber = 6 THEN 200 ELSE 0 END + l_suppkey % 7)::DOUBLE AS top,
           (30 + l_quantity::BIGINT % 12)::DOUBLE AS height, (200 + l_partkey % 50 * 2)::DOUBLE AS width
    FROM lineitem))"""


def frames_of(boxes: DataFrame, kept: Column | None = None, *more: Column) -> DataFrame:
    """video_id, timestamp, boxes: the boxes of each frame as one array, by box_idx, or those that are kept; more: aggregates over all boxes of the frame."""
    names = ["box_idx", *[f.split(":")[0] for f in ("text", "text_confidence", "box_confidence", "bbox", "x_range", "y_range", "center")]]
    box = F.struct(*names)
    rows = boxes.groupBy("video_id", "timestamp").agg(F.sort_array(F.collect_list(box if kept is None else F.when(kept, box))).alias("boxes"), *more)
    return rows.withColumn("boxes", F.transform("boxes", lambda b: F.struct(*[b[n].alias(n) for n in names[1:]])))


def timelines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(reference, hypothesis): video_id, idx, text, start, end. The hypothesis is shifted, some segments have no length, some are gone."""
    o = table(spark, sf_dir, "orders").withColumn("idx", F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")) - 1)
    video, start = (F.col("o_custkey") % 50).alias("video_id"), F.col("idx") * 2000
    length = 800 + F.col("o_orderkey") % 1500
    ref = o.select(video, "idx", F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("text"), start.cast("bigint").alias("start"), (start + length).cast("bigint").alias("end"))
    moved = start + F.col("o_orderkey") % 700
    hyp = o.filter("o_orderkey % 11 <> 0").select(
        video,
        "idx",
        F.concat("o_orderpriority", F.lit("."), "o_orderstatus").alias("text"),
        moved.cast("bigint").alias("start"),
        (moved + F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(length - F.col("o_orderkey") % 300)).cast("bigint").alias("end"),
    )
    return ref, hyp


TIMELINES_SQL = """
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS idx FROM orders),
ref AS (SELECT o_custkey % 50 AS video_id, idx, o_orderpriority || ' ' || o_orderstatus AS text, idx * 2000 AS s, idx * 2000 + 800 + o_orderkey % 1500 AS e FROM o),
hyp AS (SELECT o_custkey % 50 AS video_id, idx, o_orderpriority || '.' || o_orderstatus AS text, idx * 2000 + o_orderkey % 700 AS s,
        idx * 2000 + o_orderkey % 700 + CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 800 + o_orderkey % 1500 - o_orderkey % 300 END AS e
        FROM o WHERE o_orderkey % 11 <> 0)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, v: 64 grey values 0 to 255 of an image of 8 by 8."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("img_id"), F.transform("embedding", lambda x: F.least(F.greatest(F.floor(128 + x.cast("double") * 400), F.lit(0)), F.lit(255)).cast("int")).alias("v"))


IMAGES_SQL = """
images AS (SELECT vec_id AS img_id, list_transform(embedding, lambda x: least(greatest(floor(128 + x::DOUBLE * 400), 0), 255)::INT) AS v FROM embeddings)"""
