"""Reading frames, segments and timelines from files, and writing them."""

from __future__ import annotations

import os
import re
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.sources import pictures
from reelquery.sources.adapters import BOX

FRAME_JSON = f"text string, text_confidence double, x_range array<double>, y_range array<double>, timestamp bigint, boxes array<{BOX}>"
SEGMENT_JSON = "text string, start_ms bigint, end_ms bigint, y_range array<double>, text_confidence double, frame_count int, adjusted_confidence double, y_penalty double, iso_penalty double"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def name_times(name: Column) -> Column:
    """[ms] or [start, end] of a file name of one or two numbers, else null."""
    one, two = F.regexp_extract(name, "^([0-9]+)(?:_([0-9]+))?$", 1), F.regexp_extract(name, "^([0-9]+)(?:_([0-9]+))?$", 2)
    a, b = one.try_cast("bigint"), two.try_cast("bigint")
    return F.when(a.isNotNull() & (two == ""), F.array(a)).when(a.isNotNull() & b.isNotNull(), F.array(a, b))


def list_frames(spark: SparkSession, folder: str, on_bad: str = "warn") -> DataFrame:
    """path, times, content of the images in a folder, in no order: sort what is made of them, not their bytes.

    on_bad: warn says how many files have names without times and leaves them out, error fails on them. No folder: no rows.
    """
    if "://" not in folder and not os.path.isdir(folder):
        return spark.createDataFrame([], "path string, times array<bigint>, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}").load(folder)
    named = files.select("path", name_times(stem(F.col("path"))).alias("times"), "content")
    if on_bad == "error":
        return named.withColumn("times", F.coalesce("times", F.raise_error(F.concat(F.lit("no times in the name "), "path")).cast("array<bigint>")))
    if bad := named.filter(F.col("times").isNull()).select("path").count():  # reads no contents
        warnings.warn(f"{bad} files in {folder} have no times in their names", stacklevel=2)
    return named.filter(F.col("times").isNotNull())


def load_images(files: DataFrame) -> DataFrame:
    """The columns of files but content, and height, width, bgr (bytes by row, column, channel). What can't be decoded has nulls."""
    rest = [c for c in files.columns if c != "content"]

    def run(batches):
        for batch in batches:
            out = {"height": [], "width": [], "bgr": []}
            for data in batch.column(batch.schema.get_field_index("content")).to_pylist():
                try:
                    image = pictures.decoded(data or b"")
                    row = (*image.shape[:2], image.tobytes())
                except ValueError:
                    row = (None, None, None)
                for k, v in zip(out, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(out["height"], pa.int32()), pa.array(out["width"], pa.int32()), pa.array(out["bgr"], pa.binary())], [*rest, *out])

    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest)
    return files.mapInArrow(run, f"{schema}, height int, width int, bgr binary")


def load_keyframes(spark: SparkSession, folder: str, on_bad: str = "warn") -> DataFrame:
    """start_ms, end_ms, height, width, bgr of a folder of keyframes, named start_end; a name of one time is a keyframe of no length."""
    shot = load_images(list_frames(spark, folder, on_bad))
    return shot.select(F.element_at("times", 1).alias("start_ms"), F.element_at("times", -1).alias("end_ms"), "height", "width", "bgr")


def frame_time(n: Column, position: Column, fps: Column) -> Column:
    """Milliseconds of frame n: the container's, or by the frame rate, or by 30 a second."""
    return F.when(position > 0, F.round(position)).when(fps > 0, F.round(n * 1000 / fps)).otherwise(F.floor(n * 1000 / 30)).cast("bigint")


def sampled(frames: DataFrame, source_fps: float, fps: float) -> DataFrame:
    """Every step-th of frames (n, ...), with the time of each; step is the rounded ratio of the rates."""
    step = max(1, int(source_fps / fps + 0.5))
    return frames.filter(F.pmod("n", F.lit(step)) == 0).withColumn("timestamp", F.round(F.col("n") / source_fps * 1000).cast("bigint"))


def _rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """file, pos and the objects of a JSON array, or of the arrays field or result.field of an object, for each file, read once."""
    array = f"array<struct<{_typed(schema)}>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    held = F.from_json("value", f"struct<{field}:{array},result:struct<{field}:{array}>>")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", array)).otherwise(F.coalesce(held[field], held["result"][field]))
    return whole.select("file", F.posexplode(rows).alias("pos", "r")).select("file", "pos", "r.*")


def _typed(schema: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2: ", schema)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a JSON file, or of each in a folder, bare or wrapped, with file and pos; missing fields are defaults."""
    f = _rows(spark, path, "frames", FRAME_JSON)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    return f.select("file", "pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text_confidence", F.lit(0.0)).alias("text_confidence"), *[F.coalesce(c, zero).alias(c) for c in ("x_range", "y_range")], F.coalesce("timestamp", F.lit(0)).cast("bigint").alias("timestamp"), F.coalesce("boxes", F.array().cast(f"array<{BOX}>")).alias("boxes"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a JSON file, or of each in a folder: bare, in segments, or in result.segments; with file and seg_idx."""
    return _rows(spark, path, "segments", SEGMENT_JSON).withColumnRenamed("pos", "seg_idx")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """file, idx, text, start, end of result.segments; rows that lack one are left out."""
    rows = _rows(spark, path, "segments", "text string, start bigint, end bigint")
    return rows.dropna(subset=["text", "start", "end"]).select("file", F.col("pos").alias("idx"), F.trim("text").alias("text"), "start", "end")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; fields that are null are left out."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_timeline(keyframes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A text line start,end for each keyframe, by start."""
    keyframes.orderBy("start_ms", "end_ms").select(F.concat_ws(",", "start_ms", "end_ms").alias("value")).write.mode(mode).text(path)


#: What a mode of write_keyframes writes.
KEYFRAME_MODES = {"full": {"frames", "mask", "json", "timeline"}, "timeline": {"timeline"}, "frames": {"frames"}}


def write_keyframes(keyframes: DataFrame, folder: str, mode: str = "full") -> DataFrame:
    """Keyframes (start_ms, end_ms, height, width, bgr, mask of packed bits) as files in a folder that all workers share.

    full: frames/start_end.png, mask/start_end.png (white on black), timeline.txt and keyframes.json; timeline
    and frames: that alone. timeline.txt and keyframes.json are folders of parts. The result has a row for each picture: path.
    """
    parts = KEYFRAME_MODES[mode]
    made = {"frames": "frames", "mask": "mask"}
    for name in made.keys() & parts:
        os.makedirs(f"{folder}/{name}", exist_ok=True)

    def run(batches):
        for batch in batches:
            paths = []
            for r in batch.to_pylist():
                h, w, name = r["height"], r["width"], f"{r['start_ms']}_{r['end_ms']}.png"
                if "frames" in parts:
                    paths.append((f"{folder}/frames/{name}", np.frombuffer(r["bgr"], np.uint8).reshape(h, w, 3)))
                if "mask" in parts:
                    paths.append((f"{folder}/mask/{name}", np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=h * w).reshape(h, w) * 255))
            for path, pixels in paths:
                # A task that is tried again writes the same file.
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(pictures.encoded(pixels))
                os.replace(f"{path}.{os.getpid()}", path)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string())], ["path"])

    if "timeline" in parts:
        write_timeline(keyframes, f"{folder}/timeline.txt")
    name = F.concat_ws("_", "start_ms", "end_ms")
    if "json" in parts:
        write_json(keyframes.orderBy("start_ms", "end_ms").select("start_ms", "end_ms", F.concat(name, F.lit(".png")).alias("image"), F.concat(name, F.lit(".png")).alias("mask")), f"{folder}/keyframes.json")
    spark = keyframes.sparkSession
    if not made.keys() & parts:
        return spark.createDataFrame([], "path string")
    keyframes.select("start_ms", "end_ms", "height", "width", "bgr", "mask").mapInArrow(run, "path string").write.mode("overwrite").text(f"{folder}/pictures.txt")
    return spark.read.text(f"{folder}/pictures.txt").withColumnRenamed("value", "path")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token of a JSON array of strings, or of a text with one token a line."""
    whole = spark.read.text(path, wholetext=True).select("value", F.from_json("value", "array<string>").alias("list"))
    tokens = F.when(F.ltrim(F.col("value")).startswith("["), F.col("list")).otherwise(F.split(F.regexp_replace("value", r"\n$", ""), "\r?\n"))
    return whole.select(F.posexplode(tokens).alias("token_id", "token"))


def stripped_names(files: DataFrame, prefix: str) -> DataFrame:
    """name, new_name for files (name) that begin with prefix; those whose new name exists, or two of them want, are left out."""
    new = files.filter(F.startswith("name", F.lit(prefix))).select("name", F.substring("name", len(prefix) + 1, 100_000).alias("new_name")).filter("new_name <> ''")
    free = new.join(files.select(F.col("name").alias("new_name")), "new_name", "left_anti")
    return free.groupBy("new_name").agg(F.min("name").alias("name"), F.count("*").alias("n")).filter("n = 1").select("name", "new_name")
