import datetime
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import decode, merge
from reelquery.sources import files, pictures
from reelquery.streaming import timeline


@pytest.mark.parametrize("name, want", [("001234", [1234]), ("001234_001250", [1234, 1250]), ("132_932_0", None), ("abc", None), ("1234_", None), ("_1234", None), ("12.3", None)])
def test_name_times(spark, name, want):
    assert spark.range(1).select(files.name_times(F.lit(name)).alias("t")).first()["t"] == want


def test_list_frames(spark, tmp_path):
    for n in ("2000.png", "500_900.JPG", "bad.png", "1.txt"):
        (tmp_path / n).write_bytes(b"x")
    with pytest.warns(UserWarning, match="^1 files"):
        got = files.list_frames(spark, str(tmp_path)).collect()
    assert sorted(r.times for r in got) == [[500, 900], [2000]]
    with pytest.raises(Exception, match="no times"):
        files.list_frames(spark, str(tmp_path), "error").collect()
    assert files.list_frames(spark, str(tmp_path / "none")).count() == 0


def test_json(spark, tmp_path):
    seg = {"text": " a ", "start_ms": 1, "end_ms": 2, "text_confidence": 0.5}
    for name, body in {"bare": [seg], "wrapped": {"segments": [seg]}, "result": {"meta": {}, "result": {"segments": [seg]}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        (r,) = files.read_segments(spark, str(tmp_path / f"{name}.json")).collect()
        assert (r.text, r.end_ms, r.adjusted_confidence) == (" a ", 2, None)
    (tmp_path / "frames.json").write_text(json.dumps({"frames": [{"text": "x"}]}))
    (f,) = files.read_frames(spark, str(tmp_path / "frames.json")).collect()
    assert (f.timestamp, f.y_range, f.boxes) == (0, [0, 0], [])
    (tmp_path / "gt.json").write_text(json.dumps({"result": {"text": "", "segments": [{"text": " a ", "start": 1, "end": 2}, {"text": "b", "start": 1}]}}))
    (t,) = files.read_timeline(spark, str(tmp_path / "gt.json")).collect()
    assert tuple(t)[1:] == (0, "a", 1, 2)
    (tmp_path / "two").mkdir()
    for i in range(2):
        (tmp_path / "two" / f"{i}.json").write_text(json.dumps({"segments": [seg, seg | {"text": f"{i}"}]}))
    both = files.read_segments(spark, str(tmp_path / "two")).collect()
    assert sorted((r.file[-6:], r.seg_idx, r.text) for r in both) == [("0.json", 0, " a "), ("0.json", 1, "0"), ("1.json", 0, " a "), ("1.json", 1, "1")]


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(2, 3, None), (1, 2, "a")], "start_ms int, end_ms int, text string")
    files.write_json(df, str(tmp_path / "j"))
    lines = sorted("".join(p.read_text() for p in (tmp_path / "j").glob("part*")).split())
    assert lines == ['{"start_ms":1,"end_ms":2,"text":"a"}', '{"start_ms":2,"end_ms":3}']
    files.write_timeline(df, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1,2", "2,3"]


def filtered_png(pixels, kind):
    """A PNG whose rows all have one kind of filter, made from its definition."""
    h, w = pixels.shape[:2]
    rows = pixels[:, :, ::-1].reshape(h, -1).astype(int)
    out = b""
    for y in range(h):
        line = []
        for i in range(w * 3):
            a, b, c = (rows[y, i - 3] if i > 2 else 0), (rows[y - 1, i] if y else 0), (rows[y - 1, i - 3] if y and i > 2 else 0)
            paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))  # noqa: B023
            line.append((rows[y, i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return pictures.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_pictures():
    r = np.random.default_rng(1)
    for h, w in ((1, 1), (5, 7), (8, 3)):
        x = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (pictures.decoded(pictures.encoded(x)) == x).all()
        assert (pictures.decoded(pictures.encoded(x[:, :, 0])) == x[:, :, :1]).all()
        for kind in range(5):
            assert (pictures.decoded(filtered_png(x, kind)) == x).all()
        pad = -w * 3 % 4
        body = b"".join(row.tobytes() + b"\0" * pad for row in x[::-1])
        assert (pictures.decoded(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0) + body) == x).all()
    for bad in (b"", b"x", pictures.PNG, pictures.PNG + b"\0" * 30, b"BM"):
        with pytest.raises(ValueError):
            pictures.decoded(bad)


def test_keyframes_are_written_and_read(spark, tmp_path):
    r = np.random.default_rng(2)
    x, m = r.integers(0, 256, (2, 4, 6, 3)).astype(np.uint8), r.integers(0, 2, (2, 4, 6)).astype(np.uint8)
    df = spark.createDataFrame([(500 * i, 500 * i + 400, 4, 6, bytearray(x[i].tobytes()), bytearray(np.packbits(m[i]).tobytes())) for i in range(2)], "start_ms bigint, end_ms bigint, height int, width int, bgr binary, mask binary")
    assert files.write_keyframes(df, str(tmp_path / "k")).count() == 4
    for folder, want in (("frames", x), ("mask", np.repeat(m[..., None], 3, -1) * 255)):
        got = sorted(files.load_keyframes(spark, str(tmp_path / "k" / folder)).collect())
        assert [(g.start_ms, g.end_ms, bytes(g.bgr)) for g in got] == [(500 * i, 500 * i + 400, want[i].tobytes()) for i in range(2)]
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "k" / "keyframes.json")).select("start_ms", "end_ms", "image").collect()) == [(0, 400, "0_400.png"), (500, 900, "500_900.png")]
    assert files.write_keyframes(df, str(tmp_path / "t"), "timeline").count() == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "t" / "timeline.txt")).collect()] == ["0,400", "500,900"] and not (tmp_path / "t" / "frames").exists()
    (tmp_path / "k" / "frames" / "1_2.png").write_bytes(b"no picture")
    assert files.load_keyframes(spark, str(tmp_path / "k" / "frames")).filter("bgr is null").count() == 1


def test_vocabulary(spark, tmp_path):
    for body in ('["a", "b"]', "a\nb\n"):
        (tmp_path / "v").write_text(body)
        assert [tuple(r) for r in files.read_vocabulary(spark, str(tmp_path / "v")).orderBy("token_id").collect()] == [(0, "a"), (1, "b")]


def test_names(spark):
    df = spark.createDataFrame([("p_a",), ("p_b",), ("b",), ("c",)], "name string")
    assert [tuple(r) for r in files.stripped_names(df, "p_").collect()] == [("p_a", "a")]


def test_model_is_loaded_once_a_worker(spark):
    def load():
        return lambda content: [{"text": t, "text_confidence": 0.9, "box_confidence": 0.9, "bbox": [[0.0, 0.0]] * 4, "x_range": [0.0, 1.0], "y_range": [0.0, 1.0], "center": [0.5, 0.5]} for t in content.decode().split(",")]

    df = spark.createDataFrame([("p", [1], bytearray(b"a, ,b"))], "path string, times array<bigint>, content binary")
    assert [b["text"] for b in decode.recognise(df, load).first()["boxes"]] == ["a", "b"]


def test_stream_is_the_fold(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("a", 1, 0.9), ("a", 500, 0.8), ("", 900, 0.0), ("a", 1200, 0.7), ("b", 1700, 0.5), ("", 2000, 0.0), ("c", 9000, 0.4)]
    data = [(1, t, x, c, [0.0, 1.0], base + datetime.timedelta(milliseconds=t)) for x, t, c in rows]
    schema = "video_id bigint, timestamp bigint, text string, text_confidence double, y_range array<double>, seen timestamp"
    batch = spark.createDataFrame(data, schema)
    want = [(s["text"], s["start_ms"], s["end_ms"], s["frame_count"]) for s in merge.fold_runs(batch).first()["segments"]]
    src = tmp_path / "in"
    # Three files, in order, then a late frame of another video that moves the watermark on.
    late = spark.createDataFrame([(2, 1, "z", 0.0, [0.0, 1.0], base + datetime.timedelta(hours=1))], schema)
    parts = [batch.filter("timestamp < 800"), batch.filter("timestamp between 800 and 1999"), batch.filter("timestamp >= 2000"), late, late.withColumn("seen", F.expr("seen + interval 1 hour"))]
    for name, f in (("runs", timeline.stream_runs), ("counts", timeline.stream_counts), ("sessions", timeline.stream_sessions)):
        folder = src / name
        folder.mkdir(parents=True)
        q = f(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("memory").queryName(f"t_{name}").option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        try:
            for p in parts:
                p.coalesce(1).write.mode("append").parquet(str(folder))
                q.processAllAvailable()
        finally:
            q.stop()
    got = [(r.text, r.start_ms, r.end_ms, r.frame_count) for r in spark.sql("select * from t_runs where video_id = 1 order by start_ms").collect()]
    assert got == want
    assert spark.sql("select sum(frames) n, sum(with_text) w from t_counts where video_id = 1").first() == (7, 5)
    assert [r.frames for r in spark.sql("select * from t_sessions where video_id = 1 order by start").collect()] == [4, 1]
